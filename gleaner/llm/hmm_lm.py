"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by the scaled forward recursion.

Words are counted over all training texts. The most frequent ones are symbols of
their own, the others share symbols by their last two bytes. Inside a shared
symbol every training word has a probability per state: that of the counts times
the word's share of the state, from its own expected counts, backed off to the
shares of the symbol. So the model is a distribution over all texts: the hidden
chain emits a symbol, the state and the symbol a word, and one symbol ends the
text.

The parameters start from segments of a bounded sample, drawn by id, and are fitted
to them until the likelihood gains less than `WARM_GAIN` a token. Each iteration then
runs forward-backward over all training texts in their partitions, in segments of
`segment` tokens, and only expected counts by word leave a partition, summed before
and after the shuffle. Scores are computed over whole texts, without segments.

Texts are encoded once, in chunks of neighbouring texts that are written. A word
that a task cannot look up in the bounded dictionary of frequent ones is kept in the
list of its chunk, once however often the chunk has it. In an iteration the lists
travel to their words' buckets as packed blocks with the chunk's expected counts, are
summed there, and the totals travel back in the order of the list: no row per word,
no text, and no hot word, as each chunk sends a word at most once. Shares of the
states travel as 16-bit numbers, and sums are taken of those that come back, so
the words of a symbol still add up to it. What is trained does not depend on the bound of
the dictionary.

Edge cases: a null or empty text is the end token alone. A text of any length is
scored as a whole, in memory proportional to its tokens. A row without id is
held out. Repeated rows are scored each. Ties in frequency go to the smaller
word. Without training texts every token has the probability that smoothing
leaves, and the states are equal. An empty table gives no rows. Only id and text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import release, remainder
from gleaner.llm.tokens import slices
from gleaner.session import materialise, scratch_path

SMOOTHING = 0.1
TAIL_SYMBOLS = 64
FLUSH = 400_000
#: Codes from here on are written as this one and, in full, in a second list.
WIDE = 65_535
#: Occurrences that the shares of its symbol count for in a word's shares of the states.
BACKOFF = 1.0
#: The start ends when an iteration over its sample gains less than this, in log10 a token.
WARM_GAIN = 2e-4
#: A chunk is full with so many texts, or tokens.
CHUNK_TEXTS, CHUNK_TOKENS = 4000, 1_000_000
BUCKET_WORDS = 400_000  # words of chunks that a bucket gets, about
PIECE = 16_384  # dictionary codes that are summed together
ENCODED = "_chunk bigint, _meta binary, _syms binary, _wide binary, _words binary, _tails binary, _buckets binary, _times binary"
SENT = "_key int, _chunk bigint, _list binary, _times binary, _c binary"
SUMMED = "_key int, _chunk bigint, _n binary, _c binary"


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower changes A-Z only and bytes.split parts at exactly the blanks of the word rule."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tail_symbol(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_SYMBOLS


@dataclass(frozen=True)
class Vocabulary:
    """Symbols 0 to len(head) - 1 are words, then TAIL_SYMBOLS shared ones, then the end of a text."""

    head: dict[bytes, int]
    counts: dict[bytes, int]  # of the bounded dictionary, the head among them
    total: int
    distinct: int
    ends: int
    tail_total: tuple[int, ...]
    tail_distinct: tuple[int, ...]

    @property
    def symbols(self) -> int:
        return len(self.head) + TAIL_SYMBOLS + 1

    def base(self, count: float) -> float:
        return math.log10((count + SMOOTHING) / (self.total + SMOOTHING * (self.distinct + 1)))

    def inside(self, count: float, tail: int) -> float:
        """log10 probability of a word inside its shared symbol; one unseen word stands for all of them."""
        return math.log10((count + SMOOTHING) / (self.tail_total[tail] + SMOOTHING * (self.tail_distinct[tail] + 1)))

    def unigram(self) -> np.ndarray:
        """Share of each symbol in the training tokens, never 0."""
        head = [0] * len(self.head)
        for word, k in self.head.items():
            head[k] = self.counts[word]
        x = np.array([*head, *self.tail_total, self.ends], dtype=float) + SMOOTHING
        return x / x.sum()


def count_words(texts: DataFrame) -> DataFrame:
    """(_word, _count) of a frame with a column `_t`: counted per task, then summed."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        for frame in frames:
            for text in frame["_t"]:
                found.update(words_of(text))
                if len(found) > FLUSH:
                    yield pd.DataFrame({"_word": list(found), "_count": list(found.values())})
                    found = Counter()
        yield pd.DataFrame({"_word": list(found), "_count": list(found.values())})

    parts = texts.select("_t").mapInPandas(of, "_word binary, _count bigint")
    return parts.groupBy("_word").agg(F.sum("_count").alias("_count"))


def build_vocabulary(counts: DataFrame, ends: int, head_words: int, dictionary_words: int) -> Vocabulary:
    """`head_words` and `dictionary_words` bound what the driver and each task hold of the words."""
    # the least count at which the words still fit, from the number of words of each count
    many, least = 0, 0
    for r in counts.groupBy("_count").agg(F.count("*").alias("n")).orderBy(F.desc("_count")).limit(dictionary_words).collect():
        many += r["n"]
        if many > dictionary_words:
            break
        least = r["_count"]
    top = counts.filter(F.col("_count") >= (least or 1 << 62)).collect()
    known = {bytes(r["_word"]): r["_count"] for r in sorted(top, key=lambda r: (-r["_count"], bytes(r["_word"])))}
    head = {w: k for k, w in enumerate(list(known)[:head_words])}
    tail = F.crc32(F.substring("_word", -2, 2)) % TAIL_SYMBOLS
    sums = counts.groupBy(tail.cast("int").alias("k")).agg(F.sum("_count").alias("c"), F.count("*").alias("v")).collect()
    total, distinct = sum(r["c"] for r in sums) + ends, sum(r["v"] for r in sums) + (ends > 0)
    tail_total, tail_distinct = [0] * TAIL_SYMBOLS, [0] * TAIL_SYMBOLS
    for r in sums:
        tail_total[r["k"]], tail_distinct[r["k"]] = r["c"], r["v"]
    for w in head:
        tail_total[tail_symbol(w)] -= known[w]
        tail_distinct[tail_symbol(w)] -= 1
    return Vocabulary(head, known, total, distinct, ends, tuple(tail_total), tuple(tail_distinct))


def written(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Codes as two bytes each; those that need more follow in the second list, in order."""
    return np.minimum(codes, WIDE).astype("<u2").tobytes(), codes[codes >= WIDE].astype("<u4").tobytes()


def read(syms: bytes, wide: bytes) -> np.ndarray:
    """The codes that were written; the first ones if `syms` is cut."""
    codes = np.frombuffer(syms, dtype="<u2").astype(np.int64)
    places = np.flatnonzero(codes == WIDE)
    codes[places] = np.frombuffer(wide, dtype="<u4")[: len(places)]
    return codes


def encode(texts: DataFrame, vocabulary: Vocabulary, buckets: int) -> DataFrame:
    """Chunks of texts: ids and lengths, the codes of all texts end to end, and the words that the dictionary lacks.

    Codes are places in the dictionary, the head first, then one for the end of a text, then
    places in the chunk's list of words, which is ordered by bucket.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        get = {word: k for k, word in enumerate(v.counts)}.get
        end, number = len(v.counts), TaskContext.get().partitionId() << 32
        parts: list[pa.RecordBatch] = []
        codes: list[np.ndarray] = []
        own: dict[bytes, int] = {}
        times: list[int] = []
        tokens = 0

        def chunk() -> pa.RecordBatch:
            words = list(own)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), dtype=np.int64, count=len(words))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), dtype=np.int64)
            place[order] = np.arange(len(words))
            flat = np.concatenate(codes)
            local = flat > end
            flat[local] = end + 1 + place[flat[local] - end - 1]
            syms, wide = written(flat)
            meta = pa.Table.from_batches(parts).combine_chunks()
            zipped = lambda x: pa.compress(x, codec="zstd", asbytes=True) if x else b""
            sizes = lambda x: len(x).to_bytes(8, "little")
            blobs = [
                syms, wide, b" ".join(words[i] for i in order), bytes(tail_symbol(words[i]) for i in order),
                bucket[order].astype("<u4").tobytes(), np.array(times, dtype="<u4")[order].tobytes() if words else b"",
            ]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, meta.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(meta)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()]), *[pa.array([sizes(x) + zipped(x)], pa.binary()) for x in blobs]],
                names=[c.split()[0] for c in ENCODED.split(", ")],
            )

        for some in slices(rows, "_t"):
            lengths = []
            held = some.column("_held").to_pylist()
            for text, is_held in zip(some.column("_t").to_pylist(), held, strict=True):
                words = words_of(text)
                found = [get(w) for w in words]
                if None in found:
                    for k, w in enumerate(words):
                        if found[k] is None:
                            at = own.get(w)
                            if at is None:
                                at = own[w] = len(own)
                                times.append(0)
                            found[k] = end + 1 + at
                            times[at] += not is_held
                found.append(end)
                codes.append(np.array(found, dtype=np.int64))
                lengths.append(len(found))
            tokens += sum(lengths)
            parts.append(pa.RecordBatch.from_arrays([some.column("_id"), some.column("_held"), pa.array(lengths, pa.int64())], names=["id", "held", "n"]))
            if sum(map(len, parts)) >= CHUNK_TEXTS or tokens >= CHUNK_TOKENS:
                yield chunk()
                parts, codes, own, times, tokens, number = [], [], {}, [], 0, number + 1
        if parts:
            yield chunk()

    return texts.select("_id", "_held", "_t").mapInArrow(of, ENCODED)


def _blob(raw: bytes) -> bytes:
    size = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


class Chunk:
    """One row of `encode`, opened."""

    def __init__(self, row) -> None:
        self.number = row["_chunk"]
        meta = pa.ipc.open_stream(row["_meta"]).read_all()
        self.ids, self.held, n = meta.column("id").to_pylist(), meta.column("held").to_numpy(zero_copy_only=False), meta.column("n").to_numpy()
        self.ends = np.cumsum(n)
        self.codes = read(_blob(row["_syms"]), _blob(row["_wide"]))
        self.tails = np.frombuffer(_blob(row["_tails"]), dtype=np.uint8).astype(np.int64)
        self.buckets = np.frombuffer(_blob(row["_buckets"]), dtype="<u4").astype(np.int64)
        self.times = np.frombuffer(_blob(row["_times"]), dtype="<u4").astype(np.int64)

    def sequences(self, which: np.ndarray) -> list[np.ndarray]:
        starts = np.concatenate([[0], self.ends[:-1]])
        return [self.codes[a:b] for a, b, k in zip(starts, self.ends, which, strict=True) if k]

    def totals(self, replies, states: int) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the list's words, in all and by state, from the buckets' replies; 0 without any."""
        n, c = np.zeros(len(self.tails)), np.zeros((len(self.tails), states))
        for r in replies if replies is not None else []:
            a, b = np.searchsorted(self.buckets, [r["_key"], r["_key"] + 1])
            n[a:b] = np.frombuffer(r["_n"], dtype="<u4")
            if r["_c"]:
                c[a:b] = n[a:b, None] * _shares_read(r["_c"], states)
        return n, c


def _shares_written(counts: np.ndarray, n: np.ndarray) -> bytes:
    return np.rint(65_535 * np.clip(counts / np.maximum(n, 1e-300)[:, None], 0, 1)).astype("<u2").tobytes()


def _shares_read(raw: bytes, states: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2").reshape(-1, states) / 65_535.0


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # state
    move: np.ndarray  # state by next state
    emit: np.ndarray  # state by symbol


@dataclass(frozen=True)
class Lifts:
    """How much likelier each state makes a word than its symbol does: per symbol the states' shares and mean shares, and the
    lifts of the dictionary words behind the head."""

    shares: np.ndarray  # shared symbol by state
    means: np.ndarray  # shared symbol by state
    known: np.ndarray  # word by state

    def of(self, tails: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Lifts by word and state; the mean over a symbol's words, weighted by their probabilities, is 1 in each state."""
        return (counts + BACKOFF * self.shares[tails]) / (n[:, None] + BACKOFF) / self.means[tails]


def lifts_of(vocabulary: Vocabulary, counts: np.ndarray, rare: np.ndarray, rare_counts: np.ndarray, rare_other: np.ndarray) -> Lifts:
    """`counts` are those of the dictionary words behind the head; the words behind the dictionary come summed by symbol:
    expected counts, and the two parts of their weighted shares."""
    words = list(vocabulary.counts)[len(vocabulary.head) :]
    tails = np.array([tail_symbol(w) for w in words], dtype=np.int64)
    n = np.array([vocabulary.counts[w] for w in words], dtype=float)
    sums = rare.copy()
    np.add.at(sums, tails, counts)
    shares = (sums + SMOOTHING) / (sums + SMOOTHING).sum(axis=1, keepdims=True)
    weight = (n + SMOOTHING) / (n + BACKOFF)
    means = rare_counts + (rare_other[:, None] + SMOOTHING) * shares  # one unseen word has the shares of its symbol
    np.add.at(means, tails, weight[:, None] * (counts + BACKOFF * shares[tails]))
    means /= (np.array(vocabulary.tail_total) + SMOOTHING * (np.array(vocabulary.tail_distinct) + 1))[:, None]
    lifts = Lifts(shares, means, np.empty((0, sums.shape[1])))
    return Lifts(shares, means, lifts.of(tails, n, counts))


class Coded:
    """Emissions by code for one task: the dictionary's once, those of a chunk's own words per chunk."""

    def __init__(self, vocabulary: Vocabulary, model: Model, lifts: Lifts | None):
        self.model, self.lifts = model, lifts
        self.head, self.end = len(vocabulary.head), len(vocabulary.counts)
        tails = np.array([tail_symbol(w) for w in list(vocabulary.counts)[self.head :]], dtype=np.int64)
        known = model.emit.T[self.head + tails]
        self.emit = np.concatenate([model.emit.T[: self.head], known if lifts is None else known * lifts.known, model.emit.T[-1:]])

    def of(self, chunk: Chunk, n: np.ndarray, counts: np.ndarray) -> Model:
        """The model by code."""
        rare = self.model.emit.T[self.head + chunk.tails]
        if self.lifts is not None:
            rare = rare * self.lifts.of(chunk.tails, n, counts)
        return Model(self.model.start, self.model.move, np.concatenate([self.emit, rare]).T)


def with_totals(encoded: DataFrame, replies: DataFrame | None) -> DataFrame:
    """The chunks with `_replies`, what the buckets sent back for their lists."""
    if replies is None:
        return encoded.withColumn("_replies", F.lit(None).cast("array<struct<_key:int,_n:binary,_c:binary>>"))
    each = replies.filter("_chunk IS NOT NULL").groupBy("_chunk").agg(F.collect_list(F.struct("_key", "_n", "_c")).alias("_replies"))
    return encoded.join(each, "_chunk", "left")


def sent(chunks: DataFrame, vocabulary: Vocabulary, model: Model, lifts: Lifts | None, segment: int) -> DataFrame:
    """Expected counts of all training texts: blocks of each chunk's own words by bucket, and those of the dictionary, the
    starts and the moves in pieces under negative keys, summed over the chunks of a task."""
    shared, states = chunks.sparkSession.sparkContext.broadcast((vocabulary, model, lifts)), len(model.start)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coded, columns = Coded(*shared.value), [c.split()[0] for c in SENT.split(", ")]
        end = coded.end
        total = np.zeros((end + 2 + states, states))
        for frame in frames:
            for row in frame.to_dict("records"):
                chunk = Chunk(row)
                by_code = coded.of(chunk, *chunk.totals(row["_replies"], states))
                start, move, emit = expected_counts(by_code, chunk.sequences(~chunk.held), segment)
                total += np.concatenate([emit.T[: end + 1], start[None], move])
                words, counts, out = _blob(row["_words"]).split(b" "), emit.T[end + 1 :], []
                first = np.flatnonzero(np.diff(chunk.buckets, prepend=-1))
                for a, b in zip(first, np.append(first, len(chunk.buckets))[1:], strict=True):
                    out.append((
                        int(chunk.buckets[a]), chunk.number, b" ".join(words[a:b]), chunk.times[a:b].astype("<u4").tobytes(),
                        _shares_written(counts[a:b], chunk.times[a:b]),
                    ))
                if out:
                    yield pd.DataFrame(out, columns=columns)
        live = np.flatnonzero(total.any(axis=1))
        out = []
        for piece in np.unique(live // PIECE):
            at = live[live // PIECE == piece]
            out.append((-1 - int(piece), None, at.astype("<u4").tobytes(), None, total[at].astype("<f4").tobytes()))
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"_chunk": "Int64"})

    return chunks.mapInPandas(of, SENT)


def summed(blocks: DataFrame, states: int) -> DataFrame:
    """By key: of a bucket a reply for each chunk (count and shares of its words, in its order) and a row for each tail symbol's
    sums, of a piece its codes and sums. Rows that are no reply have no chunk."""

    def piece(key: int, frame: pd.DataFrame) -> list[tuple]:
        codes = np.concatenate([np.frombuffer(x, dtype="<u4") for x in frame["_list"]])
        values = np.concatenate([np.frombuffer(x, dtype="<f4").reshape(-1, states) for x in frame["_c"]]).astype(float)
        at, which = np.unique(codes, return_inverse=True)
        sums = np.stack([np.bincount(which, weights=values[:, s]) for s in range(states)], axis=1)
        return [(key, None, at.astype("<u4").tobytes(), sums.tobytes())]

    def bucket(key: int, frame: pd.DataFrame) -> list[tuple]:
        lists = [x.split(b" ") for x in frame["_list"]]
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(w, len(index)) for ws in lists for w in ws), dtype=np.int64)
        times = np.concatenate([np.frombuffer(x, dtype="<u4") for x in frame["_times"]]).astype(float)
        shares = np.concatenate([_shares_read(x, states) for x in frame["_c"]])
        n = np.bincount(which, weights=times, minlength=len(index))
        counts = np.stack([np.bincount(which, weights=times * shares[:, s], minlength=len(index)) for s in range(states)], axis=1)
        raw = _shares_written(counts, n)
        counts, packed = n[:, None] * _shares_read(raw, states), np.frombuffer(raw, dtype="<u2").reshape(-1, states)
        out, start = [], 0
        for chunk, ws in zip(frame["_chunk"], lists, strict=True):
            mine = which[start : start + len(ws)]
            out.append((key, int(chunk), n[mine].astype("<u4").tobytes(), packed[mine].tobytes()))
            start += len(ws)
        seen = np.flatnonzero(n)
        tails = np.fromiter((tail_symbol(w) for w in index), dtype=np.int64, count=len(index))[seen]
        weight = (n[seen] + SMOOTHING) / (n[seen] + BACKOFF)
        parts = np.concatenate([counts[seen], weight[:, None] * counts[seen], (weight * BACKOFF)[:, None]], axis=1)
        sums = np.zeros((TAIL_SYMBOLS, parts.shape[1]))
        np.add.at(sums, tails, parts)
        out.append((key, None, None, sums.tobytes()))
        return out

    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = piece(int(key[0]), frame) if key[0] < 0 else bucket(int(key[0]), frame)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMED.split(", ")]).astype({"_chunk": "Int64"})

    return blocks.groupBy("_key").applyInPandas(of, SUMMED)


def tail_sums(found: DataFrame, states: int) -> np.ndarray:
    """The buckets' sums by tail symbol, added up in tasks and then by symbol."""
    width = 2 * states + 1

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((TAIL_SYMBOLS, width))
        for frame in frames:
            for raw in frame["_c"]:
                total += np.frombuffer(raw).reshape(TAIL_SYMBOLS, width)
        yield pd.DataFrame({"tail": np.arange(TAIL_SYMBOLS), **{f"v{k}": total[:, k] for k in range(width)}})

    schema = "tail int, " + ", ".join(f"v{k} double" for k in range(width))
    parts = found.filter("_chunk IS NULL AND _key >= 0").select("_c").mapInPandas(of, schema)
    out = np.zeros((TAIL_SYMBOLS, width))
    for r in parts.groupBy("tail").agg(*[F.sum(f"v{k}") for k in range(width)]).collect():
        out[r[0]] = r[1:]
    return out


def expected_counts(model: Model, sequences: list[np.ndarray], segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of sequences, all segments of a length stepping together."""
    states, symbols = model.emit.shape
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    parts = [s[a : a + segment] for s in sequences for a in range(0, len(s), segment)]
    first = [a == 0 for s in sequences for a in range(0, len(s), segment)]
    by_symbol = model.emit.T.astype(np.float32)
    a_move = model.move.astype(np.float32)
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    for at in range(0, len(order), 2048):
        some = [parts[i] for i in order[at : at + 2048]]
        lengths = np.array([len(p) for p in some])
        begins = np.array([first[i] for i in order[at : at + 2048]])
        width = int(lengths[0])
        active = [int((lengths > t).sum()) for t in range(width)]  # longest first, so a prefix is active
        grid = np.zeros((width, len(some)), dtype=np.int64)
        for k, p in enumerate(some):
            grid[: len(p), k] = p
        emission = by_symbol[grid]
        alpha = np.zeros((width, len(some), states), dtype=np.float32)
        # a segment inside a text starts from the states' long-run shares, which are close to the expected ones
        alpha[0] = np.where(begins[:, None], model.start, _shares(model)).astype(np.float32) * emission[0]
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
        scale = np.ones((width, len(some), 1), dtype=np.float32)
        for t in range(1, width):
            n = active[t]
            x = (alpha[t - 1, :n] @ a_move) * emission[t, :n]
            scale[t, :n] = x.sum(axis=1, keepdims=True)
            alpha[t, :n] = x / scale[t, :n]
        beta = np.ones((len(some), states), dtype=np.float32)
        for t in range(width - 1, -1, -1):
            n = active[t]
            gamma = alpha[t, :n] * beta[:n]
            gamma /= gamma.sum(axis=1, keepdims=True)
            alpha_before = alpha[t - 1, :n] if t else None
            alpha[t, :n] = gamma
            if t:
                right = emission[t, :n] * beta[:n] / scale[t, :n]
                move += alpha_before.T @ right
                beta[:n] = right @ a_move.T
        start += alpha[0][begins].sum(axis=0)
        live = np.arange(width)[:, None] < lengths[None, :]
        flat, weight = grid[live], alpha[live]
        for s in range(states):
            emit[:, s] += np.bincount(flat, weights=weight[:, s], minlength=symbols)
    return start, move * model.move, emit.T


def _shares(model: Model) -> np.ndarray:
    x = np.full(len(model.start), 1.0 / len(model.start))
    for _ in range(30):
        x = x @ model.move
    return x / x.sum()


def updated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray, prior: float = 5.0) -> Model:
    """Parameters from counts. Every state keeps a little of the unigram shares, so no symbol has probability 0."""
    emit = emit + prior * unigram
    move, start = move + SMOOTHING, start + SMOOTHING
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def initial(unigram: np.ndarray, states: int, seed: int) -> Model:
    noise = np.random.default_rng(seed).gamma(2.0, 0.5, (states, len(unigram)))
    emit = unigram * noise
    move = np.full((states, states), 1.0 / states) + np.eye(states)
    return Model(np.full(states, 1.0 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def warm_segments(texts: DataFrame, vocabulary: Vocabulary, warm_docs: int, warm_tokens: int) -> list[np.ndarray]:
    """Symbols of one segment of each of `warm_docs` training texts: both drawn by a hash of the id, `warm_tokens` in all at most."""
    most = max(1, warm_tokens // warm_docs)
    drawn = texts.filter(~F.col("_held")).select("_id", F.xxhash64("_id").alias("_a"), F.xxhash64("_t").alias("_b"))
    ids = drawn.orderBy("_a", "_id", "_b").limit(warm_docs).select("_id", "_b").distinct()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ident, text in zip(frame["_id"], frame["_t"], strict=True):
                words = words_of(text)
                n = len(words) + 1
                at = zlib.crc32(ident.encode()) % (max(0, n - most) + 1)
                out.append((b" ".join(words[at : at + most]), at + most >= n and len(words[at : at + most]) < most))
            yield frame[["_id"]].assign(_s=[s for s, _ in out], _e=[e for _, e in out])

    chosen = texts.withColumn("_b", F.xxhash64("_t")).join(F.broadcast(ids), ["_id", "_b"]).dropDuplicates(["_id", "_b"])
    found = chosen.select("_id", "_t").mapInPandas(of, "_id string, _s binary, _e boolean").collect()
    head, out = len(vocabulary.head), []
    for r in sorted(found, key=lambda r: (r["_id"], bytes(r["_s"]))):
        words = bytes(r["_s"]).split()
        symbols = [vocabulary.head.get(w, head + tail_symbol(w)) for w in words] + [head + TAIL_SYMBOLS] * bool(r["_e"])
        if symbols:
            out.append(np.array(symbols, dtype=np.int64))
    return out


def warmed(model: Model, warm: list[np.ndarray], unigram: np.ndarray, most: int) -> Model:
    """Baum-Welch over the sample until it gains less than `WARM_GAIN` a token."""
    last, tokens = -np.inf, sum(map(len, warm))
    for _ in range(most if warm else 0):
        model = updated(*expected_counts(model, warm, 1 << 20), unigram)
        now = log_likelihoods(model, warm).sum() / tokens
        if now - last < WARM_GAIN:
            break
        last = now
    return model


def train(
    texts: DataFrame, encoded: DataFrame, vocabulary: Vocabulary, states: int = 6, iterations: int = 2, segment: int = 256,
    warm_docs: int = 600, warm_tokens: int = 150_000, warm_iterations: int = 50, seed: int = 1,
) -> tuple[Model, Lifts | None, DataFrame | None]:
    """Baum-Welch over all training texts, started from segments of at most `warm_docs` of them, `warm_tokens` tokens in all.

    Returns the model, the lifts of the words that share a symbol, and the buckets' replies for the chunks.
    """
    spark, unigram = encoded.sparkSession, vocabulary.unigram()
    model = warmed(initial(unigram, states, seed), warm_segments(texts, vocabulary, warm_docs, warm_tokens), unigram, warm_iterations)
    head, end = len(vocabulary.head), len(vocabulary.counts)
    tails = np.array([tail_symbol(w) for w in list(vocabulary.counts)[head:]], dtype=np.int64)
    symbols = np.concatenate([np.arange(head), head + tails, [head + TAIL_SYMBOLS]]).astype(np.int64)
    lifts, replies = None, None
    for _ in range(iterations):
        replies = materialise(summed(sent(with_totals(encoded, replies), vocabulary, model, lifts, segment), states))
        release(spark)
        flat = np.zeros((end + 2 + states, states))
        for r in replies.filter("_key < 0").select("_n", "_c").toLocalIterator():
            flat[np.frombuffer(r["_n"], dtype="<u4")] = np.frombuffer(r["_c"]).reshape(-1, states)
        by_tail = tail_sums(replies, states)
        emit = np.zeros((vocabulary.symbols, states))
        np.add.at(emit, symbols, flat[: end + 1])
        emit[head : head + TAIL_SYMBOLS] += by_tail[:, :states]
        lifts = lifts_of(vocabulary, flat[:end][head:], by_tail[:, :states], by_tail[:, states:-1], by_tail[:, -1])
        model = updated(flat[end + 1], flat[end + 2 :], emit.T, unigram)
    return model, lifts, replies


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each sequence of symbols, by the scaled forward recursion over its whole length.

    The sequences step together, the longest first, so those that have ended drop out of the end of the arrays.
    """
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lengths = np.array([len(sequences[i]) for i in order])
    out, total = np.zeros(len(sequences)), np.zeros(len(sequences))
    if not len(order):
        return out
    by_symbol, ends = np.ascontiguousarray(model.emit.T), np.cumsum(lengths)
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    begins = ends - lengths
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
    alpha = model.start * by_symbol[flat[begins]]
    kept = []
    for t in range(int(lengths[0])):
        n = int(active[t])
        if t:
            alpha = (alpha[:n] @ model.move) * by_symbol[flat[begins[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        kept.append(scale)
        if len(kept) == 64 or t == lengths[0] - 1:
            for s in kept:
                total[: len(s)] += np.log10(s)
            kept = []
    out[order] = total
    return out


def score(
    documents: DataFrame, ident: str = "doc_id", text: str = "text", head_words: int = 4000, dictionary_words: int = 200_000,
    states: int = 6, iterations: int = 2,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = documents.sparkSession
    held = F.coalesce(remainder(F.col(ident), 10) == 0, F.lit(True))
    texts = documents.select(F.col(ident).cast("string").alias("_id"), held.alias("_held"), F.col(text).alias("_t"))
    path = scratch_path(spark, "word-counts")
    count_words(texts.filter(~F.col("_held"))).write.option("compression", "zstd").parquet(path)
    release(spark)
    ends = texts.filter(~F.col("_held")).count()
    vocabulary = build_vocabulary(spark.read.parquet(path), ends, head_words, dictionary_words)
    rare = vocabulary.total - ends - sum(vocabulary.counts.values())
    buckets = max(1, -(-rare // BUCKET_WORDS), min(spark.sparkContext.defaultParallelism, -(-rare // 20_000)))
    encoded = materialise(encode(texts, vocabulary, buckets))
    release(spark)
    model, lifts, replies = train(texts, encoded, vocabulary, states, iterations)
    shared = spark.sparkContext.broadcast((vocabulary, model, lifts))
    whole = math.log10(vocabulary.total + SMOOTHING * (vocabulary.distinct + 1))
    inside_of = np.array([math.log10(c + SMOOTHING * (d + 1)) for c, d in zip(vocabulary.tail_total, vocabulary.tail_distinct, strict=True)])

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, coded = shared.value[0], Coded(*shared.value)
        base = np.array([v.base(c) for c in v.counts.values()] + [v.base(v.ends)])
        inside = np.array([0.0 if w in v.head else v.inside(c, tail_symbol(w)) for w, c in v.counts.items()] + [0.0])
        known = np.append(np.ones(len(v.counts)), v.ends > 0)
        for frame in frames:
            for row in frame.to_dict("records"):
                chunk = Chunk(row)
                n, counts = chunk.totals(row["_replies"], len(shared.value[1].start))
                chain = log_likelihoods(coded.of(chunk, n, counts), chunk.sequences(np.ones(len(chunk.ids), dtype=bool)))
                seen = np.log10(n + SMOOTHING)
                by_text = lambda x: np.add.reduceat(x[chunk.codes], np.concatenate([[0], chunk.ends[:-1]]))  # noqa: B023, E731
                yield pd.DataFrame({
                    "_id": chunk.ids, "_held": chunk.held, "_tokens": np.diff(chunk.ends, prepend=0),
                    "_known": by_text(np.concatenate([known, n > 0])).astype(np.int64), "_base": by_text(np.concatenate([base, seen - whole])),
                    "_score": chain + by_text(np.concatenate([inside, seen - inside_of[chunk.tails]])),
                })

    schema = "_id string, _held boolean, _tokens bigint, _known bigint, _base double, _score double"
    scored = with_totals(encoded.drop("_words"), replies).mapInPandas(of, schema)
    return scored.select(
        F.col("_id").cast(documents.schema[ident].dataType).alias("doc_id"), F.col("_held").alias("held_out"), F.col("_tokens").alias("n_tokens"),
        F.col("_known").alias("n_known"), F.lit(vocabulary.total).cast("bigint").alias("train_tokens"), F.col("_base").alias("base_score"),
        F.col("_score").alias("score"),
    )
