"""BPE encoding and decoding, long texts by tree concatenation.

A long text is halved until its parts are short, at any character. The parts
are encoded in parallel: texts beyond `span_chars` are dealt as spans over
tasks, and a span is halved again inside its task. Two neighbouring encodings
are joined by re-encoding a window of text around the cut, which grows until both
sides agree with it, and what lies outside of the agreement stays as it is.

Where blanks are near, the window is a run of pieces, the stretches between ASCII
blanks, across which the tokenizer never merges: it has to give the left encoding's ids for
its first piece and the right one's for its last. In an unsplit stretch of more than
`LONG_PIECE` characters the window is counted in tokens: it agrees on the left where one of
its tokens starts at the same character and has the same id as a token of the left
encoding, on the right likewise. A sequence of tokens is what the merges give if each
two neighbours are, and with a common token on either side all neighbours of the joined
sequence stood next to each other in one of the three encodings.

Texts of at most `leaf_chars` characters need no tree; they go through the cache of
pieces.

Edge cases: a null or empty text has no ids and decodes to the empty text. A text
without any blank is joined inside its one piece. Agreement is only accepted at
characters that do not compose with the one before them, and outside a special token that
the cut parts. A null id stays null; rows with the same id are encoded one by one. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.tokens import WordEncoder, batches, encoder
from gleaner.session import materialise


LONG_PIECE = 256
WINDOW_TOKENS = 8


@dataclass
class Encoded:
    """A part of a text: its pieces, the ids of each, and of long ones at the ends where their tokens start, in characters."""

    pieces: list[str]
    ids: list[bytes]
    starts: list[np.ndarray | None]

    def joined(self) -> bytes:
        return b"".join(self.ids)


def with_offsets(coder: WordEncoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The library's own ids of a text, and where each token starts."""
    e = coder.tokenizer.encode(text, add_special_tokens=False)
    return np.asarray(e.ids, dtype="<u4"), np.asarray([a for a, _ in e.offsets], dtype=np.int64)


def leaf(coder: WordEncoder, texts: list[str]) -> list[Encoded]:
    split = [coder.pieces(t) for t in texts]
    coder.learn({p for s in split for p in s if len(p) <= LONG_PIECE})
    out = []
    for pieces in split:
        ids, starts = [], []
        for p in pieces:
            long = with_offsets(coder, p) if len(p) > LONG_PIECE else None
            known = None if long else coder.known.get(p)  # a full cache may have dropped it
            ids.append(long[0].tobytes() if long else coder.encode_whole(p) if known is None else known)
            starts.append(long[1] if long else None)
        out.append(Encoded(pieces, ids, starts))
    return out


def _apart(text: str, at: int) -> bool:
    """Does the character at `at` stay on its own, whatever stands before it?"""
    if not 0 < at < len(text):
        return True
    a, b = text[at - 1], text[at]
    nfc = lambda x: unicodedata.normalize("NFC", x)
    return not unicodedata.combining(b) and nfc(a + b) == nfc(a) + nfc(b)


def _first_at(starts: np.ndarray) -> dict[int, int]:
    """The token that starts at a character, if it is the first one there."""
    first = np.flatnonzero(np.diff(starts, prepend=-1))
    return dict(zip(starts[first].tolist(), first.tolist(), strict=True))


def join_piece(coder: WordEncoder, left: tuple[str, bytes, np.ndarray], right: tuple[str, bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Ids and starts of two parts of one piece written without a gap."""
    text, cut = left[0] + right[0], len(left[0])
    li, ri, ls, rs = np.frombuffer(left[1], dtype="<u4"), np.frombuffer(right[1], dtype="<u4"), left[2], right[2] + cut
    longest = max((len(t) for t in coder.added), default=0)
    near = text[max(0, cut - longest) : cut + longest]
    parted = [
        (at, at + len(t)) for t in coder.added for k in range(len(near)) if near.startswith(t, k)
        for at in [k + max(0, cut - longest)] if at < cut < at + len(t)
    ]
    before, after = min((a for a, _ in parted), default=cut), max((b for _, b in parted), default=cut)
    window = WINDOW_TOKENS
    while True:
        begin = int(ls[len(ls) - window]) if window < len(ls) else 0
        end = int(rs[window]) if window < len(rs) else len(text)
        while not _apart(text, begin):
            begin -= 1
        while not _apart(text, end):
            end += 1
        ids, starts = with_offsets(coder, text[begin:end])
        starts = starts + begin
        in_left, in_right, own = _first_at(ls), _first_at(rs), _first_at(starts)
        good = lambda at, other, theirs, ids=ids, own=own: at in other and theirs[other[at]] == ids[own[at]] and _apart(text, at)
        i = j = 0
        if begin:
            agreed = next((at for at in own if at <= before and good(at, in_left, li)), None)
            i, j = (own[agreed], in_left[agreed]) if agreed is not None else (-1, -1)
        i2, j2 = len(ids), len(ri)
        if end < len(text):
            agreed = next((at for at in own if at >= after and good(at, in_right, ri)), None)
            i2, j2 = (own[agreed], in_right[agreed]) if agreed is not None else (-1, -1)
        if 0 <= i <= i2:
            joined = np.concatenate([li[:j], ids[i:i2], ri[j2:]]).astype("<u4")
            return joined.tobytes(), np.concatenate([ls[:j], starts[i:i2], rs[j2:]])
        window *= 2


def concatenate(coder: WordEncoder, left: Encoded, right: Encoded, window: int = 2) -> Encoded:
    """The encoding of the two texts written without a gap.

    The cut lies inside the piece made of the left's last and the right's first
    one. The window text is re-encoded by the library as a whole.
    """
    middle = left.pieces[-1] + right.pieces[0]
    if len(middle) > LONG_PIECE:
        ends = []
        for e, k in ((left, -1), (right, 0)):
            starts = e.starts[k] if e.starts[k] is not None else with_offsets(coder, e.pieces[k])[1]
            ends.append((e.pieces[k], e.ids[k], starts))
        ids, starts = join_piece(coder, *ends)
        return Encoded(
            [*left.pieces[:-1], middle, *right.pieces[1:]], [*left.ids[:-1], ids, *right.ids[1:]], [*left.starts[:-1], starts, *right.starts[1:]]
        )
    while True:
        a, b = min(window, len(left.pieces)), min(window, len(right.pieces))
        pieces = [*left.pieces[len(left.pieces) - a : -1], middle, *right.pieces[1:b]]
        ids = [coder.encode_whole(p) for p in pieces]
        whole = coder.encode_whole(" ".join(pieces))
        left_end, right_end = a == len(left.pieces), b == len(right.pieces)
        agreed = whole == b"".join(ids)  # the pieces' ids are those of the window
        left_ok = left_end or (a > 1 and ids[0] == left.ids[len(left.ids) - a])
        right_ok = right_end or (b > 1 and ids[-1] == right.ids[b - 1])
        if agreed and left_ok and right_ok:
            starts = [*left.starts[len(left.starts) - a : -1], None, *right.starts[1:b]]
            return Encoded(
                left.pieces[: len(left.pieces) - a] + pieces + right.pieces[b:],
                left.ids[: len(left.ids) - a] + ids + right.ids[b:],
                left.starts[: len(left.starts) - a] + starts + right.starts[b:],
            )
        if left_end and right_end:
            return Encoded([" ".join(pieces)], [whole], [None])  # no blank parts the text for this tokenizer: one piece
        window *= 2


def encode_tree(coder: WordEncoder, text: str, leaf_chars: int) -> Encoded:
    """Halves of halves, encoded together in one batch, then joined level by level."""
    parts = [text]
    while max(map(len, parts)) > leaf_chars:
        parts = [h for p in parts for h in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > 1 else (p,))]
    return join_all(coder, leaf(coder, parts))


def join_all(coder: WordEncoder, encoded: list[Encoded]) -> Encoded:
    while len(encoded) > 1:
        pairs = [concatenate(coder, a, b) for a, b in zip(encoded[::2], encoded[1::2], strict=False)]
        encoded = pairs + ([encoded[-1]] if len(encoded) % 2 else [])
    return encoded[0]


def encode(
    documents: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", leaf_chars: int = 16_384,
    span_chars: int = 65_536,
) -> DataFrame:
    """Columns doc_id and ids (little-endian 32-bit numbers)."""

    def short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)
        for frame in frames:
            ids, texts = frame["_id"].tolist(), frame["_t"].tolist()
            for a, b in batches([len(t) for t in texts]):
                whole: dict[int, bytes] = {}
                few = [k for k in range(a, b) if len(texts[k]) <= leaf_chars]
                whole.update(zip(few, coder.ids([texts[k] for k in few]), strict=True))
                for k in range(a, b):
                    if k not in whole:
                        whole[k] = encode_tree(coder, texts[k], leaf_chars).joined()
                yield pd.DataFrame({"doc_id": ids[a:b], "ids": [whole[k] for k in range(a, b)]})

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)
        for frame in frames:
            for row, ident_, at, part in zip(frame["_row"], frame["_id"], frame["at"], frame["part"], strict=True):
                e = encode_tree(coder, part, leaf_chars)
                sizes = np.asarray([len(i) // 4 for i in e.ids], dtype="<u4").tobytes()
                ends = [None if x is None else x.astype("<u4").tobytes() for x in (e.starts[0], e.starts[-1])]  # later joins touch the ends only
                yield pd.DataFrame({
                    "_row": [row], "_id": [ident_], "at": [at], "part": [part], "ids": [e.joined()], "sizes": [sizes], "first": [ends[0]], "last": [ends[1]],
                })

    def joined(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        coder = encoder(tokenizer)
        frame = frame.sort_values("at")
        parts = []
        for text_, ids, sizes, first, last in zip(frame["part"], frame["ids"], frame["sizes"], frame["first"], frame["last"], strict=True):
            ends = np.cumsum(np.frombuffer(sizes, dtype="<u4").astype(np.int64) * 4).tolist()
            starts: list[np.ndarray | None] = [None] * len(ends)
            starts[0], starts[-1] = (None if x is None else np.frombuffer(x, dtype="<u4").astype(np.int64) for x in (first, last))
            parts.append(Encoded(coder.pieces(text_), [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], starts))
        return pd.DataFrame({"doc_id": [frame["_id"].iloc[0]], "ids": [join_all(coder, parts).joined()]})

    source = documents.select(
        F.col(ident).cast("string").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")
    )
    long = F.length("_t") > span_chars
    near = source.filter(~long).mapInPandas(short, "doc_id string, ids binary")
    starts = F.sequence(F.lit(1), F.length("_t"), F.lit(span_chars))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("at"), F.substring("_t", s, F.lit(span_chars)).alias("part")))
    # repeated rows: the row gets a number of its own, fixed by writing the spans before they are grouped
    numbered = source.filter(long).withColumn("_row", F.monotonically_increasing_id())
    dealt = materialise(numbered.select("_row", "_id", F.explode(cut).alias("s")).select("_row", "_id", "s.at", "s.part"))
    far = (
        dealt.repartition("_row", "at")
        .mapInPandas(spans, "_row bigint, _id string, at int, part string, ids binary, sizes binary, first binary, last binary")
        .groupBy("_row").applyInPandas(joined, "doc_id string, ids binary")
    )
    out = near.union(far)
    return out.withColumn("doc_id", F.col("doc_id").cast(documents.schema[ident].dataType))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes from the ids, special tokens included."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)
        for frame in frames:
            for a, b in batches([len(i) for i in frame[ids]]):
                some = frame.iloc[a:b]
                lists = [np.frombuffer(i, dtype="<u4").tolist() for i in some[ids]]
                yield some.assign(**{out: coder.tokenizer.decode_batch(lists, skip_special_tokens=False)})

    return encoded.mapInPandas(texts, schema)


def digests(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the decimal ids and sha256 of the decoded text, hashed where the ids are."""
    ident = encoded.schema["doc_id"].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)
        for frame in frames:
            for a, b in batches([len(i) for i in frame["ids"]]):
                some = frame["ids"].iloc[a:b]
                lists = [np.frombuffer(i, dtype="<u4").tolist() for i in some]
                decoded = coder.tokenizer.decode_batch(lists, skip_special_tokens=False)
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].iloc[a:b].tolist(), "n_tokens": [len(x) for x in lists],
                    "ids_sha256": [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in lists],
                    "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                })

    named = encoded.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = named.mapInPandas(of, "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast(ident))
