"""Token ids in binary files of patched frame-of-reference blocks, in the order of the document ids.

A block holds `BLOCK` numbers. Its minimum is subtracted, the rest is packed at
the width that holds one of `PERCENTILES` of the block's numbers, whichever makes
the block smallest, and the numbers that need more go to an exception list of
places and upper bits. The ids of a file's documents run on across blocks without
gaps; each file ends with its documents (ids and lengths, packed alike), the
places where blocks start, and a trailer, so a reader gets at any stretch of ids by
decoding the blocks it touches.

`write` sorts the documents by range partitions, encodes and writes each range in
its own task, and lists the files in a table next to them. A task that runs again
writes a file of another name, and only the files of tasks that ended are
listed, so nothing is read twice. `read` takes one task per file.

Layout, little-endian: the magic word; token blocks; document id blocks; document
length blocks; three arrays of 64-bit block starts, from the begin of the file,
each with a closing one; the trailer (counts of tokens, documents, documents
without id, place of the arrays) and the magic word again. A block: minimum
(int64), count (uint16), exceptions (uint16), width (uint8), packed numbers,
places of the exceptions (uint16), their upper bits (uint64 if width + 32 bits do
not hold them, which the top bit of the width byte says, else uint32).

Edge cases: a null or empty text is the end token alone. Rows without id come
first. Rows that repeat an id come one after the other, ordered by a hash of the
text. A text of any length is one row of a task, and is written in pieces. An
empty table gives an index without files. Only id and text are read, so other
columns cannot clash. The folder may be a path or a URI that pyarrow can open
(file, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.tokens import encoder, slices

MAGIC = b"PFOR-v01"
BLOCK = 1024
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 1.0)
HEAD = struct.Struct("<qHHB")
TRAILER = struct.Struct("<QQQQ8s")
TOGETHER = 64  # blocks packed or unpacked in one step
INDEX = "part int, file string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 64-bit number needs; 0 for 0."""
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    of = lambda v: np.frexp(v.astype(np.float64))[1]
    return np.where(high > 0, of(high) + 32, of(low)).astype(np.int64)


def _bits(x: np.ndarray, width: int) -> list[bytes]:
    """The low `width` bits of each row's numbers, end to end."""
    if not width:
        return [b""] * len(x)
    size = 4 if width <= 32 else 8
    raw = np.ascontiguousarray(x.astype(f"<u{size}")).view(np.uint8).reshape(*x.shape, size)
    kept = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :width].reshape(len(x), -1)
    return [row.tobytes() for row in np.packbits(kept, axis=1, bitorder="little")]


def pack(values: np.ndarray, percentiles: tuple[float, ...] = PERCENTILES) -> list[bytes]:
    """One block for each row of a matrix of 64-bit integers."""
    k, n = values.shape
    low = values.min(axis=1)
    delta = values.astype(np.int64).view(np.uint64) - low.astype(np.int64).view(np.uint64)[:, None]
    needs = bit_lengths(delta)
    upto = np.bincount((np.arange(k)[:, None] * 65 + needs).ravel(), minlength=65 * k).reshape(k, 65).cumsum(axis=1)
    most, rows = needs.max(axis=1), np.arange(k)
    width, cost = np.full(k, 64), np.full(k, np.iinfo(np.int64).max)
    for p in percentiles:
        w = (upto >= np.ceil(p * n)).argmax(axis=1)
        c = n * w + (n - upto[rows, w]) * (16 + np.where(most - w > 32, 64, 32))
        width, cost = np.where(c < cost, w, width), np.minimum(c, cost)
    packed: list[bytes] = [b""] * k
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for i, row in zip(at, _bits(delta[at], int(w)), strict=True):
            packed[i] = row
    row, place = np.nonzero(needs > width[:, None])
    upper = delta[row, place] >> width[row].astype(np.uint64)
    cut = np.searchsorted(row, np.arange(k + 1))
    out = []
    for i in range(k):
        a, b = cut[i], cut[i + 1]
        wide = bool(most[i] - width[i] > 32)
        out.append(b"".join([
            HEAD.pack(int(low[i]), n, b - a, int(width[i]) | (128 if wide else 0)), packed[i],
            place[a:b].astype("<u2").tobytes(), upper[a:b].astype("<u8" if wide else "<u4").tobytes(),
        ]))
    return out


def unpack(blocks: list[bytes]) -> np.ndarray:
    """The numbers of blocks, end to end."""
    heads = [HEAD.unpack_from(b) for b in blocks]
    begins = np.concatenate([[0], np.cumsum([h[1] for h in heads])])
    out = np.empty(int(begins[-1]), dtype=np.uint64)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (_, n, _, w) in enumerate(heads):
        alike.setdefault((w & 127, n), []).append(i)
    for (w, n), which in alike.items():
        size = (n * w + 7) // 8
        where = begins[which][:, None] + np.arange(n)
        if not w:
            out[where] = 0
            continue
        raw = np.frombuffer(b"".join(blocks[i][HEAD.size : HEAD.size + size] for i in which), dtype=np.uint8).reshape(len(which), size)
        bits = np.unpackbits(raw, axis=1, count=n * w, bitorder="little").reshape(len(which), n, w)
        wide = 4 if w <= 32 else 8
        grid = np.zeros((len(which), n, 8 * wide), dtype=np.uint8)
        grid[:, :, :w] = bits
        out[where] = np.packbits(grid, axis=2, bitorder="little").view(f"<u{wide}").reshape(len(which), n)
    for i, (low, n, more, w) in enumerate(heads):
        if more:
            at = HEAD.size + (n * (w & 127) + 7) // 8
            place = np.frombuffer(blocks[i], dtype="<u2", count=more, offset=at)
            upper = np.frombuffer(blocks[i], dtype="<u8" if w & 128 else "<u4", count=more, offset=at + 2 * more)
            out[begins[i] + place] |= upper.astype(np.uint64) << np.uint64(w & 127)
    lows = np.array([h[0] for h in heads], dtype=np.int64).view(np.uint64)
    return (out + np.repeat(lows, [h[1] for h in heads])).view(np.int64)


class Blocks:
    """Gathers numbers and hands out whole blocks; `starts` are counted from the first."""

    def __init__(self, percentiles: tuple[float, ...] = PERCENTILES):
        self.percentiles, self.waiting, self.held = percentiles, [], 0
        self.starts, self.count = [0], 0

    def add(self, values: np.ndarray, last: bool = False) -> bytes:
        self.waiting.append(values)
        self.held += len(values)
        self.count += len(values)
        if self.held < TOGETHER * BLOCK and not last:
            return b""
        flat = np.concatenate(self.waiting).astype(np.int64)
        whole = len(flat) // BLOCK * BLOCK
        out = []
        for a in range(0, whole, TOGETHER * BLOCK):
            out += pack(flat[a : min(whole, a + TOGETHER * BLOCK)].reshape(-1, BLOCK), self.percentiles)
        if last and whole < len(flat):
            out += pack(flat[None, whole:], self.percentiles)
            whole = len(flat)
        for b in out:
            self.starts.append(self.starts[-1] + len(b))
        self.waiting, self.held = [flat[whole:]], len(flat) - whole
        return b"".join(out)


class Writer:
    """Writes one file. Documents are added in order; what stays in memory are a few blocks and the packed document table."""

    def __init__(self, out, percentiles: tuple[float, ...] = PERCENTILES):
        self.out = out
        self.tokens, self.idents, self.lengths = Blocks(percentiles), Blocks(percentiles), Blocks(percentiles)
        self.ident_bytes, self.length_bytes = bytearray(), bytearray()
        self.docs = self.nulls = 0
        self.out.write(MAGIC)

    def add(self, idents: list[int | None], ids: list[np.ndarray]) -> None:
        """Documents in ascending order of their ids, those without id first."""
        known = [i for i in idents if i is not None]
        self.docs += len(idents)
        self.nulls += len(idents) - len(known)
        self.ident_bytes += self.idents.add(np.array(known, dtype=np.int64))
        self.length_bytes += self.lengths.add(np.array([len(x) for x in ids], dtype=np.int64))
        for x in ids:
            if packed := self.tokens.add(x):
                self.out.write(packed)

    def close(self) -> int:
        """Returns the size of the file."""
        none = np.empty(0, dtype=np.int64)
        self.out.write(self.tokens.add(none, last=True))
        self.ident_bytes += self.idents.add(none, last=True)
        self.length_bytes += self.lengths.add(none, last=True)
        self.out.write(bytes(self.ident_bytes))
        self.out.write(bytes(self.length_bytes))
        begin, arrays = len(MAGIC), []
        for part in (self.tokens, self.idents, self.lengths):
            arrays.append(np.array(part.starts, dtype="<u8") + np.uint64(begin))
            begin += part.starts[-1]
        for a in arrays:
            self.out.write(a.tobytes())
        self.out.write(TRAILER.pack(self.tokens.count, self.docs, self.nulls, begin, MAGIC))
        return begin + sum(8 * len(a) for a in arrays) + TRAILER.size


class Reader:
    """Reads one file by the places of its blocks. `source` is a file open for random reads, `size` its length."""

    def __init__(self, source, size: int):
        self.source = source
        tail = self._bytes(size - TRAILER.size, size)
        self.n_tokens, self.n_docs, self.nulls, index, magic = TRAILER.unpack(tail)
        if magic != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of patched blocks")
        flat = np.frombuffer(self._bytes(index, size - TRAILER.size), dtype="<u8").astype(np.int64)
        lengths = [1 + -(-n // BLOCK) for n in (self.n_tokens, self.n_docs - self.nulls, self.n_docs)]
        self.tokens, self.idents, self.lengths = np.split(flat, np.cumsum(lengths)[:-1])

    def _bytes(self, a: int, b: int) -> bytes:
        self.source.seek(a)
        return self.source.read(b - a)

    def _stretch(self, starts: np.ndarray, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, dtype=np.int64)
        first, last = start // BLOCK, -(-stop // BLOCK)
        raw, base = self._bytes(int(starts[first]), int(starts[last])), int(starts[first])
        values = unpack([raw[starts[k] - base : starts[k + 1] - base] for k in range(first, last)])
        return values[start - first * BLOCK : stop - first * BLOCK]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The token ids from `start` up to `stop`, counted over the file; decodes only the blocks they lie in."""
        return self._stretch(self.tokens, start, min(stop, self.n_tokens)).astype("<u4")

    def documents(self, rows: int = TOGETHER * BLOCK) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """Ids and lengths of the documents, some at a time."""
        for a in range(0, self.n_docs, rows):
            b = min(a + rows, self.n_docs)
            without = max(0, min(b, self.nulls) - a)
            known = self._stretch(self.idents, max(a - self.nulls, 0), max(b - self.nulls, 0))
            yield [None] * without + known.tolist(), self._stretch(self.lengths, a, b)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def write(
    documents: DataFrame, tokenizer: str, folder: str, ident: str = "doc_id", text: str = "text", end_id: int = 2,
    file_bytes: int = 256 << 20, percentiles: tuple[float, ...] = PERCENTILES,
) -> None:
    """Encodes all texts, `end_id` after each, into files below `folder`, about `file_bytes` of text in each."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, name = context.partitionId(), f"part-{context.partitionId():07d}-{context.taskAttemptId()}.pfor"
        system, path = _open(folder)
        coder, out, writer = encoder(tokenizer), None, None
        for some in slices(rows, "_t"):
            if writer is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}")
                writer = Writer(out, percentiles)
            ids = coder.ids([t or "" for t in some.column("_t").to_pylist()])
            writer.add(some.column("_id").to_pylist(), [np.frombuffer(x + end, dtype="<u4") for x in ids])
        if writer is not None:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([writer.docs], pa.int64()),
                "n_tokens": pa.array([writer.tokens.count], pa.int64()), "n_bytes": pa.array([size], pa.int64()),
            })

    source = documents.select(F.col(f"`{ident}`").cast("bigint").alias("_id"), F.col(f"`{text}`").alias("_t"))
    total = source.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    files = max(1, -(-total // file_bytes), min(4 * cores, -(-total // (4 << 20))))
    # the last key only deals out rows that agree in all else, so one id may fill several ranges
    keyed = source.withColumn("_h", F.xxhash64("_t")).withColumn("_k", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(files, "_id", "_h", "_k").sortWithinPartitions("_id", "_h", "_k")
    ordered.select("_id", "_t").mapInArrow(of, INDEX).write.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files; with_ids adds the ids as little-endian 32-bit numbers.

    `start` counts the ids of all documents before it, over all files.
    """
    index = spark.read.parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, no more
    listed = index.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _open(folder)
        for frame in frames:
            for name, size, first in zip(frame["file"], frame["n_bytes"], frame["first"], strict=True):
                with system.open_input_file(f"{path}/{name}") as source:
                    for found in _documents(Reader(source, int(size)), with_ids):
                        yield found.assign(start=found["start"] + first)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    dealt = listed.select("part", "file", "n_bytes", "first").repartitionByRange(max(1, index.count()), "part")
    return dealt.select("file", "n_bytes", "first").mapInPandas(of, schema)


def _documents(reader: Reader, with_ids: bool, window: int = 4 * TOGETHER * BLOCK) -> Iterator[pd.DataFrame]:
    """The documents of a file. Ids are decoded a window at a time; a longer document goes through several."""
    at, low, held = 0, 0, b""
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    for idents, lengths in reader.documents():
        out, kept = [], 0
        for ident, n in zip(idents, lengths.tolist(), strict=True):
            crc, left, place, pieces = 0, n, at, []
            while left:
                if place >= low + len(held) // 4:
                    low, held = place, reader.ids(place, place + window).tobytes()
                piece = held[4 * (place - low) : 4 * (place - low + left)]
                crc = zlib.crc32(piece, crc)
                place, left = place + len(piece) // 4, left - len(piece) // 4
                if with_ids:
                    pieces.append(piece)
            out.append((ident, at, n, crc, b"".join(pieces))[: len(columns)])
            kept += n if with_ids else 0
            at += n
            if kept > 1_000_000:
                yield _frame(out, columns)
                out, kept = [], 0
        if out:
            yield _frame(out, columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})


def stretch(spark: SparkSession, folder: str, start: int, stop: int) -> np.ndarray:
    """The ids from `start` up to `stop`, counted over all files: a training window, by random access."""
    system, path = _open(folder)
    index = spark.read.parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = index.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    touched = listed.filter((F.col("first") < stop) & (F.col("first") + F.col("n_tokens") > start)).orderBy("part")
    out = []
    for r in touched.collect():
        with system.open_input_file(f"{path}/{r['file']}") as source:
            out.append(Reader(source, r["n_bytes"]).ids(max(0, start - r["first"]), stop - r["first"]))
    return np.concatenate(out) if out else np.empty(0, dtype="<u4")
