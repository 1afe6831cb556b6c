"""Bounded-space online packing of token sequences into windows of a fixed length.

Every partition keeps `open_windows` open windows. A document longer than a
window fills whole windows of its own; what is left is placed best-fit. When
none fits, the fullest window is emitted: the head of the arriving piece fills
it where at least `min_cut` tokens go in, else it is padded. What stays open at
the end of the partitions is merged in rounds of `fan_in` partitions a task,
whole windows as units, so no task ever holds more than fan_in * open_windows
windows, and the last round closes its gaps by cutting.

The pieces are written to the shared folder before they are used twice, so a
task that runs again cannot give other windows than those already merged.

Edge cases: a null or empty text is the end token alone. A null id stays null. A document of any
length is cut, each id lies in exactly one piece. Rows with the same id are
packed one by one. Ties of the best fit go to the window opened first, ties of
the fullest likewise. An empty table gives no pieces. Only the two named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tokens import batches, encoder
from gleaner.session import materialise

PIECE = "doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PLACED = PIECE + ", ids binary, part bigint, window bigint, offset bigint, open boolean"


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc: str | None, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        """The first `at` tokens and the others."""
        return Piece(self.doc, self.start, self.ids[: 4 * at], self.total), Piece(self.doc, self.start + at, self.ids[4 * at :], self.total)


class Packer:
    """Windows of one task. `closed` gathers emitted windows as lists of pieces."""

    def __init__(self, size: int, open_windows: int, min_cut: int):
        self.size, self.limit, self.min_cut = size, open_windows, min_cut
        self.open: list[list[Piece]] = []
        self.free: list[int] = []
        self.closed: list[list[Piece]] = []

    def _emit(self, k: int) -> None:
        self.closed.append(self.open.pop(k))
        self.free.pop(k)

    def _put(self, k: int, pieces: list[Piece], length: int) -> None:
        self.open[k].extend(pieces)
        self.free[k] -= length
        if not self.free[k]:
            self._emit(k)

    def _open(self, pieces: list[Piece], length: int) -> None:
        if length == self.size:
            self.closed.append(pieces)
        else:
            self.open.append(pieces)
            self.free.append(self.size - length)

    def place(self, pieces: list[Piece], length: int, cuttable: bool = True) -> None:
        """Best-fit of a unit of at most one window."""
        fitting = [f for f in self.free if f >= length]
        if fitting:
            self._put(self.free.index(min(fitting)), pieces, length)
        elif len(self.open) < self.limit:
            self._open(pieces, length)
        else:
            free = min(self.free)
            k = self.free.index(free)
            if cuttable and len(pieces) == 1 and free >= self.min_cut:
                head, rest = pieces[0].cut(free)
                self._put(k, [head], free)
                self.place([rest], length - free)
            else:
                self._emit(k)
                self._open(pieces, length)

    def add(self, piece: Piece) -> None:
        while len(piece) > self.size:
            head, piece = piece.cut(self.size)
            self.closed.append([head])
        self.place([piece], len(piece))

    def finish(self) -> None:
        """Closes the gaps of what is open: the emptiest windows are dealt out, cut freely, over the fullest."""
        order = sorted(range(len(self.open)), key=lambda k: (self.free[k], k))
        windows = [self.open[k] for k in order]
        free = [self.free[k] for k in order]
        first, last = 0, len(windows) - 1
        while first < last:
            room, moved = free[first], windows[last].pop()
            if len(moved) <= room:
                windows[first].append(moved)
                free[first] -= len(moved)
                free[last] += len(moved)
            else:
                head, rest = moved.cut(room)
                windows[first].append(head)
                windows[last].append(rest)
                free[first] = 0
                free[last] += room
            if not windows[last]:
                last -= 1
            if not free[first]:
                first += 1
        self.closed += [w for w in windows if w]
        self.open, self.free = [], []


def _rows(windows: list[list[Piece]], part: int, first: int, is_open: bool, keep_ids: bool) -> pd.DataFrame:
    out = []
    for w, pieces in enumerate(windows, first):
        offset = 0
        for p in pieces:
            out.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, p.ids if keep_ids else None, part, w, offset, is_open))
            offset += len(p)
    columns = [c.split()[0] for c in PLACED.split(", ")]
    return pd.DataFrame(out, columns=columns)


def pack(
    documents: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1,
    open_windows: int = 32, min_cut: int = 24, fan_in: int = 64, with_ids: bool = True,
) -> DataFrame:
    """Pieces with doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset; with_ids adds the ids as little-endian
    32-bit numbers."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def first_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        coder, packer, window = encoder(tokenizer), Packer(size, open_windows, min_cut), 0
        for frame in frames:
            ids, texts = frame["_id"].tolist(), ["" if t is None else t for t in frame["_t"]]
            for a, b in batches([len(t) for t in texts]):
                for doc, whole in zip(ids[a:b], coder.ids(texts[a:b]), strict=True):
                    whole += end
                    packer.add(Piece(doc, 0, whole, len(whole) // 4))
                if packer.closed:
                    yield _rows(packer.closed, part, window, False, with_ids)
                    window += len(packer.closed)
                    packer.closed = []
        yield _rows(packer.open, part, window, True, True)

    source = documents.select(F.col(ident).cast("string").alias("_id"), F.col(text).alias("_t"))
    placed = materialise(source.mapInPandas(first_pass, PLACED))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "window", "offset"]
    done = [placed.filter(~F.col("open")).select(*columns, F.lit(0).alias("level"))]
    left, level = placed.filter("open"), 0
    parts = placed.rdd.getNumPartitions()
    while parts:
        level, groups = level + 1, -(-parts // fan_in)
        merged = materialise(_merge(left, groups, fan_in, size, open_windows, with_ids))
        done.append(merged.filter(~F.col("open")).select(*columns, F.lit(level).alias("level")))
        left, parts = merged.filter("open"), groups if groups > 1 else 0
    pieces = done[0]
    for d in done[1:]:
        pieces = pieces.union(d)
    # level, task and window number name a sequence
    sequence = F.col("level").cast("bigint") * (1 << 58) + F.col("part") * (1 << 34) + F.col("window")
    named = F.col("doc_id").cast(documents.schema[ident].dataType).alias("doc_id")
    out = pieces.withColumn("sequence_id", sequence).select(named, *columns[1:6], "sequence_id", "offset")
    return out if with_ids else out.drop("ids")


def _merge(left: DataFrame, groups: int, fan_in: int, size: int, open_windows: int, with_ids: bool) -> DataFrame:
    """Packs open windows of `fan_in` tasks as units. With one group left nothing stays open."""

    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(size, open_windows, size)
        frame = frame.sort_values(["part", "window", "offset"], kind="stable")
        units = [
            [Piece(*row) for row in zip(g["doc_id"].tolist(), g["start"].tolist(), g["ids"], g["doc_tokens"].tolist(), strict=True)]
            for _, g in frame.groupby(["part", "window"], sort=True)
        ]
        # the largest first: all units of the round are at hand
        for unit in sorted(units, key=lambda u: -sum(map(len, u))):
            packer.place(unit, sum(map(len, unit)), cuttable=False)
        if groups == 1:
            packer.finish()
        part, n = int(key[0]), len(packer.closed)
        return pd.concat(
            [_rows(packer.closed, part, 0, False, with_ids), _rows(packer.open, part, n, True, True)], ignore_index=True
        )

    keyed = left.withColumn("_group", F.floor(F.col("part") / fan_in).cast("bigint") if groups > 1 else F.lit(0).cast("bigint"))
    return keyed.groupBy("_group").applyInPandas(of, PLACED)
