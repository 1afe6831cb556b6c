"""Stateful processors: the live forms of the history operators.

Each keeps a bounded amount of state per key: the last few values of its series.
The rows of a key in a micro-batch are put in order, the kept values go in front
of them, and all frames are then sliding windows over one array. The trigger
size (``maxFilesPerTrigger``) bounds how many rows there can be; windows are made
for `SLICE` rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.operators.phases import INDICATOR_WEIGHTS, MIN_LENGTH, SENSITIVITY, WINDOW

MEMORY = 10
SLICE = 10_000
PACKS = 4096
TINY = 1e-8


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")


def frames(kept: np.ndarray, new: np.ndarray, width: int) -> np.ndarray:
    """For each new value the `width` values up to it, as a row; NaN where there are fewer."""
    head = kept[-(width - 1) :] if width > 1 else kept[:0]
    padded = np.concatenate([np.full(width - 1 - len(head), np.nan), head, new])
    return np.lib.stride_tricks.sliding_window_view(padded, width)


class _Keyed(StatefulProcessor):
    """A processor whose state is one row per key."""

    state = ""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", self.state, self.ttl_ms)

    def close(self) -> None:
        pass


class Forgetting(_Keyed):
    """Share of rises among the last 10 losses."""

    output = "user_id long, event_id long, forgetting double"
    state = "recent array<double>"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = np.array(self.kept.get()[0] if self.kept.exists() else [], dtype=float)
        batch = _ordered(rows)
        losses = batch["loss"].to_numpy(float)
        seen = np.minimum(len(recent) + np.arange(1, len(losses) + 1), MEMORY)
        rises = (np.diff(frames(recent, losses, MEMORY), axis=1) > 0).sum(axis=1)
        share = np.where(seen > 1, rises / np.maximum(seen - 1, 1), 0.0)
        self.kept.update((np.concatenate([recent, losses])[-MEMORY:].tolist(),))
        yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"].to_numpy(), "forgetting": share})


class SampleMemory(_Keyed):
    """Volatility and staleness of a sample, with the step counted per sample."""

    output = "user_id long, event_id long, step long, volatility double, staleness long"
    state = "recent array<double>, step bigint, last_selected bigint"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        past, first, chosen = self.kept.get() if self.kept.exists() else ([], 0, -1)
        recent, batch = np.array(past, dtype=float), _ordered(rows)
        values = batch["uncertainty"].to_numpy(float)
        steps = first + np.arange(len(values))
        picks = np.where(batch["selected"].to_numpy(bool), steps, -1)
        latest = np.maximum.accumulate(np.concatenate([[chosen], picks]))
        volatility = np.nanvar(frames(recent, values, MEMORY), axis=1)
        staleness = np.where(latest[:-1] >= 0, steps - latest[:-1], steps)
        self.kept.update((np.concatenate([recent, values])[-MEMORY:].tolist(), int(first + len(values)), int(latest[-1])))
        yield pd.DataFrame({
            "user_id": key[0], "event_id": batch["event_id"].to_numpy(), "step": steps, "volatility": volatility, "staleness": staleness,
        })


class OrderedSampleMemory(StatefulProcessor):
    """`SampleMemory` in event time: rows wait in list state until the watermark has passed them, so they count in the order
    of their time however the files bring them.

    The key is a pack of samples, not a sample: a call, a timer and a state value cost the same for one row as for
    thousands, so `process_in_order` deals samples to a fixed number of packs and a pack is scored at once. Rows wait as binary
    records, a list element for each Arrow batch.

    A timer stands at a pack's earliest waiting row. When the watermark reaches it, all
    rows that it passed are put in order, scored and dropped from the list. A sample that
    is quiet for longer than `ttl_ms` of event time starts anew; what was kept of it goes with the next rows scored in its pack, or by
    a timer once the watermark is that far past the pack's last row, so state does not
    outlive the samples. Rows later than the watermark are dropped by Spark.
    """

    output = "user_id long, event_id long, step long, volatility double, staleness long"
    row = np.dtype([("key", "<i8"), ("at", "<i8"), ("id", "<i8"), ("value", "<f8"), ("flags", "i1")])
    sample = np.dtype([("key", "<i8"), ("recent", "<f8", (MEMORY - 1,)), ("step", "<i8"), ("latest", "<i8"), ("seen", "<i8")])
    selected, named = 1, 2

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "samples binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            records = np.empty(len(batch), dtype=self.row)
            for name in self.row.names:
                records[name] = batch[name].to_numpy()
            self.waiting.appendValue((records.tobytes(),))
            low = int(records["at"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self._wake(self._due(first))
        return iter(())

    @staticmethod
    def _due(at: int) -> int:
        """The first millisecond that is not before a row; a timer fires once the watermark is there."""
        return -(-at // 1000)

    def _wake(self, at_ms: int, passed: int | None = None) -> None:
        """One timer for a key: at its earliest waiting row, or at the end of its time to live. Those that fire now are still listed."""
        timers = [t for t in self.handle.listTimers() if passed is None or t > passed]
        if not timers or at_ms < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        stored = list(self.waiting.get()) if self.waiting.exists() else []
        rows = np.concatenate([np.empty(0, dtype=self.row), *(np.frombuffer(r[0], dtype=self.row) for r in stored)])
        due, later = rows[rows["at"] <= 1000 * passed], rows[rows["at"] > 1000 * passed]
        kept = np.frombuffer(self.kept.get()[0] if self.kept.exists() else b"", dtype=self.sample)
        out, kept = self._scored(due, kept) if len(due) else ([], kept)
        kept = kept[kept["seen"] // 1000 + self.ttl_ms >= passed]
        if len(due) and len(later):
            self.waiting.put([(later[a : a + SLICE].tobytes(),) for a in range(0, len(later), SLICE)])
        elif len(due):
            self.waiting.clear()
        if len(kept):
            self.kept.update((kept.tobytes(),))
        else:
            self.kept.clear()
        if len(later):
            self._wake(self._due(int(later["at"].min())), passed)
        elif len(kept):
            self._wake(max(int(kept["seen"].max()) // 1000 + self.ttl_ms, passed) + 1, passed)
        for some in out:
            yield some.assign(user_id=some["user_id"] if key[0] >= 0 else None)

    def _scored(self, rows: np.ndarray, kept: np.ndarray) -> tuple[Iterator[pd.DataFrame], np.ndarray]:
        """Scores of a pack's rows and its samples after them. A life is a run of a sample's rows without a long gap."""
        named = (rows["flags"] & self.named) > 0
        order = np.lexsort([rows["flags"], rows["value"], rows["id"], ~named, rows["at"], rows["key"]])
        rows, named, many, gap = rows[order], named[order], np.arange(len(rows)), 1000 * self.ttl_ms
        keys, at = rows["key"], rows["at"]
        firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        lasts = np.append(firsts[1:], len(rows)) - 1
        starts = np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[1:] - at[:-1] > gap)])
        begin, life = np.flatnonzero(starts), np.cumsum(starts) - 1

        # a life starts from what is kept of its sample, or from nothing
        state = np.zeros(len(begin), dtype=self.sample)
        state["recent"], state["latest"] = np.nan, -1
        known = np.isin(keys[firsts], kept["key"])
        old, heirs = kept[np.searchsorted(kept["key"], keys[firsts[known]])], firsts[known]
        goes_on = at[heirs] - old["seen"] <= gap
        state[life[heirs[goes_on]]] = old[goes_on]

        steps = state["step"][life] + many - begin[life]
        marks = np.maximum.accumulate(np.where((rows["flags"] & self.selected) > 0, many, -1))
        choice = lambda mark, of: np.where(mark >= begin[of], steps[mark], state["latest"][of])
        latest = choice(np.concatenate([[-1], marks[:-1]]), life)
        stale = np.where(latest >= 0, steps - latest, steps)
        # the values of each life in a line, behind those kept before them
        width = MEMORY - 1
        line, place = np.empty(len(rows) + width * len(begin)), many + width * (life + 1)
        line[place] = rows["value"]
        line[(begin + width * np.arange(len(begin)))[:, None] + np.arange(width)] = state["recent"]
        windows = np.lib.stride_tricks.sliding_window_view(line, MEMORY)

        after = np.zeros(len(lasts), dtype=self.sample)
        after["key"], after["step"], after["seen"] = keys[lasts], steps[lasts] + 1, at[lasts]
        after["latest"], after["recent"] = choice(marks[lasts], life[lasts]), line[place[lasts][:, None] - np.arange(width)[::-1]]
        both = np.concatenate([kept[~np.isin(kept["key"], after["key"])], after])

        def frames_of() -> Iterator[pd.DataFrame]:
            for a in range(0, len(rows), SLICE):
                some = slice(a, a + SLICE)
                spread = np.where(steps[some] > 0, np.nanvar(windows[place[some] - width], axis=1), 0.0)
                yield pd.DataFrame({
                    "user_id": keys[some], "event_id": pd.array(rows["id"][some], dtype="Int64"), "step": steps[some],
                    "volatility": spread, "staleness": stale[some],
                }).assign(event_id=lambda f, some=some: f["event_id"].where(named[some]))

        return frames_of(), both[np.argsort(both["key"])]

    def close(self) -> None:
        pass


def last_slope(windows: np.ndarray) -> np.ndarray:
    """Size of the newest difference over the spread of all slopes of a window: central inside, one-sided at its two ends."""
    ahead, behind = np.full_like(windows, np.nan), np.full_like(windows, np.nan)
    ahead[:, :-1] = behind[:, 1:] = np.diff(windows, axis=1)
    slopes = np.where(np.isnan(behind), ahead, np.where(np.isnan(ahead), behind, (ahead + behind) / 2))
    return np.abs(behind[:, -1]) / (np.nanstd(slopes, axis=1) + TINY)


class PhaseDetector(_Keyed):
    """The transition detector: five indicators of the last 50 values, their weighted score and its mean over five steps."""

    output = "user_id long, event_id long, score double, is_transition boolean, confidence double"
    series = ("norm", "alignment", "loss", "entropy", "bend", "score")
    state = ", ".join(f"{name} array<double>" for name in series)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        past = {name: np.empty(0) for name in self.series}
        if self.kept.exists():
            past = {name: np.array(v, dtype=float) for name, v in zip(self.series, self.kept.get(), strict=True)}
        batch = _ordered(rows)
        for at in range(0, len(batch), SLICE):
            some = batch.iloc[at : at + SLICE]
            new = {name: some[name].to_numpy(float) for name in ("norm", "alignment", "loss", "entropy")}
            # second difference of the three losses before a row, the plain one while there are only two
            losses = np.concatenate([np.full(3, np.nan), past["loss"], new["loss"]])
            before = np.lib.stride_tricks.sliding_window_view(losses, 3)[len(past["loss"]) : len(past["loss"]) + len(some)]
            plain = np.abs(before[:, 2] - before[:, 1])
            second = np.abs(before[:, 2] - 2 * before[:, 1] + before[:, 0])
            new["bend"] = np.nan_to_num(np.where(np.isnan(before[:, 0]), plain, second))
            new["score"] = self._scores(past, new)
            means = np.nanmean(frames(past["score"], new["score"], 5), axis=1)
            known = np.minimum(len(past["score"]) + np.arange(1, len(some) + 1), WINDOW)
            changed = (known >= MIN_LENGTH) & (means > SENSITIVITY)
            yield pd.DataFrame({
                "user_id": key[0], "event_id": some["event_id"].to_numpy(), "score": new["score"], "is_transition": changed,
                "confidence": np.where(changed, np.minimum(means / (2 * SENSITIVITY), 1.0), 0.0),
            })
            past = {name: np.concatenate([past[name], new[name]])[-WINDOW:] for name in self.series}
        self.kept.update(tuple(past[name].tolist() for name in self.series))

    @staticmethod
    def _scores(past: dict[str, np.ndarray], new: dict[str, np.ndarray]) -> np.ndarray:
        wide = {name: frames(past[name], new[name], WINDOW) for name in ("norm", "entropy", "alignment", "loss", "bend")}
        length = (~np.isnan(wide["norm"])).sum(axis=1)
        recent = {name: w[:, -5:].mean(axis=1) for name, w in wide.items()}
        earlier_bend = wide["bend"][:, -10:-5].mean(axis=1)
        now, then = wide["loss"][:, -10:].var(axis=1), wide["loss"][:, -20:-10].var(axis=1)
        found = {
            "norm_change": (5, last_slope(wide["norm"])),
            "entropy_change": (5, last_slope(wide["entropy"])),
            "alignment_drop": (5, np.maximum(0.0, recent["alignment"] - wide["alignment"][:, -1])),
            "curvature_shift": (10, np.abs(recent["bend"] - earlier_bend) / (earlier_bend + TINY)),
            "landscape_shift": (20, np.abs(now - then) / (then + TINY)),
        }
        # an indicator counts once its windows are full
        return sum(INDICATOR_WEIGHTS[name] * np.where(length >= least, value, 0.0) for name, (least, value) in found.items())


def process(stream: DataFrame, processor: StatefulProcessor, key: str = "user_id") -> DataFrame:
    """Run a processor over a stream keyed by `key`, with rows (key, ts, event_id, ...).

    State with a time to live needs a running trigger: Spark then keeps planning
    batches to expire it, so an ``availableNow`` run would not end.
    """
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=processor.output,
        outputMode="append",
        timeMode="processingtime" if processor.ttl_ms else "none",
    )


def process_in_order(
    stream: DataFrame, processor: OrderedSampleMemory, late: str, key: str = "user_id", ts: str = "ts", packs: int = PACKS
) -> DataFrame:
    """Run an event-time processor; rows may come up to `late` behind the newest one, those without a time are left out.

    Samples are dealt to `packs` packs by a hash, those without a key to one of their own. A pack's waiting rows and samples have
    to fit in a task's memory.
    """
    who, ident = F.col(key).cast("long"), F.col("event_id").cast("long")
    flags = F.coalesce(F.col("selected"), F.lit(False)).cast("int") + F.when(ident.isNotNull(), processor.named).otherwise(0)
    rows = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, late).select(
        F.when(who.isNull(), -1).otherwise(F.pmod(F.xxhash64(who), F.lit(packs))).cast("int").alias("pack"), ts,
        F.coalesce(who, F.lit(0)).alias("key"), F.unix_micros(ts).alias("at"), F.coalesce(ident, F.lit(0)).alias("id"),
        F.coalesce(F.col("uncertainty").cast("double"), F.lit(float("nan"))).alias("value"), flags.cast("byte").alias("flags"),
    )
    return rows.groupBy("pack").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="append", timeMode="eventtime",
    )
