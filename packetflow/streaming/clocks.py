"""Clock fits and corrected packet times on a stream.

Clock samples and packets of an observation point share one state and are handled in event-time order: the newest samples (a ring, as many as a
fit takes), the point's first sample, and the line in force.  A packet takes the line of the newest sample at or before it, as
``clock_as_of`` finds it in a table; samples and packets may come in any order within the lateness.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from packetflow.operators.clock import FIT_ROWS, clock_offset, correct_time
from packetflow.streaming.flows import LATE, keep_state_in_rocksdb
from packetflow.streaming.state import Waiting, only_timer

_LINE = ["slope", "intercept", "x0", "y0"]


#: Lines that are fitted side by side: each takes as much memory as the samples it is fitted to.
AT_ONCE = 4_096


def fitted(x: np.ndarray, y: np.ndarray, rows: int, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares lines over the newest ``rows`` samples, after each of the last ``fresh``: slope, intercept (NaN without two times), count."""
    parts = [_lines(x[: start + AT_ONCE], y[: start + AT_ONCE], rows, min(AT_ONCE, len(x) - start)) for start in range(len(x) - fresh, len(x), AT_ONCE)]
    return tuple(np.concatenate(part) for part in zip(*parts))


def _lines(x: np.ndarray, y: np.ndarray, rows: int, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = x[-(fresh + rows - 1) :], y[-(fresh + rows - 1) :]
    pad = np.full(rows - 1, np.nan)
    windows = [np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, v]), rows)[len(v) - fresh :] for v in (x, y)]
    there = ~np.isnan(windows[0])
    n = there.sum(axis=1)
    x, y = (np.where(there, w, 0.0) for w in windows)
    mx, my = x.sum(axis=1) / n, y.sum(axis=1) / n
    dx, dy = np.where(there, x - mx[:, None], 0.0), np.where(there, y - my[:, None], 0.0)
    square = (dx * dx).sum(axis=1)
    slope = np.where(square > 0, (dx * dy).sum(axis=1) / np.where(square > 0, square, 1.0), np.nan)
    return slope, my - slope * mx, n


class _Clock(StatefulProcessor):
    """Packets with their line (``lines`` false), or the samples with theirs."""

    def __init__(self, columns: list[str], rows: int, lines: bool):
        self.columns, self.rows, self.lines = columns, rows, lines

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle)
        self.ring = handle.getListState("ring", "t3 long, drift long")
        self.first = handle.getValueState("first", "t3 long, drift long")
        self.line = handle.getValueState("line", "slope double, intercept double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = (pa.RecordBatch.from_pandas(frame, preserve_index=False) for frame in rows if len(frame))
        yield from self.advance(batches, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance([], timerValues.getCurrentWatermarkInMs() * 1000)

    def advance(self, fresh: Iterable[pa.RecordBatch], mark: int) -> Iterator[pd.DataFrame]:
        for passed, _ in self.waiting.passed(fresh, mark):
            # At one instant samples come before packets.
            out = self.step(passed.sort_by([("t", "ascending"), ("kind", "ascending"), ("t3", "ascending"), ("id", "ascending")]))
            if out is not None and len(out):
                yield out
        only_timer(self.handle, self.waiting.due(mark))

    def step(self, rows: pa.Table) -> pd.DataFrame | None:
        packet = rows.column("kind").to_numpy() == 1
        at = np.flatnonzero(~packet)
        t3, drift = rows.column("t3").to_numpy()[at], rows.column("drift").to_numpy()[at]
        old = np.array(list(self.ring.get()) if self.ring.exists() else [], np.int64).reshape(-1, 2)
        first = self.first.get() if self.first.exists() else None
        if first is None and len(at):
            first = (int(t3[0]), int(drift[0]))
            self.first.update(first)
        before = self.line.get() if self.line.exists() else None
        slope, intercept, count = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        if len(at):
            x = np.concatenate([old[:, 0], t3])
            y = np.concatenate([old[:, 1], drift])
            slope, intercept, count = fitted((x - first[0]).astype(np.float64), (y - first[1]).astype(np.float64), self.rows, len(at))
            self.ring.put([(int(a), int(b)) for a, b in zip(x[-(self.rows - 1) :], y[-(self.rows - 1) :])])
            known = np.flatnonzero(~np.isnan(slope))
            if len(known):
                self.line.update((float(slope[known[-1]]), float(intercept[known[-1]])))
        if self.lines:
            frame = rows.take(pa.array(at)).select(self.columns).to_pandas()
            return frame.assign(slope=slope, intercept=intercept, x0=first[0], y0=first[1], samples=count) if len(at) else None
        # The newest known line before each packet; -1: the one in force before these rows.
        ordinal = np.full(len(packet), -1)
        ordinal[at[~np.isnan(slope)]] = np.flatnonzero(~np.isnan(slope))
        newest = np.maximum.accumulate(ordinal)[packet]
        held = before if before is not None else (np.nan, np.nan)
        frame = rows.filter(pa.array(packet)).select(self.columns).to_pandas()
        frame["slope"] = np.append(slope, held[0])[newest]
        frame["intercept"] = np.append(intercept, held[1])[newest]
        frame["x0"], frame["y0"] = first if first is not None else (0, 0)
        return frame


def _with_samples(sync: DataFrame, packets: DataFrame | None, late: str, rows: int):
    """Samples and packets under common columns, by observation point."""
    offsets = clock_offset(sync) if "drift" not in sync.columns else sync
    names = [f"c{i}" for i in range(len((packets if packets is not None else offsets).columns))]
    common = lambda df, **values: df.select(*[v.alias(n) for n, v in values.items()])
    t = F.expr("(t3 + 999) div 1000")
    if packets is None:
        own = {n: F.col(c) for n, c in zip(names, offsets.columns)}
    else:
        own = {n: F.lit(None).cast(f.dataType) for n, f in zip(names, packets.schema)}
    both = common(offsets, **own, ts=F.timestamp_micros(t), t=t, kind=F.lit(0), id=F.col("seq").cast("bigint"), t3=F.col("t3"), drift=F.col("drift"), point=F.col("obs_point"))
    if packets is not None:
        own = {n: F.col(c) for n, c in zip(names, packets.columns)}
        zero = F.lit(0).cast("bigint")
        both = both.unionByName(common(packets, **own, ts=F.col("ts"), t=F.unix_micros("ts"), kind=F.lit(1), id=F.col("packet_id"), t3=zero, drift=zero, point=F.col("obs_point")))
    keep_state_in_rocksdb(sync.sparkSession)
    given = (packets if packets is not None else offsets).schema
    line = [T.StructField(n, T.DoubleType()) for n in _LINE[:2]] + [T.StructField(n, T.LongType()) for n in [*_LINE[2:], *(["samples"] if packets is None else [])]]
    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, given)] + line)
    grouped = both.withWatermark("ts", late).groupBy("point")
    done = grouped.transformWithStateInPandas(_Clock(names, rows, packets is None), out, "append", "EventTime")
    return done.toDF(*given.names, *[f.name for f in line])


def stream_drift_fit(sync: DataFrame, rows: int = FIT_ROWS, late: str = LATE) -> DataFrame:
    """``drift_fit`` of a stream of clock samples: each sample with its line, once the watermark has passed it."""
    if rows < 2:
        raise ValueError("a line needs at least two samples")
    return _with_samples(sync, None, late, rows).select("obs_point", "seq", "t3", "delay", "drift", "x0", "y0", F.nanvl("slope", F.lit(None)).alias("slope"), F.nanvl("intercept", F.lit(None)).alias("intercept"), "samples")


def stream_correct_time(packets: DataFrame, sync: DataFrame, rows: int = FIT_ROWS, late: str = LATE) -> DataFrame:
    """Packets of a stream with ``clock``, ``corrected_ns`` and ``corrected_ts``, by lines fitted to a stream of clock samples."""
    done = _with_samples(sync, packets, late, rows)
    known = F.col("slope").isNotNull() & ~F.isnan("slope")
    clocked = done.withColumn("clock", F.when(known, F.struct(*_LINE))).select(*packets.columns, "clock")
    return correct_time(clocked)
