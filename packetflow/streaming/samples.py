"""Packet selection by running number, on a stream.

A task holds the counter of an interface (or of all, with the global scope).  Packets wait until the watermark has passed them, so that their
numbers follow event time, and come out with the columns they had.  The counter goes on from micro-batch to micro-batch and over restarts.
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

from packetflow.functions.scalars import hash_order
from packetflow.operators.sampling import _n_of_n_limits, _positive, _scope
from packetflow.streaming.flows import LATE, keep_state_in_rocksdb
from packetflow.streaming.state import Waiting, _bytes, only_timer


class _Numbered(StatefulProcessor):
    """Numbers packets in event-time order, from 1; subclasses pick some."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = (pa.RecordBatch.from_pandas(frame, preserve_index=False) for frame in rows if len(frame))
        yield from self.advance(batches, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance([], timerValues.getCurrentWatermarkInMs() * 1000)

    def advance(self, fresh: Iterable[pa.RecordBatch], mark: int) -> Iterator[pd.DataFrame]:
        before = count = self.count.get()[0] if self.count.exists() else 0
        for passed, _ in self.waiting.passed(fresh, mark):
            passed = passed.sort_by([("t", "ascending"), ("id", "ascending")])
            passed = passed.append_column("rank", pa.array(np.arange(count + 1, count + 1 + passed.num_rows)))
            count += passed.num_rows
            kept = self.pick(passed)
            if kept.num_rows:
                yield kept.select(self.columns).to_pandas()
        if count > before:
            self.count.update((count,))
        only_timer(self.handle, self.waiting.due(mark))

    def pick(self, packets: pa.Table) -> pa.Table:
        raise NotImplementedError


class _InARow(_Numbered):
    """``keep`` packets in a row of every ``period``."""

    def __init__(self, columns: list[str], keep: int, period: int, invert: bool):
        super().__init__(columns)
        self.keep, self.period, self.invert = keep, period, invert

    def pick(self, packets: pa.Table) -> pa.Table:
        rank = packets.column("rank").to_numpy()
        return packets.filter(pa.array(rank % self.period >= self.keep if self.invert else (rank - 1) % self.period < self.keep))


class _Drawn(_Numbered):
    """The ``n`` packets with the least draw of every ``N`` in a row; a run still open waits as the reservoir."""

    def __init__(self, columns: list[str], n: int, N: int):
        super().__init__(columns)
        self.n, self.N = n, N

    def init(self, handle) -> None:
        super().init(handle)
        self.reservoir = handle.getListState("reservoir", "rows binary")

    def pick(self, packets: pa.Table) -> pa.Table:
        held = [pa.ipc.open_stream(pa.py_buffer(row[0])).read_next_batch() for row in self.reservoir.get()] if self.reservoir.exists() else []
        rows = pa.concat_tables([*[pa.Table.from_batches([b]) for b in held], packets], promote_options="permissive").combine_chunks()
        run = (rows.column("rank").to_numpy() - 1) // self.N
        # A run is whole once its last number has come; the last run may be open.  Of an open run only the n least draws can stay.
        last = int(packets.column("rank")[-1].as_py())
        order = np.lexsort((rows.column("id").to_numpy(), np.array(rows.column("draw").to_pylist(), object).astype(str), run))
        run = run[order]
        place = np.arange(len(run)) - np.searchsorted(run, run)
        best = order[place < self.n]
        whole = (rows.column("rank").to_numpy()[best] - 1) // self.N < last // self.N
        stay = rows.take(pa.array(np.sort(best[~whole]))).combine_chunks()
        if stay.num_rows:
            self.reservoir.put([(_bytes(b),) for b in stay.to_batches()])
        else:
            self.reservoir.clear()
        return rows.take(pa.array(np.sort(best[whole])))


def _sampled(stream: DataFrame, scope: str, late: str, draw, make) -> DataFrame:
    by = _scope(scope)
    # The packets' own columns travel under plain names: Python gives those that begin with an underscore others.
    names = [f"c{i}" for i in range(len(stream.columns))]
    own = [F.col(c).alias(n) for c, n in zip(stream.columns, names)]
    scoped = F.coalesce(F.col(by[0]), F.lit("")) if by else F.lit("")
    rows = stream.select(*own, "ts", F.unix_micros("ts").alias("t"), F.col("packet_id").alias("id"), draw.alias("draw"), scoped.alias("scope")).withWatermark("ts", late)
    keep_state_in_rocksdb(stream.sparkSession)
    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, stream.schema)])
    return rows.groupBy("scope").transformWithStateInPandas(make(names), out, "append", "EventTime").toDF(*stream.columns)


def stream_sample_count(stream: DataFrame, keep: int, skip: int, scope: str = "interface", invert: bool = False, late: str = LATE) -> DataFrame:
    """``sample_count`` of a stream: the same packets, each once the watermark has passed it."""
    _positive(keep=keep, skip=skip)
    return _sampled(stream, scope, late, F.lit(""), lambda columns: _InARow(columns, keep, keep + skip, invert))


def stream_sample_n_of_N(stream: DataFrame, n: int, N: int, seed: int = 0, scope: str = "interface", late: str = LATE) -> DataFrame:
    """``sample_n_of_N`` of a stream: the same packets of every run of N that is whole; they leave when its last packet has."""
    _n_of_n_limits(n, N)
    return _sampled(stream, scope, late, hash_order(F.col("packet_id"), seed), lambda columns: _Drawn(columns, n, N))
