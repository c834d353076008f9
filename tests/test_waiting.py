"""Rows that wait on a stream are handed over in bounded pieces."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from packetflow.operators import measures as M
from packetflow.streaming import clocks, samples, state


class Stored:
    """A list, value or map of a handle, in memory."""

    def __init__(self):
        self.held = None

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held if isinstance(self.held, tuple) else iter(list(self.held or []))

    def put(self, rows):
        self.held = list(rows)

    def update(self, row):
        self.held = row

    def clear(self):
        self.held = None

    def getValue(self, key):
        return (self.held or {}).get(key)

    def updateValue(self, key, value):
        self.held = {**(self.held or {}), key: value}

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, *_):
        return self.states.setdefault(name, Stored())

    getValueState = getMapState = getListState

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.fixture
def small(monkeypatch):
    """Runs, blocks and pieces of few rows."""
    for name, rows in (("RUN", 100), ("BLOCK", 10), ("PIECE", 50)):
        monkeypatch.setattr(state, name, rows)


def batches(rows, size=30):
    return [pa.RecordBatch.from_pandas(rows.iloc[at : at + size], preserve_index=False) for at in range(0, len(rows), size)]


def packets(count, seed=1, span=5_000):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"t": rng.integers(0, span, count), "id": np.arange(count), "c0": [None if i % 40 < 30 else "x" for i in range(count)]})


def test_pieces_are_whole_in_order_and_bounded(small):
    rows = packets(3_000)
    waiting = state.Waiting(Handle())
    assert list(waiting.passed(batches(rows.iloc[:2_000]), -1)) == [] and waiting.first == rows.t.iloc[:2_000].min()
    seen = []
    for fresh, mark, come in ((rows.iloc[2_000:2_990], 2_000, 2_990), (rows.iloc[2_990:], 2_500, 3_000), (rows.iloc[:0], 2_600, 3_000), (rows.iloc[:0], 9_000, 3_000)):
        reached = -1
        for piece, upto in waiting.passed(batches(fresh), mark):
            t = piece.column("t").to_numpy()
            assert reached < t.min() <= t.max() <= upto <= mark and piece.num_rows <= 400
            seen += piece.column("id").to_pylist()
            reached = upto
        left = rows.iloc[:come].query("t > @mark")
        assert waiting.first == (left.t.min() if len(left) else None) and sorted(seen) == rows.iloc[:come].query("t <= @mark").id.tolist()
    assert sorted(seen) == list(range(3_000)) and waiting.first is None
    assert not waiting.index.exists() and not waiting.blocks.exists()


def test_an_instant_stays_in_one_piece(small):
    rows = packets(600, span=3)
    waiting = state.Waiting(Handle())
    assert list(waiting.passed(batches(rows), -1)) == []
    got = [np.unique(piece.column("t").to_numpy()).tolist() for piece, _ in waiting.passed([], 10)]
    assert sum(got, []) == [0, 1, 2]


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def run(processor, rows):
    """All rows in two micro-batches without a watermark, then one that closes everything."""
    processor.init(Handle())
    out = []
    for part, ms in ((rows.iloc[::2], 0), (rows.iloc[1::2], 0), (rows.iloc[:0], 10**9)):
        out += processor.handleInputRows(None, iter([part.iloc[at : at + 30] for at in range(0, len(part), 30)]), Mark(ms))
    return out


def flow_rows(count, seed):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"k": [f"k{i}" for i in rng.integers(0, 12, count)], "t": rng.integers(1, 3_000, count) * 1_000, "packet_id": np.arange(count)})
    return rows.assign(orient=rng.integers(1, 3, count), fin=(rng.random(count) < 0.1).astype(int), tcp=1, f0=rng.integers(0, 3, count), f1=0, f2=0, f3=0, v0=1, v1=rng.integers(0, 3, count), flush=0)


@pytest.mark.parametrize("on_time", [False, True])
def test_flows_do_not_depend_on_the_pieces(monkeypatch, on_time):
    rows = flow_rows(1_500, 4)
    order = {c: "" if c == "k" else state.NOTHING for c in rows.columns}
    rows = pd.concat([rows, pd.DataFrame([{**order, "t": 1_234_000, "flush": 1}])], ignore_index=True)
    rules = state.Rules(60_000, 40_000, 2, [("packets", 0, M.SUM, M.TOTAL, None), ("last", 1, M.LAST_OF, M.LATEST, None)], on_time)
    got = []
    for piece in (10**6, 50):
        monkeypatch.setattr(state, "RUN", 2 * piece), monkeypatch.setattr(state, "BLOCK", 10), monkeypatch.setattr(state, "PIECE", piece)
        parts = run(state.FlowStates(rules), rows)
        assert (len(parts) > 10) == (piece == 50)
        done = pd.concat(parts).sort_values(["k", "flow_no", "slice", "_last_t"]).reset_index(drop=True)
        got.append(done.astype(object).where(done.notna(), None))
    assert set(got[0].end_reason) == {1, 2, 3, 4} and got[0].equals(got[1])


def test_samples_and_lines_do_not_depend_on_the_pieces(monkeypatch):
    rows = packets(2_000).assign(t=lambda f: f.t * 1_000, draw=lambda f: [f"{i * 7919 % 2003:05d}" for i in f.id])
    clock = rows.assign(kind=rows.id % 3 % 2, t3=rows.t * 1000, drift=rows.id * rows.id % 1013)
    makers = [lambda: samples._InARow(["id"], 3, 7, False), lambda: samples._Drawn(["id"], 2, 9), lambda: clocks._Clock(["id"], 5, True), lambda: clocks._Clock(["id"], 5, False)]
    for make in makers:
        got = []
        for piece in (10**6, 50):
            monkeypatch.setattr(state, "RUN", 2 * piece), monkeypatch.setattr(state, "BLOCK", 10), monkeypatch.setattr(state, "PIECE", piece)
            parts = run(make(), clock if isinstance(make(), clocks._Clock) else rows)
            assert max(len(p) for p in parts) <= (10**6 if piece > 50 else 400)
            got.append(pd.concat(parts, ignore_index=True))
        assert len(got[0]) > 400 and got[0].equals(got[1])


def test_lines_are_fitted_a_bounded_number_at_once(monkeypatch):
    x, y = np.arange(50.0), np.arange(50.0) ** 2
    whole = clocks.fitted(x, y, 9, 41)
    sizes, lines = [], clocks._lines
    monkeypatch.setattr(clocks, "AT_ONCE", 7)
    monkeypatch.setattr(clocks, "_lines", lambda a, b, rows, fresh: sizes.append(fresh) or lines(a, b, rows, fresh))
    for a, b in zip(clocks.fitted(x, y, 9, 41), whole):
        assert np.array_equal(a, b, equal_nan=True)
    assert max(sizes) == 7 and sum(sizes) == 41


def test_a_digest_seen_often_is_looked_up_and_not_joined(small):
    """Each sighting meets one earlier sighting: rows of a step are those that came, and none is joined with all of its digest."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"k": [f"d{i}" for i in rng.integers(0, 4, 900)], "t": rng.integers(1, 400, 900) * 1_000, "packet_id": np.arange(900), "side": rng.integers(0, 2, 900)})
    got = pd.concat(run(state.Delays(2_000), pd.concat([rows, rows[rows.side == 1].iloc[:50]], ignore_index=True)))
    first = [r for r in rows.itertuples() if r.side == 0]
    want = []
    for r in rows[rows.side == 1].itertuples():
        near = [(a.t, a.packet_id) for a in first if a.k == r.k and 0 <= r.t - a.t <= 2_000]
        if near:
            want.append((r.k, max(near)[1], r.packet_id, r.t - max(near)[0]))
    assert len(want) > 200 and sorted(got.itertuples(index=False, name=None)) == sorted(want)
