"""Drift lines, as-of correction and one-way delay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at, collect, table
from packetflow.operators import clock
from packetflow.schemas import SYNC_SAMPLES

BASE = 1704067200 * 10**9


def samples(spark, drifts, step=10**9, point=1):
    """Exchanges with a symmetric 2 ms delay and the given drifts (ns)."""
    rows = []
    for i, drift in enumerate(drifts):
        t3 = BASE + i * step
        rows.append((point, i, t3 - 4_000_000, t3 - 2_000_000 - drift, t3))
    return spark.createDataFrame(rows, SYNC_SAMPLES)


def test_offset(spark):
    assert collect(clock.clock_offset(samples(spark, [500])), "delay", "drift") == [(2_000_000, 500)]


def test_drift_line_then_step(spark):
    """70 samples on a line of 3 ns per s, then a step: the fit uses the newest 60 samples."""
    drifts = [3 * i for i in range(70)] + [1_000_000 + 3 * i for i in range(70, 75)]
    fits = {r["seq"]: r for r in clock.drift_fit(samples(spark, drifts)).collect()}
    assert fits[0]["slope"] is None and fits[0]["samples"] == 1
    assert fits[1]["slope"] == pytest.approx(3e-9)
    assert fits[69]["slope"] == pytest.approx(3e-9) and fits[69]["samples"] == 60
    x, y = np.arange(15, 75) * 1e9, np.array(drifts[15:75], dtype=float)
    assert fits[74]["slope"] == pytest.approx(np.polyfit(x, y, 1)[0], rel=1e-9)


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sync = samples(spark, [int(v) for v in rng.integers(0, 10**6, 300)]).cache()
    whole = {r["seq"]: r["slope"] for r in clock.drift_fit(sync, rows=5).collect()}
    monkeypatch.setattr(clock, "BLOCK", 20)
    cut = {r["seq"]: r["slope"] for r in clock.drift_fit(sync, rows=5, chunk="7 seconds").collect()}
    assert len(cut) == 300 and whole.keys() == cut.keys()
    assert all(whole[s] is None or cut[s] == pytest.approx(whole[s], rel=1e-9, abs=1e-18) for s in whole)


@pytest.mark.parametrize("chunk,most_lines", [("1 second", 0), ("1 minute", 0), ("1 day", 0), ("1 day", clock.MOST_LINES)])
def test_as_of_and_correction(spark, chunk, most_lines):
    """The line in force is the newest at or before the packet; none before the second sample."""
    fits = clock.drift_fit(samples(spark, [1_000_000 * i for i in range(200)]))  # 1 ms per s
    packets = table(spark, [{"t": 0.5}, {"t": 1}, {"t": 150.25}, {"t": 500}, {"t": 5, "obs_point": 2}])
    timed = clock.correct_time(clock.clock_as_of(packets, fits, chunk=chunk, most_lines=most_lines))
    assert packets.columns == timed.columns[: len(packets.columns)]
    got = collect(timed, "packet_id", "corrected_ts")
    assert got == [(1, at(0.5)), (2, at(0.999)), (3, at(150.25 - 0.15025)), (4, at(499.5)), (5, at(5))]


def test_few_lines_leave_the_packets_where_they_are(spark):
    fits = clock.drift_fit(samples(spark, [10**6 * i for i in range(50)] + [7]))
    plan = clock.clock_as_of(table(spark, [{"t": 0.5}]), fits)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2  # both over the lines
    assert "strategy=broadcast" in plan and "Sort" not in plan
    lines = [(1, 0, 5), (1, 1, 5), (1, 2, 9)]  # two lines at one instant: the later one counts
    fits = spark.createDataFrame([(p, s, (BASE // 1000 + t) * 1000, float(s), 0.0, 0, 0) for p, s, t in lines], "obs_point int, seq long, t3 long, slope double, intercept double, x0 long, y0 long")
    packets = table(spark, [{"t": t / 1e6} for t in (4, 5, 8, 9, 1000)])
    for most in (0, clock.MOST_LINES):
        assert collect(clock.clock_as_of(packets, fits, most_lines=most), "packet_id", "clock.slope") == [(1, None), (2, 1.0), (3, 1.0), (4, 2.0), (5, 2.0)]


def test_precision(spark):
    row = clock.time_precision(table(spark, [{"t": 1.234567}])).first()
    assert (row["seconds"], row["millis"]) == (1704067201, 1704067201234)
    assert (row["micros"], row["nanos"]) == (1704067201234567, 1704067201234567000)


@pytest.mark.parametrize("hot_rows", [10**6, 2])
def test_one_way_delay(spark, hot_rows):
    """The newest packet with the digest at a, within the limit; equal digests give no pair list."""
    rows = [
        {"t": 0, "obs_point": 1}, {"t": 0.010, "obs_point": 2}, {"t": 1, "obs_point": 1}, {"t": 1.020, "obs_point": 2},
        {"t": 9, "obs_point": 2}, {"t": 1.005, "obs_point": 3}, {"t": 20, "obs_point": 1}, {"t": 20, "obs_point": 2},
    ]
    packets = table(spark, rows).withColumn("packet_digest", F.lit("d"))
    got = clock.one_way_delay(packets, 1, 2, "5 seconds", chunk="1 second", hot_rows=hot_rows)
    assert collect(got, "packet_id_a", "packet_id_b", "delay_us") == [(1, 2, 10_000), (3, 4, 20_000), (7, 8, 0)]
