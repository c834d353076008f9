"""Streams replayed over files agree with the batch operators."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import EPOCH, collect, random_rows, table
from packetflow.operators import clock, flows, keys, rtt, sampling
from packetflow.sources.packets import stream_packets
from packetflow.sources.sinks import stream_flows_to, write_flows
from packetflow.streaming import flows as streaming
from packetflow.streaming import clocks, samples
from packetflow.streaming.late import LateRows

IDLE, ACTIVE, LATE = "20 seconds", "15 seconds", "30 seconds"
FIELDS = [
    "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "dns_id", "slice", "end_reason", "flow_start", "flow_end",
    "start_after_export", "packet_total", "octet_total", "packet_delta", "octet_delta", "octet_sum_squares", "fin_count",
    "syn_count", "psh_count", "ack_count", "retransmitted_packets", "retransmitted_octets",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Packets in several files, disordered within the lateness, and a last one far ahead that closes everything."""
    path = str(tmp_path_factory.mktemp("packets"))
    packets = table(spark, random_rows(21, 300)).drop("ip_bytes").cache()
    arrival = F.unix_micros("ts") - 1704067200 * 10**6 + F.pmod("packet_id", F.lit(5)) * 2_000_000
    files = packets.withColumn("file", F.least(F.lit(3), F.floor(arrival / 150_000_000)))
    for number in range(4):  # one after the other: files are read in order of their age
        files.where(F.col("file") == number).drop("file").coalesce(1).write.mode("append").parquet(f"{path}/p")
    end = table(spark, [{"t": 2000, "src_ip": "10.9.9.9", "packet_id": 10**6}]).drop("ip_bytes")
    end.coalesce(1).write.mode("append").parquet(f"{path}/p")
    return f"{path}/p"


@pytest.fixture(scope="module")
def packets(spark, folder):
    return spark.read.parquet(folder).cache()


def stream(spark, folder):
    return stream_packets(spark, folder, schema=spark.read.parquet(folder).schema, maxFilesPerTrigger=1)


def drain(spark, df, tmp_path, name):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name), query


def test_flows(spark, folder, packets, tmp_path):
    got, _ = drain(spark, streaming.stream_flows(stream(spark, folder), IDLE, ACTIVE, LATE, biflow=True), tmp_path, "flows_done")
    want = flows.build_flows(packets, IDLE, active=ACTIVE, biflow=True).where("src_ip <> '10.9.9.9'")
    assert want.where("end_reason = 2").count() > 5
    assert got.dtypes == want.dtypes
    # Every column, so every measure, and the number of the flow.
    assert collect(got.where("src_ip <> '10.9.9.9'"), *got.columns) == collect(want, *got.columns)


def test_idle_sessions(spark, folder, packets, tmp_path):
    got, _ = drain(spark, streaming.stream_flows_idle(stream(spark, folder), IDLE, LATE), tmp_path, "idle_done")
    want = flows.build_flows(packets, IDLE, fin=False).where("src_ip <> '10.9.9.9'")
    fields = ["flow_start", "flow_end", "packet_total", "octet_total", "octet_sum_squares"]
    assert collect(got, *fields) == collect(want, *fields)


def test_pairs_stay_within_a_flow(spark, folder, packets, tmp_path):
    got, _ = drain(spark, streaming.stream_rtt(stream(spark, folder), "5 seconds", LATE, IDLE), tmp_path, "rtt_done")
    fields = ["packet_id", "matched_id", "direction", "delay_us"]
    want = rtt.rtt_pairs(flows.split_flows(keys.flow_key(packets, biflow=True), IDLE), "5 seconds")
    assert want.count() > 20 and collect(got, *fields) == collect(want, *fields)
    loose = rtt.rtt_pairs(flows.split_flows(keys.flow_key(packets, biflow=True), "1 day", fin=False), "5 seconds")
    assert loose.count() > want.count()  # some pairs would cross the end of a flow


def arriving(spark, path, *files):
    """Packets in files that a stream reads one after the other."""
    for rows in files:
        table(spark, rows).drop("ip_bytes").coalesce(1).write.mode("append").parquet(path)
    return stream(spark, path)


def test_silent_flows_report_on_time(spark, tmp_path):
    """Active periods of 15 s, idle after 20 s: nothing but another key moves the clock."""
    a = {"src_port": 1, "ip_length": 100}
    rows = arriving(spark, str(tmp_path / "p"), [{"t": 0, "packet_id": 1, **a}, {"t": 4, "packet_id": 2, **a}, {"t": 46, "packet_id": 3, "src_port": 2}], [{"t": 100, "packet_id": 4, "src_port": 2}], [{"t": 101, "packet_id": 5, "src_port": 2}])
    for on_time, want in ((False, [(0, 1, 2, 2)]), (True, [(0, 2, 2, 2), (1, 1, 2, 0)])):
        done = streaming.stream_flows(rows, IDLE, ACTIVE, LATE, measures=["packet_total", "packet_delta"], on_time=on_time, buckets=3)
        got, _ = drain(spark, done, tmp_path / str(on_time), f"silent_{on_time}")
        assert collect(got.where("src_port = 1"), "slice", "end_reason", "packet_total", "packet_delta") == want


def test_an_interim_record_leaves_before_the_next_packet(spark, tmp_path):
    """A flow goes on: its first period has left although the stream ends before the flow does."""
    a = {"src_port": 1}
    rows = arriving(spark, str(tmp_path / "p"), [{"t": 0, "packet_id": 1, **a}], [{"t": 46.5, "packet_id": 2, "src_port": 2}], [{"t": 46.6, "packet_id": 3, "src_port": 2}])
    done = streaming.stream_flows(rows, IDLE, ACTIVE, LATE, measures=["packet_total"], on_time=True, buckets=3)
    got, _ = drain(spark, done, tmp_path, "interim_early")
    assert collect(got, "src_port", "slice", "end_reason", "packet_total") == [(1, 0, 2, 1)]


def test_a_flush_equals_the_forced_end_at_that_time(spark, folder, packets, tmp_path):
    at = packets.where("src_ip <> '10.9.9.9'").agg(F.expr("percentile_approx(ts, 0.6)")).first()[0]
    source = stream(spark, folder)
    first = packets.orderBy("ts").first()["packet_id"]
    orders = source.where(F.col("packet_id") == first).select(F.lit(at).alias("ts"))
    got, _ = drain(spark, streaming.stream_flows(source, IDLE, ACTIVE, LATE, biflow=True, control=orders), tmp_path, "flushed")
    before = flows.build_flows(packets.where(F.col("ts") <= F.lit(at)), IDLE, active=ACTIVE, biflow=True, horizon=at)
    after = flows.build_flows(packets.where(F.col("ts") > F.lit(at)), IDLE, active=ACTIVE, biflow=True)
    assert before.where("end_reason = 4").count() > 3
    shown = lambda df: df.where("src_ip <> '10.9.9.9'")
    assert collect(shown(got), *FIELDS) == collect(shown(before.unionByName(after)), *FIELDS)
    assert collect(got.where("end_reason = 4"), *got.columns) == collect(before.where("end_reason = 4"), *got.columns)


def test_a_restart_goes_on_from_the_state(spark, folder, packets, tmp_path):
    """Two runs over one checkpoint, the second after the source has grown: one numbering, no record twice."""
    files = sorted(Path(folder).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    path, out = tmp_path / "p", str(tmp_path / "out")
    path.mkdir()
    for part in (files[:2], files[2:]):
        for f in part:
            (path / f.name).write_bytes(f.read_bytes())
            os.utime(path / f.name, ns=(f.stat().st_mtime_ns,) * 2)  # files are read in order of their age
        rows = stream_packets(spark, str(path), schema=packets.schema, maxFilesPerTrigger=1)
        done = streaming.stream_flows(rows, IDLE, ACTIVE, LATE, biflow=True, buckets=5)
        stream_flows_to(done, out, str(tmp_path / "c"), availableNow=True).awaitTermination()
    want = flows.build_flows(packets, IDLE, active=ACTIVE, biflow=True).where("src_ip <> '10.9.9.9'")
    got = spark.read.parquet(out).where("src_ip <> '10.9.9.9'")
    assert collect(got, "flow_no", *FIELDS) == collect(want, "flow_no", *FIELDS)


@pytest.mark.parametrize("scope", ["interface", "global"])
def test_counted_samples_are_those_of_the_table(spark, folder, packets, tmp_path, scope):
    table_ = packets.where("packet_id < 1000000")  # the last packet closes the stream and stays behind its watermark
    by = (lambda r: r.interface) if scope == "interface" else (lambda r: 0)
    for i, invert in enumerate((False, True)):
        got, _ = drain(spark, samples.stream_sample_count(stream(spark, folder), 3, 4, scope, invert, LATE), tmp_path / str(i), f"counted_{scope}_{i}")
        want = sampling.sample_count(table_, 3, 4, scope, invert)
        assert got.dtypes == want.dtypes and collect(got, *got.columns) == collect(want, *got.columns)
    got, _ = drain(spark, samples.stream_sample_n_of_N(stream(spark, folder), 2, 9, 5, scope, LATE), tmp_path / "n", f"drawn_{scope}")
    place, whole = {}, set()
    for r in table_.orderBy("ts", "packet_id").select("packet_id", "interface").collect():
        place.setdefault(by(r), []).append(r.packet_id)
    for ids in place.values():
        whole.update(ids[: len(ids) // 9 * 9])
    want = [r for r in collect(sampling.sample_n_of_N(table_, 2, 9, 5, scope), "packet_id") if r[0] in whole]
    assert len(want) > 40 and collect(got, "packet_id") == want


def test_late_packets_are_dropped_and_counted(spark, tmp_path):
    path = str(tmp_path / "p")
    for number, t in enumerate([0, 500, 510, 1, 1000]):
        table(spark, [{"t": t, "packet_id": number, "src_port": number}]).drop("ip_bytes").coalesce(1).write.mode("append").parquet(path)
    late = LateRows()
    spark.streams.addListener(late)
    try:
        got, query = drain(spark, streaming.stream_flows(stream(spark, path), IDLE, None, LATE), tmp_path, "late_done")
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        assert late.of(query) == 1
    finally:
        spark.streams.removeListener(late)
    assert collect(got, "src_port") == [(0,), (1,), (2,)]


def test_aggregate_and_sink(spark, folder, packets, tmp_path):
    done = streaming.stream_flows(stream(spark, folder), IDLE, None, LATE, biflow=True)
    query = streaming.stream_aggregate(done, str(tmp_path / "out"), str(tmp_path / "c1"), {"availableNow": True}, octets=3000, distinct=None)
    query.awaitTermination()
    total = packets.where("src_ip <> '10.9.9.9'").agg(F.count("*"), F.sum("ip_length")).first()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert tuple(stored.agg(F.sum("packet_total"), F.sum("octet_total")).first()) == tuple(total)
    assert {r[0] for r in stored.select("agg_level").distinct().collect()} >= {0, 4}
    assert not list(Path(spark.conf.get("spark.checkpoint.dir")).glob("packetflow-scratch-*"))  # nothing is left of a batch

    again = streaming.stream_flows(stream(spark, folder), IDLE, None, LATE, biflow=True)
    stream_flows_to(again, str(tmp_path / "sink"), str(tmp_path / "c2"), availableNow=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).agg(F.sum("packet_total")).first()[0] == total[0]


def test_write_flows_by_day(spark, tmp_path):
    rows = [{"t": 0}, {"t": 86400 * 2, "src_port": 9}]
    write_flows(flows.build_flows(table(spark, rows)), str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert collect(stored, "flow_date") == [(EPOCH.date(),), ((EPOCH + dt.timedelta(days=2)).date(),)]
    write_flows(flows.build_flows(table(spark, rows)), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4


def test_clock_lines_and_corrected_times(spark, folder, packets, tmp_path):
    """Samples and packets of two points, disordered within the lateness; more samples than a fit takes."""
    rows = [(1 + i % 2, i, 1704067200 * 10**9 + i * 3_000_000_000 + (i * 7919) % 1000) for i in range(200)]
    sync = spark.createDataFrame([(p, i, t - 4000 - i, t - 900 - i * i, t) for p, i, t in rows], "obs_point int, seq long, t1 long, t2 long, t3 long")
    path = str(tmp_path / "sync")
    for low in (0, 70, 140):
        sync.where((F.col("seq") >= low) & (F.col("seq") < low + 70)).coalesce(1).write.mode("append").parquet(path)
    samples_ = spark.readStream.schema(sync.schema).option("maxFilesPerTrigger", 1).parquet(path)
    mark = 1704067200 * 10**6 + 199 * 3_000_000 - 30_000_000
    got, _ = drain(spark, clocks.stream_drift_fit(samples_, 20, LATE), tmp_path / "fit", "lines_done")
    want = clock.drift_fit(sync, 20).where(F.expr(f"(t3 + 999) div 1000 <= {mark // 1000 * 1000}"))
    exact = ["obs_point", "seq", "t3", "delay", "drift", "x0", "y0", "samples"]
    assert want.count() > 180 and collect(got, *exact) == collect(want, *exact)
    a, b = ({r.seq: (r.slope, r.intercept) for r in df.collect()} for df in (got, want))
    assert all((a[k][0] is None) == (b[k][0] is None) for k in b)
    assert all(a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-3) for k in b if b[k][0] is not None)

    seen = packets.withColumn("obs_point", F.lit(1))
    timed = stream(spark, folder).withColumn("obs_point", F.lit(1))
    done, _ = drain(spark, clocks.stream_correct_time(timed, samples_, 20, LATE), tmp_path / "timed", "timed_done")
    batch = clock.correct_time(clock.clock_as_of(seen, clock.drift_fit(sync, 20)))
    near = {r.packet_id: r.corrected_ns for r in batch.collect()}
    rows = done.collect()
    assert len(rows) > 200 and all(abs(r.corrected_ns - near[r.packet_id]) <= 2 for r in rows)
