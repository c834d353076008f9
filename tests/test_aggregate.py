"""The mice cascade by hand, and what it must preserve."""

import pytest
from pyspark.sql import functions as F

from helpers import at, collect, random_rows, table
from packetflow.operators import aggregate, flows, reports

# Default order: source address, destination address, source port, destination port.
SMALL = {"idle": "10 seconds"}


@pytest.fixture(scope="module")
def six(spark):
    """Six flows, threshold 1000: one large; two that reach it together at level 2; three that end at level 4."""
    rows = [
        {"t": 0, "src_ip": "10.0.0.1", "dst_ip": "192.168.0.1", "src_port": 1, "dst_port": 80, "ip_length": 1000},
        {"t": 1, "src_ip": "10.0.0.2", "dst_ip": "192.168.0.1", "src_port": 2, "dst_port": 80, "ip_length": 500, "tcp_flags": 2},
        {"t": 2, "src_ip": "10.0.0.3", "dst_ip": "192.168.0.2", "src_port": 2, "dst_port": 80, "ip_length": 500, "tcp_flags": 17},
        {"t": 3, "src_ip": "10.0.0.4", "dst_ip": "192.168.0.3", "src_port": 3, "dst_port": 81, "ip_length": 100},
        {"t": 4, "src_ip": "10.0.0.4", "dst_ip": "192.168.0.4", "src_port": 4, "dst_port": 82, "ip_length": 100},
        {"t": 5, "src_ip": "10.0.0.5", "dst_ip": "192.168.0.4", "src_port": 5, "dst_port": 83, "ip_length": 999, "protocol": 17},
    ]
    return flows.build_flows(table(spark, rows), **SMALL).cache()


def test_cascade(six):
    done = aggregate.aggregate_cascade(six, 1000)
    got = collect(done, "agg_level", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "octet_total", "distinct_src", "distinct_dst", "original_present")
    zero = "0.0.0.0"
    assert got == [
        (0, 6, "10.0.0.1", "192.168.0.1", 1, 80, 1000, 1, 1, 1),
        (2, 6, zero, zero, 2, 80, 1000, 2, 2, 2),
        (4, 17, zero, zero, 0, 0, 999, 1, 1, 1),
        (4, 6, zero, zero, 0, 0, 200, 1, 2, 2),
    ]
    level2 = done.where("agg_level = 2")
    assert collect(level2, "flow_start", "flow_end", "syn_count", "fin_count", "original_initiated", "original_completed") == [
        (at(1), at(2), 1, 1, 1, 1)
    ]
    assert collect(level2, "distinct_src_v4", "distinct_src_v6", "distinct_dst_v4", "last_tcp_flags") == [(2, 0, 2, 17)]


@pytest.mark.parametrize("distinct", ["approx", "additive", None])
def test_other_distinct_rules(six, distinct):
    done = aggregate.aggregate_cascade(six, 1000, distinct=distinct)
    assert collect(done, "agg_level", "octet_total") == [(0, 1000), (2, 1000), (4, 200), (4, 999)]
    if distinct == "approx":
        assert collect(done.where("agg_level > 0"), "octet_total", "distinct_src", "distinct_dst") == [(1000, 2, 2), (200, 1, 2), (999, 1, 1)]
    elif distinct == "additive":
        assert collect(done.where("agg_level > 0"), "octet_total", "distinct_src") == [(1000, 2), (200, 2), (999, 1)]
    else:
        assert "distinct_src" not in done.columns


def test_finished_only(six):
    done = aggregate.aggregate_finished(six, 1000)
    assert collect(done, "agg_level", "src_ip", "octet_total") == [
        (0, "10.0.0.1", 1000), (0, "10.0.0.2", 500), (0, "10.0.0.4", 100), (0, "10.0.0.4", 100), (0, "10.0.0.5", 999),
        (1, "0.0.0.0", 500),
    ]


def test_split_mice_keeps_the_edge(six):
    small, large = aggregate.split_mice(six, 999)
    assert collect(large, "octet_total") == [(1000,), (999,)]
    assert small.count() == 4


def test_reduce_key_by_version(spark):
    rows = [{"t": 0}, {"t": 1, "ip_version": 6, "src_ip": "2001:db8::1", "dst_ip": "2001:db8::2"}]
    built = flows.build_flows(table(spark, rows), **SMALL)
    assert collect(aggregate.reduce_key(built, (8, 28, 4)), "protocol", "src_ip", "dst_ip") == [
        (0, "0.0.0.0", "192.168.0.1"), (0, "2001:db8::1", "::"),
    ]
    assert collect(aggregate.reduce_key(built, (827, 1228), 1), "src_ip", "dst_ip") == [("0.0.0.0", "192.168.0.1"), ("::", "2001:db8::2")]
    with pytest.raises(ValueError, match="cannot be reduced"):
        aggregate.reduce_key(built, (5,))


def test_every_trigger_apart(spark):
    rows = [{"t": t, "src_ip": f"10.0.0.{i}", "src_port": i} for i, t in enumerate([0, 1, 61])]
    built = flows.build_flows(table(spark, rows), **SMALL)
    done = aggregate.aggregate_every(built, "1 minute", octets=1000)
    assert collect(done, "trigger", "original_present", "distinct_src") == [(at(0), 2, 2), (at(60), 1, 1)]


def test_auto_starts_at_three_quarters_and_stays_on(spark):
    long = [{"t": t, "src_port": p} for p in range(4) for t in (10 * p, 200)]
    rows = long + [{"t": 5, "src_port": 100}, {"t": 95, "src_port": 101}, {"t": 300, "src_port": 102}]
    built = flows.build_flows(table(spark, rows), idle="1 hour")
    counts = reports.active_flow_count(built, "10 seconds", "1 hour")
    assert collect(counts, "bucket_start", "active")[:4] == [(at(0), 2), (at(10), 3), (at(20), 4), (at(30), 5)]
    done = aggregate.aggregate_auto(built, 4, "10 seconds", "1 hour", octets=10_000)
    got = collect(done.groupBy("agg_level").agg(F.sum("original_present").alias("n"), F.min("flow_end").alias("first")), "agg_level", "n", "first")
    assert got == [(0, 1, at(5)), (4, 6, at(95))]
    never = aggregate.aggregate_auto(built, 400, "10 seconds", "1 hour", octets=10_000)
    assert collect(never.select("agg_level").distinct(), "agg_level") == [(0,)]


@pytest.mark.parametrize("salts", [1, 5])
def test_octets_and_endpoints_are_preserved(spark, salts):
    built = flows.build_flows(table(spark, random_rows(9, 400)), "5 seconds").cache()
    done = aggregate.aggregate_cascade(built, 3000, reduce=(827, 7, 1228, 11), salts=salts).cache()
    for name in ("octet_total", "packet_total", "original_present"):
        assert done.agg(F.sum(name)).first()[0] == built.agg(F.sum(name)).first()[0]
    merged = done.where("agg_level > 0")
    assert merged.where("distinct_src > original_present OR distinct_src < 1").count() == 0
    # Merged once more by hand: the last level holds exactly the remaining mice of its key.
    assert merged.where("agg_level < 4 AND octet_total < 3000").count() == 0


def test_bad_options(six):
    for bad in ({"scope": "some"}, {"distinct": "maybe"}, {"reduce": ()}, {"reduce": (4, 7, 8, 11, 12)}):
        with pytest.raises(ValueError):
            aggregate.aggregate_cascade(six, 1000, **bad)
    with pytest.raises(ValueError):
        aggregate.aggregate_auto(six, 0, "1 second", "1 second")
