"""Splitting, numbering and measures on hand-made packets; hot keys; invariants."""

import pytest
from pyspark.sql import functions as F

from helpers import at, back, collect, random_rows, table
from packetflow.operators import flows, keys
from packetflow.operators.ordering import cut_into_chunks

HOT = {"hot_rows": 5}


def build(spark, rows, **options):
    options.setdefault("idle", "10 seconds")
    return flows.build_flows(table(spark, rows), **options)


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1, "chunk": "1 second"}, {"hot_rows": 1, "chunk": "10 seconds"}])
def test_gap_edge(spark, options):
    """A gap equal to the timeout continues, one microsecond more splits."""
    rows = [{"t": 1}, {"t": 11}, {"t": 21.000001}]
    got = collect(build(spark, rows, **options), "flow_no", "packet_total", "end_reason", "flow_start", "flow_end")
    assert got == [(1, 2, 1, at(1), at(11)), (2, 1, 4, at(21.000001), at(21.000001))]


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1, "chunk": "1 second"}])
def test_fin_then_ack(spark, options):
    """The packet after a FIN opens a new flow, in either direction; without biflow only its own direction."""
    rows = [{"t": 0}, {"t": 1, "tcp_flags": 17}, back({"t": 2}), {"t": 3}]
    both = build(spark, rows, biflow=True, **options)
    assert collect(both, "flow_no", "packet_total", "end_reason", "src_port", "fin_count") == [(1, 2, 3, 40000, 1), (2, 2, 4, 80, 0)]
    one = build(spark, rows, **options)
    assert collect(one, "src_port", "flow_no", "packet_total", "end_reason") == [(40000, 1, 2, 3), (40000, 2, 1, 4), (80, 1, 1, 4)]
    assert build(spark, rows, biflow=True, fin=False, **options).count() == 1


def test_fin_counts_only_for_tcp(spark):
    rows = [{"t": 0, "protocol": 17, "tcp_flags": 17}, {"t": 1, "protocol": 17, "tcp_flags": 17}]
    assert collect(build(spark, rows), "packet_total", "fin_count", "end_reason") == [(2, 0, 4)]


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1, "chunk": "3 seconds"}])
def test_long_flow(spark, options):
    """3.5 active periods, one of them empty: cumulative totals, deltas per record."""
    rows = [{"t": t, "ip_length": 100 + i} for i, t in enumerate([0, 1, 4.999999, 5, 16, 17])]
    built = build(spark, rows, idle="20 seconds", active="5 seconds", **options)
    got = collect(built, "slice", "end_reason", "packet_total", "packet_delta", "octet_total", "octet_delta", "start_after_export")
    assert got == [
        (0, 2, 3, 3, 303, 303, at(0)),
        (1, 2, 4, 1, 406, 103, at(5)),
        (3, 4, 6, 2, 615, 209, at(16)),
    ]
    full = build(spark, rows, idle="20 seconds", active="5 seconds", emit_empty=True, zero_final=True, **options)
    got = collect(full, "slice", "end_reason", "packet_total", "packet_delta", "octet_delta")
    assert got == [(0, 2, 3, 3, 303), (1, 2, 4, 1, 103), (2, 2, 4, 0, 0), (3, 4, 6, 0, 0)]


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1, "chunk": "1 second"}])
def test_reverse_first(spark, options):
    """A flow runs in the direction of its own first packet, whatever an earlier flow of the key did."""
    rows = [back({"t": 0}), {"t": 1}, {"t": 30}, back({"t": 31})]
    got = collect(build(spark, rows, biflow=True, **options), "flow_no", "src_port", "dst_port", "l3_length_fwd", "l3_length_bwd")
    assert got == [(1, 80, 40000, 100, 100), (2, 40000, 80, 100, 100)]


def test_dns_two_ids(spark):
    rows = []
    for i, t in ((1, 0), (2, 1)):
        query = {"t": t, "protocol": 17, "src_port": 5000, "dst_port": 53, "dns_id": i, "tcp_flags": 0}
        rows += [query, {**back(query), "t": t + 2, "dns_qr": 1}]
    assert collect(build(spark, rows, biflow=True), "dns_id", "packet_total") == [(1, 2), (2, 2)]
    assert collect(build(spark, rows, biflow=True, dns=False), "dns_id", "packet_total") == [(0, 4)]
    assert collect(build(spark, rows, all_protocols=True), "dns_id", "packet_total") == [(0, 4)]


def test_two_way_only_for_eligible_protocols(spark):
    rows = [{"t": 0, "protocol": 17}, back({"t": 1, "protocol": 17})]
    assert build(spark, rows, biflow=True).count() == 2
    assert build(spark, rows, all_protocols=True).count() == 1


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1, "chunk": "1 second"}])
def test_retransmit(spark, options):
    """Same seq, ack, payload length and flags as the previous packet of the flow."""
    rows = [{"t": 0, "tcp_seq": 5}, {"t": 1, "tcp_seq": 5, "ip_length": 60}, {"t": 2, "tcp_seq": 6}, {"t": 30, "tcp_seq": 6}]
    got = collect(build(spark, rows, **options), "flow_no", "retransmitted_packets", "retransmitted_octets")
    assert got == [(1, 1, 60), (2, 0, 0)]
    none = build(spark, rows, src_prefix="192.168.", **options)
    assert collect(none, "flow_no", "retransmitted_packets") == [(1, 0), (2, 0)]


def test_first_and_last_packet_values(spark):
    rows = [
        {"t": 0, "tos": 8, "src_mac": "0a:00:00:00:00:ff", "tcp_seq": 1, "app_id": 3},
        {"t": 1, "tos": 9, "src_mac": "0a:00:00:00:00:01", "tcp_seq": 2, "app_id": 0},
    ]
    packets = table(spark, rows).withColumn("packet_digest", F.md5(F.col("packet_id").cast("string")))
    built = flows.build_flows(packets, "10 seconds")
    (row,) = built.select("first_tos", "source_mac", "last_tcp_seq", "app_id", "first_packet_id", "last_packet_id").collect()
    assert tuple(row) == (8, "0a:00:00:00:00:ff", 2, 3, "c4ca4238a0b923820dcc509a6f75849b", "c81e728d9d4c2f636f067f89cc14862c")


def test_horizon(spark):
    rows = [{"t": 0}]
    assert collect(build(spark, rows, horizon=at(10)), "end_reason") == [(4,)]
    assert collect(build(spark, rows, horizon=at(10.000001)), "end_reason") == [(1,)]


def test_unknown_measure(spark):
    with pytest.raises(ValueError, match="unknown measures"):
        build(spark, [{"t": 0}], measures=["nothing"])
    with pytest.raises(ValueError, match="two-way"):
        build(spark, [{"t": 0}], pair_timeout="1 second")


def test_hot_groups_and_bursts(spark):
    packets = table(spark, random_rows(1, 400)).withColumn("_t", F.unix_micros("ts"))
    cut = cut_into_chunks(packets, ["protocol"], chunk="1 minute", rows=150)
    assert {r[0] for r in cut.where("_chunk <> -1").select("protocol").distinct().collect()} == {6}
    whole = cut.where("protocol = 6").groupBy("_chunk").count().agg(F.max("count")).first()[0]
    finer = cut_into_chunks(packets, ["protocol"], chunk="1 minute", rows=40).where("protocol = 6")
    assert finer.groupBy("_chunk").count().agg(F.max("count")).first()[0] < whole  # the burst is cut further
    late = finer.groupBy("_chunk").agg(F.min("_t").alias("a"), F.max("_t").alias("b")).orderBy("_chunk").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(late, late[1:]))
    assert cut_into_chunks(packets, ["protocol"], rows=1000) is None


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("chunk", ["1 second", "1 minute", "1 day"])
def test_hot_keys_change_nothing(spark, seed, chunk):
    """Cutting hot keys into chunks gives the same records, interim records and pairs included."""
    packets = table(spark, random_rows(seed, 400)).cache()
    options = {"idle": "20 seconds", "active": "15 seconds", "biflow": True, "pair_timeout": "5 seconds"}
    plain = flows.build_flows(packets, chunk=None, **options)
    cut = flows.build_flows(packets, chunk=chunk, hot_rows=40, **options)
    assert plain.columns == cut.columns
    assert collect(plain, *plain.columns) == collect(cut, *plain.columns)


def test_many_hot_keys_are_joined_with_salt(spark, monkeypatch):
    packets = table(spark, random_rows(6, 300)).cache()
    options = {"idle": "20 seconds", "biflow": True, "chunk": "1 minute", "hot_rows": 10}
    few = flows.build_flows(packets, **options)
    got = collect(few, *few.columns)
    monkeypatch.setattr("packetflow.operators.ordering.MOST_BROADCAST_GROUPS", 1)
    assert collect(flows.build_flows(packets, **options), *few.columns) == got


@pytest.mark.parametrize("seed", [4, 5])
def test_invariants(spark, seed):
    rows = random_rows(seed, 300)
    packets = table(spark, rows).cache()
    octets = sum(r["ip_length"] for r in rows)
    one = flows.build_flows(packets, "20 seconds")
    two = flows.build_flows(packets, "20 seconds", biflow=True)
    for built in (one, two):
        total = built.agg(F.sum("packet_total"), F.sum("octet_total")).first()
        assert tuple(total) == (300, octets)
    fin_free = {"fin": False}
    assert flows.build_flows(packets, "20 seconds", biflow=True, **fin_free).count() <= flows.build_flows(packets, "20 seconds", **fin_free).count()
    interim = flows.build_flows(packets, "20 seconds", active="7 seconds", biflow=True)
    assert tuple(interim.agg(F.sum("packet_delta"), F.sum("octet_delta")).first()) == (300, octets)
    final = interim.where("end_reason <> 2").agg(F.sum("packet_total"), F.sum("octet_total")).first()
    assert tuple(final) == (300, octets)


def test_slices_and_exports(spark):
    split = flows.split_flows(keys.flow_key(table(spark, [{"t": 0}, {"t": 4}, {"t": 6}])), "10 seconds")
    got = collect(flows.start_after_export(split, "5 seconds"), "slice", "start_after_export", "first_packet")
    assert got == [(0, at(0), 1), (1, at(6), 3)]
