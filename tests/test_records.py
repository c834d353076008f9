"""Elements, templates, dictionary, reports."""

import pytest
from pyspark.sql import functions as F

from helpers import at, collect, table
from packetflow.operators import classify, filters, flows, keys, records, reports
from packetflow.plans.queries import QUERIES


@pytest.fixture(scope="module")
def built(spark):
    rows = [
        {"t": 0, "tos": 0xB8, "ip_offset": 0x4005, "ttl": 60, "dst_ip": "224.0.0.9", "ip_length": 100, "tcp_flags": 2, "tcp_seq": 4, "app_id": 2},
        {"t": 2, "dst_ip": "224.0.0.9", "ip_length": 200, "tcp_flags": 17, "tcp_seq": 5, "ip_plength": 33},
        {"t": 0, "ip_version": 6, "protocol": 58, "src_ip": "2001:db8::1", "dst_ip": "ff02::1", "icmp_type": 128, "icmp_code": 1,
         "flow_label": 0x1FFFFF, "next_header": 58, "ip_hlength": 40},
        {"t": 0, "protocol": 2, "icmp_type": 0x16, "tcp_flags": 0},
    ]
    packets = table(spark, rows).withColumn("packet_digest", F.md5("src_ip"))
    full = flows.build_flows(packets, "10 seconds", biflow=True, pair_timeout="1 second")
    return classify.application_name(full, spark.createDataFrame([(2, "SIP")], "app_id int, app_name string"), "src_ip").cache()


def test_every_element_has_a_value_rule(built):
    projected = records.project_template(built)
    names = [e.name for e in records.template_elements(records.DEFAULT_TEMPLATE)]
    assert len(names) == len(set(names)) == 96 and projected.columns == names
    types = dict(projected.dtypes)
    for element in records.ELEMENTS.values():
        assert types[element.name] == element.type
    assert projected.count() == 3


def row_of(built, protocol, **export):
    return records.project_template(built.where(F.col("protocol") == protocol), export=records.Export(**export)).first()


def test_tcp_values(built):
    row = row_of(built, 6, observation_point=124, init_ms=1704067200000, export_us=1704067203_000_000, exporter_ipv4="192.0.2.1")
    want = {
        "octetDeltaCount": 300, "packetDeltaCount": 2, "ipClassOfService": 184, "ipDiffServCodePoint": 46, "ipPrecedence": 5,
        "fragmentOffset": 5, "fragmentFlags": 64, "ipTTL": 60, "isMulticast": 128, "octetTotalSumOfSquares": 50000, "ipv4IHL": 5,
        "flowDurationMilliseconds": 2000, "flowDurationMicroseconds": 2000000, "flowStartSysUpTime": 0, "flowEndSysUpTime": 2000,
        "flowStartDeltaMicroseconds": 3000000, "flowEndDeltaMicroseconds": 1000000, "tcpSynTotalCount": 1, "tcpFinTotalCount": 1,
        "tcpSequenceNumber": 5, "ipPayloadLength": 33, "flowEndReason": 3, "applicationId": 6 * 2**24 + 2, "applicationName": "SIP",
        "observationPointId": 124, "exporterIPv4Address": "192.0.2.1", "exportProtocolVersion": 10, "sourceIPv6Address": None,
        "destinationIPv4Address": "224.0.0.9", "icmpTypeIPv4": None, "igmpType": None, "originalFlowsInitiated": 1,
        "originalFlowsCompleted": 1, "distinctCountOfSourceIPv4Address": 1, "distinctCountOfSourceIPv6Address": 0,
        "flowStartNanoseconds": 1704067200 * 10**9, "totalLengthIPv4": 100, "packetPairsTotalCount": 0,
    }
    assert {n: row[n] for n in want} == want


def test_v6_and_igmp_values(built):
    row = row_of(built, 58)
    want = {
        "icmpTypeCodeIPv6": 128 * 256 + 1, "icmpTypeIPv6": 128, "icmpCodeIPv6": 1, "icmpTypeCodeIPv4": None, "flowLabelIPv6": 0xFFFFF,
        "nextHeaderIPv6": 58, "isMulticast": 128, "sourceIPv6Address": "2001:db8::1", "sourceIPv4Address": None, "ipv4IHL": None,
        "ipVersion": 6, "applicationName": "Unknown", "totalLengthIPv4": None,
    }
    assert {n: row[n] for n in want} == want
    assert row_of(built, 2)["igmpType"] == 0x16


def test_missing_columns_are_null(spark):
    plain = flows.build_flows(table(spark, [{"t": 0}]), measures=["packet_total"])
    row = records.project_template(plain, [86, 1, 5, (240, records.ENTERPRISE)]).first()
    assert tuple(row) == (1, None, None, None)


def test_v9_and_v5(built):
    v9 = records.project_v9(built)
    assert len(v9.columns) == 91 and "firstPacketID" not in v9.columns
    assert v9.first()["exportProtocolVersion"] == 9
    v5 = records.project_v5(built.where("protocol = 6"))
    assert len(v5.columns) == 20
    row = v5.first()
    assert (row["packetCount"], row["octetCount"], row["tcpFlags"], row["protocolType"], row["typeOfService"]) == (2, 300, 19, 6, 184)
    wide = built.where("protocol = 6").withColumn("octet_delta", F.lit(2**32 + 5))
    assert records.project_v5(wide).first()["octetCount"] == 5
    assert records.project_v5(built).where("sourceAddress LIKE '%:%'").count() == 0


def test_template_table_and_unknown(spark, built):
    table_ = spark.createDataFrame([(300, 2, 0, 86), (300, 1, 0, 7)], "template_id int, position int, enterprise int, ie int")
    assert records.project_template(built, table_).columns == ["sourceTransportPort", "packetTotalCount"]
    with pytest.raises(ValueError, match="unknown information element"):
        records.project_template(built, [12345])


def test_template_measures_prune():
    assert records.template_measures([86, 7, 8]) == ["packet_total"]
    assert records.template_measures([(242, records.ENTERPRISE), 95]) == ["first_packet_id", "app_id"]


def test_dictionary(spark, tmp_path):
    own = records.ie_dictionary(spark)
    assert own.count() == 96
    assert collect(own.where("ie = 138"), "name", "length", "coding") == [("observationPointId", 4, "UINT")]
    file = tmp_path / "registry.csv"
    file.write_text('ElementID,Name,Abstract Data Type\n1,other,unsigned64\n3,deltaFlowCount,unsigned64\n34-35,Reserved,\n82,interfaceName,string\n')
    both = records.ie_dictionary(spark, str(file))
    assert both.count() == 98
    assert collect(both.where("ie IN (1, 3, 82) AND enterprise = 0"), "ie", "name", "length", "coding") == [
        (1, "octetDeltaCount", 8, "UINT"), (3, "deltaFlowCount", 8, "UINT"), (82, "interfaceName", 65535, "STRING"),
    ]


def test_register_element(spark):
    with pytest.raises(ValueError, match="exists already"):
        records.register_element(1, "again", "bigint", None)
    records.register_element(9000, "shortest", "int", lambda: F.min("ip_length"), needs=("ip_length",), enterprise=1)
    try:
        built = flows.build_flows(table(spark, [{"t": 0, "ip_length": 70}, {"t": 1}]), measures=records.template_measures([(9000, 1)]))
        assert collect(records.project_template(built, [(9000, 1)]), "shortest") == [(70,)]
    finally:
        records.unregister_element(9000, 1)


def test_report_line(built):
    (row,) = reports.flow_report(built.where("protocol = 6")).collect()
    flow_id = keys.flow_id(built.where("protocol = 6")).first()["flow_id"]
    assert row["line"] == (
        f"flow {flow_id} [TCP] 10.0.0.1:40000 -> 224.0.0.9:80 packets 2 mac 02:00:00:00:00:01 -> 02:00:00:00:00:02 "
        "application SIP reason 3 speed 0 kBps data 200:0 level 0"
    )
    (six,) = reports.flow_report(built.where("protocol = 58")).collect()
    assert "[IC6] 2001:0db8:0000:0000:0000:0000:0000:0001:40000 -> ff02:0000" in six["line"] and "speed" not in six["line"]
    (igmp,) = reports.flow_report(built.where("protocol = 2")).collect()
    assert "[002]" in igmp["line"]


def test_speed(spark):
    built = flows.flow_speed(flows.build_flows(table(spark, [{"t": 0, "ip_length": 3000}, {"t": 0.001, "ip_length": 1000}, {"t": 0, "src_port": 1}])))
    assert collect(built, "src_port", "flow_speed") == [(1, None), (40000, 4000)]


def test_active_counts(spark):
    rows = [{"t": 0}, {"t": 25}, {"t": 12, "src_port": 1}, {"t": 31, "src_port": 1}, {"t": 14, "src_port": 2}]
    counts = reports.active_flow_count(flows.build_flows(table(spark, rows), idle="1 minute"), "10 seconds", "1 second")
    # The flow of one packet counts too: it takes a place until it has been idle.
    assert collect(counts, "bucket_start", "change", "active", "peak") == [(at(0), 1, 1, 1), (at(10), 1, 2, 3), (at(20), -1, 1, 2), (at(30), -1, 0, 1)]


def test_filters_by_hand(spark):
    rows = [
        {"t": 0}, {"t": 1, "ip_hlength": 16}, {"t": 2, "tcp_hlength": 16}, {"t": 3, "protocol": 17, "udp_length": 7},
        {"t": 4, "protocol": 17, "udp_length": 8, "interface": "eth1"}, {"t": 5, "protocol": 47, "interface": "eth1"},
        {"t": 6, "ip_version": 6, "ip_offset": 5, "protocol": 58, "interface": "eth2"},
    ]
    packets = table(spark, rows)
    assert collect(filters.rejected_headers(packets), "packet_id", "reject_reason") == [
        (2, "bad IP header length"), (3, "bad TCP header length"), (4, "bad UDP length"),
    ]
    assert collect(filters.valid_headers(packets), "packet_id") == [(1,), (5,), (6,), (7,)]
    assert collect(filters.supported_transport(packets).where("packet_id > 4"), "packet_id") == [(5,), (7,)]
    assert collect(filters.first_fragment_only(packets).where("packet_id >= 6"), "packet_id", "src_port") == [(6, 40000), (7, 0)]
    per = filters.capture_filter(packets, {"eth0": "ip_hlength = 16", "eth1": "protocol = 17"})
    assert collect(per, "packet_id") == [(2,), (5,), (7,)]
    with pytest.warns(UserWarning, match="switched off"):
        assert filters.capture_filter(packets, "no such ((").count() == 7
    with pytest.warns(UserWarning, match="switched off"):
        assert filters.capture_filter(packets, {"eth0": "missing_column = 1"}).count() == 7
    counters = reports.interface_counters(packets, F.col("packet_id") > 1, filters.reject_reason().isNotNull())
    assert collect(counters, "interface", "captured", "sampled", "rejected") == [("eth0", 4, 3, 3), ("eth1", 2, 2, 0), ("eth2", 1, 1, 0)]


def test_registered_queries_have_names():
    assert len(QUERIES) > 90
