"""Registered queries: every operator over the whole tables it reads.

Times leave as epoch microseconds and wide numbers as text, so results compare
exactly with the SQL in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetflow.functions.scalars import expand_ipv6
from packetflow.operators import aggregate, classify, clock, filters, flows, keys, measures, records, reports, rtt, sampling
from packetflow.plans import events as E
from packetflow.schemas import APP_RULES, INTERFACES, SYN, TCP
from packetflow.session import apply_runtime_conf, new_folder, settle
from packetflow.sources.frames import decode_frames
from packetflow.sources.packets import stream_packets, union_interfaces
from packetflow.sources.sinks import stream_flows_to, write_flows
from packetflow.streaming import clocks as stream_clocks
from packetflow.streaming import flows as streaming
from packetflow.streaming import samples as stream_samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    """Register ``function(spark, packets)`` or ``function(spark, packets, sf_dir)`` under its name."""
    wants_dir = function.__code__.co_argcount == 3

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_runtime_conf(spark)
        packets = E.packets(spark, sf_dir)
        return function(spark, packets, sf_dir) if wants_dir else function(spark, packets)

    QUERIES[function.__name__] = run
    return function


ID = ["ip_version", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "dns_id", "flow_no"]


def _times():
    return [F.unix_micros("flow_start").alias("start_us"), F.unix_micros("flow_end").alias("end_us")]



def _flows(packets: DataFrame, measures: list[str], biflow: bool = True, **options) -> DataFrame:
    return flows.build_flows(packets, E.IDLE, biflow=biflow, measures=measures, **options)


def _report(built: DataFrame, *columns) -> DataFrame:
    return built.select(*ID, *columns)


# --- sources and filters ------------------------------------------------------------------


@query
def read_packets(spark, packets):
    return packets.select(
        "packet_id", F.unix_micros("ts").alias("t"), "interface", "obs_point", "src_mac", "dst_mac", "ip_version",
        "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "ttl", "tos", "ip_id", "ip_offset", "ip_hlength",
        "ip_length", "ip_plength", "udp_length", "tcp_flags", "tcp_seq", "tcp_ack", "tcp_window", "tcp_urgent_ptr",
        "tcp_hlength", "dns_id", "dns_qr", "icmp_type", "icmp_code", "flow_label", "next_header", "host",
    )


@query
def union_interfaces_flows(spark, packets):
    """Two capture points, each with its own filter and sampling, as one flow table."""
    eth0 = filters.capture_filter(packets.where("interface = 'eth0'"), "ip_length >= 100")
    eth1 = sampling.sample_time(packets.where("interface = 'eth1'"), 4, 10)
    merged = union_interfaces({"eth0": eth0, "eth1": eth1})
    built = flows.build_flows(merged, E.IDLE, biflow=True, measures=["packet_total", "octet_total"], horizon=flows.horizon_of(packets))
    return built.select(*ID, *_times(), "end_reason", "packet_total", "octet_total")


def _hex(column, digits: int):
    return F.lpad(F.hex(column.cast("bigint")), digits, "0")


def _ip_hex(ip):
    v4 = F.array_join(F.transform(F.split(ip, "\\."), lambda p: F.lpad(F.hex(p.cast("bigint")), 2, "0")), "")
    return F.when(F.col("ip_version") == 4, v4).otherwise(F.replace(expand_ipv6(ip), F.lit(":"), F.lit("")))


def _frames(packets: DataFrame) -> DataFrame:
    """Frames that carry the packets: Ethernet, IP (v6: some with a hop-by-hop header), transport."""
    c = F.col
    mac = lambda m: F.replace(c(m), F.lit(":"), F.lit(""))
    v4 = F.concat(
        _hex(64 + F.expr("ip_hlength div 4"), 2), _hex(c("tos"), 2), _hex(c("ip_length"), 4), _hex(c("ip_id"), 4),
        _hex(c("ip_offset"), 4), _hex(c("ttl"), 2), _hex(c("protocol"), 2), F.lit("0000"), _ip_hex(c("src_ip")),
        _ip_hex(c("dst_ip")), F.repeat(F.lit("01"), c("ip_hlength") - 20),
    )
    extended = c("packet_id") % 4 == 1
    v6 = F.concat(
        _hex(F.lit(6 << 28) + c("tos") * 2**20 + c("flow_label"), 8), _hex(c("ip_plength"), 4),
        F.when(extended, F.lit("00")).otherwise(_hex(c("protocol"), 2)), _hex(c("ttl"), 2),
        _ip_hex(c("src_ip")), _ip_hex(c("dst_ip")),
        F.when(extended, F.concat(_hex(c("protocol"), 2), F.lit("00000000000000"))).otherwise(F.lit("")),
    )
    ports = F.concat(_hex(c("src_port"), 4), _hex(c("dst_port"), 4))
    tcp = F.concat(
        ports, _hex(c("tcp_seq"), 8), _hex(c("tcp_ack"), 8), _hex(c("tcp_hlength") * 4, 2), _hex(c("tcp_flags"), 2),
        _hex(c("tcp_window"), 4), F.lit("0000"), _hex(c("tcp_urgent_ptr"), 4),
    )
    dns = F.concat(_hex(c("dns_id"), 4), _hex(c("dns_qr") * 128 + c("dns_opcode") * 8 + c("dns_rd"), 2), F.lit("000001000000000000"))
    udp = F.concat(ports, _hex(c("udp_length"), 4), F.lit("0000"), F.when(keys.is_dns(), dns).otherwise(F.lit("")))
    icmp = F.concat(_hex(c("icmp_type"), 2), _hex(c("icmp_code"), 2), F.lit("0000"), _hex(c("src_port"), 4), _hex(c("tcp_seq"), 4))
    transport = F.when(c("protocol") == 6, tcp).when(c("protocol") == 17, udp).otherwise(icmp)
    is4 = c("ip_version") == 4
    ethernet = F.concat(mac("dst_mac"), mac("src_mac"), F.when(is4, F.lit("0800")).otherwise(F.lit("86dd")))
    frame = F.unhex(F.concat(ethernet, F.when(is4, v4).otherwise(v6), transport))
    return packets.select(c("packet_id").alias("frame_id"), "ts", "interface", frame.alias("frame"))


@query
def decode_frames_packets(spark, packets):
    decoded = decode_frames(_frames(packets))
    return decoded.select(
        "packet_id", F.unix_micros("ts").alias("t"), "src_mac", "dst_mac", "ip_version", "src_ip", "dst_ip", "ttl", "tos",
        "protocol", "ip_id", "ip_offset", "ip_hlength", "ip_length", "ip_plength", "src_port", "dst_port", "udp_length",
        "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", "tcp_urgent_ptr", "tcp_hlength", "icmp_type", "icmp_code",
        "flow_label", "next_header", "dns_id", "dns_opcode", "dns_rd", "dns_qr", "l3_hlength", "l3_length", "l4_hlength",
        F.coalesce("reject_reason", F.lit("")).alias("reject_reason"),
    )


@query
def capture_filter(spark, packets):
    kept = filters.capture_filter(packets, {"eth0": "protocol = 6 AND ip_length > 80", "eth1": "ip_version = 6 OR dst_port = 53"})
    return kept.select("packet_id", "interface", "protocol", "ip_length")


@query
def ip_only(spark, packets):
    mixed = packets.withColumn("ip_version", F.when(F.col("ip_id") % 11 == 0, 0).otherwise(F.col("ip_version")))
    return filters.ip_only(mixed).select("packet_id", "ip_version")


@query
def supported_transport(spark, packets):
    mixed = packets.withColumn(
        "protocol", F.when(F.col("ip_id") % 13 == 0, 47).when(F.col("ip_id") % 7 == 0, 2).otherwise(F.col("protocol"))
    )
    return filters.supported_transport(mixed).select("packet_id", "ip_version", "protocol")


@query
def valid_headers(spark, packets):
    return filters.valid_headers(packets).select("packet_id", "protocol", "tcp_hlength", "udp_length")


@query
def rejected_headers(spark, packets):
    return filters.rejected_headers(packets).groupBy("interface", "reject_reason").agg(F.count(F.lit(1)).alias("packets"))


@query
def first_fragment_only(spark, packets):
    return filters.first_fragment_only(packets).select("packet_id", "ip_version", "src_port", "dst_port")


# --- sampling ---------------------------------------------------------------------------------


@query
def sample_none(spark, packets):
    return sampling.sample_none(packets).select("packet_id")


@query
def sample_count(spark, packets):
    return sampling.sample_count(packets, 4, 10).select("packet_id", "interface")


@query
def sample_count_inverted(spark, packets):
    return sampling.sample_count(packets, 4, 10, invert=True).select("packet_id", "interface")


@query
def sample_count_global(spark, packets):
    return sampling.sample_count(packets, 4, 10, scope="global").select("packet_id", "interface")


@query
def sample_time(spark, packets):
    return sampling.sample_time(packets, 4, 10).select("packet_id")


@query
def sample_n_of_N(spark, packets):
    return sampling.sample_n_of_N(packets, 4, 10, seed=7).select("packet_id", "interface")


@query
def sample_uniform(spark, packets):
    return sampling.sample_uniform(packets, 25, seed=7).select("packet_id")


@query
def sample_time_decay(spark, packets):
    return sampling.sample_time_decay(packets, 1_705_000_000, 1_706_000_000, seed=7).select("packet_id")


@query
def sample_by_interface(spark, packets):
    settings = [
        {"name": "eth0", "sampling_type": 3, "param1": 3, "param2": 8},
        {"name": "eth1", "sampling_type": 1, "param1": 2, "param2": 5},
    ]
    return sampling.sample_by_interface(packets, settings, seed=7).select("packet_id", "interface")


@query
def apply_interfaces(spark, packets):
    """Settings as a table: filter and sampling rule per interface."""
    rows = [("eth0", "protocol = 6", 1, 2, 5), ("eth1", "ip_length > 100", 3, 3, 8)]
    return sampling.apply_interfaces(packets, spark.createDataFrame(rows, INTERFACES), seed=7).select("packet_id", "interface")


# --- keys and identity ----------------------------------------------------------------------


def _key_columns(keyed):
    return keyed.select("packet_id", "ip_version", "protocol", "k_ip1", "k_port1", "k_ip2", "k_port2", "k_dns", "orient")


@query
def flow_key(spark, packets):
    return _key_columns(keys.flow_key(packets))


@query
def dns_flow_key(spark, packets):
    return keys.dns_flow_key(packets).select("packet_id", "k_dns")


@query
def biflow_key(spark, packets):
    return _key_columns(keys.biflow_key(packets))


@query
def biflow_key_all_protocols(spark, packets):
    return _key_columns(keys.biflow_key(packets, all_protocols=True))


@query
def flow_id(spark, packets):
    return keys.flow_id(packets).select("packet_id", F.col("flow_id").cast("string").alias("flow_id"))


@query
def reverse_flow_id(spark, packets):
    both = keys.reverse_flow_id(packets)
    return both.select("packet_id", F.col("reverse_flow_id").cast("string").alias("reverse_flow_id"))


@query
def flow_id_fast(spark, packets):
    """The quick id separates exactly the same keys as the key columns do."""
    five = ["ip_version", "protocol", "src_ip", "dst_ip", "src_port", "dst_port"]
    return keys.flow_id(packets, fast=True).groupBy("flow_id").agg(
        *[F.min(c).alias(c) for c in five], F.count(F.lit(1)).alias("packets")
    ).drop("flow_id")


def _v4_bytes():
    """IPv4 packets whose payload is long, short with options, and shorter still."""
    c = F.col
    words = 5 + c("ip_id") % 4
    payload = F.when(c("ip_id") % 3 == 0, 60).when(c("ip_id") % 3 == 1, 38).otherwise(5)
    return F.unhex(
        F.concat(
            _hex(64 + words, 2), _hex(c("tos"), 2), _hex(words * 4 + payload, 4), _hex(c("ip_id"), 4), _hex(c("ip_offset"), 4),
            _hex(c("ttl"), 2), _hex(c("protocol"), 2), F.lit("0000"), _ip_hex(c("src_ip")), _ip_hex(c("dst_ip")),
            F.repeat(F.lit("01"), (words - 5) * 4), F.substr(F.repeat(F.col("packet_digest"), F.lit(4)), F.lit(1), payload * 2),
        )
    )


def _v6_bytes():
    """IPv6 packets with payloads of the same sizes."""
    c = F.col
    payload = F.when(c("packet_id") % 3 == 0, 60).when(c("packet_id") % 3 == 1, 38).otherwise(5)
    return F.unhex(
        F.concat(
            _hex(F.lit(6 << 28) + c("tos") * 2**20 + c("flow_label"), 8), _hex(payload, 4), _hex(c("protocol"), 2), _hex(c("ttl"), 2),
            _ip_hex(c("src_ip")), _ip_hex(c("dst_ip")), F.substr(F.repeat(c("packet_digest"), F.lit(4)), F.lit(1), payload * 2),
        )
    )


@query
def packet_id(spark, packets):
    """Digests of the IPv4 packets; ``packet_id_all`` has those of both versions."""
    v4 = packets.where("ip_version = 4").withColumn("ip_bytes", _v4_bytes())
    return keys.packet_id(v4.drop("packet_digest")).select("packet_id", "packet_digest")


@query
def packet_id_all(spark, packets):
    """Digests of all packets, of either version."""
    whole = packets.withColumn("ip_bytes", F.when(F.col("ip_version") == 4, _v4_bytes()).otherwise(_v6_bytes()))
    return keys.packet_id(whole.drop("packet_digest")).select("packet_id", "packet_digest")


@query
def flow_key_indicator(spark, packets):
    return keys.flow_key_indicator(packets).groupBy("ip_version", "flow_key_indicator").agg(F.count(F.lit(1)).alias("packets"))


# --- splitting ----------------------------------------------------------------------------------


@query
def split_idle(spark, packets):
    split = flows.split_flows(keys.flow_key(packets), E.IDLE, fin=False)
    return split.select("packet_id", "flow_no", "direction", F.unix_micros("flow_start").alias("start_us"))


@query
def split_fin(spark, packets):
    split = flows.split_flows(keys.flow_key(packets, biflow=True), E.IDLE)
    return split.select("packet_id", "flow_no", "direction", F.unix_micros("flow_start").alias("start_us"))


@query
def slice_active(spark, packets):
    split = flows.split_flows(keys.flow_key(packets, biflow=True), E.IDLE)
    return flows.slice_active(split, E.ACTIVE).select("packet_id", "flow_no", "slice")


@query
def end_reason(spark, packets):
    return _flows(packets, ["packet_total"]).select(*ID, "end_reason", *_times(), "packet_total")


@query
def force_end(spark, packets):
    """Flows still open at midnight after the last day, when an operator flushes the table."""
    built = _flows(packets, ["packet_total", "last_tcp_flags"], biflow=False)
    return _report(flows.force_end(built, E.IDLE, horizon="2024-02-01 00:00:00"), *_times(), "packet_total")


@query
def start_after_export(spark, packets):
    split = flows.split_flows(keys.flow_key(packets, biflow=True), E.IDLE)
    records_ = flows.start_after_export(split, E.ACTIVE)
    return records_.select(
        *keys.KEY_FIELDS, "flow_no", "slice", F.unix_micros("start_after_export").alias("after_export_us"), "first_packet"
    )


_TOTALS = [
    "packet_total", "octet_total", "octet_sum_squares", "fin_count", "syn_count", "rst_count", "psh_count", "ack_count",
    "urg_count", "retransmitted_packets", "retransmitted_octets",
]


@query
def build_flows(spark, packets):
    return _flows(packets, _TOTALS, biflow=False).select(*ID, *_times(), "end_reason", *_TOTALS)


@query
def build_flows_biflow(spark, packets):
    return _flows(packets, _TOTALS).select(*ID, *_times(), "end_reason", *_TOTALS)


#: Packets from which a key counts as hot in the queries that check the cut paths.
FEW_ROWS = 20


@query
def build_flows_hot_keys(spark, packets):
    """The same records with every larger key cut into time chunks."""
    return _flows(packets, _TOTALS, hot_rows=FEW_ROWS, chunk="1 day").select(*ID, *_times(), "end_reason", *_TOTALS)


@query
def build_flows_interim(spark, packets):
    """With an interim record per active period."""
    built = _flows(packets, [*_TOTALS, "packet_delta", "octet_delta"], active=E.ACTIVE)
    return built.select(
        *ID, "slice", *_times(), F.unix_micros("start_after_export").alias("after_export_us"), "end_reason", *_TOTALS,
        "packet_delta", "octet_delta",
    )


@query
def build_flows_empty_periods(spark, packets):
    """Short active periods, with the records of empty ones."""
    built = _flows(packets, ["packet_total", "octet_total", "packet_delta"], active="20 hours", emit_empty=True)
    return built.select(*ID, "slice", "end_reason", "packet_total", "octet_total", "packet_delta")


# --- measures -----------------------------------------------------------------------------------


def _measured(name: str, measures: list[str], **options) -> None:
    def run(spark, packets):
        return _report(_flows(packets, measures, **options), *measures)

    run.__name__ = name
    query(run)


_measured("packet_octet_totals", ["packet_total", "octet_total"])
_measured("octet_sum_squares", ["octet_sum_squares"])
_measured("tcp_flag_counts", ["fin_count", "syn_count", "rst_count", "psh_count", "ack_count", "urg_count", "tcp_flags_or"])
_measured(
    "directional_lengths",
    ["l3_hlength_fwd", "l3_hlength_bwd", "l3_length_fwd", "l3_length_bwd", "l4_hlength_fwd", "l4_hlength_bwd"],
)
_measured("retransmitted", ["retransmitted_packets", "retransmitted_octets"])
_measured(
    "first_packet_attrs",
    ["first_tos", "first_ttl", "first_ip_id", "first_ip_offset", "first_ip_hlength", "first_ip_length", "first_tcp_window",
     "first_tcp_urgent_ptr", "first_icmp_type", "first_icmp_code", "first_flow_label", "first_next_header", "source_mac",
     "destination_mac"],
)
_measured("last_packet_attrs", ["last_ip_plength", "last_tcp_seq", "last_tcp_ack", "last_tcp_flags"])
_measured("first_last_packet_id", ["first_packet_id", "last_packet_id"])
_measured("sampled_flag", ["is_sampled"])


@query
def retransmitted_by_prefix(spark, packets):
    built = _flows(packets, ["retransmitted_packets", "retransmitted_octets"], src_prefix="192.168.")
    return _report(built, "retransmitted_packets", "retransmitted_octets")


@query
def deltas(spark, packets):
    built = _flows(packets, ["packet_delta", "octet_delta", "octet_delta_sum_squares"], active=E.ACTIVE)
    return _report(built, "slice", "packet_delta", "octet_delta", "octet_delta_sum_squares")


@query
def deltas_zero_final(spark, packets):
    built = _flows(packets, ["packet_delta", "octet_delta"], active=E.ACTIVE, zero_final=True)
    return _report(built, "slice", "packet_delta", "octet_delta")


@query
def flow_times(spark, packets):
    return _report(_flows(packets, []), *_times())


@query
def application(spark, packets):
    apps = spark.createDataFrame([(1, "HTTP"), (2, "SIP")], "app_id int, app_name string")
    built = _flows(packets, ["app_id"])
    return _report(classify.application_name(built, apps, "src_ip"), "app_id", "app_name")


@query
def flow_speed(spark, packets):
    built = flows.flow_speed(_flows(packets, ["octet_total"]))
    return _report(built, F.coalesce("flow_speed", F.lit(-1)).cast("bigint").alias("flow_speed"))


# --- joins --------------------------------------------------------------------------------------


def _split(packets):
    return flows.split_flows(keys.flow_key(packets, biflow=True), E.IDLE)


def _pairs(pairs):
    return pairs.select("packet_id", "matched_id", "direction", "delay_us")


@query
def rtt_pairs_tcp(spark, packets):
    return _pairs(rtt.rtt_pairs_tcp(_split(packets), E.PAIR_TIMEOUT))


@query
def rtt_pairs_dns(spark, packets):
    return _pairs(rtt.rtt_pairs_dns(_split(packets), E.PAIR_TIMEOUT))


@query
def rtt_pairs_icmp(spark, packets):
    return _pairs(rtt.rtt_pairs_icmp(_split(packets), E.PAIR_TIMEOUT))


@query
def rtt_pair_timeout(spark, packets):
    return _pairs(rtt.rtt_pairs(_split(packets), "6 hours"))


@query
def rtt_pairs_consume(spark, packets):
    return _pairs(rtt.rtt_pairs(_split(packets), E.PAIR_TIMEOUT, consume=True))


@query
def rtt_pairs_consume_hot_keys(spark, packets):
    """The same pairs with every larger key cut into time chunks."""
    split = flows.split_flows(keys.biflow_key(packets), E.IDLE, chunk="1 day", hot_rows=FEW_ROWS)
    return _pairs(rtt.rtt_pairs(split, E.PAIR_TIMEOUT, consume=True))


@query
def rtt_summary(spark, packets):
    summary = rtt.rtt_summary(rtt.rtt_pairs(_split(packets), E.PAIR_TIMEOUT))
    return summary.select(
        *keys.KEY_FIELDS, "flow_no", *[F.round(c, 3).alias(c) for c in ("rtt_fwd", "rtt_bwd", "rtt")], "rtt_pairs"
    )


@query
def flow_rtt(spark, packets):
    built = _flows(packets, ["packet_total"], pair_timeout=E.PAIR_TIMEOUT)
    return _report(built, "packet_total", F.round("rtt_fwd", 3).alias("rtt_fwd"), F.round("rtt_bwd", 3).alias("rtt_bwd"), "rtt_pairs")


# Rule tables are settings: (app_id, app_name, kind, protocol, port_lo, port_hi, host, priority).
APP_RULE_ROWS = [
    (1, "Web", "port", 6, 80, 80, None, 10),
    (2, "Admin", "port", 6, 81, 89, None, 10),
    (3, "Voice", "port", 17, 5060, 5069, None, 20),
    (4, "Names", "port", 17, 53, 53, None, 30),
    (5, "Clients", "port", 6, 40000, 40199, None, 5),
    (6, "CDN", "host", None, None, None, "cdn.example", 1),
    (7, "Seven", "host", None, None, None, "u7.", 2),
]


def _rules(spark):
    return spark.createDataFrame(APP_RULE_ROWS, APP_RULES)


@query
def classify_by_port(spark, packets):
    return classify.classify_by_port(packets.drop("app_id"), _rules(spark)).select("packet_id", "app_id")


@query
def classify_by_host(spark, packets):
    rules = _rules(spark)
    classified = classify.classify_by_port(packets.drop("app_id"), rules)
    return classify.classify_by_host(classified, rules).select("packet_id", "app_id")


@query
def classify_by_host_pieces(spark, packets):
    """The same rules by equality on pieces of the host names, as for long rule lists."""
    rules = _rules(spark)
    classified = classify.classify_by_port(packets.drop("app_id"), rules)
    return classify.classify_by_host(classified, rules, most_inline=0).select("packet_id", "app_id")


@query
def application_name(spark, packets):
    rules = _rules(spark)
    classified = classify.classify_by_port(packets.drop("app_id"), rules)
    named = classify.application_name(classified, rules.select("app_id", "app_name"), "packet_id")
    return named.groupBy("app_name").agg(F.count(F.lit(1)).alias("packets"), F.sum("ip_length").alias("octets"))


@query
def application_id(spark, packets):
    return packets.select("packet_id", classify.application_id(F.col("app_id")).alias("application_id"))


# --- clocks -------------------------------------------------------------------------------------


@query
def clock_offset(spark, packets, sf_dir):
    return clock.clock_offset(E.sync_samples(spark, sf_dir)).select("obs_point", "seq", "delay", "drift")


@query
def drift_fit(spark, packets, sf_dir):
    fits = clock.drift_fit(E.sync_samples(spark, sf_dir))
    at = F.col("slope") * (F.col("t3") - F.col("x0")).cast("double") + F.col("y0") + F.col("intercept")
    return fits.select(
        "obs_point", "seq", "samples", F.round(F.coalesce("slope", F.lit(0.0)), 7).alias("slope"),
        F.round(F.coalesce(at, F.lit(0.0)) / 1e6, 1).alias("drift_ms"),
    )


def _fits_in_force(spark, packets, sf_dir):
    return clock.clock_as_of(packets, clock.drift_fit(E.sync_samples(spark, sf_dir)))


@query
def clock_as_of(spark, packets, sf_dir):
    timed = _fits_in_force(spark, packets, sf_dir)
    line = [F.coalesce(f"clock.{c}", F.lit(-1)).alias(c) for c in ("x0", "y0")]
    intercept = F.round(F.coalesce("clock.intercept", F.lit(0.0)) / 1000).cast("bigint").alias("intercept_us")
    return timed.select("packet_id", F.round(F.coalesce("clock.slope", F.lit(0.0)), 9).alias("slope"), *line, intercept)


@query
def correct_time(spark, packets, sf_dir):
    timed = clock.correct_time(_fits_in_force(spark, packets, sf_dir))
    return timed.select("packet_id", F.expr("(corrected_ns + 500) div 1000").alias("corrected_us"))


@query
def corrected_flows(spark, packets, sf_dir):
    """Clock correction before keying: flow records built on corrected time (whole milliseconds)."""
    timed = clock.correct_time(_fits_in_force(spark, packets, sf_dir))
    timed = timed.withColumn("ts", F.timestamp_millis(F.expr("(corrected_ns + 500000) div 1000000")))
    return _report(_flows(timed.drop("clock"), ["packet_total", "octet_total"]), *_times(), "packet_total", "octet_total")


@query
def time_precision(spark, packets):
    return clock.time_precision(packets).select("packet_id", "seconds", "millis", "micros", "nanos")


def _two_points(packets):
    """The same packets seen at point 1 and, some lost, later at point 2."""
    seen = packets.select("packet_id", "ts", "ttl", "ip_id", F.md5((F.col("packet_id") % 4000).cast("string")).alias("packet_digest"))
    at_1 = seen.withColumn("obs_point", F.lit(1))
    later = F.timestamp_micros(F.unix_micros("ts") + 1000 * F.col("ttl"))
    at_2 = seen.where("ip_id % 7 <> 0").withColumns({"obs_point": F.lit(2), "ts": later})
    return at_1.unionByName(at_2)


@query
def one_way_delay(spark, packets):
    return clock.one_way_delay(_two_points(packets), 1, 2, "10 minutes")


# --- aggregation --------------------------------------------------------------------------------

_AGG_MEASURES = [
    "packet_total", "octet_total", "octet_sum_squares", "fin_count", "syn_count", "ack_count", "retransmitted_packets",
    "l3_length_fwd", "l3_length_bwd", "last_ip_plength", "last_tcp_seq", "last_tcp_flags",
]
_MERGED = [
    "packet_total", "octet_total", "octet_sum_squares", "fin_count", "syn_count", "ack_count", "retransmitted_packets",
    "l3_length_fwd", "l3_length_bwd", "last_ip_plength", "last_tcp_seq", "last_tcp_flags", "original_present",
    "original_initiated", "original_completed",
]


def _agg_flows(packets):
    return _flows(packets, _AGG_MEASURES)


def _merged(df, *extra):
    return df.select(*extra, *aggregate.MERGE_KEY, *_times(), *_MERGED, *aggregate.DISTINCT)


@query
def split_mice(spark, packets):
    small, large = aggregate.split_mice(_flows(packets, ["octet_total"]), E.MICE_OCTETS)
    both = small.withColumn("mouse", F.lit(True)).unionByName(large.withColumn("mouse", F.lit(False)))
    return _report(both, "octet_total", "mouse")


@query
def reduce_key(spark, packets):
    reduced = aggregate.reduce_key(_flows(packets, ["octet_total"]), (8, 28, 7, 4), 4)
    return reduced.groupBy(*aggregate.MERGE_KEY).agg(F.count(F.lit(1)).alias("flows"), F.sum("octet_total").alias("octets"))


def _reduced_flows(packets):
    built = _agg_flows(packets).withColumns({"end_src": F.col("src_ip"), "end_dst": F.col("dst_ip")})
    return aggregate.reduce_key(built, aggregate.REDUCE, 2)


@query
def merge_flows(spark, packets):
    return _merged(aggregate.merge_flows(_reduced_flows(packets), endpoints=("end_src", "end_dst")))


@query
def merge_flows_additive(spark, packets):
    return _merged(aggregate.merge_flows(_reduced_flows(packets), distinct="additive"))


def _close(approximate, exact, *extra):
    """Merged flows with whether the sketches' counts lie within 5 % (or one) of the exact ones."""
    keys = [*extra, *aggregate.MERGE_KEY]
    counts = exact.select(*keys, F.col("distinct_src").alias("_src"), F.col("distinct_dst").alias("_dst"))
    close = [(F.abs(F.col(f"distinct_{s}") - F.col(f"_{s}")) <= F.greatest(F.lit(1), 0.05 * F.col(f"_{s}"))).alias(f"{s}_close") for s in ("src", "dst")]
    return approximate.join(counts, keys).select(*keys, "octet_total", *close)


@query
def merge_flows_approx(spark, packets):
    flows, ends = settle(_reduced_flows(packets), "reduced"), ("end_src", "end_dst")
    exact = aggregate.merge_flows(flows, endpoints=ends)
    return _close(aggregate.merge_flows(flows, distinct="approx", endpoints=ends), exact)


@query
def distinct_endpoints(spark, packets):
    return aggregate.distinct_endpoints(_reduced_flows(packets), endpoints=("end_src", "end_dst"))


@query
def original_flow_counts(spark, packets):
    built = _flows(packets, ["fin_count", "syn_count"])
    return built.groupBy("protocol").agg(
        *[F.sum(c).alias(c) for c in ("original_present", "original_initiated", "original_completed", "fin_count")]
    )


@query
def aggregate_cascade(spark, packets):
    return _merged(aggregate.aggregate_cascade(_agg_flows(packets), E.MICE_OCTETS), "agg_level")


@query
def aggregate_cascade_approx(spark, packets):
    flows = settle(_agg_flows(packets), "flows")
    made = [aggregate.aggregate_cascade(flows, E.MICE_OCTETS, distinct=kind, settled=True).where("agg_level > 0") for kind in ("approx", "exact")]
    return _close(*made, "agg_level")


@query
def aggregate_finished(spark, packets):
    return _merged(aggregate.aggregate_finished(_agg_flows(packets), E.MICE_OCTETS), "agg_level")


@query
def aggregate_every(spark, packets):
    done = aggregate.aggregate_every(_agg_flows(packets), E.TRIGGER, octets=E.MICE_OCTETS)
    return _merged(done, F.unix_micros("trigger").alias("trigger_us"), "agg_level")


#: Three quarters of it are first in use after twelve days at scale 0.01: flows pass before and are merged after.
AUTO_CAPACITY = 714


@query
def aggregate_auto(spark, packets):
    built = _agg_flows(packets)
    done = aggregate.aggregate_auto(built, AUTO_CAPACITY, E.TRIGGER, E.IDLE, octets=E.MICE_OCTETS)
    return _merged(done, F.unix_micros("trigger").alias("trigger_us"), "agg_level")


# --- records ------------------------------------------------------------------------------------

EXPORT = records.Export(
    observation_point=124, observation_domain=3, exporter_ipv4="192.0.2.1", exporter_ipv6="2001:db8::1", exporter_port=4000,
    collector_ipv4="192.0.2.9", collector_ipv6="2001:db8::9", collector_port=4739, export_interface=2,
    init_ms=1_704_067_200_000, export_us=1_706_745_600_000_000, active_timeout_s=432_000 % 32_768, idle_timeout_s=172_800 % 32_768,
)


def _record_flows(spark, packets):
    built = _flows(packets, records.template_measures() + ["tcp_flags_or"], pair_timeout=E.PAIR_TIMEOUT)
    apps = spark.createDataFrame([(1, "HTTP"), (2, "SIP")], "app_id int, app_name string")
    return classify.application_name(built, apps, "src_ip")


def _plain(projected: DataFrame) -> DataFrame:
    """Nulls become -1 or empty text, wide numbers text, so both engines hand over equal values."""
    columns = []
    for name, kind in projected.dtypes:
        if kind == "string":
            columns.append(f"coalesce({name}, '') AS {name}")
        elif kind.startswith("decimal"):
            columns.append(f"CAST({name} AS STRING) AS {name}")
        else:
            columns.append(f"coalesce(CAST({name} AS BIGINT), -1) AS {name}")
    return projected.selectExpr(*columns)


@query
def project_template(spark, packets):
    return _plain(records.project_template(_record_flows(spark, packets), export=EXPORT))


@query
def project_v9(spark, packets):
    return _plain(records.project_v9(_record_flows(spark, packets), export=EXPORT))


@query
def project_v5(spark, packets):
    built = _flows(packets, ["packet_delta", "octet_delta", "first_tos", "tcp_flags_or"])
    return _plain(records.project_v5(built, EXPORT))


@query
def information_elements(spark, packets):
    """The dictionary with the number of flow records that carry each element."""
    projected = records.project_template(_record_flows(spark, packets), export=EXPORT)
    counts = projected.agg(*[F.count(c).alias(c) for c in projected.columns])
    long = counts.unpivot([], counts.columns, "name", "records")
    return records.ie_dictionary(spark).join(long, "name").select("enterprise", "ie", "name", "length", "coding", "records")


@query
def observation_ids(spark, packets):
    tagged = records.observation_ids(_flows(packets, ["packet_total"]), 124, 3)
    return _report(tagged, "packet_total", "observationPointId", "observationDomainId")


@query
def flow_report(spark, packets):
    built = _flows(packets, ["packet_total", "octet_total", "l3_length_fwd", "l3_length_bwd", "source_mac", "destination_mac"])
    return reports.flow_report(built)


@query
def register_element(spark, packets):
    """A new element: the largest packet of a flow, measured and exported."""
    number, enterprise = 9001, 32473
    records.unregister_element(number, enterprise)
    records.register_element(
        number, "largestPacket", "bigint", "max(ip_length)", needs=("ip_length",), enterprise=enterprise
    )
    template = [7, 11, 4, 86, (number, enterprise)]
    projected = records.project_template(_flows(packets, records.template_measures(template)), template)
    records.unregister_element(number, enterprise)
    return projected


# --- reports ------------------------------------------------------------------------------------


@query
def interface_counters(spark, packets):
    sampled = F.pmod(F.unix_seconds("ts"), F.lit(14)) < 4
    return reports.interface_counters(packets, sampled, filters.reject_reason().isNotNull())


@query
def reject_counters(spark, packets):
    return reports.reject_counters(packets, filters.reject_reason())


@query
def active_flow_count(spark, packets):
    counts = reports.active_flow_count(_flows(packets, []), "1 hour", E.IDLE)
    return counts.select(F.unix_micros("bucket_start").alias("bucket_us"), "change", "active", "peak")


@query
def protocol_mix(spark, packets):
    return reports.protocol_mix(_flows(packets, ["packet_total", "octet_total"]))


@query
def tumbling_windows(spark, packets):
    counted = packets.groupBy(F.window("ts", "1 hour").alias("w"), "protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("ip_length").alias("octets"),
        F.expr(f"count_if(protocol = {TCP} AND tcp_flags & {SYN} = {SYN}) AS syn_packets"),
    )
    return counted.select(F.unix_micros("w.start").alias("start_us"), "protocol", "packets", "octets", "syn_packets")


# --- sinks and streams --------------------------------------------------------------------------


@query
def write_flows_dated(spark, packets):
    """Flows written to a dated table and read back by day."""
    path = new_folder(spark, "flows")
    write_flows(_flows(packets, ["packet_total", "octet_total"]), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("flow_date").cast("string").alias("flow_date")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packet_total").alias("packets"), F.sum("octet_total").alias("octets")
    )


def _stream_events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return stream_packets(spark, sf_dir, schema=schema, pathGlobFilter="events.parquet")


def _stream(spark, sf_dir):
    return spark.sql(E._PACKETS_SQL, events=_stream_events(spark, sf_dir))


def _drain(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what there is now and read its table back."""
    path, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


LATE = "1 hour"


@query
def stream_packets_counts(spark, packets, sf_dir):
    rows = _stream(spark, sf_dir).select("packet_id", "interface", "protocol", "ip_length")
    return _drain(spark, rows, "packets").groupBy("interface", "protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("ip_length").alias("octets")
    )


#: Buckets of the stream queries: small state, few tasks.
BUCKETS = 8


def _stream_flows(spark, sf_dir, active=E.ACTIVE, **options):
    return streaming.stream_flows(_stream(spark, sf_dir), E.IDLE, active, LATE, biflow=True, buckets=BUCKETS, **options)


@query
def stream_flows(spark, packets, sf_dir):
    done = _drain(spark, _stream_flows(spark, sf_dir), "flows")
    return done.select(
        *ID, "slice", *_times(), "end_reason", "packet_total", "octet_total", "packet_delta", "octet_delta", "fin_count", "syn_count",
        "retransmitted_packets",
    )


_STREAM_MEASURES = [name for name in measures.ALL if name != "is_sampled"]


@query
def stream_flow_measures(spark, packets, sf_dir):
    """Every measure of a flow, kept as the state of a stream."""
    done = _drain(spark, _stream_flows(spark, sf_dir, None, measures=_STREAM_MEASURES), "measures")
    return done.select(*ID, *_times(), *_STREAM_MEASURES)


@query
def stream_flows_on_time(spark, packets, sf_dir):
    """Each active period reports when it ends, with or without a packet."""
    done = _drain(spark, _stream_flows(spark, sf_dir, "20 hours", on_time=True, measures=["packet_total", "packet_delta", "octet_delta"]), "on-time")
    return done.select(*ID, "slice", *_times(), "end_reason", "packet_total", "packet_delta", "octet_delta")


@query
def stream_flows_flush(spark, packets, sf_dir):
    """An order on a control stream ends every open flow; here the control stream is derived from the packets."""
    rows = _stream(spark, sf_dir)
    at = F.lit(E.FLUSH_AT).cast("timestamp")
    # One order: the first packet at or after that time sends it.
    orders = rows.where(F.col("packet_id") == 0).select(at.alias("ts"))
    done = streaming.stream_flows(rows, E.IDLE, None, LATE, biflow=True, buckets=BUCKETS, control=orders, measures=["packet_total", "octet_total"])
    return _drain(spark, done, "flush").select(*ID, *_times(), "end_reason", "packet_total", "octet_total")


@query
def stream_sample_count(spark, packets, sf_dir):
    rows = _stream(spark, sf_dir).select("packet_id", "ts", "interface", "ip_length", "host")
    return _drain(spark, stream_samples.stream_sample_count(rows, 4, 10, late=LATE), "counted").select("packet_id", "interface", "ip_length", "host")


@query
def stream_sample_n_of_N(spark, packets, sf_dir):
    rows = _stream(spark, sf_dir).select("packet_id", "ts", "interface")
    return _drain(spark, stream_samples.stream_sample_n_of_N(rows, 4, 10, seed=7, late=LATE), "drawn").select("packet_id", "interface")


@query
def stream_drift_fit(spark, packets, sf_dir):
    fits = _drain(spark, stream_clocks.stream_drift_fit(E.samples_of(_stream_events(spark, sf_dir)), late=LATE), "fits")
    at = F.col("slope") * (F.col("t3") - F.col("x0")).cast("double") + F.col("y0") + F.col("intercept")
    return fits.select(
        "obs_point", "seq", "samples", F.round(F.coalesce("slope", F.lit(0.0)), 7).alias("slope"),
        F.round(F.coalesce(at, F.lit(0.0)) / 1e6, 1).alias("drift_ms"),
    )


@query
def stream_correct_time(spark, packets, sf_dir):
    rows = _stream(spark, sf_dir).select("packet_id", "ts", "obs_point")
    done = stream_clocks.stream_correct_time(rows, E.samples_of(_stream_events(spark, sf_dir)), late=LATE)
    return _drain(spark, done, "corrected").select("packet_id", F.expr("(corrected_ns + 500) div 1000").alias("corrected_us"))


@query
def stream_flows_idle(spark, packets, sf_dir):
    done = _drain(spark, streaming.stream_flows_idle(_stream(spark, sf_dir), E.IDLE, LATE), "idle")
    return done.select(*keys.KEY_FIELDS, *_times(), "packet_total", "octet_total")


@query
def stream_rtt(spark, packets, sf_dir):
    done = _drain(spark, streaming.stream_rtt(_stream(spark, sf_dir), E.PAIR_TIMEOUT, LATE, E.IDLE, buckets=BUCKETS), "rtt")
    return done.select("packet_id", "matched_id", "direction", "delay_us")


@query
def stream_one_way_delay(spark, packets, sf_dir):
    done = streaming.stream_one_way_delay(_two_points(_stream(spark, sf_dir)), 1, 2, "10 minutes", LATE)
    return _drain(spark, done, "delay")


@query
def stream_flows_to_table(spark, packets, sf_dir):
    finished = _stream_flows(spark, sf_dir, None)
    path, checkpoint = new_folder(spark, "sink"), new_folder(spark, "sink-checkpoint")
    stream_flows_to(finished, path, checkpoint, availableNow=True).awaitTermination()
    stored = spark.read.parquet(path)
    return stored.groupBy("end_reason").agg(F.count(F.lit(1)).alias("flows"), F.sum("packet_total").alias("packets"))


@query
def stream_aggregate(spark, packets, sf_dir):
    """Finished flows of the stream through the cascade; totals per level."""
    finished = _stream_flows(spark, sf_dir, None)
    path, checkpoint = new_folder(spark, "cascade"), new_folder(spark, "cascade-checkpoint")
    streaming.stream_aggregate(
        finished, path, checkpoint, {"availableNow": True}, octets=E.MICE_OCTETS, distinct=None
    ).awaitTermination()
    stored = spark.read.parquet(path)
    return stored.groupBy("agg_level").agg(F.sum("original_present").alias("flows"), F.sum("packet_total").alias("packets"))
