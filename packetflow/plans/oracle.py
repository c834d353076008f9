"""The registered queries in plain SQL over the raw tables."""

from __future__ import annotations

from packetflow.operators.records import DEFAULT_TEMPLATE, ENTERPRISE, template_elements
from packetflow.plans import oracle_base as B

ORACLE: dict[str, str] = {}

ID = "ip_version, protocol, src_ip, dst_ip, src_port, dst_port, dns_id, flow_no"
TIMES = "start_us, end_us"
HOUR = 3_600_000_000


def _sql(name: str, ctes: list[str], select: str) -> None:
    ORACLE[name] = B.with_clauses(*ctes) + select


def _packets(name: str, select: str, *more: str) -> None:
    _sql(name, [B.PACKETS, *more], select)


def _split(name: str, select: str, *more: str, biflow: bool = True, fin: bool = True) -> None:
    _sql(name, [*B.base(biflow, fin), *more], select)


def _flows(name: str, select: str, *more: str, biflow: bool = True) -> None:
    _sql(name, [*B.flow_base(biflow), *more], select)


# --- sources and filters ------------------------------------------------------------------

_packets(
    "read_packets",
    """SELECT packet_id, t, interface, obs_point, src_mac, dst_mac, ip_version, protocol, src_ip, dst_ip, src_port, dst_port,
    ttl, tos, ip_id, ip_offset, ip_hlength, ip_length, ip_plength, udp_length, tcp_flags, tcp_seq, tcp_ack, tcp_window,
    tcp_urgent_ptr, tcp_hlength, dns_id, dns_qr, icmp_type, icmp_code, flow_label, next_header, host FROM packets""",
)
_merged_points = """points AS (SELECT * FROM packets WHERE interface = 'eth0' AND ip_length >= 100
  UNION ALL SELECT * FROM packets WHERE interface = 'eth1' AND (t // 1000000) % 14 < 4)"""
_sql(
    "union_interfaces_flows",
    [B.PACKETS, _merged_points, B.keyed(True, source="points"), B.split(), B.flows()],
    f"SELECT {ID}, {TIMES}, end_reason, packet_total, octet_total FROM flows",
)
_REASON = """CASE WHEN ip_hlength < 20 THEN 'bad IP header length' WHEN protocol = 6 AND tcp_hlength < 20 THEN 'bad TCP header length'
  WHEN protocol = 17 AND udp_length < 8 THEN 'bad UDP length' END"""
_packets(
    "decode_frames_packets",
    f"""SELECT packet_id, t, src_mac, dst_mac, ip_version, src_ip, dst_ip, ttl, tos, protocol,
    CASE WHEN ip_version=4 THEN ip_id ELSE 0 END AS ip_id, CASE WHEN ip_version=4 THEN ip_offset ELSE 0 END AS ip_offset,
    ip_hlength, ip_length, ip_plength, src_port, dst_port, udp_length, tcp_seq * CAST(protocol IN (1,6,58) AS INT) AS tcp_seq,
    tcp_ack * CAST(protocol = 6 AS INT) AS tcp_ack, tcp_flags, tcp_window, tcp_urgent_ptr, tcp_hlength, icmp_type, icmp_code,
    flow_label, CASE WHEN ip_version=4 THEN 0 WHEN packet_id % 4 = 1 THEN 0 ELSE next_header END AS next_header,
    dns_id, dns_opcode, dns_rd, dns_qr, l3_hlength, l3_length, l4_hlength, coalesce({_REASON}, '') AS reject_reason FROM packets""",
)
_packets(
    "capture_filter",
    """SELECT packet_id, interface, protocol, ip_length FROM packets
    WHERE (interface='eth0' AND protocol = 6 AND ip_length > 80) OR (interface='eth1' AND (ip_version = 6 OR dst_port = 53))""",
)
_packets("ip_only", "SELECT packet_id, ip_version FROM packets WHERE ip_id % 11 <> 0 AND ip_version IN (4, 6)")
_packets(
    "supported_transport",
    """SELECT * FROM (SELECT packet_id, ip_version, CASE WHEN ip_id % 13 = 0 THEN 47 WHEN ip_id % 7 = 0 THEN 2 ELSE protocol END AS protocol
    FROM packets) WHERE (ip_version=4 AND protocol IN (6,17,1,2)) OR (ip_version=6 AND protocol IN (17,6,58))""",
)
_packets(
    "valid_headers",
    f"SELECT packet_id, protocol, tcp_hlength, udp_length FROM packets WHERE ({_REASON}) IS NULL",
)
_packets(
    "rejected_headers",
    f"SELECT interface, {_REASON} AS reject_reason, count(*) AS packets FROM packets WHERE ({_REASON}) IS NOT NULL GROUP BY 1, 2",
)
_LATER = "ip_version = 6 AND ip_offset & 8191 <> 0"
_packets(
    "first_fragment_only",
    f"""SELECT packet_id, ip_version, CASE WHEN {_LATER} THEN 0 ELSE src_port END AS src_port,
    CASE WHEN {_LATER} THEN 0 ELSE dst_port END AS dst_port FROM packets""",
)

# --- sampling ---------------------------------------------------------------------------------

_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY interface ORDER BY t, packet_id) AS n FROM packets)"
_RANKED_ALL = "ranked AS (SELECT *, row_number() OVER (ORDER BY t, packet_id) AS n FROM packets)"
_DRAW = "md5(concat('7:', CAST(packet_id AS VARCHAR)))"
_FRACTION = f"(CAST(concat('0x', substr({_DRAW}, 1, 8)) AS BIGINT) / 4294967296.0)"
_packets("sample_none", "SELECT packet_id FROM packets")
_packets("sample_count", "SELECT packet_id, interface FROM ranked WHERE (n - 1) % 14 < 4", _RANKED)
_packets("sample_count_inverted", "SELECT packet_id, interface FROM ranked WHERE n % 14 >= 4", _RANKED)
_packets("sample_count_global", "SELECT packet_id, interface FROM ranked WHERE (n - 1) % 14 < 4", _RANKED_ALL)
_packets("sample_time", "SELECT packet_id FROM packets WHERE (t // 1000000) % 14 < 4")


def _runs(n: int) -> str:
    return f"""runs AS (SELECT *, row_number() OVER (PARTITION BY interface, (n - 1) // {n} ORDER BY {_DRAW}, packet_id) AS place FROM ranked)"""


_packets("sample_n_of_N", "SELECT packet_id, interface FROM runs WHERE place <= 4", _RANKED, _runs(10))
_packets("sample_uniform", f"SELECT packet_id FROM packets WHERE {_FRACTION} < 0.25")
_packets(
    "sample_time_decay",
    f"""SELECT packet_id FROM (SELECT *, CAST(t // 1000000 AS DOUBLE) AS s FROM packets) WHERE {_FRACTION} <
    CASE WHEN s < 1705000000.0 THEN pow(s / 1705000000.0, 4) WHEN s > 1706000000.0 THEN pow(1706000000.0 / s, 4) ELSE 1.0 END""",
)
_packets(
    "sample_by_interface",
    "SELECT packet_id, interface FROM runs WHERE (interface='eth0' AND place <= 3) OR (interface='eth1' AND (n - 1) % 7 < 2)",
    _RANKED,
    _runs(8),
)

_FILTERED = "chosen AS (SELECT * FROM packets WHERE (interface = 'eth0' AND protocol = 6) OR (interface = 'eth1' AND ip_length > 100))"
_packets(
    "apply_interfaces",
    "SELECT packet_id, interface FROM runs WHERE (interface='eth1' AND place <= 3) OR (interface='eth0' AND (n - 1) % 7 < 2)",
    _FILTERED,
    _RANKED.replace("FROM packets", "FROM chosen"),
    _runs(8),
)

# --- keys and identity ----------------------------------------------------------------------

_KEYED = "SELECT packet_id, ip_version, protocol, k_ip1, k_port1, k_ip2, k_port2, k_dns, orient FROM keyed"
_packets("flow_key", _KEYED, B.keyed())
_packets("dns_flow_key", "SELECT packet_id, k_dns FROM keyed", B.keyed())
_packets("biflow_key", _KEYED, B.keyed(True))
_packets("biflow_key_all_protocols", _KEYED, B.keyed(all_protocols=True))


def _wire(ip: str) -> str:
    return " + ".join(f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256**i}" for i in range(4))


def _v6(ip: str) -> str:
    """Eight padded groups of an address with one '::'."""
    head, tail = f"split_part({ip}, '::', 1)", f"split_part({ip}, '::', 2)"
    count = lambda x: f"len(list_filter(string_split({x}, ':'), lambda g: g <> ''))"
    zeros = f"repeat(':0', 8 - {count(head)} - {count(tail)})"
    return (
        f"array_to_string(list_transform(list_filter(string_split(concat({head}, {zeros}, ':', {tail}), ':'), lambda g: g <> ''),"
        " lambda g: lpad(g, 4, '0')), ':')"
    )


def _id_text(src: str, dst: str, sport: str, dport: str) -> str:
    v4 = f"concat(CAST(protocol AS VARCHAR), CAST({_wire(src)} AS VARCHAR), CAST({_wire(dst)} AS VARCHAR), CAST({sport} AS VARCHAR), CAST({dport} AS VARCHAR))"
    v6 = f"concat(CAST(protocol AS VARCHAR), {_v6(src)}, {_v6(dst)}, CAST({sport} AS VARCHAR), CAST({dport} AS VARCHAR))"
    return f"CASE WHEN ip_version = 4 THEN {v4} ELSE {v6} END"


def _times33(text: str) -> str:
    """Sum of 33^(n-i) * c_i modulo 2^64, by reduction over the characters."""
    return (
        f"CAST(list_reduce(list_prepend(CAST(5381 AS HUGEINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS HUGEINT))),"
        " lambda h, c: (h * 33 + c) % 18446744073709551616) AS VARCHAR)"
    )


_packets(
    "flow_id",
    f"SELECT packet_id, {_times33('tx')} AS flow_id FROM (SELECT packet_id, {_id_text('src_ip', 'dst_ip', 'src_port', 'dst_port')} AS tx FROM packets)",
)
_packets(
    "reverse_flow_id",
    f"SELECT packet_id, {_times33('tx')} AS reverse_flow_id FROM (SELECT packet_id, {_id_text('dst_ip', 'src_ip', 'dst_port', 'src_port')} AS tx FROM packets)",
)
_packets(
    "flow_id_fast",
    "SELECT ip_version, protocol, src_ip, dst_ip, src_port, dst_port, count(*) AS packets FROM packets GROUP BY ALL",
)


def _v4_hex(ip: str) -> str:
    return "concat(" + ", ".join(f"printf('%02x', CAST(split_part({ip}, '.', {i}) AS INT))" for i in range(1, 5)) + ")"


_IP_HEX = f"""built AS (SELECT packet_id, 20 + 4 * (ip_id % 4) AS hl, CASE ip_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 38 ELSE 5 END AS pl,
  printf('%04x', 20 + 4 * (ip_id % 4) + CASE ip_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 38 ELSE 5 END) AS len_hex, printf('%04x', ip_id) AS id_hex,
  printf('%02x', protocol) AS proto_hex, {_v4_hex('src_ip')} AS src_hex, {_v4_hex('dst_ip')} AS dst_hex,
  repeat('01', 4 * (ip_id % 4)) AS opt_hex, substr(repeat(packet_digest, 4), 1, 2 * CASE ip_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 38 ELSE 5 END) AS pay_hex
  FROM packets WHERE ip_version = 4)"""
_packets(
    "packet_id",
    """SELECT packet_id, md5(from_hex(concat(len_hex, id_hex, proto_hex, src_hex, dst_hex,
    CASE WHEN pl >= 43 THEN substr(pay_hex, 1, 86) ELSE right(concat(opt_hex, pay_hex), 86) END))) AS packet_digest FROM built""",
    _IP_HEX,
)
_V6_HEX = f"""built6 AS (SELECT packet_id, CASE packet_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 38 ELSE 5 END AS pl, printf('%02x', protocol) AS proto_hex,
  replace({_v6('src_ip')}, ':', '') AS src_hex, replace({_v6('dst_ip')}, ':', '') AS dst_hex, repeat(packet_digest, 4) AS pay_hex
  FROM packets WHERE ip_version = 6)"""
_packets(
    "packet_id_all",
    """SELECT packet_id, md5(from_hex(concat(len_hex, id_hex, proto_hex, src_hex, dst_hex,
    CASE WHEN pl >= 43 THEN substr(pay_hex, 1, 86) ELSE right(concat(opt_hex, pay_hex), 86) END))) AS packet_digest FROM built
    UNION ALL SELECT packet_id, md5(from_hex(concat(printf('%04x', pl), proto_hex, src_hex, dst_hex, substr(pay_hex, 1, 2 * least(pl, 43))))) FROM built6""",
    _IP_HEX,
    _V6_HEX,
)
_bits4 = sum(1 << b for b in (3, 6, 11, 59, 7, 10))
_bits6 = sum(1 << b for b in (3, 6, 11, 59, 26, 27))
_packets(
    "flow_key_indicator",
    f"SELECT ip_version, CASE WHEN ip_version=4 THEN {_bits4} ELSE {_bits6} END AS flow_key_indicator, count(*) AS packets FROM packets GROUP BY 1, 2",
)

# --- splitting ----------------------------------------------------------------------------------

_split("split_idle", "SELECT packet_id, flow_no, direction, t0 AS start_us FROM split", biflow=False, fin=False)
_split("split_fin", "SELECT packet_id, flow_no, direction, t0 AS start_us FROM split")
_split("slice_active", f"SELECT packet_id, flow_no, (t - t0) // {B.ACTIVE_US} AS slice FROM split")
_flows("end_reason", f"SELECT {ID}, end_reason, {TIMES}, packet_total FROM flows")
_flows(
    "force_end",
    f"""SELECT {ID}, {TIMES}, packet_total FROM flows
    WHERE NOT fin_end AND epoch_us(TIMESTAMP '2024-02-01 00:00:00') - end_us <= {B.IDLE_US}""",
    biflow=False,
)
_split(
    "start_after_export",
    f"""SELECT {B.KEY}, flow_no, (t - t0) // {B.ACTIVE_US} AS slice, min(t) AS after_export_us, arg_min(packet_id, pos) AS first_packet
    FROM split GROUP BY ALL""",
)
_TOTALS = """packet_total, octet_total, octet_sum_squares, fin_count, syn_count, rst_count, psh_count, ack_count, urg_count,
  retransmitted_packets, retransmitted_octets"""
_flows("build_flows", f"SELECT {ID}, {TIMES}, end_reason, {_TOTALS} FROM flows", biflow=False)
_flows("build_flows_biflow", f"SELECT {ID}, {TIMES}, end_reason, {_TOTALS} FROM flows")


def _slices(active_us: int) -> list[str]:
    """CTEs for records per active period: ``pieces`` (deltas) and ``slices`` (running totals)."""
    grow = [
        "packet_total", "octet_total", "octet_sum_squares", "fin_count", "syn_count", "rst_count", "psh_count", "ack_count", "urg_count",
    ]
    running = ", ".join(f"CAST(sum({c}) OVER s AS BIGINT) AS {c}" for c in grow)
    return [
        f"sliced AS (SELECT *, (t - t0) // {active_us} AS slice FROM split)",
        f"""pieces AS (SELECT {B.KEY}, flow_no, slice, min(o0) AS o0, min(t0) AS start_us, max(t) AS end_us, min(t) AS after_export_us,
  arg_max(tcp_flags, pos) & 1 = 1 AND protocol = 6 AS fin_end, {B.SUMS} FROM sliced GROUP BY {B.KEY}, flow_no, slice)""",
        f"""slices AS (SELECT ip_version, protocol, CASE WHEN o0=1 THEN k_ip1 ELSE k_ip2 END AS src_ip, CASE WHEN o0=1 THEN k_ip2 ELSE k_ip1 END AS dst_ip,
  CASE WHEN o0=1 THEN k_port1 ELSE k_port2 END AS src_port, CASE WHEN o0=1 THEN k_port2 ELSE k_port1 END AS dst_port, k_dns AS dns_id,
  flow_no, slice, start_us, end_us, after_export_us, lead(slice) OVER s AS next_slice, lead(after_export_us) OVER s AS next_us, fin_end,
  CASE WHEN lead(slice) OVER s IS NOT NULL THEN 2 WHEN fin_end THEN 3
       WHEN (SELECT max(t) FROM packets) - end_us > {B.IDLE_US} THEN 1 ELSE 4 END AS end_reason,
  packet_total AS packet_delta, octet_total AS octet_delta, octet_sum_squares AS octet_delta_sum_squares,
  retransmitted_packets, retransmitted_octets, {running} FROM pieces WINDOW s AS (PARTITION BY {B.KEY}, flow_no ORDER BY slice))""",
    ]


_split(
    "build_flows_interim",
    f"SELECT {ID}, slice, {TIMES}, after_export_us, end_reason, {_TOTALS}, packet_delta, octet_delta FROM slices",
    *_slices(B.ACTIVE_US),
)
_split(
    "build_flows_empty_periods",
    f"""SELECT {ID}, slice, end_reason, packet_total, octet_total, packet_delta FROM slices UNION ALL
    SELECT {ID}, CAST(gap AS BIGINT) AS slice, 2, packet_total, octet_total, 0 FROM slices, unnest(range(slice + 1, next_slice)) AS g(gap) WHERE next_slice > slice + 1""",
    *_slices(20 * HOUR),
)

# --- measures -----------------------------------------------------------------------------------

for _name, _columns in {
    "packet_octet_totals": "packet_total, octet_total",
    "octet_sum_squares": "octet_sum_squares",
    "tcp_flag_counts": "fin_count, syn_count, rst_count, psh_count, ack_count, urg_count, tcp_flags_or",
    "directional_lengths": "l3_hlength_fwd, l3_hlength_bwd, l3_length_fwd, l3_length_bwd, l4_hlength_fwd, l4_hlength_bwd",
    "retransmitted": "retransmitted_packets, retransmitted_octets",
    "first_packet_attrs": """first_tos, first_ttl, first_ip_id, first_ip_offset, first_ip_hlength, first_ip_length, first_tcp_window,
      first_tcp_urgent_ptr, first_icmp_type, first_icmp_code, first_flow_label, first_next_header, source_mac, destination_mac""",
    "last_packet_attrs": "last_ip_plength, last_tcp_seq, last_tcp_ack, last_tcp_flags",
    "first_last_packet_id": "first_packet_id, last_packet_id",
    "sampled_flag": "is_sampled",
    "flow_times": TIMES,
    "application": "app_id, CASE app_id WHEN 1 THEN 'HTTP' WHEN 2 THEN 'SIP' ELSE 'Unknown' END AS app_name",
    "flow_speed": """CAST(CASE WHEN end_us = start_us THEN -1 ELSE floor(CAST(octet_total * 1000000 AS DOUBLE) / ((end_us - start_us) * 1000)) END AS BIGINT) AS flow_speed""",
}.items():
    _flows(_name, f"SELECT {ID}, {_columns} FROM flows")
ORACLE["retransmitted_by_prefix"] = ORACLE["retransmitted"].replace("(NOT opens AND protocol = 6 AND", "(NOT opens AND src_ip LIKE '192.168.%' AND protocol = 6 AND")
_split("deltas", f"SELECT {ID}, slice, packet_delta, octet_delta, octet_delta_sum_squares FROM slices", *_slices(B.ACTIVE_US))
_split(
    "deltas_zero_final",
    f"""SELECT {ID}, slice, CASE WHEN next_slice IS NULL THEN 0 ELSE packet_delta END AS packet_delta,
    CASE WHEN next_slice IS NULL THEN 0 ELSE octet_delta END AS octet_delta FROM slices""",
    *_slices(B.ACTIVE_US),
)

# --- joins --------------------------------------------------------------------------------------

_DNS = "protocol = 17 AND (src_port = 53 OR dst_port = 53)"
_ICMP = "(ip_version = 4 AND protocol = 1) OR (ip_version = 6 AND protocol = 58)"
_SAME_FLOW = " AND ".join(f"a.{c} = b.{c}" for c in [*B.KEY.split(", "), "flow_no"])
_ANSWERS = {
    "tcp": "b.protocol = 6 AND a.tcp_ack = b.tcp_seq",
    "dns": """b.protocol = 17 AND (b.src_port = 53 OR b.dst_port = 53) AND a.dns_qr = 0 AND b.dns_qr = 1 AND a.dns_id = b.dns_id
      AND a.dns_opcode = b.dns_opcode AND a.dns_rd = b.dns_rd""",
    "icmp": """((b.ip_version = 4 AND b.protocol = 1 AND b.icmp_type <> 8) OR (b.ip_version = 6 AND b.protocol = 58 AND b.icmp_type <> 128))
      AND a.tcp_seq = b.tcp_seq""",
}


def _pairs(timeout_us: int, kinds=("tcp", "dns", "icmp")) -> str:
    answers = " OR ".join(f"({_ANSWERS[k]})" for k in kinds)
    return f"""pairs AS (SELECT * FROM (SELECT b.packet_id, a.packet_id AS matched_id, b.direction, b.t - a.t AS delay_us, a.pos AS a_pos, b.pos AS b_pos,
  {", ".join("b." + c for c in B.KEY.split(", "))}, b.flow_no,
  row_number() OVER (PARTITION BY b.packet_id ORDER BY a.pos DESC) AS newest
  FROM split a JOIN split b ON {_SAME_FLOW} AND a.direction <> b.direction AND a.pos < b.pos AND ({answers})
  ) WHERE newest = 1 AND delay_us <= {timeout_us})"""


_PAIR = "SELECT packet_id, matched_id, direction, delay_us FROM pairs"
for _kind in _ANSWERS:
    _split(f"rtt_pairs_{_kind}", _PAIR, _pairs(B.PAIR_US, (_kind,)))
_split("rtt_pair_timeout", _PAIR, _pairs(6 * HOUR))
_split(
    "rtt_pairs_consume",
    "SELECT packet_id, matched_id, direction, delay_us FROM walk WHERE stands",
    _pairs(B.PAIR_US),
    f"""numbered_pairs AS (SELECT *, row_number() OVER (PARTITION BY {B.KEY}, flow_no, direction ORDER BY b_pos) AS nth,
  dense_rank() OVER (ORDER BY {B.KEY}, flow_no, direction) AS run FROM pairs)""",
    """walk AS (SELECT packet_id, matched_id, direction, delay_us, run, nth, true AS stands, b_pos AS limit_pos FROM numbered_pairs WHERE nth = 1
  UNION ALL SELECT p.packet_id, p.matched_id, p.direction, p.delay_us, p.run, p.nth, p.a_pos > w.limit_pos,
  CASE WHEN p.a_pos > w.limit_pos THEN p.b_pos ELSE w.limit_pos END FROM walk w JOIN numbered_pairs p ON p.run = w.run AND p.nth = w.nth + 1)""",
)
_RTT = f"""rtt AS (SELECT {B.KEY}, flow_no, coalesce(avg(delay_us * 1000.0) FILTER (WHERE direction = 1), 0.0) AS rtt_fwd,
  coalesce(avg(delay_us * 1000.0) FILTER (WHERE direction = 2), 0.0) AS rtt_bwd, count(*) AS rtt_pairs FROM pairs GROUP BY {B.KEY}, flow_no)"""
_split(
    "rtt_summary",
    f"SELECT {B.KEY}, flow_no, round(rtt_fwd, 3) AS rtt_fwd, round(rtt_bwd, 3) AS rtt_bwd, round(rtt_fwd + rtt_bwd, 3) AS rtt, rtt_pairs FROM rtt",
    _pairs(B.PAIR_US),
    _RTT,
)
_WITH_RTT = f"""flows_rtt AS (SELECT f.*, coalesce(r.rtt_fwd, 0.0) AS rtt_fwd, coalesce(r.rtt_bwd, 0.0) AS rtt_bwd, coalesce(r.rtt_pairs, 0) AS rtt_pairs
  FROM flows f LEFT JOIN rtt r ON {" AND ".join(f"f.{c} = r.{c}" for c in [*B.KEY.split(", "), "flow_no"])})"""
_flows(
    "flow_rtt",
    f"SELECT {ID}, packet_total, round(rtt_fwd, 3) AS rtt_fwd, round(rtt_bwd, 3) AS rtt_bwd, rtt_pairs FROM flows_rtt",
    _pairs(B.PAIR_US),
    _RTT,
    _WITH_RTT,
)
_BY_PORT = """CASE WHEN protocol = 6 AND (dst_port BETWEEN 40000 AND 40199 OR src_port BETWEEN 40000 AND 40199) THEN 5
  WHEN protocol = 6 AND 80 IN (dst_port, src_port) THEN 1
  WHEN protocol = 6 AND (dst_port BETWEEN 81 AND 89 OR src_port BETWEEN 81 AND 89) THEN 2
  WHEN protocol = 17 AND (dst_port BETWEEN 5060 AND 5069 OR src_port BETWEEN 5060 AND 5069) THEN 3
  WHEN protocol = 17 AND 53 IN (dst_port, src_port) THEN 4 ELSE 0 END"""
_packets("classify_by_port", f"SELECT packet_id, {_BY_PORT} AS app_id FROM packets")
_packets(
    "classify_by_host",
    f"""SELECT packet_id, CASE WHEN contains(host, 'cdn.example') THEN 6 WHEN contains(host, 'u7.') THEN 7 ELSE {_BY_PORT} END AS app_id
    FROM packets""",
)
ORACLE["classify_by_host_pieces"] = ORACLE["classify_by_host"]
_packets(
    "application_name",
    f"""SELECT CASE {_BY_PORT} WHEN 1 THEN 'Web' WHEN 2 THEN 'Admin' WHEN 3 THEN 'Voice' WHEN 4 THEN 'Names' WHEN 5 THEN 'Clients'
    ELSE 'Unknown' END AS app_name, count(*) AS packets, CAST(sum(ip_length) AS BIGINT) AS octets FROM packets GROUP BY 1""",
)
_packets("application_id", "SELECT packet_id, 100663296 + app_id AS application_id FROM packets")

# --- clocks -------------------------------------------------------------------------------------

_SYNC = """sync AS (SELECT 1 + user_id % 4 AS obs_point, event_id AS seq, us * 1000 - 2000000 - k * 1000 AS t1,
  us * 1000 - 1000000 - (us - 1704067200000000) // 50 - k * 700 AS t2, us * 1000 AS t3
  FROM (SELECT *, epoch_us(ts) AS us, CAST(regexp_replace(props,'[^0-9]','','g') AS BIGINT) AS k FROM events WHERE event_type = 'view')),
offsets AS (SELECT *, (t3 - t1) // 2 AS delay, t3 - t2 - (t3 - t1) // 2 AS drift FROM sync),
based AS (SELECT *, first_value(t3) OVER w AS x0, first_value(drift) OVER w AS y0 FROM offsets WINDOW w AS (PARTITION BY obs_point ORDER BY t3, seq)),
shifted AS (SELECT *, CAST(t3 - x0 AS DOUBLE) AS x, CAST(drift - y0 AS DOUBLE) AS y FROM based),
fits AS (SELECT *, regr_slope(y, x) OVER w AS raw_slope, regr_intercept(y, x) OVER w AS raw_intercept, count(*) OVER w AS samples
  FROM shifted WINDOW w AS (PARTITION BY obs_point ORDER BY t3, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
lines AS (SELECT *, CASE WHEN samples > 1 THEN raw_slope END AS slope, CASE WHEN samples > 1 THEN raw_intercept END AS intercept FROM fits)"""
_sql("clock_offset", [_SYNC], "SELECT obs_point, seq, delay, drift FROM offsets")
_sql(
    "drift_fit",
    [_SYNC],
    """SELECT obs_point, seq, samples, round(coalesce(slope, 0.0), 7) AS slope,
    round(coalesce(slope * x + y0 + intercept, 0.0) / 1e6, 1) AS drift_ms FROM lines""",
)
_FORCE = """timed AS (SELECT p.packet_id, p.t, l.slope, l.intercept, l.x0, l.y0 FROM packets p ASOF LEFT JOIN
  (SELECT * FROM lines WHERE slope IS NOT NULL) l ON p.obs_point = l.obs_point AND p.t * 1000 >= l.t3)"""
_sql("clock_as_of", [B.PACKETS, _SYNC, _FORCE], """SELECT packet_id, round(coalesce(slope, 0.0), 9) AS slope, coalesce(x0, -1) AS x0, coalesce(y0, -1) AS y0,
  CAST(round(coalesce(intercept, 0.0) / 1000) AS BIGINT) AS intercept_us FROM timed""")
_CORRECTED = """corrected AS (SELECT *, t * 1000 - coalesce(CAST(trunc(slope * CAST(t * 1000 - x0 AS DOUBLE)) AS BIGINT) + y0
  + CAST(trunc(intercept) AS BIGINT), 0) AS ns FROM timed)"""
_sql("correct_time", [B.PACKETS, _SYNC, _FORCE, _CORRECTED], "SELECT packet_id, (ns + 500) // 1000 AS corrected_us FROM corrected")
_LABEL = "CASE protocol WHEN 1 THEN 'ICM' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 58 THEN 'IC6' ELSE printf('%03d', protocol) END"
_RETIMED = "packets AS (SELECT r.* REPLACE ((c.ns + 500000) // 1000000 * 1000 AS t) FROM raw_packets r JOIN corrected c USING (packet_id))"
_sql(
    "corrected_flows",
    [B.PACKETS.replace("packets AS (", "raw_packets AS ("), _SYNC, _FORCE.replace("FROM packets p", "FROM raw_packets p"), _CORRECTED, _RETIMED, *B.flow_base(True)[1:]],
    f"SELECT {ID}, start_us, end_us, packet_total, octet_total FROM flows",
)
_packets(
    "time_precision",
    "SELECT packet_id, t // 1000000 AS seconds, t // 1000 AS millis, t AS micros, t * 1000 AS nanos FROM packets",
)
_packets(
    "one_way_delay",
    """SELECT b.packet_digest, a.packet_id AS packet_id_a, b.packet_id AS packet_id_b, b.t - a.t AS delay_us
    FROM seen2 b ASOF JOIN seen1 a ON a.packet_digest = b.packet_digest AND b.t >= a.t WHERE b.t - a.t <= 600000000""",
    "seen1 AS (SELECT packet_id, t, md5(CAST(packet_id % 4000 AS VARCHAR)) AS packet_digest FROM packets)",
    """seen2 AS (SELECT packet_id, t + 1000 * ttl AS t, md5(CAST(packet_id % 4000 AS VARCHAR)) AS packet_digest FROM packets WHERE ip_id % 7 <> 0)""",
)

# --- aggregation --------------------------------------------------------------------------------

_MERGE = ["ip_version", "protocol", "src_ip", "dst_ip", "src_port", "dst_port"]
_SUMMED = ["packet_total", "octet_total", "octet_sum_squares", "fin_count", "syn_count", "ack_count", "retransmitted_packets",
           "l3_length_fwd", "l3_length_bwd", "original_present", "original_initiated", "original_completed"]
_LAST = ["last_ip_plength", "last_tcp_seq", "last_tcp_flags"]
_DISTINCT = ["distinct_src", "distinct_src_v4", "distinct_src_v6", "distinct_dst", "distinct_dst_v4", "distinct_dst_v6"]
_ZERO_IP = "CASE WHEN ip_version = 6 THEN '::' ELSE '0.0.0.0' END"
_REDUCE = {"src_ip": _ZERO_IP, "dst_ip": _ZERO_IP, "src_port": "0", "dst_port": "0"}
_ORDER = ["src_ip", "dst_ip", "src_port", "dst_port"]
_MERGED_OUT = ", ".join([*_MERGE, "start_us", "end_us", *_SUMMED, *_LAST])


def _merge_cte(name: str, source: str, level: int, by: tuple[str, ...] = (), where: str = "true") -> str:
    """Reduce the first ``level`` fields of ``source`` and merge; endpoints travel as lists."""
    fields = {c: c for c in _MERGE}
    for c in _ORDER[:level]:
        fields[c] = _REDUCE[c]
    keys = [*by, *_MERGE]
    reduced = ", ".join([*by, *[f"{v} AS {k}" for k, v in fields.items()]])
    kept = ", ".join([*_SUMMED, "ord", "start_us", "end_us", "srcs", "dsts"])
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMMED)
    lasts = ", ".join(["max(ord) AS ord", *[f"max(ord).{c} AS {c}" for c in _LAST]])
    return f"""{name} AS (SELECT {", ".join(keys)}, {sums}, {lasts}, min(start_us) AS start_us, max(end_us) AS end_us,
  list_distinct(flatten(list(srcs))) AS srcs, list_distinct(flatten(list(dsts))) AS dsts
  FROM (SELECT {reduced}, {kept} FROM {source} WHERE {where}) GROUP BY {", ".join(keys)})"""


def _distinct_of(srcs: str, dsts: str) -> str:
    out = []
    for side, items in (("src", srcs), ("dst", dsts)):
        out.append(f"{items} AS distinct_{side}")
        out += [f"CASE WHEN ip_version = {v} THEN {items} ELSE 0 END AS distinct_{side}_v{v}" for v in (4, 6)]
    return ", ".join(out)


_COUNTED = _distinct_of("len(srcs)", "len(dsts)")
_LISTED = f"""listed AS (SELECT *, [src_ip] AS srcs, [dst_ip] AS dsts,
  struct_pack(end_us := end_us, start_us := start_us, flow_no := flow_no, {", ".join(f"{c} := {c}" for c in _LAST)}) AS ord FROM flows)"""


def _cascade(octets: int, levels: int = 4, by: tuple[str, ...] = (), mice: str = "true", source: str = "listed") -> list[str]:
    small = f"octet_total < {octets} AND ({mice})"
    ctes = []
    previous, where = source, small
    extra = "".join(f"{c}, " for c in by)
    union = [f"SELECT 0 AS agg_level, {extra}{_MERGED_OUT}, {_COUNTED} FROM {source} WHERE NOT ({small})"]
    for level in range(1, levels + 1):
        ctes.append(_merge_cte(f"level{level}", previous, level, by, where))
        done = "true" if level == levels else f"octet_total >= {octets}"
        union.append(f"SELECT {level} AS agg_level, {extra}{_MERGED_OUT}, {_COUNTED} FROM level{level} WHERE {done}")
        previous, where = f"level{level}", f"octet_total < {octets}"
    ctes.append("cascade AS (" + " UNION ALL ".join(union) + ")")
    return ctes


_flows("split_mice", f"SELECT {ID}, octet_total, octet_total < 500 AS mouse FROM flows")
_flows(
    "reduce_key",
    """SELECT ip_version, 0 AS protocol, CASE WHEN ip_version = 4 THEN '0.0.0.0' ELSE src_ip END AS src_ip,
    CASE WHEN ip_version = 6 THEN '::' ELSE dst_ip END AS dst_ip, 0 AS src_port, dst_port, count(*) AS flows,
    CAST(sum(octet_total) AS BIGINT) AS octets FROM flows GROUP BY 1, 2, 3, 4, 5, 6""",
)
_flows("merge_flows", f"SELECT {_MERGED_OUT}, {_COUNTED} FROM merged", _LISTED, _merge_cte("merged", "listed", 2))
_flows(
    "merge_flows_additive",
    f"SELECT {_MERGED_OUT}, {_distinct_of('original_present', 'original_present')} FROM merged",
    _LISTED,
    _merge_cte("merged", "listed", 2),
)
_CLOSE = "true AS src_close, true AS dst_close"
_flows("merge_flows_approx", f"SELECT {', '.join(_MERGE)}, octet_total, {_CLOSE} FROM merged", _LISTED, _merge_cte("merged", "listed", 2))
_flows(
    "distinct_endpoints",
    f"SELECT {', '.join(_MERGE)}, {_COUNTED} FROM merged",
    _LISTED,
    _merge_cte("merged", "listed", 2),
)
_flows(
    "original_flow_counts",
    """SELECT protocol, count(*) AS original_present, CAST(sum(original_initiated) AS BIGINT) AS original_initiated,
    CAST(sum(original_completed) AS BIGINT) AS original_completed, CAST(sum(fin_count) AS BIGINT) AS fin_count FROM flows GROUP BY protocol""",
)
_flows("aggregate_cascade", "SELECT * FROM cascade", _LISTED, *_cascade(500))
_flows(
    "aggregate_cascade_approx", f"SELECT agg_level, {', '.join(_MERGE)}, octet_total, {_CLOSE} FROM cascade WHERE agg_level > 0", _LISTED, *_cascade(500)
)
_flows("aggregate_finished", "SELECT * FROM cascade", _LISTED, *_cascade(500, 1, mice="end_reason = 3"))
_TRIGGERED = f"triggered AS (SELECT *, end_us // {B.DAY_US} * {B.DAY_US} AS trigger_us FROM listed)"
_flows("aggregate_every", "SELECT * FROM cascade", _LISTED, _TRIGGERED, *_cascade(500, by=("trigger_us",), source="triggered"))
_ACTIVE = f"""changes AS (SELECT moment // {{width}} AS bucket, CAST(sum(step) AS BIGINT) AS change FROM
  (SELECT start_us AS moment, 1 AS step FROM flows UNION ALL SELECT end_us + {B.IDLE_US}, -1 FROM flows) GROUP BY 1),
moments AS (SELECT moment, sum(sum(step)) OVER (ORDER BY moment) AS held FROM
  (SELECT start_us AS moment, 1 AS step FROM flows UNION ALL SELECT end_us + {B.IDLE_US}, -1 FROM flows) GROUP BY moment),
highest AS (SELECT moment // {{width}} AS bucket, max(held) AS held FROM moments GROUP BY 1),
closing AS (SELECT bucket, change, sum(change) OVER (ORDER BY bucket) AS active FROM changes),
active AS (SELECT bucket * {{width}} AS bucket_us, change, CAST(active AS BIGINT) AS active,
  CAST(greatest(held, active - change) AS BIGINT) AS peak FROM closing JOIN highest USING (bucket))"""
_flows(
    "aggregate_auto",
    "SELECT * FROM cascade",
    _LISTED,
    _TRIGGERED,
    _ACTIVE.format(width=B.DAY_US),
    "crossing AS (SELECT min(bucket_us) AS begins FROM active WHERE peak > 0.75 * 714)",
    *_cascade(500, by=("trigger_us",), source="triggered", mice="coalesce(trigger_us >= (SELECT begins FROM crossing), false)"),
)

# --- records ------------------------------------------------------------------------------------

_NAMED_APP = "CASE app_id WHEN 1 THEN 'HTTP' WHEN 2 THEN 'SIP' ELSE 'Unknown' END"
_v4i, _v6i = "ip_version = 4 AND protocol = 1", "ip_version = 6 AND protocol = 58"
_INIT, _EXPORT = 1_704_067_200_000, 1_706_745_600_000_000
_ACTIVE_S, _IDLE_S = 432_000 % 32_768, 172_800 % 32_768
_FIRST_OCTET = "CAST(split_part(dst_ip, '.', 1) AS INT)"
_VALUES = {
    "octetDeltaCount": "octet_delta", "packetDeltaCount": "packet_delta", "protocolIdentifier": "protocol",
    "ipClassOfService": "first_tos", "sourceTransportPort": "src_port",
    "sourceIPv4Address": "CASE WHEN ip_version=4 THEN src_ip ELSE '' END", "destinationTransportPort": "dst_port",
    "destinationIPv4Address": "CASE WHEN ip_version=4 THEN dst_ip ELSE '' END",
    "flowEndSysUpTime": f"end_us // 1000 - {_INIT}", "flowStartSysUpTime": f"start_us // 1000 - {_INIT}",
    "sourceIPv6Address": "CASE WHEN ip_version=6 THEN src_ip ELSE '' END",
    "destinationIPv6Address": "CASE WHEN ip_version=6 THEN dst_ip ELSE '' END", "flowLabelIPv6": "first_flow_label & 1048575",
    "icmpTypeCodeIPv4": f"CASE WHEN {_v4i} THEN first_icmp_type * 256 + first_icmp_code ELSE -1 END", "igmpType": "-1",
    "flowActiveTimeout": str(_ACTIVE_S), "flowIdleTimeout": str(_IDLE_S), "fragmentIdentification": "first_ip_id",
    "postIpClassOfService": "first_tos", "sourceMacAddress": "source_mac", "ipVersion": "ip_version",
    "destinationMacAddress": "destination_mac", "octetTotalCount": "octet_total", "packetTotalCount": "packet_total",
    "fragmentOffset": "first_ip_offset & 8191", "applicationId": "100663296 + app_id", "applicationName": _NAMED_APP,
    "exporterIPv4Address": "'192.0.2.1'", "exporterIPv6Address": "'2001:db8::1'", "droppedOctetDeltaCount": "retransmitted_octets",
    "droppedPacketDeltaCount": "retransmitted_packets", "flowEndReason": "end_reason", "observationPointId": "124",
    "icmpTypeCodeIPv6": f"CASE WHEN {_v6i} THEN first_icmp_type * 256 + first_icmp_code ELSE -1 END",
    "flowID": _times33("tx"), "observationDomainId": "3", "flowStartMilliseconds": "start_us // 1000",
    "flowEndMilliseconds": "end_us // 1000", "flowStartMicroseconds": "start_us", "flowEndMicroseconds": "end_us",
    "flowStartNanoseconds": "start_us * 1000", "flowEndNanoseconds": "end_us * 1000",
    "flowStartDeltaMicroseconds": f"{_EXPORT} - start_us", "flowEndDeltaMicroseconds": f"{_EXPORT} - end_us",
    "systemInitTimeMilliseconds": str(_INIT), "flowDurationMilliseconds": "end_us // 1000 - start_us // 1000",
    "flowDurationMicroseconds": "end_us - start_us",
    "flowKeyIndicator": f"CASE WHEN ip_version=4 THEN {_bits4} ELSE {_bits6} END",
    "icmpTypeIPv4": f"CASE WHEN {_v4i} THEN first_icmp_type ELSE -1 END", "icmpCodeIPv4": f"CASE WHEN {_v4i} THEN first_icmp_code ELSE -1 END",
    "icmpTypeIPv6": f"CASE WHEN {_v6i} THEN first_icmp_type ELSE -1 END", "icmpCodeIPv6": f"CASE WHEN {_v6i} THEN first_icmp_code ELSE -1 END",
    "tcpSequenceNumber": "last_tcp_seq", "tcpAcknowledgementNumber": "last_tcp_ack", "tcpWindowSize": "first_tcp_window",
    "tcpUrgentPointer": "first_tcp_urgent_ptr", "ipHeaderLength": "first_ip_hlength",
    "totalLengthIPv4": "CASE WHEN ip_version=4 THEN first_ip_length ELSE -1 END", "ipTTL": "first_ttl",
    "nextHeaderIPv6": "CASE WHEN ip_version=6 THEN first_next_header ELSE -1 END", "ipDiffServCodePoint": "first_tos >> 2",
    "ipPrecedence": "first_tos >> 5", "fragmentFlags": "(first_ip_offset >> 8) & 224", "octetDeltaSumOfSquares": "octet_delta_sum_squares",
    "octetTotalSumOfSquares": "octet_sum_squares", "ipPayloadLength": "last_ip_plength",
    "isMulticast": f"CASE WHEN ip_version=4 THEN CASE WHEN {_FIRST_OCTET} BETWEEN 224 AND 239 THEN 128 ELSE 0 END WHEN dst_ip LIKE 'ff%' THEN 128 ELSE 0 END",
    "ipv4IHL": "CASE WHEN ip_version=4 THEN first_ip_hlength // 4 ELSE -1 END", "collectorIPv4Address": "'192.0.2.9'",
    "collectorIPv6Address": "'2001:db8::9'", "exportInterface": "2", "exportProtocolVersion": "10", "exportTransportProtocol": "6",
    "collectorTransportPort": "4739", "exporterTransportPort": "4000", "tcpSynTotalCount": "syn_count", "tcpFinTotalCount": "fin_count",
    "tcpRstTotalCount": "rst_count", "tcpPshTotalCount": "psh_count", "tcpAckTotalCount": "ack_count", "tcpUrgTotalCount": "urg_count",
    "ipTotalLength": "first_ip_length", "originalFlowsPresent": "original_present", "originalFlowsInitiated": "original_initiated",
    "originalFlowsCompleted": "original_completed", "distinctCountOfSourceIPAddress": "1", "distinctCountOfDestinationIPAddress": "1",
    "distinctCountOfSourceIPv4Address": "CAST(ip_version=4 AS INT)", "distinctCountOfDestinationIPv4Address": "CAST(ip_version=4 AS INT)",
    "distinctCountOfSourceIPv6Address": "CAST(ip_version=6 AS INT)", "distinctCountOfDestinationIPv6Address": "CAST(ip_version=6 AS INT)",
    "roundTripTimeNanoseconds": "CAST(floor(rtt_fwd + rtt_bwd) AS BIGINT)", "packetPairsTotalCount": "rtt_pairs",
    "firstPacketID": "first_packet_id", "lastPacketID": "last_packet_id", "flowStartAfterExport": "after_export_us * 1000",
}
_TEXTED = f"""texted AS (SELECT *, {_id_text("src_ip", "dst_ip", "src_port", "dst_port")} AS tx FROM flows_rtt)"""


def _template(names: list[str]) -> str:
    return ", ".join(f'{_VALUES[n]} AS "{n}"' for n in names)


_ALL_NAMES = [e.name for e in template_elements(DEFAULT_TEMPLATE)]
_PLAIN_NAMES = [e.name for e in template_elements(DEFAULT_TEMPLATE) if e.enterprise != ENTERPRISE]
_PROJECTED = [_pairs(B.PAIR_US), _RTT, _WITH_RTT, _TEXTED]
_flows("project_template", f"SELECT {_template(_ALL_NAMES)} FROM texted", *_PROJECTED)
_flows("project_v9", f"SELECT {_template(_PLAIN_NAMES)} FROM texted", *_PROJECTED)
_flows(
    "information_elements",
    " UNION ALL ".join(
        f"""SELECT {e.enterprise} AS enterprise, {e.ie} AS ie, '{e.name}' AS name, {e.length} AS length, '{e.coding}' AS coding,
        count(nullif(CAST("{e.name}" AS VARCHAR), '{"" if e.type == "string" else -1}')) AS records FROM projected"""
        for e in template_elements(DEFAULT_TEMPLATE)
    ),
    *_PROJECTED,
    f"projected AS MATERIALIZED (SELECT {_template(_ALL_NAMES)} FROM texted)",
)
_flows(
    "project_v5",
    f"""SELECT CASE WHEN ip_version = 4 THEN src_ip ELSE '0.0.0.0' END AS "sourceAddress",
    CASE WHEN ip_version = 4 THEN dst_ip ELSE '0.0.0.0' END AS "destinationAddress", '0.0.0.0' AS "nextHop", 0 AS "inputInterface", 0 AS "outputInterface",
    packet_delta % 4294967296 AS "packetCount", octet_delta % 4294967296 AS "octetCount", start_us // 1000 - {_INIT} AS "startSystemUpTime",
    end_us // 1000 - {_INIT} AS "endSystemUpTime", src_port AS "sourcePort", dst_port AS "destinationPort", 0 AS padding1,
    tcp_flags_or AS "tcpFlags", protocol AS "protocolType", first_tos AS "typeOfService", 0 AS "sourceAs", 0 AS "destinationAs",
    0 AS "sourceMask", 0 AS "destinationMask", 0 AS padding2 FROM flows""",
)
_flows("observation_ids", f'SELECT {ID}, packet_total, 124 AS "observationPointId", 3 AS "observationDomainId" FROM flows')
_v6_or = lambda ip: f"CASE WHEN ip_version = 6 THEN {_v6(ip)} ELSE {ip} END"
_flows(
    "flow_report",
    f"""SELECT concat_ws(' ', 'flow ' || {_times33("tx")}, '[' || {_LABEL} || ']',
    concat({_v6_or("src_ip")}, ':', src_port, ' -> ', {_v6_or("dst_ip")}, ':', dst_port), 'packets ' || packet_total,
    concat('mac ', source_mac, ' -> ', destination_mac), 'reason ' || end_reason,
    CASE WHEN end_us <> start_us THEN 'speed ' || CAST(floor(CAST(octet_total * 1000000 AS DOUBLE) / ((end_us - start_us) * 1000)) AS BIGINT) || ' kBps' END,
    concat('data ', l3_length_fwd, ':', l3_length_bwd), 'level 0') AS line
    FROM (SELECT *, {_id_text("src_ip", "dst_ip", "src_port", "dst_port")} AS tx FROM flows)""",
)
_flows(
    "register_element",
    """SELECT src_port AS "sourceTransportPort", dst_port AS "destinationTransportPort", protocol AS "protocolIdentifier",
    packet_total AS "packetTotalCount", largest AS "largestPacket" FROM flows""",
)
ORACLE["register_element"] = ORACLE["register_element"].replace("count(*) AS packet_total,", "max(ip_length) AS largest, count(*) AS packet_total,")

# --- reports ------------------------------------------------------------------------------------

_packets(
    "interface_counters",
    f"""SELECT interface, count(*) AS captured, count(*) FILTER (WHERE (t // 1000000) % 14 < 4) AS sampled,
    count(*) FILTER (WHERE (t // 1000000) % 14 < 4 AND ({_REASON}) IS NOT NULL) AS rejected FROM packets GROUP BY interface""",
)
_flows("active_flow_count", "SELECT bucket_us, change, active, peak FROM active", _ACTIVE.format(width=HOUR))
_flows(
    "protocol_mix",
    f"""SELECT {_LABEL} AS label, count(*) AS flows, CAST(sum(packet_total) AS BIGINT) AS packets, CAST(sum(octet_total) AS BIGINT) AS octets
    FROM flows GROUP BY 1""",
)
_packets(
    "tumbling_windows",
    f"""SELECT t // {HOUR} * {HOUR} AS start_us, protocol, count(*) AS packets, CAST(sum(ip_length) AS BIGINT) AS octets,
    count(*) FILTER (WHERE protocol = 6 AND tcp_flags & 2 > 0) AS syn_packets FROM packets GROUP BY 1, 2""",
)

# --- sinks and streams --------------------------------------------------------------------------

_flows(
    "write_flows_dated",
    """SELECT CAST(CAST(make_timestamp(end_us) AS DATE) AS VARCHAR) AS flow_date, count(*) AS flows,
    CAST(sum(packet_total) AS BIGINT) AS packets, CAST(sum(octet_total) AS BIGINT) AS octets FROM flows GROUP BY 1""",
)
_packets(
    "stream_packets_counts",
    "SELECT interface, protocol, count(*) AS packets, CAST(sum(ip_length) AS BIGINT) AS octets FROM packets GROUP BY 1, 2",
)
# A stream over one file ends with the watermark one hour (the lateness) before its newest packet, in whole ms.
_MARK = f"((SELECT max(t) FROM packets) // 1000 - {HOUR // 1000}) * 1000"
# A flow has left the stream once the watermark is past its FIN, or more than the idle timeout past its end.
_CLOSED = f"(fin_end AND end_us <= {_MARK} OR {_MARK} > end_us + {B.IDLE_US})"
_split(
    "stream_flows",
    f"""SELECT {ID}, slice, {TIMES}, CASE WHEN next_slice IS NOT NULL THEN 2 WHEN fin_end THEN 3 ELSE 1 END AS end_reason,
    packet_total, octet_total, packet_delta, octet_delta, fin_count, syn_count, retransmitted_packets
    FROM slices WHERE next_us <= {_MARK} OR (next_us IS NULL AND {_CLOSED})""",
    *_slices(B.ACTIVE_US),
)
_IDLE_ONLY = [
    B.PACKETS, B.keyed(), B.split(fin=False).replace(f"t - prev_t > {B.IDLE_US}", f"t - prev_t >= {B.IDLE_US}"), B.flows(fin=False),
]
_sql(
    "stream_flows_idle",
    _IDLE_ONLY,
    f"SELECT {B.KEY}, {TIMES}, packet_total, octet_total FROM flows WHERE (end_us + {B.IDLE_US}) // 1000 * 1000 <= {_MARK}",
)
_sql(
    "stream_drift_fit",
    [_SYNC],
    """SELECT obs_point, seq, samples, round(coalesce(slope, 0.0), 7) AS slope, round(coalesce(slope * x + y0 + intercept, 0.0) / 1e6, 1) AS drift_ms
    FROM lines WHERE t3 // 1000 <= ((SELECT max(t3) FROM sync) // 1000000 - 3600000) * 1000""",
)
ORACLE["stream_correct_time"] = ORACLE["correct_time"] + f" WHERE t <= {_MARK}"
_packets("stream_sample_count", f"SELECT packet_id, interface, ip_length, host FROM ranked WHERE (n - 1) % 14 < 4 AND t <= {_MARK}", _RANKED)
# A run of ten has left once its last packet is behind the watermark.
_packets(
    "stream_sample_n_of_N",
    f"""SELECT packet_id, interface FROM runs WHERE place <= 4 AND
    (n - 1) // 10 < (SELECT count(*) FROM packets p WHERE p.interface = runs.interface AND p.t <= {_MARK}) // 10""",
    _RANKED, _runs(10),
)
_split(
    "stream_rtt",
    f"SELECT packet_id, matched_id, direction, delay_us FROM pairs JOIN (SELECT packet_id, t AS probe_us FROM packets) USING (packet_id) WHERE probe_us <= {_MARK}",
    _pairs(B.PAIR_US),
)
_flows(
    "stream_flow_measures",
    f"""SELECT {ID}, {TIMES}, packet_total, octet_total, octet_sum_squares, packet_delta, octet_delta, octet_delta_sum_squares, fin_count, syn_count, rst_count,
    psh_count, ack_count, urg_count, tcp_flags_or, retransmitted_packets, retransmitted_octets, app_id, l3_hlength_fwd, l3_hlength_bwd, l3_length_fwd,
    l3_length_bwd, l4_hlength_fwd, l4_hlength_bwd, first_tos, first_ttl, first_ip_id, first_ip_offset, first_ip_hlength, first_ip_length, first_tcp_window,
    first_tcp_urgent_ptr, first_icmp_type, first_icmp_code, first_flow_label, first_next_header, last_ip_plength, last_tcp_seq, last_tcp_ack, last_tcp_flags,
    source_mac, destination_mac, first_packet_id, last_packet_id FROM flows WHERE {_CLOSED}""",
)
# With every period on time: the records of a flow are its periods up to its end, the last of them final.  A flow that is open at the mark has
# shown the periods that ended by then.
_ON_TIME_US = 20 * HOUR
_split(
    "stream_flows_on_time",
    f"""SELECT {ID}, slice, start_us, CAST(coalesce(max(last_us) OVER (PARTITION BY {ID} ORDER BY slice), start_us) AS BIGINT) AS end_us,
    CASE WHEN slice < final THEN 2 WHEN fin_end THEN 3 ELSE 1 END AS end_reason,
    CAST(sum(n) OVER (PARTITION BY {ID} ORDER BY slice) AS BIGINT) AS packet_total, n AS packet_delta, octets AS octet_delta FROM told
    WHERE slice < final OR closed""",
    f"flow_list AS (SELECT *, t_last AS end_us FROM (SELECT {B.KEY}, flow_no, min(o0) AS o0, min(t) AS start_us, max(t) AS t_last, arg_max(tcp_flags, pos) & 1 = 1 AND protocol = 6 AS fin_end FROM split WHERE t <= {_MARK} GROUP BY {B.KEY}, flow_no, protocol))",
    f"""reached AS (SELECT *, {_CLOSED} AS closed, CASE WHEN fin_end THEN (end_us - start_us) // {_ON_TIME_US}
    ELSE (least(end_us + {B.IDLE_US}, {_MARK}) - start_us) // {_ON_TIME_US} END AS final FROM flow_list)""",
    f"sums AS (SELECT {B.KEY}, flow_no, (t - t0) // {_ON_TIME_US} AS slice, count(*) AS n, CAST(sum(ip_length) AS BIGINT) AS octets, max(t) AS last_us FROM split WHERE t <= {_MARK} GROUP BY ALL)",
    f"""told AS (SELECT CASE WHEN o0=1 THEN k_ip1 ELSE k_ip2 END AS src_ip, CASE WHEN o0=1 THEN k_ip2 ELSE k_ip1 END AS dst_ip, CASE WHEN o0=1 THEN k_port1 ELSE k_port2 END AS src_port,
    CASE WHEN o0=1 THEN k_port2 ELSE k_port1 END AS dst_port, k_dns AS dns_id, ip_version, protocol, flow_no, slice, start_us, last_us, final, fin_end, closed, coalesce(n, 0) AS n, coalesce(octets, 0) AS octets
    FROM (SELECT *, unnest(range(0, final + 1)) AS slice FROM reached) LEFT JOIN sums USING ({B.KEY}, flow_no, slice))""",
)
# A flush cuts every key: packets up to it and packets after it are never in one flow.
_FLUSH = "epoch_us(TIMESTAMP '2024-01-20 00:00:00')"
_flows(
    "stream_flows_flush",
    f"""SELECT {ID}, {TIMES}, CASE WHEN fin_end THEN 3 WHEN end_us <= {_FLUSH} AND {_FLUSH} - end_us <= {B.IDLE_US} THEN 4 ELSE 1 END AS end_reason, packet_total, octet_total
    FROM flows WHERE {_CLOSED} OR end_us <= {_FLUSH}""",
)
ORACLE["stream_flows_flush"] = ORACLE["stream_flows_flush"].replace("(prev_t IS NULL OR", f"(prev_t IS NULL OR (prev_t <= {_FLUSH} AND t > {_FLUSH}) OR")
# Both points have a watermark; what the join of ten minutes gives may be that much older.
ORACLE["stream_one_way_delay"] = ORACLE["one_way_delay"] + f" AND b.t <= (least((SELECT max(t) FROM seen1), (SELECT max(t) FROM seen2)) - {HOUR} - 600000000) // 1000 * 1000"
_packets("reject_counters", f"SELECT * FROM (SELECT {_REASON} AS reject_reason, count(*) AS packets FROM packets GROUP BY 1) WHERE reject_reason IS NOT NULL")
_flows(
    "stream_flows_to_table",
    f"""SELECT CASE WHEN fin_end THEN 3 ELSE 1 END AS end_reason, count(*) AS flows, CAST(sum(packet_total) AS BIGINT) AS packets
    FROM flows WHERE {_CLOSED} GROUP BY 1""",
)
_flows(
    "stream_aggregate",
    "SELECT agg_level, CAST(sum(original_present) AS BIGINT) AS flows, CAST(sum(packet_total) AS BIGINT) AS packets FROM cascade GROUP BY agg_level",
    _LISTED.removesuffix(")") + f" WHERE {_CLOSED})",
    *_cascade(500),
)

# Cut into chunks or not, the records are the same.
ORACLE["build_flows_hot_keys"] = ORACLE["build_flows_biflow"]
ORACLE["rtt_pairs_consume_hot_keys"] = ORACLE["rtt_pairs_consume"]
