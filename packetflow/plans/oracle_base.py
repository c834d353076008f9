"""SQL text shared by the oracle queries: the same packets, flows and pairs in plain SQL."""

PACKETS = """
e AS (SELECT event_id, ts, user_id, event_type, value,
             CAST(regexp_replace(props,'[^0-9]','','g') AS INT) AS k, user_id % 10 AS u10 FROM events),
b AS (SELECT *, CASE WHEN u10=9 THEN 6 ELSE 4 END AS ip_version,
  CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'purchase' THEN 17 WHEN 'signup' THEN 17
       ELSE CASE WHEN u10=9 THEN 58 ELSE 1 END END AS protocol,
  CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 81 WHEN 'purchase' THEN 5061 WHEN 'signup' THEN 53
       ELSE 1000+CAST(user_id AS INT) END AS server_port,
  CASE WHEN event_type='error' THEN 1000+CAST(user_id AS INT) ELSE 40000+CAST(user_id AS INT) END AS client_port,
  CASE WHEN u10=9 THEN concat('2001:db8::', CAST(user_id % 256 AS VARCHAR))
       ELSE concat('10.0.', CAST(user_id % 8 AS VARCHAR), '.', CAST(user_id % 250 AS VARCHAR)) END AS client_ip,
  CASE WHEN u10=9 THEN '2001:db8:ffff::1' ELSE concat('192.168.0.', CAST(user_id % 5 AS VARCHAR)) END AS server_ip,
  concat('02:00:00:00:00:', printf('%02x', CAST(user_id % 256 AS INT))) AS client_mac,
  concat('02:00:00:00:01:', printf('%02x', CAST(user_id % 5 AS INT))) AS server_mac,
  event_id % 2 AS rev FROM e),
packets AS (SELECT event_id AS packet_id, epoch_us(ts) AS t, CASE WHEN user_id % 3 = 0 THEN 'eth1' ELSE 'eth0' END AS interface,
  CAST(1 + user_id % 4 AS INT) AS obs_point,
  CASE WHEN rev=0 THEN client_mac ELSE server_mac END AS src_mac, CASE WHEN rev=0 THEN server_mac ELSE client_mac END AS dst_mac,
  ip_version, protocol,
  CASE WHEN rev=0 THEN client_ip ELSE server_ip END AS src_ip,   CASE WHEN rev=0 THEN server_ip ELSE client_ip END AS dst_ip,
  CASE WHEN rev=0 THEN client_port ELSE server_port END AS src_port, CASE WHEN rev=0 THEN server_port ELSE client_port END AS dst_port,
  32 + k % 96 AS ttl, (k % 8) * 32 AS tos, CAST(event_id % 65536 AS INT) AS ip_id,
  CASE k % 4 WHEN 0 THEN 16384 WHEN 1 THEN 8192 WHEN 2 THEN k ELSE 0 END AS ip_offset,
  CASE WHEN ip_version=6 THEN 40 ELSE 20 + 4 * (k % 2) END AS ip_hlength,
  40 + CAST(floor(value*3) AS INT) AS ip_length,
  40 + CAST(floor(value*3) AS INT) - CASE WHEN ip_version=6 THEN 40 ELSE 20 + 4 * (k % 2) END AS ip_plength,
  CASE WHEN protocol=17 THEN k ELSE 0 END AS udp_length,
  CASE WHEN protocol<>6 THEN 0 WHEN k<5 THEN 17 WHEN k<15 THEN 2 WHEN k<20 THEN 20 WHEN k<50 THEN 24 ELSE 16 END AS tcp_flags,
  k % 4 AS tcp_seq, CAST(floor(k/4) AS INT) % 4 AS tcp_ack,
  CASE WHEN protocol=6 THEN 1024 + k * 64 ELSE 0 END AS tcp_window, CASE WHEN protocol=6 THEN k % 3 ELSE 0 END AS tcp_urgent_ptr,
  CASE WHEN protocol=6 THEN 16 + 4 * (k % 5) ELSE 0 END AS tcp_hlength,
  CASE WHEN event_type='signup' THEN k % 3 ELSE 0 END AS dns_id,
  0 AS dns_opcode, CASE WHEN event_type='signup' THEN 1 ELSE 0 END AS dns_rd,
  CASE WHEN event_type='signup' THEN CAST(rev AS INT) ELSE 0 END AS dns_qr,
  CASE WHEN protocol IN (1,58) THEN CASE WHEN rev=0 THEN CASE WHEN ip_version=6 THEN 128 ELSE 8 END
                                         ELSE CASE WHEN ip_version=6 THEN 129 ELSE 0 END END ELSE 0 END AS icmp_type,
  CASE WHEN protocol IN (1,58) THEN k % 3 ELSE 0 END AS icmp_code,
  CASE WHEN ip_version=6 THEN k * 1000 ELSE 0 END AS flow_label,
  CASE WHEN ip_version=6 THEN protocol ELSE 0 END AS next_header,
  CASE WHEN ip_version=6 THEN 40 ELSE 20 + 4 * (k % 2) END AS l3_hlength,
  40 + CAST(floor(value*3) AS INT) AS l3_length,
  CASE WHEN protocol=6 THEN 16 + 4 * (k % 5) ELSE 0 END AS l4_hlength,
  md5(CAST(event_id AS VARCHAR)) AS packet_digest,
  k % 7 = 0 AS is_sampled,
  CASE WHEN k % 3 = 0 THEN 0 ELSE CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END END AS app_id,
  concat('u', CAST(user_id % 50 AS VARCHAR), CASE WHEN user_id % 3 = 0 THEN '.cdn.example.net' ELSE '.example.org' END) AS host
FROM b)
"""

KEY = "ip_version, protocol, k_ip1, k_port1, k_ip2, k_port2, k_dns"

_US = {"hour": 3_600_000_000, "day": 86_400_000_000}
IDLE_US = 48 * _US["hour"]
ACTIVE_US = 120 * _US["hour"]
PAIR_US = 24 * _US["hour"]
DAY_US = _US["day"]


def keyed(biflow: bool = False, all_protocols: bool = False, dns: bool = True, source: str = "packets") -> str:
    """CTE ``keyed``: packets with key columns and orientation."""
    is_dns = "(protocol = 17 AND (src_port = 53 OR dst_port = 53))"
    if all_protocols:
        two_way, k_dns = "true", "0"
    else:
        two_way = (
            f"(protocol = 6 OR (ip_version = 4 AND protocol = 1) OR (ip_version = 6 AND protocol = 58) OR {is_dns})"
            if biflow
            else "false"
        )
        k_dns = f"CASE WHEN {is_dns} THEN dns_id ELSE 0 END" if dns else "0"
    return f"""
swapped AS (SELECT *, {two_way} AND (src_ip > dst_ip OR (src_ip = dst_ip AND src_port > dst_port)) AS swap FROM {source}),
keyed AS (SELECT *, CASE WHEN swap THEN dst_ip ELSE src_ip END AS k_ip1, CASE WHEN swap THEN dst_port ELSE src_port END AS k_port1,
  CASE WHEN swap THEN src_ip ELSE dst_ip END AS k_ip2, CASE WHEN swap THEN src_port ELSE dst_port END AS k_port2,
  {k_dns} AS k_dns, CASE WHEN swap THEN 2 ELSE 1 END AS orient FROM swapped)"""


def split(fin: bool = True, idle_us: int = IDLE_US) -> str:
    """CTE ``split``: numbered flows with direction, previous packet in the flow, ordinal."""
    fin_cut = "OR (protocol = 6 AND prev_flags & 1 = 1)" if fin else ""
    return f"""
lagged AS (SELECT *, lag(t) OVER w AS prev_t, lag(tcp_flags) OVER w AS prev_flags, lag(tcp_seq) OVER w AS prev_seq,
  lag(tcp_ack) OVER w AS prev_ack, lag(ip_plength) OVER w AS prev_len, row_number() OVER w AS pos FROM keyed
  WINDOW w AS (PARTITION BY {KEY} ORDER BY t, packet_id)),
opened AS (SELECT *, (prev_t IS NULL OR t - prev_t > {idle_us} {fin_cut}) AS opens FROM lagged),
numbered AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY t, packet_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flow_no FROM opened),
split AS (SELECT *, min(t) OVER f AS t0, first_value(orient) OVER f AS o0,
  CASE WHEN orient = first_value(orient) OVER f THEN 1 ELSE 2 END AS direction,
  (NOT opens AND protocol = 6 AND prev_seq = tcp_seq AND prev_ack = tcp_ack AND prev_len = ip_plength AND prev_flags = tcp_flags) AS repeats
  FROM numbered WINDOW f AS (PARTITION BY {KEY}, flow_no ORDER BY t, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


SUMS = """count(*) AS packet_total, CAST(sum(ip_length) AS BIGINT) AS octet_total,
  CAST(sum(CAST(ip_length AS BIGINT)*ip_length) AS BIGINT) AS octet_sum_squares,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags & 1 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS fin_count,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags & 2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS syn_count,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags & 4 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rst_count,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags & 8 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS psh_count,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags & 16 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ack_count,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags & 32 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS urg_count,
  bit_or(CASE WHEN protocol=6 THEN tcp_flags ELSE 0 END) AS tcp_flags_or,
  CAST(sum(CASE WHEN repeats THEN 1 ELSE 0 END) AS BIGINT) AS retransmitted_packets,
  CAST(sum(CASE WHEN repeats THEN ip_length ELSE 0 END) AS BIGINT) AS retransmitted_octets,
  bool_or(is_sampled) AS is_sampled,
  coalesce(arg_max(app_id, pos) FILTER (WHERE app_id <> 0), 0) AS app_id,
  CAST(sum(CASE WHEN direction=1 THEN l3_hlength ELSE 0 END) AS BIGINT) AS l3_hlength_fwd,
  CAST(sum(CASE WHEN direction=2 THEN l3_hlength ELSE 0 END) AS BIGINT) AS l3_hlength_bwd,
  CAST(sum(CASE WHEN direction=1 THEN l3_length ELSE 0 END) AS BIGINT) AS l3_length_fwd,
  CAST(sum(CASE WHEN direction=2 THEN l3_length ELSE 0 END) AS BIGINT) AS l3_length_bwd,
  CAST(sum(CASE WHEN direction=1 THEN l4_hlength ELSE 0 END) AS BIGINT) AS l4_hlength_fwd,
  CAST(sum(CASE WHEN direction=2 THEN l4_hlength ELSE 0 END) AS BIGINT) AS l4_hlength_bwd,
  arg_min(tos, pos) AS first_tos, arg_min(ttl, pos) AS first_ttl, arg_min(ip_id, pos) AS first_ip_id,
  arg_min(ip_offset, pos) AS first_ip_offset, arg_min(ip_hlength, pos) AS first_ip_hlength, arg_min(ip_length, pos) AS first_ip_length,
  arg_min(tcp_window, pos) AS first_tcp_window, arg_min(tcp_urgent_ptr, pos) AS first_tcp_urgent_ptr,
  arg_min(icmp_type, pos) AS first_icmp_type, arg_min(icmp_code, pos) AS first_icmp_code,
  arg_min(flow_label, pos) AS first_flow_label, arg_min(next_header, pos) AS first_next_header,
  arg_max(ip_plength, pos) AS last_ip_plength, arg_max(tcp_seq, pos) AS last_tcp_seq, arg_max(tcp_ack, pos) AS last_tcp_ack,
  arg_max(tcp_flags, pos) AS last_tcp_flags, arg_min(src_mac, pos) AS source_mac, arg_min(dst_mac, pos) AS destination_mac,
  arg_min(packet_digest, pos) AS first_packet_id, arg_max(packet_digest, pos) AS last_packet_id"""


def flows(fin: bool = True, idle_us: int = IDLE_US) -> str:
    """CTE ``flows``: one record per flow, no active slices."""
    fin_end = "arg_max(tcp_flags, pos) & 1 = 1 AND protocol = 6" if fin else "false"
    return f"""
grouped AS (SELECT {KEY}, flow_no, min(o0) AS o0, min(t) AS start_us, max(t) AS end_us, {fin_end} AS fin_end, {SUMS}
  FROM split GROUP BY {KEY}, flow_no),
flows AS (SELECT ip_version, protocol, CASE WHEN o0=1 THEN k_ip1 ELSE k_ip2 END AS src_ip, CASE WHEN o0=1 THEN k_ip2 ELSE k_ip1 END AS dst_ip,
  CASE WHEN o0=1 THEN k_port1 ELSE k_port2 END AS src_port, CASE WHEN o0=1 THEN k_port2 ELSE k_port1 END AS dst_port,
  k_dns AS dns_id, 0 AS slice, 0 AS agg_level,
  CASE WHEN fin_end THEN 3 WHEN (SELECT max(t) FROM packets) - end_us > {idle_us} THEN 1 ELSE 4 END AS end_reason,
  packet_total AS packet_delta, octet_total AS octet_delta, octet_sum_squares AS octet_delta_sum_squares,
  start_us AS after_export_us, 1 AS original_present, CASE WHEN syn_count>0 THEN 1 ELSE 0 END AS original_initiated,
  CASE WHEN fin_count>0 THEN 1 ELSE 0 END AS original_completed, grouped.* FROM grouped)"""


def with_clauses(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


def base(biflow: bool = False, fin: bool = True, **key) -> list[str]:
    return [PACKETS, keyed(biflow, **key), split(fin)]


def flow_base(biflow: bool = False, fin: bool = True, **key) -> list[str]:
    return [*base(biflow, fin, **key), flows(fin)]
