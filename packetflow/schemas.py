"""Table layouts: packets, frames, interface settings, clock samples, rules."""

from pyspark.sql import types as T

PACKETS = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("interface", T.StringType()),
        T.StructField("obs_point", T.IntegerType()),
        T.StructField("src_mac", T.StringType()),
        T.StructField("dst_mac", T.StringType()),
        T.StructField("ip_version", T.IntegerType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("tos", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("ip_id", T.IntegerType()),
        T.StructField("ip_offset", T.IntegerType()),
        T.StructField("ip_hlength", T.IntegerType()),
        T.StructField("ip_length", T.IntegerType()),
        T.StructField("ip_plength", T.IntegerType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("udp_length", T.IntegerType()),
        T.StructField("tcp_seq", T.LongType()),
        T.StructField("tcp_ack", T.LongType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("tcp_urgent_ptr", T.IntegerType()),
        T.StructField("tcp_hlength", T.IntegerType()),
        T.StructField("icmp_type", T.IntegerType()),
        T.StructField("icmp_code", T.IntegerType()),
        T.StructField("flow_label", T.LongType()),
        T.StructField("next_header", T.IntegerType()),
        T.StructField("dns_id", T.IntegerType()),
        T.StructField("dns_opcode", T.IntegerType()),
        T.StructField("dns_rd", T.IntegerType()),
        T.StructField("dns_qr", T.IntegerType()),
        T.StructField("l3_hlength", T.IntegerType()),
        T.StructField("l3_length", T.IntegerType()),
        T.StructField("l4_hlength", T.IntegerType()),
        T.StructField("ip_bytes", T.BinaryType()),
        T.StructField("app_id", T.IntegerType()),
    ]
)

FRAMES = T.StructType(
    [
        T.StructField("frame_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("interface", T.StringType()),
        T.StructField("frame", T.BinaryType()),
        T.StructField("wire_len", T.IntegerType()),
    ]
)

INTERFACES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("filter", T.StringType()),
        T.StructField("sampling_type", T.IntegerType()),
        T.StructField("param1", T.LongType()),
        T.StructField("param2", T.LongType()),
    ]
)

SYNC_SAMPLES = T.StructType(
    [
        T.StructField("obs_point", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("t1", T.LongType()),
        T.StructField("t2", T.LongType()),
        T.StructField("t3", T.LongType()),
    ]
)

APP_RULES = T.StructType(
    [
        T.StructField("app_id", T.IntegerType()),
        T.StructField("app_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("port_lo", T.IntegerType()),
        T.StructField("port_hi", T.IntegerType()),
        T.StructField("host", T.StringType()),
        T.StructField("priority", T.IntegerType()),
    ]
)

IE_DICTIONARY = T.StructType(
    [
        T.StructField("enterprise", T.IntegerType()),
        T.StructField("ie", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("coding", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)

# IP protocol numbers and TCP flag bits.
ICMP, IGMP, TCP, UDP, ICMP6 = 1, 2, 6, 17, 58
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32

# Reasons a flow record was closed.
IDLE_TIMEOUT, ACTIVE_TIMEOUT, END_DETECTED, FORCED_END = 1, 2, 3, 4
