"""Flow keys and flow identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetflow.functions.scalars import flow_id_text, times33
from packetflow.schemas import ICMP, ICMP6, TCP, UDP

#: Columns that together name the flow a packet belongs to.
KEY_FIELDS = ["ip_version", "protocol", "k_ip1", "k_port1", "k_ip2", "k_port2", "k_dns"]

#: The same behind their hash: sorting by key then compares one number in nearly every case.
KEY = ["k_hash", *KEY_FIELDS]


def is_dns() -> Column:
    return (F.col("protocol") == UDP) & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))


def flow_key(packets: DataFrame, biflow: bool = False, dns: bool = True, all_protocols: bool = False) -> DataFrame:
    """Add the key columns and ``orient`` (1: the packet runs from side 1 to side 2).

    Two-way keys apply to TCP, ICMP, ICMPv6 and DNS; with ``all_protocols`` they
    apply to everything and the DNS id is left out of the key.
    """
    protocol, version = F.col("protocol"), F.col("ip_version")
    if all_protocols:
        two_way, dns = F.lit(True), False
    elif biflow:
        two_way = (
            (protocol == TCP)
            | ((version == 4) & (protocol == ICMP))
            | ((version == 6) & (protocol == ICMP6))
            | is_dns()
        )
    else:
        two_way = F.lit(False)
    src_ip, dst_ip = F.coalesce("src_ip", F.lit("")), F.coalesce("dst_ip", F.lit(""))
    src_port, dst_port = F.coalesce("src_port", F.lit(0)), F.coalesce("dst_port", F.lit(0))
    swap = two_way & ((src_ip > dst_ip) | ((src_ip == dst_ip) & (src_port > dst_port)))
    dns_id = F.col("dns_id") if dns and "dns_id" in packets.columns else F.lit(None)
    return packets.withColumns(
        {
            "k_ip1": F.when(swap, dst_ip).otherwise(src_ip),
            "k_port1": F.when(swap, dst_port).otherwise(src_port),
            "k_ip2": F.when(swap, src_ip).otherwise(dst_ip),
            "k_port2": F.when(swap, src_port).otherwise(dst_port),
            "k_dns": F.coalesce(F.when(is_dns(), dns_id).cast("int"), F.lit(0)),
            "orient": F.when(swap, F.lit(2)).otherwise(F.lit(1)),
        }
    ).withColumn("k_hash", F.xxhash64(*KEY_FIELDS))


def dns_flow_key(packets: DataFrame) -> DataFrame:
    """The DNS transaction id where it is part of the key, else 0, as ``k_dns``."""
    return packets.withColumn("k_dns", F.coalesce(F.when(is_dns(), F.col("dns_id")).cast("int"), F.lit(0)))


def biflow_key(packets: DataFrame, all_protocols: bool = False) -> DataFrame:
    return flow_key(packets, biflow=True, all_protocols=all_protocols)


def _identity(src_ip, dst_ip, src_port, dst_port, fast: bool) -> Column:
    if fast:
        return F.xxhash64("ip_version", "protocol", src_ip, dst_ip, src_port, dst_port)
    return times33(flow_id_text(F.col("ip_version"), F.col("protocol"), src_ip, dst_ip, src_port, dst_port))


def flow_id_column(fast: bool = False) -> Column:
    return _identity(F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"), fast)


def flow_id(df: DataFrame, fast: bool = False) -> DataFrame:
    """64-bit id of the oriented key: unsigned ``decimal(20,0)``, or ``xxhash64`` with ``fast``."""
    return df.withColumn("flow_id", flow_id_column(fast))


def reverse_flow_id(df: DataFrame, fast: bool = False) -> DataFrame:
    """Id of the opposite direction."""
    return df.withColumn(
        "reverse_flow_id", _identity(F.col("dst_ip"), F.col("src_ip"), F.col("dst_port"), F.col("src_port"), fast)
    )


# Information elements that make up the key, as bit numbers.
KEY_BITS_ALWAYS = (3, 6, 11, 59)
KEY_BITS_V4 = (7, 10)
KEY_BITS_V6 = (26, 27)


def flow_key_indicator_column() -> Column:
    def bits(numbers):
        return F.lit(sum(1 << n for n in numbers)).cast("bigint")

    return (
        F.when(F.col("ip_version") == 4, bits(KEY_BITS_ALWAYS + KEY_BITS_V4))
        .when(F.col("ip_version") == 6, bits(KEY_BITS_ALWAYS + KEY_BITS_V6))
        .otherwise(bits(KEY_BITS_ALWAYS))
    )


def flow_key_indicator(df: DataFrame) -> DataFrame:
    return df.withColumn("flow_key_indicator", flow_key_indicator_column())


#: Header bytes that name a packet: total length, identification, protocol, source, destination.
HEADER_FIELDS = ((3, 2), (5, 2), (10, 1), (13, 4), (17, 4))
HEADER_FIELD_BYTES = 13
FIXED_HEADER_BYTES = 20
#: The same of IPv6: payload length, next header, source, destination; hop limit, traffic class and flow label may change on the way.
HEADER_FIELDS_V6 = ((5, 2), (7, 1), (9, 16), (25, 16))
FIXED_HEADER_BYTES_V6 = 40


def packet_id_column(bytes_col: str = "ip_bytes", length: int = 56) -> Column:
    """md5 over header fields and up to ``length - 13`` payload bytes of an IPv4 or IPv6 packet, null for other bytes.

    The payload of an IPv6 packet is all behind the fixed header, extension headers too, and no byte beyond its payload length.
    """
    if length < HEADER_FIELD_BYTES:
        raise ValueError(f"length must be at least {HEADER_FIELD_BYTES}")
    data = F.col(bytes_col)
    wanted = length - HEADER_FIELD_BYTES

    def number(start: int, size: int) -> Column:
        return F.conv(F.hex(F.substring(data, start, size)), 16, 10).cast("int")

    total = number(3, 2)
    header = number(1, 1).bitwiseAND(F.lit(15)) * 4
    # Payload if long enough, else the tail of options + payload, else all of options + payload.
    start = F.when(total - header >= wanted, header).when(
        total - FIXED_HEADER_BYTES >= wanted, total - wanted
    ).otherwise(F.lit(FIXED_HEADER_BYTES))
    size = F.least(F.lit(wanted), F.greatest(F.lit(0), total - FIXED_HEADER_BYTES))
    fields = [F.substring(data, at, n) for at, n in HEADER_FIELDS]
    v4 = F.md5(F.concat(*fields, F.substring(data, start + 1, size)))
    fields = [F.substring(data, at, n) for at, n in HEADER_FIELDS_V6]
    v6 = F.md5(F.concat(*fields, F.substring(data, F.lit(FIXED_HEADER_BYTES_V6 + 1), F.least(F.lit(wanted), number(5, 2)))))
    version = F.shiftright(number(1, 1), 4)
    return F.when(version == 4, v4).when(version == 6, v6)


def packet_id(df: DataFrame, bytes_col: str = "ip_bytes", length: int = 56) -> DataFrame:
    """Add ``packet_digest``; equal for the same packet seen at several observation points."""
    return df.withColumn("packet_digest", packet_id_column(bytes_col, length))
