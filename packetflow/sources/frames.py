"""Raw Ethernet frames to packet columns, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetflow.functions.scalars import compress_ipv6
from packetflow.schemas import ICMP, ICMP6, IGMP, TCP, UDP

# EtherTypes, header sizes, IPv6 extension headers, bytes of a transport header that must be there.
ETHERNET = 14
ETHERTYPE_IPV4, ETHERTYPE_IPV6 = 0x0800, 0x86DD
IPV6_HEADER = 40
HOP_BY_HOP, ROUTING, FRAGMENT, AUTHENTICATION, DESTINATION, SHIM6 = 0, 43, 44, 51, 60, 140
TRANSPORT_BYTES = {TCP: 20, UDP: 8, ICMP: 8, ICMP6: 8, IGMP: 8}
DNS_BYTES = 12

_SHORT = "frame too short"


def _hex(offset, size: int, text: Column | None = None) -> Column:
    text = F.col("_hex") if text is None else text
    start = (offset.cast("int") if isinstance(offset, Column) else F.lit(offset)) * 2 + 1
    return F.substr(text, start, F.lit(size * 2))


def _number(offset, size: int) -> Column:
    """Unsigned number of ``size`` network-order bytes at a byte offset of the frame."""
    return F.conv(_hex(offset, size), 16, 10).cast("bigint")


def _mac(offset: int) -> Column:
    return F.regexp_replace(F.lower(_hex(offset, 6)), "(..)(?!$)", "$1:")


def _joined(offset: int, count: int, size: int, separator: str, form) -> Column:
    """``count`` consecutive numbers of ``size`` bytes as text."""
    text = F.col("_hex")
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: form(F.conv(_hex(offset + i * size, size, text), 16, 10))
    )
    return F.array_join(parts, separator)


def _ipv4(offset: int) -> Column:
    return _joined(offset, 4, 1, ".", lambda n: n)


def _ipv6_groups(offset: int) -> Column:
    return _joined(offset, 8, 2, ":", lambda n: F.lower(F.hex(n.cast("bigint"))))


def _walk_extensions() -> Column:
    """Follow the extension headers to the end: next header, its offset, fragment word.

    A header has eight bytes at least, so the length of the frame bounds their number.
    """
    start = F.struct(
        _number(ETHERNET + 6, 1).alias("next"),
        F.lit(ETHERNET + IPV6_HEADER).cast("bigint").alias("at"),
        F.lit(0).cast("bigint").alias("fragment"),
    )
    text = F.col("_hex")

    def step(state: Column, _: Column) -> Column:
        next_header, at, fragment = state["next"], state["at"], state["fragment"]
        sized = next_header.isin(HOP_BY_HOP, ROUTING, DESTINATION, SHIM6)
        known = sized | next_header.isin(FRAGMENT, AUTHENTICATION)
        # A later fragment carries no further headers.
        go = known & (fragment.bitwiseAND(F.lit(0xFFF8)) == 0)
        following = F.conv(_hex(at, 1, text), 16, 10).cast("bigint")
        units = F.conv(_hex(at + 1, 1, text), 16, 10).cast("bigint")
        length = (
            F.when(sized, (units + 1) * 8)
            .when(next_header == AUTHENTICATION, (units + 2) * 4)
            .otherwise(F.lit(8).cast("bigint"))
        )
        word = F.conv(_hex(at + 2, 2, text), 16, 10).cast("bigint")
        return F.struct(
            F.when(go, following).otherwise(next_header).alias("next"),
            F.when(go, at + length).otherwise(at).alias("at"),
            F.when(go & (next_header == FRAGMENT), word).otherwise(fragment).alias("fragment"),
        )

    most = F.greatest(F.lit(1), F.floor((F.length(text) / 2 - ETHERNET - IPV6_HEADER) / 8).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step)


def decode_frames(frames: DataFrame) -> DataFrame:
    """Packet columns of each frame, plus ``reject_reason`` (null for usable packets)."""
    rows = frames.withColumn("_hex", F.hex("frame"))
    rows = rows.withColumn("_type", _number(12, 2))
    v4 = F.col("_type") == ETHERTYPE_IPV4
    v6 = F.col("_type") == ETHERTYPE_IPV6
    rows = rows.withColumns(
        {
            "ip_version": F.when(v4 | v6, F.shiftright(_number(ETHERNET, 1), 4)).cast("int"),
            "_ext": F.when(v6, _walk_extensions()),
            "ip_hlength": F.when(v4, _number(ETHERNET, 1).bitwiseAND(F.lit(15)) * 4).when(v6, F.lit(IPV6_HEADER)).cast("int"),
            "ip_length": F.when(v4, _number(ETHERNET + 2, 2)).when(v6, IPV6_HEADER + _number(ETHERNET + 4, 2)).cast("int"),
        }
    )
    rows = rows.withColumns(
        {
            "protocol": F.when(v4, _number(ETHERNET + 9, 1)).when(v6, F.col("_ext.next")).cast("int"),
            "_l4": F.when(v4, ETHERNET + F.col("ip_hlength")).when(v6, F.col("_ext.at")).cast("int"),
            # IPv6: the offset of the fragment header, in the units of the IPv4 field.
            "_later": v6 & (F.shiftright(F.col("_ext.fragment"), 3) != 0),
            "_src": F.when(v4, _ipv4(ETHERNET + 12)).when(v6, _ipv6_groups(ETHERNET + 8)),
            "_dst": F.when(v4, _ipv4(ETHERNET + 16)).when(v6, _ipv6_groups(ETHERNET + 24)),
        }
    )
    protocol, at = F.col("protocol"), F.col("_l4")
    readable = ~F.coalesce(F.col("_later"), F.lit(False))
    tcp, udp = readable & (protocol == TCP), readable & (protocol == UDP)
    echo = readable & ((v4 & (protocol == ICMP)) | (v6 & (protocol == ICMP6)))
    typed = echo | (readable & v4 & (protocol == IGMP))
    with_ports = tcp | udp
    zero = F.lit(0)

    def field(offset: int, size: int, when: Column, otherwise: Column | None = None, kind: str = "int") -> Column:
        value = F.when(when, _number(at + offset, size))
        return F.coalesce(value, zero if otherwise is None else otherwise).cast(kind)

    rows = rows.withColumns(
        {
            "src_port": field(0, 2, with_ports, F.when(echo, _number(at + 4, 2)).otherwise(zero)),
            "dst_port": field(2, 2, with_ports, F.when(echo, _number(at + 4, 2)).otherwise(zero)),
            "tcp_seq": field(4, 4, tcp, F.when(echo, _number(at + 6, 2)).otherwise(zero), "bigint"),
            "tcp_ack": field(8, 4, tcp, kind="bigint"),
            "tcp_hlength": F.when(tcp, F.shiftright(_number(at + 12, 1), 4) * 4).otherwise(zero).cast("int"),
            "tcp_flags": F.when(tcp, _number(at + 13, 1).bitwiseAND(F.lit(63))).otherwise(zero).cast("int"),
            "tcp_window": field(14, 2, tcp),
            "tcp_urgent_ptr": field(18, 2, tcp),
            "udp_length": field(4, 2, udp),
            "icmp_type": field(0, 1, typed),
            "icmp_code": field(1, 1, typed),
        }
    )
    dns = udp & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))
    rows = rows.withColumns(
        {"dns_id": field(8, 2, dns), "_dns_bits": F.coalesce(F.when(dns, _number(at + 10, 1)), zero).cast("int")}
    )
    # A later fragment has no transport header; every other packet must hold it whole, DNS its own header too.
    wanted = F.lit(0)
    for number, size in TRANSPORT_BYTES.items():
        wanted = F.when(protocol == number, F.lit(size)).otherwise(wanted)
    wanted = F.when(readable, wanted).otherwise(F.lit(0))
    reason = (
        F.when(F.length("_hex") < 2 * (ETHERNET + 1), _SHORT)
        .when(~(v4 | v6), "not IP")
        .when(F.length("_hex") < 2 * ETHERNET + F.when(v4, 40).otherwise(80), _SHORT)
        .when(v4 & (F.col("ip_hlength") < 20), "bad IP header length")
        .when(v4 & ~protocol.isin(TCP, UDP, ICMP, IGMP), "unsupported transport")
        .when(readable & v6 & ~protocol.isin(TCP, UDP, ICMP6), "unsupported transport")
        .when(F.length("_hex") < 2 * (at + wanted), _SHORT)
        .when(tcp & (F.col("tcp_hlength") < 20), "bad TCP header length")
        .when(udp & (F.col("udp_length") < 8), "bad UDP length")
        .when(dns & (F.length("_hex") < 2 * (at + TRANSPORT_BYTES[UDP] + DNS_BYTES)), _SHORT)
    )
    word = _number(ETHERNET, 4)
    first = "frame_id" if "frame_id" in frames.columns else "packet_id"
    return rows.select(
        F.col(first).alias("packet_id"),
        *[c for c in ("ts", "interface", "obs_point") if c in frames.columns],
        _mac(6).alias("src_mac"),
        _mac(0).alias("dst_mac"),
        "ip_version",
        F.when(v4, F.col("_src")).when(v6, compress_ipv6(F.col("_src"))).alias("src_ip"),
        F.when(v4, F.col("_dst")).when(v6, compress_ipv6(F.col("_dst"))).alias("dst_ip"),
        F.when(v4, _number(ETHERNET + 8, 1)).when(v6, _number(ETHERNET + 7, 1)).cast("int").alias("ttl"),
        F.when(v4, _number(ETHERNET + 1, 1)).when(v6, F.shiftright(word, 20).bitwiseAND(F.lit(255))).cast("int").alias("tos"),
        "protocol",
        F.when(v4, _number(ETHERNET + 4, 2)).otherwise(zero).cast("int").alias("ip_id"),
        F.when(v4, _number(ETHERNET + 6, 2)).when(v6, F.shiftright(F.col("_ext.fragment"), 3)).cast("int").alias("ip_offset"),
        "ip_hlength",
        "ip_length",
        (F.col("ip_length") - F.col("ip_hlength")).alias("ip_plength"),
        "src_port",
        "dst_port",
        "udp_length",
        "tcp_seq",
        "tcp_ack",
        "tcp_flags",
        "tcp_window",
        "tcp_urgent_ptr",
        "tcp_hlength",
        "icmp_type",
        "icmp_code",
        F.when(v6, word.bitwiseAND(F.lit(0xFFFFF))).otherwise(zero).cast("bigint").alias("flow_label"),
        F.when(v6, _number(ETHERNET + 6, 1)).otherwise(zero).cast("int").alias("next_header"),
        "dns_id",
        F.shiftright(F.col("_dns_bits"), 3).bitwiseAND(F.lit(15)).alias("dns_opcode"),
        F.col("_dns_bits").bitwiseAND(F.lit(1)).alias("dns_rd"),
        F.shiftright(F.col("_dns_bits"), 7).alias("dns_qr"),
        F.col("ip_hlength").alias("l3_hlength"),
        F.col("ip_length").alias("l3_length"),
        F.col("tcp_hlength").alias("l4_hlength"),
        F.substr("frame", F.lit(ETHERNET + 1), F.col("ip_length")).alias("ip_bytes"),
        F.lit(0).alias("app_id"),
        reason.alias("reject_reason"),
    )
