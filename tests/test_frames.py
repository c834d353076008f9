"""Hand-made frames for every branch of the decoder."""

import pytest

from packetflow.sources.frames import decode_frames

ETH4 = "aabbccddeeff 020000000001 0800"
ETH6 = "aabbccddeeff 020000000001 86dd"
TCP = "1f90 0050 00000005 00000007 50 12 0400 0000 0001"
UDP_DNS = "1388 0035 0014 0000 abcd 8100 0001"


def ip4(protocol, words=5, total=60):
    return f"4{words} 10 {total:04x} 0102 4000 40 {protocol:02x} 0000 0a000001 c0a80002" + "00000000" * (words - 5)


def ip6(next_header, payload=40):
    return f"6 a1 12345 {payload:04x} {next_header:02x} 3f 20010db8000000000000000000000007 20010db8ffff00000000000000000001"


FRAMES = {
    "tcp": ETH4 + ip4(6) + TCP,
    "udp": ETH4 + ip4(17) + UDP_DNS + "00" * 8,
    "icmp": ETH4 + ip4(1) + "08 01 0000 1234 0009",
    "igmp": ETH4 + ip4(2) + "16 00 0000 e0000001",
    "options": ETH4 + ip4(6, 7, 64) + TCP,
    "udp6": ETH6 + ip6(17) + UDP_DNS + "00" * 8,
    "icmp6": ETH6 + ip6(58) + "80 00 0000 1234 0009",
    "extensions": ETH6 + ip6(0) + "3c 00 000000000000" + "06 01" + "00" * 14 + TCP,
    "authentication": ETH6 + ip6(51) + "06 04" + "00" * 22 + TCP,
    "first_fragment": ETH6 + ip6(44) + "11 00 0001 00000001" + UDP_DNS + "00" * 8,
    "later_fragment": ETH6 + ip6(44) + "11 00 0009 00000001" + "00" * 20,
    "encrypted": ETH6 + ip6(50) + "00" * 40,
    "short_header": ETH4 + "44" + ip4(6)[2:] + TCP,
    "short_tcp": ETH4 + ip4(6) + TCP.replace("50 12", "40 12"),
    "short_udp": ETH4 + ip4(17) + "1388 0035 0004 0000",
    "unsupported": ETH4 + ip4(47) + "00" * 20,
    "twelve_extensions": ETH6 + ip6(0) + "3c 00 000000000000" * 11 + "06 00 000000000000" + TCP,
    "tcp_cut": ETH4 + ip4(6) + TCP[:-5],
    "tcp_ports_only": ETH4 + ip4(6) + "1f90 0050",
    "tcp_gone": ETH4 + ip4(6),
    "udp_cut": ETH4 + ip4(17) + "1388 0050 0008",
    "udp_whole": ETH4 + ip4(17) + "1388 0050 0008 0000",
    "icmp_cut": ETH4 + ip4(1) + "08 00 0000",
    "icmp6_cut": ETH6 + ip6(58) + "80 00 0000 1234",
    "dns_cut": ETH4 + ip4(17) + "1388 0035 0014 0000 abcd 8100",
    "long_packet": ETH4 + ip4(17, total=1028) + "1388 0050 03f0 0000" + "5a" * 1000,
    "arp": "aabbccddeeff 020000000001 0806" + "00" * 30,
    "cut": ETH4,
}


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [(i, bytearray.fromhex(text.replace(" ", ""))) for i, text in enumerate(FRAMES.values())]
    frames = spark.createDataFrame(rows, "frame_id long, frame binary")
    by_id = {r["packet_id"]: r for r in decode_frames(frames).collect()}
    return {name: by_id[i] for i, name in enumerate(FRAMES)}


def values(row, *names):
    return tuple(row[n] for n in names)


def test_ipv4(decoded):
    row = decoded["tcp"]
    assert values(row, "src_mac", "dst_mac", "ip_version", "src_ip", "dst_ip") == (
        "02:00:00:00:00:01", "aa:bb:cc:dd:ee:ff", 4, "10.0.0.1", "192.168.0.2",
    )
    assert values(row, "tos", "ip_length", "ip_id", "ip_offset", "ttl", "protocol", "ip_hlength", "ip_plength") == (16, 60, 258, 16384, 64, 6, 20, 40)
    assert values(row, "src_port", "dst_port", "tcp_seq", "tcp_ack", "tcp_hlength", "tcp_flags", "tcp_window", "tcp_urgent_ptr") == (
        8080, 80, 5, 7, 20, 18, 1024, 1,
    )
    assert values(decoded["options"], "ip_hlength", "src_port", "l3_hlength", "l4_hlength") == (28, 8080, 28, 20)
    assert len(row["ip_bytes"]) == 40 and row["ip_bytes"][:1] == b"\x45"


def test_transports(decoded):
    assert values(decoded["udp"], "src_port", "dst_port", "udp_length", "dns_id", "dns_qr", "dns_opcode", "dns_rd") == (5000, 53, 20, 0xABCD, 1, 0, 1)
    assert values(decoded["icmp"], "src_port", "dst_port", "tcp_seq", "icmp_type", "icmp_code") == (0x1234, 0x1234, 9, 8, 1)
    assert values(decoded["igmp"], "src_port", "icmp_type") == (0, 0x16)


def test_ipv6(decoded):
    row = decoded["udp6"]
    assert values(row, "ip_version", "src_ip", "dst_ip", "ttl", "tos", "flow_label", "next_header") == (
        6, "2001:db8::7", "2001:db8:ffff::1", 63, 0x1A - 0x1A + 0xA1, 0x12345, 17,
    )
    assert values(row, "ip_length", "ip_hlength", "dst_port", "dns_id") == (80, 40, 53, 0xABCD)
    assert values(decoded["icmp6"], "protocol", "src_port", "tcp_seq", "icmp_type") == (58, 0x1234, 9, 128)
    for name in ("extensions", "authentication"):
        assert values(decoded[name], "protocol", "src_port", "tcp_flags", "reject_reason") == (6, 8080, 18, None)
    assert values(decoded["first_fragment"], "protocol", "dst_port", "ip_offset", "next_header") == (17, 53, 0, 44)
    assert values(decoded["later_fragment"], "protocol", "dst_port", "ip_offset", "reject_reason") == (17, 0, 1, None)


@pytest.mark.parametrize(
    "name,reason",
    [
        ("short_header", "bad IP header length"), ("short_tcp", "bad TCP header length"), ("short_udp", "bad UDP length"),
        ("unsupported", "unsupported transport"), ("encrypted", "unsupported transport"), ("arp", "not IP"), ("cut", "frame too short"),
    ],
)
def test_rejects(decoded, name, reason):
    assert decoded[name]["reject_reason"] == reason


def test_good_frames_have_no_reason(decoded):
    bad = {"short_header", "short_tcp", "short_udp", "unsupported", "encrypted", "arp", "cut", "dns_cut"}
    bad |= {"tcp_cut", "tcp_ports_only", "tcp_gone", "udp_cut", "icmp_cut", "icmp6_cut"}
    assert {n for n, r in decoded.items() if r["reject_reason"]} == bad


def test_any_number_of_extension_headers(decoded):
    assert values(decoded["twelve_extensions"], "protocol", "src_port", "dst_port", "tcp_flags", "reject_reason") == (6, 8080, 80, 18, None)


@pytest.mark.parametrize("name", ["tcp_cut", "tcp_ports_only", "tcp_gone", "udp_cut", "icmp_cut", "icmp6_cut", "dns_cut"])
def test_cut_transport_headers_are_rejected(decoded, name):
    assert decoded[name]["reject_reason"] == "frame too short"


def test_whole_transport_headers_and_packets_pass(decoded):
    assert decoded["udp_whole"]["reject_reason"] is None and decoded["later_fragment"]["reject_reason"] is None
    assert decoded["long_packet"]["reject_reason"] is None and len(decoded["long_packet"]["ip_bytes"]) == 1028
