"""Flow ids and packet digests against direct computation."""

import hashlib
import ipaddress

import pytest
from pyspark.sql import functions as F

from helpers import collect, table
from packetflow.functions.scalars import compress_ipv6, expand_ipv6, micros
from packetflow.operators import keys


def times33(text):
    value = 5381
    for char in text.encode():
        value = (value * 33 + char) % 2**64
    return value


def wire(ip):
    return int.from_bytes(ipaddress.ip_address(ip).packed, "little")


def test_flow_id(spark):
    v6 = {"ip_version": 6, "src_ip": "2001:db8::7", "dst_ip": "fe80::1", "protocol": 17, "src_port": 53, "dst_port": 4000}
    packets = table(spark, [{"t": 0, "src_ip": "10.1.2.3", "dst_ip": "255.255.255.255", "src_port": 65535, "dst_port": 1}, {"t": 1, **v6}])
    both = keys.reverse_flow_id(keys.flow_id(packets))
    got = {r["packet_id"]: (int(r["flow_id"]), int(r["reverse_flow_id"])) for r in both.collect()}
    a, b = wire("10.1.2.3"), wire("255.255.255.255")
    assert got[1] == (times33(f"6{a}{b}655351"), times33(f"6{b}{a}165535"))
    x, y = (ipaddress.ip_address(v6[n]).exploded for n in ("src_ip", "dst_ip"))
    assert got[2] == (times33(f"17{x}{y}534000"), times33(f"17{y}{x}400053"))


def test_ids_mirror_each_other(spark):
    there = {"t": 0, "src_port": 9}
    back = {"t": 1, "src_ip": "192.168.0.1", "dst_ip": "10.0.0.1", "src_port": 80, "dst_port": 9}
    rows = keys.reverse_flow_id(keys.flow_id(table(spark, [there, back]))).collect()
    assert rows[0]["flow_id"] == rows[1]["reverse_flow_id"] and rows[0]["reverse_flow_id"] == rows[1]["flow_id"]


@pytest.mark.parametrize(
    "options,payload", [(b"", bytes(range(60))), (b"\x01" * 20, bytes(range(30))), (b"\x01" * 4, bytes(range(7))), (b"", b"")]
)
def test_packet_id_branches(spark, options, payload):
    """Long payload, short payload topped up from options, everything after the addresses."""
    header = 20 + len(options)
    total = header + len(payload)
    data = bytes([0x40 + header // 4, 0]) + total.to_bytes(2, "big") + b"\xab\xcd\x40\x00\x40\x06\x00\x00" + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    data += options + payload
    named = data[2:4] + data[4:6] + data[9:10] + data[12:20]
    if len(payload) >= 43:
        body = payload[:43]
    else:
        body = (options + payload)[-43:] if len(options + payload) >= 43 else options + payload
    packets = spark.createDataFrame([(bytearray(data),)], "ip_bytes binary")
    assert keys.packet_id(packets).first()["packet_digest"] == hashlib.md5(named + body).hexdigest()


@pytest.mark.parametrize("payload", [bytes(range(60)), bytes(range(7)), b""])
def test_packet_id_of_ipv6(spark, payload):
    """Fixed fields and payload; what routers change does not matter, nor do bytes beyond the packet."""
    src, dst = ipaddress.ip_address("2001:db8::7").packed, ipaddress.ip_address("fe80::1").packed
    build = lambda first, hops, source: first + len(payload).to_bytes(2, "big") + b"\x11" + bytes([hops]) + source + dst + payload
    rows = [build(b"\x60\x00\x00\x00", 64, src), build(b"\x6a\xb1\x23\x45", 9, src) + b"pad", build(b"\x60\x00\x00\x00", 64, src[:-1] + b"\x08")]
    packets = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(rows)], "n int, ip_bytes binary")
    got = [r.packet_digest for r in keys.packet_id(packets).orderBy("n").collect()]
    named = lambda source: hashlib.md5(len(payload).to_bytes(2, "big") + b"\x11" + source + dst + payload[:43]).hexdigest()
    assert got == [named(src), named(src), named(src[:-1] + b"\x08")]


def test_packet_id_length(spark):
    with pytest.raises(ValueError):
        keys.packet_id_column(length=12)


@pytest.mark.parametrize(
    "ip", ["::", "::1", "fe80::", "2001:db8::7", "1:2:3:4:5:6:7:8", "1:0:0:2:0:0:0:3", "0:0:1::", "1:0:2:3:4:5:6:7", "10:0:0:100::1"]
)
def test_ipv6_text(spark, ip):
    address = ipaddress.ip_address(ip)
    plain = ":".join(f"{int(g, 16):x}" for g in address.exploded.split(":"))
    df = spark.createDataFrame([(ip, plain)], "ip string, plain string")
    got = df.select(expand_ipv6(F.col("ip")).alias("long"), compress_ipv6(F.col("plain")).alias("short")).first()
    assert tuple(got) == (address.exploded, address.compressed)


def test_flow_key_indicator(spark):
    v6 = {"ip_version": 6, "src_ip": "::1", "dst_ip": "::2"}
    marked = keys.flow_key_indicator(table(spark, [{"t": 0}, {"t": 0, **v6}]))
    bits = [sum(1 << b for b in (3, 6, 7, 10, 11, 59)), sum(1 << b for b in (3, 6, 11, 26, 27, 59))]
    assert collect(marked, "packet_id", "flow_key_indicator") == [(1, bits[0]), (2, bits[1])]


def test_durations():
    assert micros("10 seconds") == 10_000_000 and micros(250) == 250_000
    for bad in (0, -1, True):
        with pytest.raises(ValueError):
            micros(bad)
