"""Scalar column functions: durations, addresses, hashes.  All stay in the JVM."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(duration) -> int:
    """Microseconds of a duration: ``"10 seconds"``, a timedelta, or plain milliseconds."""
    if isinstance(duration, bool):
        raise ValueError("a duration is needed, not a truth value")
    if isinstance(duration, int):
        value = duration * 1000
    else:
        value = int(pd.Timedelta(duration).value // 1000)
    if value <= 0:
        raise ValueError(f"duration must be positive: {duration!r}")
    return value


# --- addresses ------------------------------------------------------------------


def expand_ipv6(ip: Column) -> Column:
    """Eight four-digit groups of a canonical (compressed) IPv6 text."""
    halves = F.split(ip, "::", 2)

    def groups(text: Column) -> Column:
        return F.filter(F.split(F.coalesce(text, F.lit("")), ":"), lambda g: g != "")

    head, tail = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail)))
    whole = F.concat(head, gap, tail)
    return F.array_join(F.transform(whole, lambda g: F.lpad(F.lower(g), 4, "0")), ":")


def compress_ipv6(text: Column) -> Column:
    """Canonical form of eight colon-separated groups without leading zeros.

    The first of the longest zero runs (two groups or more) becomes ``::``.
    """
    runs = F.regexp_extract_all(text, F.lit("(?:^|:)(0(?::0)+)(?=:|$)"), F.lit(1))
    run = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))
    padded = F.concat(F.lit(":"), text, F.lit(":"))

    def cut(longest: Column) -> Column:
        where = F.call_function("instr", padded, F.concat(F.lit(":"), longest, F.lit(":")))
        head = F.substr(padded, F.lit(2), where - 2)
        tail = F.regexp_replace(F.substr(padded, where + F.length(longest) + 2), ":$", "")
        return F.when(longest == "", text).otherwise(F.concat(head, F.lit("::"), tail))

    return F.get(F.transform(F.array(run), cut), F.lit(0))


def ipv4_wire_number(ip: Column) -> Column:
    """The four octets as an unsigned number, first octet lowest (as read from the wire on little-endian)."""
    octets = F.split(ip, "\\.")
    return reduce(
        lambda a, b: a + b,
        [F.get(octets, F.lit(i)).try_cast("bigint") * F.lit(256**i) for i in range(4)],
    )


# --- hashes ---------------------------------------------------------------------


def hash_fraction(packet_id: Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) fixed by seed and packet id: the first 32 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), packet_id.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def hash_order(packet_id: Column, seed: int = 0) -> Column:
    """A random but repeatable sort key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), packet_id.cast("string")))


def times33(text: Column) -> Column:
    """64-bit ``h = h*33 + c`` from 5381 over the characters, as ``decimal(20,0)``.

    The state is kept in two 32-bit halves of ``bigint``: exact under ANSI mode
    and without decimal arithmetic per character.
    """
    mask = F.lit(2**32 - 1)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    start = F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(5381).cast("bigint").alias("lo"))

    def step(state, char):
        low = state["lo"] * 33 + F.ascii(char)
        high = state["hi"] * 33 + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    return F.aggregate(
        chars,
        start,
        step,
        lambda s: (
            s["hi"].cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + s["lo"].cast("decimal(20,0)")
        ).cast("decimal(20,0)"),
    )


def flow_id_text(ip_version, protocol, src_ip, dst_ip, src_port, dst_port) -> Column:
    v4 = F.concat(
        protocol.cast("string"),
        F.coalesce(F.when(ip_version == 4, ipv4_wire_number(src_ip)).cast("string"), F.lit("")),
        F.coalesce(F.when(ip_version == 4, ipv4_wire_number(dst_ip)).cast("string"), F.lit("")),
        src_port.cast("string"),
        dst_port.cast("string"),
    )
    v6 = F.concat(
        protocol.cast("string"), expand_ipv6(src_ip), expand_ipv6(dst_ip), src_port.cast("string"), dst_port.cast("string")
    )
    return F.when(ip_version == 4, v4).otherwise(v6)
