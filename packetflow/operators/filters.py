"""Packet filters and rejects; narrow predicates that reach the scan."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetflow.schemas import ICMP, ICMP6, IGMP, TCP, UDP


def _usable(df: DataFrame, predicate: str) -> Column | None:
    """The predicate as a column, or None (with a warning) where it is not valid on ``df``."""
    if not predicate or not predicate.strip():
        return None
    try:
        condition = F.expr(predicate)
        df.where(condition).schema  # noqa: B018 - forces analysis
    except (AnalysisException, ParseException) as error:
        warnings.warn(f"capture filter {predicate!r} is not valid and is switched off: {error}", stacklevel=3)
        return None
    return condition


def capture_filter(df: DataFrame, predicate: str | dict[str, str]) -> DataFrame:
    """Keep packets that satisfy a SQL predicate, one for all or one per interface.

    An invalid filter is switched off with a warning; interfaces without one keep everything.
    """
    if isinstance(predicate, str):
        condition = _usable(df, predicate)
        return df if condition is None else df.where(condition)
    # Interfaces with one and the same predicate are one set.
    names: dict[str, list[str]] = {}
    for name, text in predicate.items():
        names.setdefault(text, []).append(name)
    usable = {text: condition for text in names if (condition := _usable(df, text)) is not None}
    if not usable:
        return df
    on = F.col("interface")
    keep = ~on.isin([n for text in usable for n in names[text]])
    for text, condition in usable.items():
        keep = keep | (on.isin(names[text]) & condition)
    return df.where(keep)


def ip_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("ip_version").isin(4, 6))


def supported_transport(df: DataFrame) -> DataFrame:
    version, protocol = F.col("ip_version"), F.col("protocol")
    return df.where(
        ((version == 4) & protocol.isin(TCP, UDP, ICMP, IGMP)) | ((version == 6) & protocol.isin(UDP, TCP, ICMP6))
    )


def reject_reason() -> Column:
    """Why a packet's headers are unusable; null when they are fine."""
    protocol = F.col("protocol")
    return (
        F.when(F.col("ip_hlength") < 20, "bad IP header length")
        .when((protocol == TCP) & (F.col("tcp_hlength") < 20), "bad TCP header length")
        .when((protocol == UDP) & (F.col("udp_length") < 8), "bad UDP length")
    )


def valid_headers(df: DataFrame) -> DataFrame:
    return df.where(reject_reason().isNull())


def rejected_headers(df: DataFrame) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason()).where(F.col("reject_reason").isNotNull())


def first_fragment_only(df: DataFrame) -> DataFrame:
    """IPv6 ports are only known in an unfragmented packet or its first fragment; else 0."""
    later = (F.col("ip_version") == 6) & (F.col("ip_offset").bitwiseAND(0x1FFF) != 0)
    return df.withColumns(
        {name: F.when(later, F.lit(0)).otherwise(F.col(name)) for name in ("src_port", "dst_port")}
    )
