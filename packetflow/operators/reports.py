"""Counters and readable reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetflow.functions.scalars import expand_ipv6, micros
from packetflow.operators.keys import flow_id_column
from packetflow.operators.ordering import running_total


def interface_counters(packets: DataFrame, sampled: Column | None = None, rejected: Column | None = None) -> DataFrame:
    """Captured packets per interface, with sampled and rejected beside them."""
    sampled = F.lit(True) if sampled is None else sampled
    rejected = F.lit(False) if rejected is None else rejected
    return packets.groupBy("interface").agg(
        F.count(F.lit(1)).alias("captured"),
        F.count_if(sampled).alias("sampled"),
        F.count_if(sampled & rejected).alias("rejected"),
    )


def reject_counters(packets: DataFrame, reason: Column) -> DataFrame:
    return packets.select(reason.alias("reject_reason")).where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("packets")
    )


def active_flow_count(flows: DataFrame, bucket, idle) -> DataFrame:
    """Places taken in the flow table, for each time bucket in which a flow came or expired.

    A flow takes its place from its first packet until ``idle`` after its last one.  ``change`` is the
    difference over the bucket, ``active`` the number at its end, ``peak`` the most at any time in it.
    """
    width = micros(bucket)
    steps = F.array(
        F.struct(F.unix_micros("flow_start").alias("at"), F.lit(1).alias("step")),
        F.struct((F.unix_micros("flow_end") + micros(idle)).alias("at"), F.lit(-1).alias("step")),
    )
    # One row per instant, then one per bucket: sums and the highest running sum inside it.
    instants = flows.select(F.inline(steps)).groupBy("at").agg(F.sum("step").alias("step"))
    instants = instants.withColumn("_bucket", F.expr(f"at div {width}"))
    inside = instants.withColumn("_inside", F.sum("step").over(Window.partitionBy("_bucket").orderBy("at")))
    changes = inside.groupBy("_bucket").agg(F.sum("step").alias("change"), F.max("_inside").alias("_highest"))
    totals = running_total(changes, "_bucket", "change", "active")
    before = F.col("active") - F.col("change")
    return totals.select(
        F.timestamp_micros(F.col("_bucket") * F.lit(width)).alias("bucket_start"), "change", "active",
        (before + F.greatest(F.col("_highest"), F.lit(0))).alias("peak"),
    )


# Protocol labels.
PROTOCOL_LABELS = {1: "ICM", 6: "TCP", 17: "UDP", 58: "IC6"}


def protocol_label(protocol: Column) -> Column:
    label = F.lpad(protocol.cast("string"), 3, "0")
    for number, text in PROTOCOL_LABELS.items():
        label = F.when(protocol == number, F.lit(text)).otherwise(label)
    return label


def protocol_mix(flows: DataFrame) -> DataFrame:
    return flows.groupBy(protocol_label(F.col("protocol")).alias("label")).agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum("packet_total").alias("packets"),
        F.sum("octet_total").alias("octets"),
    )


def _address(ip: Column) -> Column:
    return F.when(F.col("ip_version") == 6, expand_ipv6(ip)).otherwise(ip)


def flow_report(flows: DataFrame) -> DataFrame:
    """One readable line per flow record; parts whose columns are absent are left out."""
    have = set(flows.columns)
    nanos = (F.unix_micros("flow_end") - F.unix_micros("flow_start")) * 1000
    parts = [
        F.format_string("flow %s", flow_id_column().cast("string")),
        F.format_string("[%s]", protocol_label(F.col("protocol"))),
        F.format_string("%s:%d -> %s:%d", _address(F.col("src_ip")), F.col("src_port"), _address(F.col("dst_ip")), F.col("dst_port")),
        F.format_string("packets %d", F.col("packet_total")),
    ]
    if {"source_mac", "destination_mac"} <= have:
        parts.append(F.format_string("mac %s -> %s", F.col("source_mac"), F.col("destination_mac")))
    if "app_name" in have:
        parts.append(F.format_string("application %s", F.col("app_name")))
    if "end_reason" in have:
        parts.append(F.format_string("reason %d", F.col("end_reason")))
    if "octet_total" in have:
        speed = F.when(nanos != 0, F.expr("octet_total * 1000000") / nanos)
        parts.append(F.when(nanos != 0, F.format_string("speed %d kBps", F.floor(speed).cast("bigint"))))
    if "rtt_pairs" in have:
        micro = F.floor((F.col("rtt_fwd") + F.col("rtt_bwd")) / 1000).cast("bigint")
        parts.append(F.when(F.col("rtt_pairs") > 0, F.format_string("rtt %d us (%d)", micro, F.col("rtt_pairs"))))
    if {"l3_length_fwd", "l3_length_bwd"} <= have:
        parts.append(F.format_string("data %d:%d", F.col("l3_length_fwd"), F.col("l3_length_bwd")))
    if "agg_level" in have:
        parts.append(F.format_string("level %d", F.col("agg_level")))
    return flows.select(F.concat_ws(" ", *parts).alias("line"))
