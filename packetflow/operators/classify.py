"""Application of a packet, from rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetflow.operators.ordering import lookup, salted_lookup
from packetflow.schemas import TCP, UDP

# Engine id of the application id, and the name without classification.
ENGINE_ID = 6
UNKNOWN = "Unknown"

#: Host rules up to which the rules travel inside the expression.
MOST_INLINE_RULES = 500


def port_table(app_rules: DataFrame) -> DataFrame:
    """Best rule per (protocol, port).

    Ranges become single ports, so the look-up is an equi-join.  Two protocols of
    65,536 ports each bound the table at 131,072 narrow rows.
    """
    ports = app_rules.where(
        (F.col("kind") == "port") & F.col("protocol").isin(TCP, UDP) & (F.col("port_lo") <= F.col("port_hi"))
    ).select(
        "protocol",
        F.explode(
            F.sequence(F.greatest(F.col("port_lo"), F.lit(0)), F.least(F.col("port_hi"), F.lit(65535)))
        ).alias("port"),
        F.struct("priority", "app_id").alias("rule"),
    )
    return ports.groupBy("protocol", "port").agg(F.min("rule").alias("rule"))


def classify_by_port(df: DataFrame, app_rules: DataFrame) -> DataFrame:
    """``app_id`` by protocol and either port; the rule with the lowest priority number wins, 0 if none."""
    table = port_table(app_rules)
    kept = [c for c in df.columns if c != "app_id"]
    for side in ("dst", "src"):
        named = table.select("protocol", F.col("port").alias(f"{side}_port"), F.col("rule").alias(f"_{side}_rule"))
        df = df.join(F.broadcast(named), ["protocol", f"{side}_port"], "left")
    best = F.least("_dst_rule", "_src_rule")
    return df.select(*kept, F.coalesce(best["app_id"], F.lit(0)).alias("app_id"))


def classify_by_host(df: DataFrame, app_rules: DataFrame, host: str = "host", most_inline: int = MOST_INLINE_RULES) -> DataFrame:
    """Rules on text contained in a host name override ``app_id``.

    Few rules are put into the expression (no join at all).  Beyond that, the
    distinct hosts are cut into pieces of the rules' lengths and matched by
    equality.  Both give the same result for rules of any length.
    """
    rules = app_rules.where((F.col("kind") == "host") & (F.length("host") > 0)).select(
        "priority", "app_id", F.col("host").alias("text")
    )
    previous = F.col("app_id") if "app_id" in df.columns else F.lit(0)
    inline = rules.limit(most_inline + 1).collect()
    if len(inline) <= most_inline:
        found = _inline_match(F.col(host), inline)
        return df.withColumn("app_id", F.coalesce(found, previous))
    matched = _match_by_pieces(df.select(F.col(host).alias("_host")).where(F.col(host).isNotNull()).distinct(), rules)
    matched = matched.withColumnRenamed("_host", host)
    joined = salted_lookup(df, matched, [host], F.col("packet_id"), how="left")
    return joined.withColumn("app_id", F.coalesce("_host_app", previous)).drop("_host_app")


def _inline_match(host: Column, rules: list) -> Column:
    if not rules:
        return F.lit(None).cast("int")
    ordered = sorted(rules, key=lambda r: (r["priority"], r["app_id"]))
    table = F.array(*[F.struct(F.lit(r["app_id"]).alias("app_id"), F.lit(r["text"]).alias("text")) for r in ordered])
    return F.get(F.filter(table, lambda r: F.contains(host, r["text"])), F.lit(0))["app_id"]


def _match_by_pieces(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    # One number for each length that occurs; a host shorter than a rule yields no piece of that length.
    lengths = [row[0] for row in rules.select(F.length("text").alias("n")).distinct().collect()]
    host = F.col("_host")

    def pieces_of(n: int) -> Column:
        starts = F.when(F.length(host) >= n, F.sequence(F.lit(1), F.length(host) - n + 1))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda at: F.substr(host, at, F.lit(n)))

    pieces = F.flatten(F.array(*[pieces_of(n) for n in sorted(lengths)]))
    cut = hosts.withColumn("text", F.explode(F.array_distinct(pieces)))
    best = rules.groupBy("text").agg(F.min(F.struct("priority", "app_id")).alias("rule"))
    hits = salted_lookup(cut, best, ["text"], F.col("_host"))
    return hits.groupBy("_host").agg(F.min("rule").alias("rule")).select("_host", F.col("rule.app_id").alias("_host_app"))


def application_name(df: DataFrame, apps: DataFrame, salt: str | None = None, enabled: bool = True) -> DataFrame:
    """``app_name`` of ``app_id``; "Unknown" for no entry or with classification off."""
    if not enabled:
        return df.withColumn("app_name", F.lit(UNKNOWN))
    names = apps.groupBy("app_id").agg(F.min("app_name").alias("app_name"))
    spread = F.col(salt) if salt else F.col(df.columns[0])
    return lookup(df, names, ["app_id"], spread).withColumn("app_name", F.coalesce("app_name", F.lit(UNKNOWN)))


def application_id(app_id: Column) -> Column:
    """One byte engine id followed by three bytes of application number."""
    return F.lit(ENGINE_ID << 24) + app_id.cast("bigint")
