"""Aggregation of small ("mice") flows through a cascade of reduced keys."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetflow.functions.scalars import micros
from packetflow.operators.ordering import salted_lookup
from packetflow.operators.reports import active_flow_count
from packetflow.schemas import END_DETECTED
from packetflow.session import settle

# Default threshold and reduction order (first in the list is reduced first).
OCTETS = 10_000
REDUCE = (827, 1228, 7, 11)

#: Key of a merged flow.
MERGE_KEY = ["ip_version", "protocol", "src_ip", "dst_ip", "src_port", "dst_port"]

# Information elements that can be reduced -> (column, IP version or None for both).
REDUCIBLE = {
    4: ("protocol", None),
    7: ("src_port", None),
    8: ("src_ip", 4),
    11: ("dst_port", None),
    12: ("dst_ip", 4),
    27: ("src_ip", 6),
    28: ("dst_ip", 6),
    827: ("src_ip", None),
    1228: ("dst_ip", None),
}

SUMS = [
    "packet_total", "octet_total", "octet_sum_squares", "packet_delta", "octet_delta", "octet_delta_sum_squares",
    "fin_count", "syn_count", "rst_count", "psh_count", "ack_count", "urg_count",
    "retransmitted_packets", "retransmitted_octets",
    "l3_hlength_fwd", "l3_length_fwd", "l4_hlength_fwd", "l3_hlength_bwd", "l3_length_bwd", "l4_hlength_bwd",
    "original_present", "original_initiated", "original_completed",
]
LASTS = ["last_ip_plength", "last_tcp_seq", "last_tcp_ack", "last_tcp_flags"]
DISTINCT = [f"distinct_{side}{v}" for side in ("src", "dst") for v in ("", "_v4", "_v6")]


def split_mice(flows: DataFrame, octets: int = OCTETS) -> tuple[DataFrame, DataFrame]:
    """Flows below the threshold, and the rest (a flow exactly at it stays)."""
    small = F.col("octet_total") < octets
    return flows.where(small), flows.where(~small)


def _fields(fields) -> list[int]:
    unknown = [f for f in fields if f not in REDUCIBLE]
    if unknown:
        raise ValueError(f"fields that cannot be reduced: {unknown}; known are {sorted(REDUCIBLE)}")
    return list(fields)


def _reduced(fields, level: int) -> dict[str, Column]:
    """Key columns after the first ``level`` reductions."""
    out: dict[str, Column] = {name: F.col(name) for name in MERGE_KEY}
    version = F.col("ip_version")
    for field in _fields(fields)[:level]:
        name, only = REDUCIBLE[field]
        if name.endswith("_ip"):
            zero = F.when(version == 6, F.lit("::")).otherwise(F.lit("0.0.0.0"))
            out[name] = zero if only is None else F.when(version == only, zero).otherwise(out[name])
        else:
            out[name] = F.lit(0)
    return out


def reduce_key(flows: DataFrame, fields=REDUCE, level: int | None = None) -> DataFrame:
    """Zero the first ``level`` fields of the list in the flow key."""
    return flows.withColumns(_reduced(fields, len(fields) if level is None else level))


def _merge_order(columns: list[str]) -> Column:
    """The flow whose last values stay: the one that ended, then started last, then has the largest number.

    The last values themselves end the order, so the greatest struct is one flow's, the same in every run.
    """
    ties = [c for c in ("flow_no", *LASTS) if c in columns]
    return F.struct("flow_end", "flow_start", *ties)


def _with_lasts(merged: DataFrame) -> DataFrame:
    """The last values of merged flows out of their ``_order``."""
    kept = [f.name for f in merged.schema["_order"].dataType.fields if f.name in LASTS]
    return merged.withColumns({n: F.col("_order")[n] for n in kept}).drop("_order")


def _merge_aggs(columns: list[str]) -> list[Column]:
    have = set(columns)
    aggs = [F.sum(n).alias(n) for n in SUMS if n in have]
    aggs += [F.min(n).alias(n) for n in ("flow_start", "start_after_export") if n in have]
    aggs += [F.max("flow_end").alias("flow_end")]
    aggs += [F.bit_or(n).alias(n) for n in ("tcp_flags_or",) if n in have]
    aggs += [F.bool_or(n).alias(n) for n in ("is_sampled",) if n in have]
    aggs += [F.max("_order").alias("_order")]
    return aggs


def _split_by_version(side: str, total: Column) -> list[Column]:
    version, zero = F.col("ip_version"), F.lit(0).cast("bigint")
    return [
        total.alias(f"distinct_{side}"),
        F.when(version == 4, total).otherwise(zero).alias(f"distinct_{side}_v4"),
        F.when(version == 6, total).otherwise(zero).alias(f"distinct_{side}_v6"),
    ]


def merge_flows(flows: DataFrame, keys=tuple(MERGE_KEY), distinct: str | None = "exact", endpoints=("src_ip", "dst_ip")) -> DataFrame:
    """Merge flows with equal ``keys``: sums, first start, last end, last values, distinct endpoints.

    ``endpoints`` names the columns with the original addresses when the key's own
    are already reduced.  ``distinct``: ``exact``, ``approx`` (HyperLogLog), ``additive``
    (sum of the parts' counts) or None.
    """
    keys = list(keys)
    rows = flows.withColumn("_order", _merge_order(flows.columns))
    aggs = _merge_aggs(flows.columns)
    if distinct == "additive":
        aggs += [F.sum(n).alias(n) for n in DISTINCT if n in flows.columns]
    elif distinct == "approx":
        aggs += [F.hll_sketch_estimate(F.hll_sketch_agg(c)).alias(f"_n_{s}") for s, c in zip(("src", "dst"), endpoints)]
    elif distinct not in (None, "exact"):
        raise ValueError(f"distinct must be exact, approx, additive or None, not {distinct!r}")
    merged = _with_lasts(rows.groupBy(*keys).agg(*aggs))
    if distinct == "approx":
        counts = [c for s in ("src", "dst") for c in _split_by_version(s, F.col(f"_n_{s}"))]
        merged = merged.select("*", *counts).drop("_n_src", "_n_dst")
    if distinct == "exact":
        ends = [F.col(c).alias(f"_end_{c}") for c in endpoints]
        merged = merged.join(_distinct_counts(flows.select(*keys, *ends), keys, [f"_end_{c}" for c in endpoints]), keys)
    return merged


def _distinct_counts(rows: DataFrame, keys: list[str], ends: list[str]) -> DataFrame:
    """Exact distinct endpoints per key.

    Addresses are first made distinct per (key, side) with map-side combine, so the
    shuffle spreads a hot key over its addresses; only counts meet per key.
    """
    sides = F.array(
        *[F.struct(F.lit(side).alias("side"), F.col(c).alias("address")) for side, c in zip(("src", "dst"), ends)]
    )
    single = rows.select(*keys, F.inline(sides)).distinct()
    counts = single.groupBy(*keys).agg(
        F.count_if(F.col("side") == "src").alias("_n_src"), F.count_if(F.col("side") == "dst").alias("_n_dst")
    )
    return counts.select(*keys, *_split_by_version("src", F.col("_n_src")), *_split_by_version("dst", F.col("_n_dst")))


def distinct_endpoints(flows: DataFrame, keys=tuple(MERGE_KEY), endpoints=("src_ip", "dst_ip")) -> DataFrame:
    keys = list(keys)
    ends = [F.col(c).alias(f"_end_{c}") for c in endpoints]
    return _distinct_counts(flows.select(*keys, *ends), keys, [f"_end_{c}" for c in endpoints])


def aggregate_cascade(
    flows: DataFrame,
    octets: int = OCTETS,
    reduce=REDUCE,
    scope: str = "all",
    distinct: str | None = "exact",
    by: tuple[str, ...] = (),
    salts: int = 16,
    settled: bool = False,
) -> DataFrame:
    """Merge mice level by level.  ``flows`` has one record per flow (no interim records).

    At level k the first k fields are zeroed and equal keys merge; merged flows that
    reach ``octets`` stay at level k, the others go on, and the last level keeps
    all.  ``agg_level`` tells the level (0: never aggregated).  ``scope='finished'``
    aggregates only flows ended by FIN.  ``by`` adds columns to every key.

    Each level is used by the next level and by the result, so it is written to the
    shared folder once; so are the flows unless the caller says they are a table
    already (``settled``).
    """
    fields = _fields(reduce)
    if not 1 <= len(fields) <= 4:
        raise ValueError("one to four fields can be reduced")
    if scope not in ("all", "finished"):
        raise ValueError(f"scope must be 'all' or 'finished', not {scope!r}")
    if distinct not in ("exact", "approx", "additive", None):
        raise ValueError(f"distinct must be exact, approx, additive or None, not {distinct!r}")
    keys = [*by, *MERGE_KEY]
    if not settled:
        flows = settle(flows, "flows")
    small = F.col("octet_total") < octets
    if scope == "finished":
        small = small & (F.col("end_reason") == END_DETECTED)
    mice, others = flows.where(small), flows.where(~small)

    aggs = _merge_aggs(flows.columns)
    if distinct == "additive":
        aggs += [F.sum(n).alias(n) for n in DISTINCT if n in flows.columns]
    elif distinct == "approx":
        # Sketches are built once from the original flows and united afterwards: bounded state per key.
        aggs += [F.hll_union_agg(f"_hll_{s}").alias(f"_hll_{s}") for s in ("src", "dst")]

    current = mice.withColumn("_order", _merge_order(flows.columns))
    levels: list[DataFrame] = []  # every merged flow of each level
    kept: list[DataFrame] = []
    for level in range(1, len(fields) + 1):
        reduced = current.withColumns(_reduced(fields, level))
        if distinct == "approx" and level == 1:
            first = [a for a in _merge_aggs(flows.columns)]
            first += [F.hll_sketch_agg(f"_end_{s}").alias(f"_hll_{s}") for s in ("src", "dst")]
            ends = {f"_end_{s}": F.col(f"{s}_ip") for s in ("src", "dst")}
            merged = current.withColumns(ends).withColumns(_reduced(fields, 1)).groupBy(*keys).agg(*first)
        else:
            merged = reduced.groupBy(*keys).agg(*aggs)
        if level < len(fields):
            merged = settle(merged, f"level{level}")
            levels.append(merged)
        done = merged if level == len(fields) else merged.where(F.col("octet_total") >= octets)
        kept.append(done.withColumn("agg_level", F.lit(level)))
        current = merged.where(F.col("octet_total") < octets)
    merged = _with_lasts(fold(lambda a, b: a.unionByName(b), kept))

    if distinct == "approx":
        counts = [
            c for s in ("src", "dst") for c in _split_by_version(s, F.hll_sketch_estimate(F.col(f"_hll_{s}")))
        ]
        merged = merged.select("*", *counts).drop("_hll_src", "_hll_dst")
    elif distinct == "exact":
        counts = _cascade_distinct(mice, levels, fields, octets, keys, salts)
        merged = merged.join(counts, [*keys, "agg_level"])
    others = others.withColumn("agg_level", F.lit(0))
    if distinct is None:
        others = others.drop(*DISTINCT)
    common = [c for c in others.columns if c in merged.columns]
    extra = [c for c in others.columns if c not in merged.columns]
    return others.select(*common, *extra).unionByName(merged.select(*common), allowMissingColumns=True)


def _cascade_distinct(mice, levels, fields, octets, keys, salts) -> DataFrame:
    """Distinct endpoints of every merged flow, keyed by (key, agg_level).

    The level at which a level-1 key ends is found by walking back from the last
    level (one row per merged key).  Original endpoints then look their level up
    once, with salted keys, and the counts are taken per final key.
    """
    last = len(fields)

    def lookup_key(level):
        """Columns of the level's key under other names, computed from a row's own key."""
        named = _reduced(fields, level)
        return {f"_at_{name}": named[name] if name in named else F.col(name) for name in keys}

    ends_at = None  # key of a level -> level where the merged flow ends
    for level in range(last - 1, 0, -1):
        rows = levels[level - 1].select(*keys, "octet_total")
        stays = F.col("octet_total") >= octets
        if ends_at is None:
            ends_at = rows.select(*keys, F.when(stays, F.lit(level)).otherwise(F.lit(last)).alias("agg_level"))
            continue
        onward = rows.withColumns(lookup_key(level + 1))
        following = ends_at.select(*[F.col(k).alias(f"_at_{k}") for k in keys], F.col("agg_level").alias("_next"))
        onward = salted_lookup(onward, following, [f"_at_{k}" for k in keys], F.struct(*keys), salts=salts, how="left")
        # A flow that stays finds no row at the next level, or another flow's; its own level counts.
        ends_at = onward.select(*keys, F.when(stays, F.lit(level)).otherwise(F.col("_next")).alias("agg_level"))
    ends = mice.select(*keys).distinct().withColumns(lookup_key(1))
    if ends_at is None:
        placed = ends.withColumn("agg_level", F.lit(last))
    else:
        at_first = ends_at.select(*[F.col(k).alias(f"_at_{k}") for k in keys], "agg_level")
        placed = salted_lookup(ends, at_first, [f"_at_{k}" for k in keys], F.struct(*keys), salts=salts)
    final = {}
    for name in MERGE_KEY:
        column = F.col(name)
        for level in range(1, last + 1):
            column = F.when(F.col("agg_level") == level, _reduced(fields, level)[name]).otherwise(column)
        final[name] = column
    others = [k for k in keys if k not in MERGE_KEY]
    placed = placed.select(
        *others, "agg_level", *[c.alias(n) for n, c in final.items()],
        F.col("src_ip").alias("_end_src"), F.col("dst_ip").alias("_end_dst"),
    )
    return _distinct_counts(placed, [*keys, "agg_level"], ["_end_src", "_end_dst"])


def aggregate_finished(flows: DataFrame, octets: int = OCTETS, reduce=REDUCE, **options) -> DataFrame:
    """Flows ended by FIN: mice go through the first reduction, everything else passes."""
    return aggregate_cascade(flows, octets, tuple(reduce)[:1], scope="finished", **options)


def _trigger(interval) -> Column:
    width = micros(interval)
    return F.timestamp_micros(F.floor(F.unix_micros("flow_end") / F.lit(width)) * F.lit(width))


def aggregate_every(flows: DataFrame, interval, **cascade) -> DataFrame:
    """The cascade once per trigger interval (by flow end)."""
    return aggregate_cascade(flows.withColumn("trigger", _trigger(interval)), by=("trigger",), **cascade)


# Fixed value: share of the capacity in use at which aggregation starts.
AUTO_SHARE = 0.75


def aggregate_auto(flows: DataFrame, capacity: int, interval, idle, share: float = AUTO_SHARE, **cascade) -> DataFrame:
    """Aggregate from the first interval in which flows take more than ``share`` of ``capacity`` places; it stays on.

    A flow takes its place until it has been idle for ``idle``.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    flows = settle(flows, "flows")
    busy = active_flow_count(flows, interval, idle).where(F.col("peak") > share * capacity)
    crossing = busy.agg(F.min("bucket_start")).scalar()
    marked = flows.withColumn("trigger", _trigger(interval)).withColumn("_from", crossing)
    aggregated = marked.where(F.col("trigger") >= F.col("_from")).drop("_from")
    before = marked.where(F.col("_from").isNull() | (F.col("trigger") < F.col("_from"))).drop("_from")
    done = aggregate_cascade(aggregated, by=("trigger",), settled=True, **cascade)
    return done.unionByName(before.withColumn("agg_level", F.lit(0)), allowMissingColumns=True)
