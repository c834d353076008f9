"""Round-trip times: pairing a packet with the newest earlier answerable packet.

Pairing is an as-of look-up on the pair key, not a self-join: each packet adds at
most one row as a candidate and one as a probe, and no pair list of a group is
ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from packetflow.functions.scalars import micros
from packetflow.operators.keys import KEY, is_dns
from packetflow.operators.ordering import carry_forward
from packetflow.schemas import ICMP, ICMP6, TCP
from packetflow.session import settle

PAIR_TIMEOUT = "1 second"
PAIR_SUMS = ["_rtt_sum_fwd", "_rtt_n_fwd", "_rtt_sum_bwd", "_rtt_n_bwd"]


def _icmp() -> Column:
    version, protocol = F.col("ip_version"), F.col("protocol")
    return ((version == 4) & (protocol == ICMP)) | ((version == 6) & (protocol == ICMP6))


def _pair_keys(kinds: tuple[str, ...]) -> tuple[Column, Column]:
    """What a later packet must ask for to find this one, and what this one asks for."""

    def key(first, second=None, third=None):
        zero = F.lit(0)
        parts = [p if p is not None else zero for p in (first, second, third)]
        return F.struct(*[F.coalesce(p.cast("bigint"), zero.cast("bigint")).alias(n) for p, n in zip(parts, "abc")])

    offered, asked = F.lit(None), F.lit(None)
    if "tcp" in kinds:
        on = F.col("protocol") == TCP
        offered, asked = F.when(on, key(F.col("tcp_ack"))), F.when(on, key(F.col("tcp_seq")))
    if "dns" in kinds:
        name = key(F.col("dns_id"), F.col("dns_opcode"), F.col("dns_rd"))
        offered = F.coalesce(offered, F.when(is_dns() & (F.col("dns_qr") == 0), name))
        asked = F.coalesce(asked, F.when(is_dns() & (F.col("dns_qr") == 1), name))
    if "icmp" in kinds:
        request = F.when(F.col("ip_version") == 6, F.lit(128)).otherwise(F.lit(8))
        offered = F.coalesce(offered, F.when(_icmp(), key(F.col("tcp_seq"))))
        asked = F.coalesce(asked, F.when(_icmp() & (F.col("icmp_type") != request), key(F.col("tcp_seq"))))
    return offered, asked


def rtt_pairs(
    split: DataFrame,
    timeout=PAIR_TIMEOUT,
    consume: bool = False,
    kinds: tuple[str, ...] = ("tcp", "dns", "icmp"),
) -> DataFrame:
    """Pairs within two-way flows (output of ``split_flows`` on two-way keys).

    Each probe pairs with the newest earlier packet of the opposite direction that
    has what it asks for, at most ``timeout`` before.  With ``consume`` a match
    empties the opposite direction's candidates.  Keys that ``split_flows`` found hot
    are cut into the same time chunks here.
    """
    offered, asked = _pair_keys(kinds)
    cut = "_chunk" if "_chunk" in split.columns else None
    columns = [*KEY, "flow_no", "_t0"]
    passed = [*columns, cut] if cut else columns
    base = split.select(
        *passed, "_t", "_pos", "packet_id", "direction", offered.alias("_offered"), asked.alias("_asked")
    ).where(F.col("_offered").isNotNull() | F.col("_asked").isNotNull())
    if cut:
        # Read three times below; these few columns are cheaper to keep than to split again.
        base = settle(base, "pair-rows")
    # Direction whose packets the row belongs with: its own as candidate, the opposite as probe.
    roles = F.array(
        F.struct(F.lit(True).alias("offers"), F.col("direction").alias("side"), F.col("_offered").alias("on")),
        F.struct(F.lit(False).alias("offers"), (3 - F.col("direction")).alias("side"), F.col("_asked").alias("on")),
    )
    rows = (
        base.withColumn("_role", F.explode(roles))
        .select(*passed, "_t", "_pos", "packet_id", "direction", "_role.offers", "_role.side", "_role.on")
        .where(F.col("on").isNotNull())
        .select("*", F.col("on.a").alias("_a"), F.col("on.b").alias("_b"), F.col("on.c").alias("_c"))
        .drop("on")
    )
    candidate = F.when(F.col("offers"), F.struct(F.col("_t").alias("t"), F.col("_pos").alias("pos"), F.col("packet_id").alias("id")))
    by = [*columns, "side", "_a", "_b", "_c"]
    found = carry_forward(rows, by, candidate, "_match", tie="_pos", chunk=None, cut=cut)
    pairs = found.where(
        ~F.col("offers") & F.col("_match").isNotNull() & (F.col("_t") - F.col("_match.t") <= micros(timeout))
    ).select(
        *passed,
        "direction",
        "packet_id",
        "_t",
        "_pos",
        F.col("_match.id").alias("matched_id"),
        F.col("_match.t").alias("_matched_t"),
        F.col("_match.pos").alias("_matched_pos"),
        (F.col("_t") - F.col("_match.t")).alias("delay_us"),
    )
    return _consume(pairs, cut is not None) if consume else pairs


def rtt_pairs_tcp(split: DataFrame, timeout=PAIR_TIMEOUT, **options) -> DataFrame:
    return rtt_pairs(split, timeout, kinds=("tcp",), **options)


def rtt_pairs_dns(split: DataFrame, timeout=PAIR_TIMEOUT, **options) -> DataFrame:
    return rtt_pairs(split, timeout, kinds=("dns",), **options)


def rtt_pairs_icmp(split: DataFrame, timeout=PAIR_TIMEOUT, **options) -> DataFrame:
    return rtt_pairs(split, timeout, kinds=("icmp",), **options)


def _consume(pairs: DataFrame, is_cut: bool) -> DataFrame:
    """Keep the pairs that survive emptied candidate lists.

    A pair is an interval (matched, probe]; in order of probes a pair stands if it
    begins after the last standing pair of its direction ended, the *limit*.  Rows are
    walked in order with that one number of state.  Hot keys are walked chunk by
    chunk: each chunk is first summed up as a function from the limit before it to
    the limit after it, the functions are applied along the key (one short row per
    chunk), and every chunk then starts from its own limit.
    """
    by = [*KEY, "flow_no", "_t0", "direction"]
    if is_cut:
        # Two uses: the chunk functions and the walk.
        pairs = settle(pairs, "pairs")
        cut = pairs.where(F.col("_chunk") != -1).select(*by, "_chunk", "_matched_pos", "_pos")
        passed = cut.groupBy(*by, "_chunk").applyInPandas(
            _limit_function(by), StructType([*cut.select(*by, "_chunk").schema.fields, *_LIMIT_STEPS])
        )
        limits = passed.groupBy(*by).applyInPandas(
            _limits_along(by), StructType([*cut.select(*by, "_chunk").schema.fields, StructField("_limit", LongType())])
        )
        rows = pairs.join(limits, [*by, "_chunk"], "left").fillna({"_limit": -1})
    else:
        rows = pairs.withColumns({"_chunk": F.lit(-1).cast("bigint"), "_limit": F.lit(-1).cast("bigint")})
    key = [*by, "_chunk"]
    ordered = rows.select(*pairs.columns, *[c for c in ("_chunk", "_limit") if c not in pairs.columns])
    ordered = ordered.repartition(*key).sortWithinPartitions(*key, "_pos")
    return ordered.mapInPandas(_walk(key), ordered.schema).drop("_chunk", "_limit")


_LIMIT_STEPS = [StructField("below", ArrayType(LongType())), StructField("limit", ArrayType(LongType()))]


def _walk(key: list[str]):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limit = None, -1
        for batch in batches:
            keep = []
            names = zip(*[batch[name] for name in key])
            for name, start, begins, ends in zip(names, batch["_limit"], batch["_matched_pos"], batch["_pos"]):
                if name != current:
                    current, limit = name, start
                keep.append(begins > limit)
                if begins > limit:
                    limit = ends
            yield batch[np.array(keep, dtype=bool)]

    return walk


def _limit_function(by: list[str]):
    """Limit after a chunk as steps of the limit before it: below ``below[i]`` it is ``limit[i]``, else unchanged.

    The first pair to stand is the first that begins after the limit, so only pairs
    with a new latest begin can be first; from there on the chain is fixed.
    """

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        begins, ends = rows["_matched_pos"].to_numpy(), rows["_pos"].to_numpy()
        latest = np.maximum.accumulate(begins)
        # The pair that stands next after pair i: the first to begin after i's end.
        following = np.searchsorted(latest, ends, side="right")
        final = ends.copy()
        for i in range(len(ends) - 1, -1, -1):
            if following[i] < len(ends):
                final[i] = final[following[i]]
        first = np.flatnonzero(np.concatenate([[True], latest[1:] > latest[:-1]]))
        below, limit = latest[first], final[first]
        # Begins from the chunk's first end on exceed any limit before the chunk; equal steps merge.
        reach = np.searchsorted(below, ends[0], side="left") + 1
        below, limit = below[:reach], limit[:reach]
        last_of_step = np.concatenate([limit[1:] != limit[:-1], [True]])
        out = rows[[*by, "_chunk"]].iloc[:1].copy()
        out["below"], out["limit"] = [below[last_of_step].tolist()], [limit[last_of_step].tolist()]
        return out

    return steps


def _limits_along(by: list[str]):
    """The limit before each chunk of a key."""

    def along(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("_chunk")
        limit, before = -1, []
        for below, after in zip(chunks["below"], chunks["limit"]):
            before.append(limit)
            step = np.searchsorted(below, limit, side="right")
            if step < len(after):
                limit = int(after[step])
        return chunks[[*by, "_chunk"]].assign(_limit=before)

    return along


def pair_sums() -> list[Column]:
    out = []
    for side, direction in (("fwd", 1), ("bwd", 2)):
        hit = F.col("direction") == direction
        out.append(F.sum(F.when(hit, F.col("delay_us")).otherwise(0)).alias(f"_rtt_sum_{side}"))
        out.append(F.count_if(hit).alias(f"_rtt_n_{side}"))
    return out


def mean_columns(df: DataFrame) -> DataFrame:
    """Mean delays in ns per direction and the number of pairs."""
    def mean(side):
        total, n = F.col(f"_rtt_sum_{side}"), F.col(f"_rtt_n_{side}")
        return F.when(n > 0, total * 1000.0 / n).otherwise(F.lit(0.0))

    return df.withColumns(
        {
            "rtt_fwd": mean("fwd"),
            "rtt_bwd": mean("bwd"),
            "rtt_pairs": F.col("_rtt_n_fwd") + F.col("_rtt_n_bwd"),
        }
    ).drop(*PAIR_SUMS)


def rtt_summary(pairs: DataFrame) -> DataFrame:
    """Per flow: mean delay per direction, their sum as round-trip time, number of pairs."""
    sums = pairs.groupBy(*KEY, "flow_no").agg(*pair_sums())
    return mean_columns(sums).withColumn("rtt", F.col("rtt_fwd") + F.col("rtt_bwd"))
