"""Packets to flow records: splitting by idle gap and FIN, active slices, end reasons.

Plan without hot keys: packets are shuffled once, on the key; splitting, numbering
and the final ``groupBy`` all use that partitioning.

Plan with hot keys: the shuffle is on ``(key, time chunk)``.  A narrow copy of the
hot keys, one row per chunk, carries the open flow from chunk to chunk; its result
joins back on the same partitioning.  The final ``groupBy`` combines within each
task before its shuffle, so a flow that holds a third of all packets arrives as
one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetflow.functions.scalars import micros
from packetflow.operators import measures as M
from packetflow.operators.keys import KEY, flow_key
from packetflow.operators.ordering import CHUNK, HOT_ROWS, cut_into_chunks
from packetflow.schemas import ACTIVE_TIMEOUT, END_DETECTED, FORCED_END, IDLE_TIMEOUT, TCP

# Default timeouts.
IDLE = "10 seconds"
ACTIVE = "5 seconds"

#: Header values compared with the previous packet to find a retransmission.
REPEAT_FIELDS = ("tcp_seq", "tcp_ack", "ip_plength", "tcp_flags")


def _is_fin(columns: list[str], fin: bool, flags: str = "tcp_flags") -> Column:
    if not fin or "tcp_flags" not in columns:
        return F.lit(False)
    return F.expr(f"coalesce(protocol = {TCP} AND {flags} & 1 = 1, false)")


def split_flows(
    packets: DataFrame, idle=IDLE, fin: bool = True, chunk=CHUNK, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Number the flows of each key.

    A packet opens a new flow when it is the first of its key, comes more than
    ``idle`` after the previous one, or follows a FIN.  Added columns: ``flow_no``
    (from 1 per key), ``direction`` (1 as the flow's first packet, 2 against it),
    ``flow_start``.  Keys with about ``hot_rows`` packets or more are cut into chunks of
    width ``chunk``; ``chunk=None`` skips the look for them.
    """
    keyed = packets if "k_ip1" in packets.columns else flow_key(packets)
    idle_us = micros(idle)
    repeat_fields = [name for name in REPEAT_FIELDS if name in keyed.columns]
    rows = keyed.withColumns({"_t": F.unix_micros("ts"), "_fin": _is_fin(keyed.columns, fin)})
    cut = cut_into_chunks(rows, KEY, chunk=chunk, rows=hot_rows) if chunk is not None else None
    groups = KEY
    if cut is not None:
        groups, rows = [*KEY, "_chunk"], cut
    order = Window.partitionBy(*groups).orderBy("_t", "packet_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    packet = F.struct("_t", "_fin", *repeat_fields)
    opening = F.struct(F.col("_t").alias("t"), F.col("orient").alias("orient"))
    marked = rows.withColumns({"_packet": packet, "_local": F.row_number().over(order)})
    marked = marked.withColumns({"_before": F.lag("_packet").over(order)})
    apart = (F.col("_t") - F.col("_before._t") > idle_us) | F.col("_before._fin")
    marked = marked.withColumn("_cut", F.coalesce(apart, F.lit(False)))
    opens_here = F.col("_before").isNull() | F.col("_cut")
    marked = marked.withColumns(
        {
            "_cuts": F.sum(F.col("_cut").cast("bigint")).over(so_far),
            "_opening": F.last(F.when(opens_here, opening), ignorenulls=True).over(so_far),
        }
    )

    if cut is None:
        joined = marked.withColumns({"flow_no": F.col("_cuts") + 1, "_pos": F.col("_local").cast("bigint"), "_opens": opens_here})
        joined = joined.withColumn("_previous", F.when(~F.col("_opens"), F.col("_before")))
    else:
        edges = (
            marked.withColumns({"_first_t": F.first("_t").over(so_far), "_next": F.lead("_t").over(order)})
            .where(F.col("_next").isNull() & (F.col("_chunk") != -1))
            .select(*groups, "_first_t", "_cuts", "_local", "_opening", "_packet")
        )
        along = Window.partitionBy(*KEY).orderBy("_chunk")
        up_to = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edges = edges.withColumn("_last", F.lag("_packet").over(along))
        continues = (F.col("_first_t") - F.col("_last._t") <= idle_us) & ~F.col("_last._fin")
        edges = edges.withColumn("_continues", F.coalesce(continues, F.lit(False)))
        opened = F.when(~F.col("_continues") | (F.col("_cuts") > 0), F.col("_opening"))
        opens = F.col("_cuts") + F.when(F.col("_continues"), 0).otherwise(1)
        edges = edges.withColumns(
            {
                "_current": F.last(opened, ignorenulls=True).over(up_to),
                "_flows_before": F.sum(opens).over(up_to) - opens,
                "_rows_before": F.sum("_local").over(up_to) - F.col("_local"),
            }
        )
        carried = edges.select(
            *groups,
            "_continues",
            F.when(F.col("_continues"), F.lag("_current").over(along)).alias("_carried_opening"),
            F.when(F.col("_continues"), F.col("_last")).alias("_carried_packet"),
            "_flows_before",
            "_rows_before",
        )
        joined = marked.join(carried, groups, "left").fillna({"_continues": False, "_flows_before": 0, "_rows_before": 0})
        in_carried = F.col("_continues") & (F.col("_cuts") == 0)
        first_row = F.col("_before").isNull()
        joined = joined.withColumns(
            {
                "flow_no": F.col("_flows_before") + F.col("_cuts") + F.when(F.col("_continues"), 0).otherwise(1),
                "_pos": F.col("_rows_before") + F.col("_local"),
                "_opening": F.when(in_carried, F.col("_carried_opening")).otherwise(F.col("_opening")),
                "_opens": F.col("_cut") | (first_row & ~F.col("_continues")),
                "_previous": F.when(first_row, F.col("_carried_packet")).when(~F.col("_cut"), F.col("_before")),
            }
        )
    repeated = F.lit(False)
    if len(repeat_fields) == len(REPEAT_FIELDS):
        repeated = F.col("protocol") == TCP
        for name in REPEAT_FIELDS:
            repeated = repeated & (F.col(f"_previous.{name}") == F.col(name))
    return joined.withColumns(
        {
            "direction": F.when(F.col("orient") == F.col("_opening.orient"), 1).otherwise(2),
            "_t0": F.col("_opening.t"),
            "flow_start": F.timestamp_micros("_opening.t"),
            "_repeat": F.coalesce(repeated, F.lit(False)),
        }
    ).drop(
        "_packet", "_local", "_before", "_cut", "_cuts", "_opening", "_continues", "_previous",
        "_carried_opening", "_carried_packet", "_flows_before", "_rows_before",
    )


def slice_active(split: DataFrame, active) -> DataFrame:
    """Number of the active period a packet falls in, from the start of its flow."""
    return split.withColumn("slice", F.floor((F.col("_t") - F.col("_t0")) / F.lit(micros(active))).cast("int"))


def horizon_of(packets: DataFrame) -> Column:
    """Time of the newest packet, as a scalar subquery (no action is run here)."""
    return packets.select(F.max(F.unix_micros("ts"))).scalar()


def end_reason(flows: DataFrame, idle=IDLE, horizon=None) -> DataFrame:
    """Why the last record of a flow was closed: FIN, idle, or flushed at the end of input.

    ``flows`` has ``flow_end`` and, for FIN, ``protocol`` and ``last_tcp_flags``.
    ``horizon`` is the end of input (default: the newest flow end).
    """
    if isinstance(horizon, Column):
        end = horizon
    elif horizon is None:
        end = flows.select(F.max(F.unix_micros("flow_end"))).scalar()
    else:
        end = F.unix_micros(F.lit(horizon).cast("timestamp"))
    ended = _is_fin(["tcp_flags"], True, "last_tcp_flags") if "last_tcp_flags" in flows.columns else F.lit(False)
    return flows.withColumn("end_reason", _reason(ended, F.unix_micros("flow_end"), end, idle))


def _reason(ended: Column, last_t: Column, horizon: Column, idle) -> Column:
    return (
        F.when(ended, F.lit(END_DETECTED))
        .when(horizon - last_t > micros(idle), F.lit(IDLE_TIMEOUT))
        .otherwise(F.lit(FORCED_END))
    )


def force_end(flows: DataFrame, idle=IDLE, horizon=None) -> DataFrame:
    """The flows still open at the end of input, which are flushed."""
    return end_reason(flows, idle, horizon).where(F.col("end_reason") == FORCED_END)


def _horizon(packets: DataFrame, horizon) -> Column:
    if horizon is None:
        return horizon_of(packets)
    if isinstance(horizon, Column):
        return horizon
    return F.unix_micros(F.lit(horizon).cast("timestamp"))


def build_flows(
    packets: DataFrame,
    idle=IDLE,
    active=None,
    biflow: bool = False,
    measures: list[str] | None = None,
    zero_final: bool = False,
    src_prefix: str | None = None,
    fin: bool = True,
    dns: bool = True,
    all_protocols: bool = False,
    horizon=None,
    emit_empty: bool = False,
    pair_timeout=None,
    consume: bool = False,
    chunk=CHUNK,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Flow records of a packet table.

    ``active`` adds an interim record per active period (end reason 2): totals grow
    over the flow, deltas are per record.  ``zero_final`` sets the deltas of the
    final record to 0.  ``emit_empty`` adds the interim records of empty periods.
    ``src_prefix`` limits retransmissions to sources with that prefix.
    ``pair_timeout`` adds round-trip times (two-way flows only).
    """
    from packetflow.operators import rtt

    keyed = flow_key(packets, biflow=biflow, dns=dns, all_protocols=all_protocols)
    split = split_flows(keyed, idle, fin, chunk, hot_rows)
    if src_prefix:
        split = split.withColumn("_repeat", F.col("_repeat") & F.col("src_ip").startswith(src_prefix))
    plain, packed = M.resolve(measures, packets.columns)
    identity = [*KEY, "flow_no"]
    group = identity
    if active is not None:
        split = slice_active(split, active)
        group = [*identity, "slice"]

    built = {name: M.MEASURES[name].build() for name in plain}
    bookkeeping = {
        "_start": "max(_t0)",
        "_orient": "max(IF(_opens, orient, NULL))",
        "_slice_first_t": "min(_t)",
        "_last_t": "max(_t)",
        "_last_fin": "max_by(_fin, _pos)",
    }
    kept = [F.expr(f"{rule} AS {name}") for name, rule in bookkeeping.items()]
    flows = split.groupBy(*group).agg(*kept, *[c.alias(n) for n, c in built.items()])

    if pair_timeout is not None:
        if not (biflow or all_protocols):
            raise ValueError("round-trip times need two-way flows")
        pairs = rtt.rtt_pairs(split, pair_timeout, consume=consume)
        if active is not None:
            pairs = slice_active(pairs, active)
        per_record = pairs.groupBy(*group).agg(*rtt.pair_sums())
        flows = flows.join(per_record, group, "left").fillna(0, rtt.PAIR_SUMS)

    if active is not None:
        flows = _interim_records(flows, plain, rtt.PAIR_SUMS if pair_timeout is not None else [], emit_empty)
    else:
        flows = flows.withColumns({"slice": F.lit(0), "_is_last": F.lit(True)})
    final = _reason(F.col("_last_fin"), F.col("_last_t"), _horizon(packets, horizon), idle)
    flows = flows.withColumn("end_reason", F.when(F.col("_is_last"), final).otherwise(F.lit(ACTIVE_TIMEOUT)))
    if zero_final:
        for name in ("packet_delta", "octet_delta", "octet_delta_sum_squares"):
            if name in plain:
                flows = flows.withColumn(name, F.when(F.col("_is_last"), F.lit(0)).otherwise(F.col(name)))
    if pair_timeout is not None:
        flows = rtt.mean_columns(flows)
    return _finish(flows, plain, packed, pair_timeout is not None)


def _interim_records(flows: DataFrame, plain: list[str], pair_sums: list[str], emit_empty: bool) -> DataFrame:
    """Combine the records of each flow; a group is one flow's active periods."""
    if emit_empty:
        flows = _with_empty_periods(flows, plain, pair_sums)
    by_slice = Window.partitionBy(*KEY, "flow_no").orderBy("slice")
    order = by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {
        "_is_last": F.lead("slice").over(by_slice).isNull(),
        "_orient": F.first("_orient", ignorenulls=True).over(order),
        "_last_t": F.max("_last_t").over(order),
    }
    for name in plain:
        combine = M.MEASURES[name].combine
        if name == "is_sampled":
            out[name] = F.max(name).over(order)
        elif combine == M.TOTAL:
            out[name] = F.sum(name).over(order)
        elif combine == M.FIRST:
            out[name] = F.first(name, ignorenulls=True).over(order)
        elif combine == M.LATEST:
            out[name] = F.last(name, ignorenulls=True).over(order)
    for name in pair_sums:
        out[name] = F.sum(name).over(order)
    return flows.withColumns(out)


def _with_empty_periods(flows: DataFrame, plain: list[str], pair_sums: list[str]) -> DataFrame:
    """Add a record per active period without packets.

    The gap inside a flow is at most the idle timeout, so each record adds at most
    idle / active rows.
    """
    order = Window.partitionBy(*KEY, "flow_no").orderBy("slice")
    previous = F.lag("slice").over(order)
    spread = flows.withColumn("_from", F.coalesce(previous + 1, F.col("slice")))
    spread = spread.withColumn("_at", F.explode(F.sequence("_from", "slice")))
    empty = F.col("_at") < F.col("slice")
    counted = [n for n in plain if M.MEASURES[n].combine in (M.TOTAL, M.DELTA) and not n.startswith(("last_", "_", "is_"))]
    blank = [n for n in plain if n not in counted]
    out = {name: F.when(empty, F.lit(0)).otherwise(F.col(name)) for name in [*counted, *pair_sums]}
    out.update({name: F.when(~empty, F.col(name)) for name in [*blank, "_slice_first_t", "_last_t", "_orient"]})
    out["_last_fin"] = F.col("_last_fin") & ~empty
    return spread.withColumns(out).withColumn("slice", F.col("_at")).drop("_from", "_at")


def _finish(flows: DataFrame, plain: list[str], packed: list[str], with_rtt: bool) -> DataFrame:
    """Oriented key, times and unpacked columns, in a fixed column order."""
    columns = [
        "ip_version",
        "protocol",
        "IF(_orient = 1, k_ip1, k_ip2) AS src_ip",
        "IF(_orient = 1, k_ip2, k_ip1) AS dst_ip",
        "IF(_orient = 1, k_port1, k_port2) AS src_port",
        "IF(_orient = 1, k_port2, k_port1) AS dst_port",
        "k_dns AS dns_id",
        "flow_no",
        "slice",
        "end_reason",
        "0 AS agg_level",
        "timestamp_micros(_start) AS flow_start",
        "timestamp_micros(_last_t) AS flow_end",
        "timestamp_micros(_slice_first_t) AS start_after_export",
    ]
    for name in plain:
        if not name.startswith("_"):
            default = M.MEASURES[name].default
            columns.append(f"`{name}`" if default is None else f"coalesce(`{name}`, {default!r}) AS `{name}`")
    columns += [f"{M.PACKED[name].rule} AS {name}" for name in packed]
    if with_rtt:
        columns += ["rtt_fwd", "rtt_bwd", "rtt_pairs"]
    columns.append("1L AS original_present")
    if "syn_count" in plain:
        columns.append("CAST(syn_count > 0 AS BIGINT) AS original_initiated")
    if "fin_count" in plain:
        columns.append("CAST(fin_count > 0 AS BIGINT) AS original_completed")
    for side in ("src", "dst"):
        columns.append(f"1L AS distinct_{side}")
        columns += [f"CAST(ip_version = {v} AS BIGINT) AS distinct_{side}_v{v}" for v in (4, 6)]
    return flows.selectExpr(*columns)


def start_after_export(split: DataFrame, active) -> DataFrame:
    """First packet time and id of every record of a flow."""
    sliced = slice_active(split, active)
    return sliced.groupBy(*KEY, "flow_no", "slice").agg(
        F.timestamp_micros(F.min("_t")).alias("start_after_export"),
        F.min_by("packet_id", "_pos").alias("first_packet"),
    )


def flow_speed_column() -> Column:
    """kB/s of a flow: octets * 10^6 / duration in ns; null without a duration."""
    nanos = (F.unix_micros("flow_end") - F.unix_micros("flow_start")) * 1000
    return F.when(nanos != 0, F.expr("octet_total * 1000000") / nanos)


def flow_speed(flows: DataFrame) -> DataFrame:
    return flows.withColumn("flow_speed", F.floor(flow_speed_column()))
