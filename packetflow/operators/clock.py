"""Clock synchronisation: offsets, rolling drift lines, corrected times, one-way delay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetflow.functions.scalars import micros
from packetflow.operators.ordering import CHUNK, HOT_ROWS, carry_forward, cut_into_chunks, global_rank, lookup
from packetflow.session import settle

# Fixed value: samples a drift line is fitted to.
FIT_ROWS = 60

#: Samples per block of the rolling fit.
BLOCK = 4096

#: Pieces of drift lines up to which they are broadcast (about 100 bytes each).
MOST_LINES = 500_000


def clock_offset(sync: DataFrame) -> DataFrame:
    """Path delay and clock drift of each exchange (ns): sent t1, server t2, received t3."""
    delay = F.expr("(t3 - t1) div 2")
    return sync.withColumn("delay", delay).withColumn("drift", F.col("t3") - F.col("t2") - F.col("delay"))


def drift_fit(sync: DataFrame, rows: int = FIT_ROWS, chunk=CHUNK) -> DataFrame:
    """Least-squares line of drift over time on the newest ``rows`` samples, after every sample.

    Times and drifts count from the observation point's first sample (``x0``, ``y0``).
    Samples are cut into blocks by rank; a block also gets the last ``rows - 1``
    samples before it, so a busy observation point is fitted in many tasks.
    """
    if rows < 2:
        raise ValueError("a line needs at least two samples")
    offsets = clock_offset(sync) if "drift" not in sync.columns else sync
    origin = offsets.groupBy("obs_point").agg(F.min_by(F.struct("t3", "drift"), F.struct("t3", "seq")).alias("_origin"))
    timed = offsets.withColumn("_t", F.expr("t3 div 1000"))
    ranked = global_rank(timed, ["obs_point"], "_rank", tie=["t3", "seq"], chunk=chunk)
    size = max(BLOCK, 4 * rows)
    blocks = ranked.withColumn("_block", F.expr(f"(_rank - 1) div {size}"))
    late = F.pmod(F.col("_rank") - 1, F.lit(size)) >= size - (rows - 1)
    spread = blocks.withColumn(
        "_in", F.explode(F.when(late, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block")))
    )
    based = lookup(spread, origin, ["obs_point"], F.col("seq"), how="inner")
    based = based.withColumns({"x0": F.col("_origin.t3"), "y0": F.col("_origin.drift")})
    x = (F.col("t3") - F.col("x0")).cast("double")
    y = (F.col("drift") - F.col("y0")).cast("double")
    newest = Window.partitionBy("obs_point", "_in").orderBy("_rank").rowsBetween(-(rows - 1), 0)
    fitted = based.withColumns({"_x": x, "_y": y}).withColumns(
        {
            "slope": F.regr_slope("_y", "_x").over(newest),
            "intercept": F.regr_intercept("_y", "_x").over(newest),
            "samples": F.count(F.lit(1)).over(newest),
        }
    )
    return fitted.where(F.col("_in") == F.col("_block")).select(
        "obs_point", "seq", "t3", "delay", "drift", "x0", "y0", "slope", "intercept", "samples"
    )


def clock_as_of(packets: DataFrame, fits: DataFrame, chunk=CHUNK, most_lines: int = MOST_LINES) -> DataFrame:
    """Add to each packet the drift line in force at its time (``clock`` is null before the first).

    Lines are few beside packets.  They become intervals cut at time buckets of about one line each, and packets look
    theirs up by (observation point, bucket): packets stay where they are while the pieces are at most
    ``most_lines``.  Beyond that, packets and lines are ordered together in time chunks; both give the same result.
    """
    line = F.struct("slope", "intercept", "x0", "y0")
    known = fits.where("slope IS NOT NULL").select("obs_point", F.expr("(t3 + 999) div 1000").alias("_t"), F.col("seq").alias("_order"), line.alias("_line"))
    lines = settle(known, "drift-lines")  # few rows from a long plan, used several times
    points, number, span = lines.groupBy("obs_point").agg(F.count(F.lit(1)).alias("n"), (F.max("_t") - F.min("_t")).alias("span")).agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("span")
    ).first()
    # Buckets of the mean length of an interval: an interval is cut into two pieces on average.
    if 2 * (number or 0) + points > most_lines:
        return _clock_in_order(packets, lines, chunk)
    width = max(1, (span or 0) // max(1, number or 1))
    newest = lines.groupBy(F.col("obs_point").alias("_point"), F.col("_t").alias("_from")).agg(F.max_by("_line", "_order").alias("_line"))
    until = F.lead("_from").over(Window.partitionBy("_point").orderBy("_from"))
    ranges = newest.withColumn("_until", until)
    pieces = ranges.where("_until IS NOT NULL").withColumn("_bucket", F.explode(F.expr(f"sequence(_from div {width}, (_until - 1) div {width})")))
    last = ranges.where("_until IS NULL").select(F.col("_point").alias("_last_point"), F.col("_from").alias("_last_from"), F.col("_line").alias("_last"))
    t = F.unix_micros("ts")
    inside = (F.col("obs_point") == F.col("_point")) & (F.col("_at") == F.col("_bucket")) & (F.col("_us") >= F.col("_from")) & (F.col("_us") < F.col("_until"))
    timed = packets.withColumn("_us", t).withColumn("_at", F.expr(f"_us div {width}"))
    found = timed.join(F.broadcast(pieces), inside, "left").join(F.broadcast(last), F.col("obs_point") == F.col("_last_point"), "left")
    clock = F.coalesce("_line", F.when(F.col("_us") >= F.col("_last_from"), F.col("_last")))
    return found.select(*packets.columns, clock.alias("clock"))


def _clock_in_order(packets: DataFrame, lines: DataFrame, chunk) -> DataFrame:
    rows = packets.withColumns({"_t": F.unix_micros("ts"), "_kind": F.lit(1), "_order": F.col("packet_id")})
    both = rows.unionByName(lines.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    found = carry_forward(both, ["obs_point"], F.col("_line"), "clock", tie=["_kind", "_order"], chunk=chunk)
    return found.where("_kind = 1").drop("_t", "_kind", "_order", "_line")


def correct_time(packets: DataFrame) -> DataFrame:
    """Corrected nanoseconds and time of packets that carry a ``clock`` line; unchanged without one."""
    nanos = F.unix_micros("ts") * 1000
    since = (nanos - F.col("clock.x0")).cast("double")
    drift = (F.col("clock.slope") * since).cast("bigint") + F.col("clock.y0") + F.col("clock.intercept").cast("bigint")
    corrected = nanos - F.coalesce(drift, F.lit(0).cast("bigint"))
    return packets.withColumn("corrected_ns", corrected).withColumn(
        "corrected_ts", F.timestamp_micros(F.expr("corrected_ns div 1000"))
    )


def time_precision(df: DataFrame, column: str = "ts") -> DataFrame:
    """One instant in seconds, milliseconds, microseconds and nanoseconds."""
    return df.withColumns(
        {
            "seconds": F.unix_seconds(column),
            "millis": F.unix_millis(column),
            "micros": F.unix_micros(column),
            "nanos": F.unix_micros(column) * 1000,
        }
    )


def one_way_delay(
    packets: DataFrame, point_a: int, point_b: int, limit, chunk=CHUNK, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Delay from point a to point b by packet digest.

    A packet at b is measured against the newest packet with its digest at a, at
    most ``limit`` before: one row per packet at b even when many packets share a digest.
    """
    rows = packets.where(F.col("obs_point").isin(point_a, point_b)).select(
        "packet_digest", "packet_id", "obs_point", F.unix_micros("ts").alias("_t")
    )
    at_a = F.when(F.col("obs_point") == point_a, F.struct(F.col("_t").alias("t"), F.col("packet_id").alias("id")))
    # At one instant the packet at a comes first.
    rows = rows.withColumn("_side", (F.col("obs_point") == point_b).cast("int"))
    cut = cut_into_chunks(rows, ["packet_digest"], chunk=chunk, rows=hot_rows)
    found = carry_forward(
        rows if cut is None else cut, ["packet_digest"], at_a, "_sent", tie=["_side", "packet_id"], chunk=None,
        cut=None if cut is None else "_chunk",
    )
    delay = F.col("_t") - F.col("_sent.t")
    return found.where((F.col("obs_point") == point_b) & (delay <= micros(limit))).select(
        "packet_digest",
        F.col("_sent.id").alias("packet_id_a"),
        F.col("packet_id").alias("packet_id_b"),
        delay.alias("delay_us"),
    )
