"""Order-dependent helpers that never put one key's whole history into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts a key in one task, and one
key may hold a third of all packets.  Here hot keys are cut into time chunks: the
work is done inside ``(key, chunk)``, and a summary of one row per chunk is passed
along the key.  A task then holds at most the packets of one key in one chunk, or
one row per chunk of a key.  Keys that are not hot stay in one piece, which costs
one shuffle and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetflow.functions.scalars import micros
from packetflow.session import settle

#: Default width of a time chunk.
CHUNK = "1 minute"


def time_chunk(t: str, chunk) -> Column:
    """Chunk number of a microsecond column."""
    return F.expr(f"`{t}` div {micros(chunk)}")


def _names(tie: str | list[str]) -> list[str]:
    return [tie] if isinstance(tie, str) else list(tie)


#: Rows from which a group counts as hot.
HOT_ROWS = 1_000_000
#: Hot groups (or bursts) up to which they are broadcast; more of them are a written table, joined with salt.
MOST_BROADCAST_GROUPS = 20_000
#: Rows a hot group is expected to have in the sample it is found in.
SAMPLED_ROWS = 1_000
#: Most parts a burst chunk is cut into.
MOST_PARTS = 1_000_000


def _largest(sample: DataFrame, by: list[str], limit: float) -> tuple[DataFrame, bool] | None:
    """Groups with at least ``limit`` sampled rows and their number, and whether they are few; None if there are none.

    Few of them are a local table; more are written, so they need not be found again.
    """
    counted = sample.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    largest = counted.where(F.col("_n") >= limit)
    found = largest.limit(MOST_BROADCAST_GROUPS + 1).collect()
    if len(found) > MOST_BROADCAST_GROUPS:
        return settle(largest, "hot"), False
    return (sample.sparkSession.createDataFrame(found, largest.schema), True) if found else None


def _add(rows: DataFrame, groups: tuple[DataFrame, bool], on: list[str], salt: str) -> DataFrame:
    """Left join with the groups of ``_largest``."""
    table, few = groups
    if few:
        return rows.join(F.broadcast(table), on, "left")
    return salted_lookup(rows, table, on, F.col(salt), how="left")


def cut_into_chunks(
    df: DataFrame, by: list[str], t: str = "_t", chunk=CHUNK, rows: int = HOT_ROWS, always: bool = False
) -> DataFrame | None:
    """Add ``_chunk``: the time chunk of rows of hot groups, -1 for groups left in one piece; None if none is hot.

    Hot groups have about ``rows`` rows or more (with ``always``, every group is cut).  A
    chunk that itself has that many, a burst, is cut into as many parts as it needs.
    Small jobs over a sample of the grouping columns find both.  What they find only
    decides how the work is cut, never a result: a group they miss is done in one piece.
    """
    fraction = min(1.0, SAMPLED_ROWS / rows)
    limit = rows * fraction
    width = micros(chunk)
    timed = df.withColumn("_at", time_chunk(t, chunk))
    sample = timed.select(*by, "_at")
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=1)
    is_hot = F.lit(True)
    if not always:
        hot = _largest(sample, by, limit)
        if hot is None:
            return None
        hot = (hot[0].select(*by, F.lit(True).alias("_hot")), hot[1])
        sample = _add(sample, hot, by, "_at").where("_hot").drop("_hot")
        timed = _add(timed, hot, by, t)
        is_hot = F.coalesce("_hot", F.lit(False))
    bursts = _largest(sample, [*by, "_at"], limit)
    part = "0"
    if bursts is not None:
        parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("_n") / F.lit(limit)) + 1)
        bursts = (bursts[0].select(*by, "_at", parts.cast("bigint").alias("_parts")), bursts[1])
        timed = _add(timed, bursts, [*by, "_at"], t)
        part = f"((`{t}` - _at * {width}) * coalesce(_parts, 1L)) div {width}"
    number = F.expr(f"_at * {MOST_PARTS} + {part}")
    return timed.select(*df.columns, F.when(is_hot, number).otherwise(F.lit(-1)).cast("bigint").alias("_chunk"))


def global_rank(
    df: DataFrame, by: list[str], name: str = "rank", t: str = "_t", tie: str | list[str] = "packet_id", chunk=CHUNK,
    rows: int = HOT_ROWS,
) -> DataFrame:
    """Running number from 1 in ``(t, tie)`` order within ``by`` (the whole table when ``by`` is empty)."""
    cut = cut_into_chunks(df, by, t, chunk, rows, always=True)
    groups = [*by, "_chunk"]
    counts = cut.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rank_n"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*groups, (F.sum("_rank_n").over(before) - F.col("_rank_n")).alias("_rank_before"))
    local = Window.partitionBy(*groups).orderBy(t, *_names(tie))
    return (
        cut.withColumn("_rank_local", F.row_number().over(local))
        .join(offsets, groups)
        .withColumn(name, F.col("_rank_before") + F.col("_rank_local"))
        .select(*df.columns, name)
    )


def carry_forward(
    df: DataFrame,
    by: list[str],
    value: Column,
    name: str,
    t: str = "_t",
    tie: str | list[str] = "packet_id",
    chunk=CHUNK,
    cut: str | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """As-of look-up: the newest non-null ``value`` before each row (or up to it) within ``by``.

    Every group is cut into chunks of width ``chunk``; with ``chunk=None`` none is; with a
    chunk column ``cut`` those where it is not -1 are.  The per-chunk summary is
    combined on the map side, so a hot key costs one row per chunk before anything
    is shuffled.
    """
    end = Window.currentRow if inclusive else -1
    rows = df.withColumn("_cf_value", value)
    if chunk is None and cut is None:
        whole = Window.partitionBy(*by).orderBy(t, *_names(tie)).rowsBetween(Window.unboundedPreceding, end)
        return rows.withColumn(name, F.last("_cf_value", ignorenulls=True).over(whole)).drop("_cf_value")
    if cut is None:
        rows = cut_into_chunks(rows, by, t, chunk, always=True).withColumnRenamed("_chunk", "_cf_chunk")
    else:
        rows = rows.withColumn("_cf_chunk", F.col(cut))
    groups = [*by, "_cf_chunk"]
    position = F.struct(t, *_names(tie))
    pieces = rows.where(F.col("_cf_chunk") != -1)
    # All chunks are counted by hash; only rows that define a value are looked at for the newest one.
    present = pieces.groupBy(*groups).agg(F.count(F.lit(1)).alias("_cf_rows"))
    newest = pieces.where(F.col("_cf_value").isNotNull()).groupBy(*groups).agg(F.max_by("_cf_value", position).alias("_cf_newest"))
    newest = present.join(newest, groups, "left")
    earlier = Window.partitionBy(*by).orderBy("_cf_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*groups, F.last("_cf_newest", ignorenulls=True).over(earlier).alias("_cf_carried"))
    local = Window.partitionBy(*groups).orderBy(t, *_names(tie)).rowsBetween(Window.unboundedPreceding, end)
    return (
        rows.withColumn("_cf_local", F.last("_cf_value", ignorenulls=True).over(local))
        .join(carried, groups, "left")
        .withColumn(name, F.coalesce("_cf_local", "_cf_carried"))
        .select(*df.columns, name)
    )


def running_total(df: DataFrame, position: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Running sum over a dense ``bigint`` position, in two levels of blocks."""
    rows = df.withColumn("_block", F.expr(f"`{position}` div {block}"))
    totals = rows.groupBy("_block").agg(F.sum(value).alias("_block_sum"))
    # One row per block of positions: small enough to be ordered in one place.
    before = totals.select(
        "_block",
        (F.sum("_block_sum").over(Window.partitionBy(F.lit(0)).orderBy("_block")) - F.col("_block_sum")).alias("_before"),
    )
    inside = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_inside", F.sum(value).over(inside))
        .join(before, "_block")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_inside", "_before")
    )


def salted_lookup(left: DataFrame, right: DataFrame, on: list[str], salt: Column, salts: int = 16, how: str = "inner") -> DataFrame:
    """Many-to-one join whose hot keys are spread over ``salts`` tasks.

    ``right`` has one row per key; it is copied ``salts`` times, ``left`` rows pick
    one copy by hash of ``salt``.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    added = [c for c in right.columns if c not in on]
    return spread.join(copies, [*on, "_salt"], how).select(*left.columns, *added)


#: Rows up to which a settings-like table is broadcast.
SMALL_ROWS = 100_000


def lookup(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "left", most: int = SMALL_ROWS) -> DataFrame:
    """Many-to-one join with a table that is expected to be small.

    ``right`` is counted (up to ``most`` + 1 rows): small enough, it is broadcast;
    else the join is salted, so a hot key never meets in one task.
    """
    if right.limit(most + 1).count() <= most:
        added = [c for c in right.columns if c not in on]
        return left.join(F.broadcast(right), on, how).select(*left.columns, *added)
    return salted_lookup(left, right, on, salt, how=how)
