"""Mixing sources to target weights by capped water-filling.

A budget of words (``share`` times all words) is split over the sources by weight.  No source is taken more than
``epochs`` times: where its part would exceed that, the source is clamped and the excess goes to the others by weight,
until none is above.  That has a closed form: in the order of cap / weight the clamped sources come first, and one level
``words / weight`` serves all the others.

Within a source the target is met by whole repetitions of all its documents and a seeded sample for the rest: documents in
the order of a hash of their id are taken once more while they fit into the rest, then the one document whose size comes
nearest to what is left.  The cut in that order is found through sums over 4,096 hash ranges, so only the documents
of one range are ever sorted together; what remains per source is one row (repetitions, last hash key, extra key), and
each document decides on its own row.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, the last one;
documents with one and the same id share their fate; sources without words get target 0; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetflow.llm.tables import WORD, free_name, quoted, table
from packetflow.session import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Sources up to which the table of one row per source is broadcast; with more of them Spark chooses the join.
MOST_BROADCAST = 100_000


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(doc_id: str, seed: str) -> Column:
    """The place of a document in the seeded order."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), F.lit(":"), name)


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with a column ``target``; one row per source, ordered in one place."""
    everywhere = Window.partitionBy(F.lit(0))
    by_ratio = everywhere.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = sources.withColumn("_cap", F.col("source_size") * F.lit(float(epochs))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    rows = rows.withColumn("_budget", F.sum("source_size").over(everywhere) * F.lit(float(share)))
    rows = rows.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # The first source that can hold its part sets the level; where none can, all are clamped.
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("source").isNull(), "source", "_level"))).over(everywhere)["_level"]
    return rows.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap")))).select(*sources.columns, "target")


def weigh(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: its words, and the weights in turn by code point, null last."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))))
    return sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, last key of the sample, extra key.

    ``sizes`` has source, key and size of every document; rows of one key count together.
    """
    rest = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    rest = rest.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    ranged = sizes.withColumn("range", F.substring("key", 1, 3))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("n").over(upto))
    joined = sums.join(small(rest.select("source", "rest").withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    # The first range that does not fit whole is cut document by document.
    cut = joined.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("range", F.col("upto") - F.col("n"))).alias("x"), F.first("rest").alias("rest"))
    cut = small(cut.select(F.col("source").alias("_source"), F.col("x.range").alias("_range"), F.col("x.col2").alias("_before"), "rest"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    inside = sizes.withColumn("range", F.substring("key", 1, 3)).join(cut, same & (F.col("range") == F.col("_range")))
    inside = inside.withColumn("upto", F.col("_before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")))
    fits = inside.where(F.col("upto") <= F.col("rest")).groupBy("source").agg(F.max("key").alias("last"), F.max("upto").alias("filled"))
    edge = cut.join(fits.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        "_source", F.coalesce("last", "_range").alias("last"), (F.col("rest") - F.coalesce("filled", "_before")).alias("left")
    )
    edge = small(settle(edge, "mix"))
    off = F.abs(F.col("size") - F.col("left"))
    beyond = sizes.groupBy("source", "key").agg(F.sum("size").alias("size")).join(edge, same).where((F.col("key") > F.col("last")) & (off < F.col("left")))
    extra = beyond.groupBy("source").agg(F.min(F.struct(off.alias("off"), "key"))["key"].alias("extra")).withColumnRenamed("source", "_e")
    out = rest.join(edge.select(F.col("_source"), "last"), same, "left").drop("_source")
    return out.join(extra, F.col("source").eqNullSafe(F.col("_e")), "left").select("source", "source_size", "target", "whole", "last", "extra")


def small(sources: DataFrame) -> DataFrame:
    """Marked for broadcast where it is known to be small: one row per source."""
    return F.broadcast(sources) if sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else sources


def with_repeats(rows: DataFrame, per_source: DataFrame, source: str, key: Column, name: str) -> DataFrame:
    """``rows`` with how often each document is taken (column ``name``) and the planned columns of its source in ``_plan``."""
    held = small(per_source.select(F.struct("*").alias("_plan")))
    joined = rows.join(held, F.col(source).eqNullSafe(F.col("_plan.source")), "left")
    once_more = F.coalesce((key <= F.col("_plan.last")) | (key == F.col("_plan.extra")), F.lit(False))
    # Without a cut the rest holds no further document (the target is a whole number of repetitions).
    return joined.withColumn(name, F.coalesce(F.col("_plan.whole"), F.lit(0)) + once_more.cast("long"))


def fit(docs: DataFrame, seed: str = SEED, share: float = SHARE, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(sizes: doc_id, source, key, size of every document; plan: one row per source), both written to the shared folder."""
    sizes = settle(docs.select("doc_id", "source", hash_key("doc_id", seed).alias("key"), size_of("text").alias("size")), "sizes")
    targets = settle(water_fill(weigh(sizes, weights), share, epochs), "targets")
    return sizes, settle(plan(sizes, targets), "mix")


def mix(docs: DataFrame, seed: str = SEED, share: float = SHARE, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed documents: every document as many times as the mix takes it.  The texts are not shuffled."""
    _, per_source = fit(docs, seed, share, epochs, weights)
    own = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_doc")).withColumn("source", F.col("_doc.source")).withColumn("doc_id", F.col("_doc.doc_id"))
    taken = with_repeats(own, per_source, "source", hash_key("doc_id", seed), "_times").where("_times > 0")
    repeated = taken.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_nth"))
    return repeated.select("_doc.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, per_source = fit(table(spark, sf_dir, "documents"))
    return with_repeats(sizes, per_source, "source", F.col("key"), "times").select(
        "doc_id", "size", F.col("_plan.source_size").alias("source_size"), F.col("_plan.target").alias("target"), (F.col("size") * F.col("times")).alias("taken")
    )


#: The same result in DuckDB's SQL.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) || ':' || coalesce(doc_id::VARCHAR, '') AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, list_value{WEIGHTS}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM d GROUP BY source
), r AS (
  SELECT *, source_size * {float(EPOCHS)}::DOUBLE AS cap, source_size * {float(EPOCHS)}::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * {SHARE}::DOUBLE AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight, cap)) AS target FROM l
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
), f AS (
  SELECT source, max(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS gap FROM c GROUP BY source
), x AS (
  SELECT source, arg_min(key, (off, key)) AS extra
  FROM (SELECT source, key, gap, abs(n - gap) AS off FROM (
    SELECT c.source, key, gap, sum(size) AS n FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source WHERE upto > rest GROUP BY c.source, key, gap)) WHERE off < gap GROUP BY source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto <= rest OR coalesce(key = extra, FALSE) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN x ON c.source IS NOT DISTINCT FROM x.source
"""
