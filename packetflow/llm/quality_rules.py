"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document when a share (symbols, repeated lines, ...) lies above a cutoff.  Cutoffs come from
labelled documents: within a stratum (a language), a cutoff is certified when the exact binomial tail shows that at
most ``limit`` of the good documents lie above it.  The tests of all strata and rules share ``alpha`` (Bonferroni);
along the fixed grid of one rule the tests go from the most lenient cutoff down and stop at the first failure, which
needs no further correction.  ``max_false_rejection`` is split over the rules, so a stratum loses at most that share of
good documents to all of them together, with probability ``1 - alpha``.

All of it is DataFrame expressions: a document is one row from start to end, and texts are never shuffled; only the
numbers of labelled documents are, and counts.

Defined cases: a null or empty text has no words and fails the base rules; a null stratum is one of its own; several
labels of a document count as its worst one, labels that are null or of unknown documents do not count; without enough
labels no cutoff is certified and only the base rules decide; repeated rows are judged alike, each on its own; an empty
table stays empty.  Columns of the input are kept, even where they have the names of the measures (those are in one
struct column of a free name).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetflow.llm.tables import GAP, WORD, free_name, table
from packetflow.session import settle

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_FALSE_REJECTION = 0.01
ALPHA = 0.05
#: Cutoffs tried for every share: 0.02, 0.04, ... 0.98.
STEPS = 49
#: Strata whose cutoffs may be broadcast; with more of them Spark chooses the join.
MOST_BROADCAST = 10_000

#: The measured shares: name, numerator, denominator (columns of the measures).
SHARES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "upper": ("n_upper", "word_chars"),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with one struct column ``measures`` (a longer name if taken): MEASURES as longs."""
    names = {n: free_name(docs, f"_{n}") for n in ["whole", "words", "kept_lines", "grams", "sorted_grams", "repeats"]}
    whole, words, lines, grams, sorted_grams, repeats = names.values()
    out = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(words, F.filter(F.split(whole, GAP), lambda w: w != ""))
    # Lines with a word in them: white space alone does not make one.
    out = out.withColumn(lines, F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)))
    # A three-word window is held as its 64-bit hash: within one document two of them do not collide in practice.
    window = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    out = out.withColumn(grams, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), window))
    # Sorting puts equal windows side by side: n log n per document, without a row per word, and only where any repeat.
    none = F.array().cast("array<struct<gram:bigint,at:int>>")
    placed = F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at")))
    out = out.withColumn(sorted_grams, F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(placed)).otherwise(none))
    equal = lambda g, j: F.coalesce(F.get(sorted_grams, j)["gram"] == g["gram"], F.lit(False))
    out = out.withColumn(
        repeats,
        F.sort_array(F.transform(F.filter(sorted_grams, lambda g, i: equal(g, i - 1) | equal(g, i + 1)), lambda g: g["at"])),
    )
    covered = F.aggregate(
        F.transform(repeats, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(repeats, j + 1) - at, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    left_of = lambda pattern: F.length(F.regexp_replace(whole, pattern, ""))
    measures = F.struct(
        F.size(words).cast("long").alias("n_words"),
        left_of(GAP).cast("long").alias("word_chars"),
        left_of(f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        left_of("[^A-Z]+").cast("long").alias("n_upper"),
    )
    # As the one element of an array: else every use of a measure downstream would repeat the work that makes it.
    return out.select(*docs.columns, F.explode(F.array(measures)).alias(free_name(docs, "measures")))


def base_failed(measures: str) -> Column:
    """Fewer than MIN_WORDS words, or more than half of them in repeated three-word windows."""
    m = F.col(measures)
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def share(measures: str, name: str) -> Column:
    top, bottom = SHARES[name]
    m = F.col(measures)
    return F.when(m[bottom] > 0, m[top] / m[bottom]).otherwise(F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), exact to rounding; 1 where k lies above the mean (no evidence then).

    The largest term, pmf(k), is built from logarithms; the ratios of the terms below it are added up from there.
    """
    odds = p / (1 - p)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    log_pmf = F.aggregate(steps, n * F.lit(math.log1p(-p)), lambda acc, i: acc + F.log((n - k + i) / i) + F.lit(math.log(odds)))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, i):
        j = k - i + 1
        term = acc["term"] * j / ((n - j + 1) * F.lit(odds))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    ratios = F.aggregate(steps, zero, step)["total"]
    return F.when(k > n * F.lit(p), F.lit(1.0)).otherwise(F.exp(log_pmf) * ratios)


def certify(
    measured: DataFrame,
    labels: DataFrame,
    measures: str = "measures",
    stratum: str = "lang",
    key: str = "doc_id",
    max_false_rejection: float = MAX_FALSE_REJECTION,
    alpha: float = ALPHA,
) -> DataFrame:
    """One row per stratum: ``stratum``, ``n_good`` and, for every rule, the certified ``cutoff_<rule>`` (null: none).

    Good documents are those with label ``quality`` 1 that pass the base rules.  Counts per stratum and cutoff are
    one aggregate with fixed-width buffers, combined before the shuffle.
    """
    worst = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").alias("_quality"))
    cuts = F.array(*[F.lit(i * 2 / 100) for i in range(1, STEPS + 1)])
    # The level of a share is the number of cutoffs below it.
    level = lambda rule: F.size(F.filter(cuts, lambda c: share(measures, rule) > c))
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in SHARES])
    rows = measured.where(~base_failed(measures)).select(F.col(key).alias("_key"), F.col(stratum).cast("string").alias("_stratum"), levels.alias("_levels"))
    good = rows.join(worst.where("_quality = 1"), F.col("_key") == F.col("_label_id")).select("_stratum", F.explode("_levels").alias("x"))
    counts = good.groupBy("_stratum", "x.rule", "x.level").agg(F.count(F.lit(1)).alias("n"))
    # From here on there are at most STEPS + 1 rows of counts per stratum and rule.
    held = counts.groupBy("_stratum", "rule").agg(F.collect_list(F.struct("level", "n")).alias("held"), F.sum("n").alias("n_good"))
    everywhere = Window.partitionBy(F.lit(0))  # over one row per stratum and rule
    tried = held.withColumn("strata", F.size(F.collect_set(F.coalesce("_stratum", F.lit(""))).over(everywhere)))
    tried = tried.select("*", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("i"))
    above = F.aggregate("held", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["level"] >= F.col("i"), x["n"]).otherwise(0))
    tail = binomial_tail(F.col("k"), F.col("n_good"), max_false_rejection / len(SHARES))
    # More documents lie above a lower cutoff, so the certified ones are a run from the most lenient down.
    passed = tried.withColumn("k", above).withColumn("cut", F.when(tail <= F.lit(alpha) / (F.col("strata") * len(SHARES)), F.col("i") * 2 / 100))
    return passed.groupBy(F.col("_stratum").alias("stratum")).agg(
        F.max("n_good").alias("n_good"), *[F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cutoff_{r}") for r in SHARES]
    )


def judge(measured: DataFrame, cutoffs: DataFrame, measures: str = "measures", stratum: str = "lang", name: str = "kept") -> DataFrame:
    """The measured rows with a boolean column ``name``: passes the base rules and every certified cutoff of its stratum."""
    own = {c: free_name(measured, f"_rule_{c}") for c in cutoffs.columns}
    limits = cutoffs.select(*[F.col(c).alias(own[c]) for c in cutoffs.columns])
    if cutoffs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    joined = measured.join(limits, F.col(stratum).cast("string").eqNullSafe(F.col(own["stratum"])), "left")
    rejected = base_failed(measures)
    for rule in SHARES:
        rejected = rejected | F.coalesce(share(measures, rule) > F.col(own[f"cutoff_{rule}"]), F.lit(False))
    return joined.withColumn(name, ~rejected).select(*measured.columns, name)


def fit(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Certified cutoffs of a table of documents, written once.

    All documents are measured where they are and only their numbers meet the labels: picking the labelled ones first
    would shuffle texts.
    """
    measured = settle(measure(docs.select("doc_id", "lang", "text")).drop("text"), "measures")
    return settle(certify(measured, labels, **settings), "rules")


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that pass: one narrow pass over the texts after the cutoffs are fitted."""
    measured = measure(docs)
    measures = measured.columns[-1]
    kept = free_name(measured, "kept")
    return judge(measured, fit(docs, labels, **settings), measures, name=kept).where(kept).select(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # The measures are a few numbers per document: written once, they serve the cutoffs and the verdicts.
    measured = settle(measure(docs.select("doc_id", "lang", "text")).drop("text"), "measures")
    cutoffs = settle(certify(measured, labels), "rules")
    m = F.col("measures")
    return judge(measured, cutoffs).select(
        "doc_id",
        *[m[c].alias(c) for c in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]],
        base_failed("measures").alias("base_failed"),
        "kept",
    )


_CUTS = [i * 2 / 100 for i in range(1, STEPS + 1)]

#: The same result in DuckDB's SQL.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{GAP}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM documents
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2))
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r
), m AS (
  SELECT d.r, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{GAP}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper
  FROM d LEFT JOIN covered USING (r)
), s AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {", ".join(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS s_{n}" for n, (a, b) in SHARES.items())}
  FROM m
), good AS (
  SELECT s.* FROM s JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed
), strata AS (SELECT greatest(count(DISTINCT coalesce(lang, '')), 1) AS n FROM good
), k AS (
  SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (share > cut) AS k
  FROM (SELECT lang, unnest([{", ".join(f"'{n}'" for n in SHARES)}]) AS rule, unnest([{", ".join(f"s_{n}" for n in SHARES)}]) AS share FROM good),
       (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in _CUTS)}]) AS cut)
  GROUP BY ALL
), tail AS (
  SELECT lang, rule, cut,
         CASE WHEN k > n * {MAX_FALSE_REJECTION / len(SHARES)!r}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
              + i * ln({MAX_FALSE_REJECTION / len(SHARES)!r}::DOUBLE) + (n - i) * ln(1 - {MAX_FALSE_REJECTION / len(SHARES)!r}::DOUBLE)))) END AS p
  FROM k
), cuts AS (
  SELECT lang, rule, min(cut) AS cut FROM tail, strata WHERE p <= {ALPHA}::DOUBLE / (strata.n * {len(SHARES)}) GROUP BY ALL
), bad AS (
  SELECT DISTINCT r FROM (SELECT r, lang, unnest([{", ".join(f"'{n}'" for n in SHARES)}]) AS rule, unnest([{", ".join(f"s_{n}" for n in SHARES)}]) AS share FROM s) x
  JOIN cuts ON x.lang IS NOT DISTINCT FROM cuts.lang AND x.rule = cuts.rule WHERE share > cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept
FROM s
"""
