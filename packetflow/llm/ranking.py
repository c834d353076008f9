"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document of label 1 before one of label 0) are drawn with a seed from all labelled documents (``fit_all``) or from a bounded
sample of them (``fit``); the score of a document is linear in its features, and the weights minimise the logistic loss on feature
differences, with an L2 term (Newton's method: the loss is convex).  The threshold is a quantile of their scores: the
share of label 0 among them.  Scores are then carried to 0..1 by a logistic curve that puts that quantile at CUT.

Features are read in one walk over the whole text: shares of character classes, repetition, lengths, and how often words of
each hashed shape occur.  A shape keeps the pattern of cases, digits, symbols and of letters beyond ASCII, not the
letters.  Scoring is a map; sums over the labelled documents, or the features of the sample (MOST_LABELLED rows at most), come to the driver.

Defined cases: a null or empty text has the features of zero words and a score like any other; labels of one
document count as its lowest, null labels and labels of unknown documents do not count; without both labels in the sample every score is
0.5; repeated documents get one and the same score; an empty table stays empty; other columns stay as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetflow.llm.tables import as_texts, free_name, remainder, table
from packetflow.session import settle

#: Labelled rows a model is fitted on at most; which ones is decided by a hash of their id.
MOST_LABELLED = 8_000
PAIRS_PER_DOCUMENT = 8
#: Labelled documents that draw their partners from each other, and how many of either label a group has at least (about).
IN_GROUP, LEAST = 20_000, 200
#: Scores that are sorted at once to find the quantile.
MOST_SORTED = 100_000
RIDGE = 1e-3
SEED = 11
#: The value of a score at the quantile that separates kept from rejected documents.
CUT = 0.7
SHAPES = 64
#: Characters of the longest word that is kept in the table of shapes; longer ones are worked out each time.
LONGEST_HELD = 200
DENSE = 16

_SHAPE_OF = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})
_RUNS = re.compile(r"(.)\1+")


class ShapeBuckets(dict):
    """word -> bucket of its shape; forgets everything when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        shape = _RUNS.sub(r"\1", re.sub(r"[^\x00-\x7f]+", "u", word.translate(_SHAPE_OF)))
        bucket = zlib.crc32(shape.encode()) % SHAPES
        if len(word) <= LONGEST_HELD:
            self[word] = bucket
        return bucket


def features(text: str, buckets: dict[str, int]) -> np.ndarray:
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    letters = max(int(kinds[65:91].sum() + kinds[97:123].sum()), 1)
    symbols = sum(int(kinds[ord(c)]) for c in "#$%&*|<>{}[]~^@\\_=+")
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    windows = list(zip(words, words[1:], words[2:]))
    out = np.zeros(DENSE + SHAPES, np.float32)
    out[:DENSE] = (
        np.log1p(len(words)), chars / n / 10, kinds[65:91].sum() / letters, symbols / chars * 10, kinds[33] / chars * 10, kinds[48:58].sum() / chars * 10,
        (kinds[44] + kinds[46]) / n, len(counts) / n, counts.most_common(1)[0][1] / n if counts else 0.0, repeats / n, len(set(windows)) / max(len(windows), 1),
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)) / 4, n / max(len(lines), 1) / 100, kinds[128:].sum() / chars, float(len(words) < 20),
    )
    out[DENSE:] = np.sqrt(np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=SHAPES) / n)
    return out


@F.arrow_udf(T.ArrayType(T.FloatType()))
def features_of(texts: pa.Array) -> pa.Array:
    buckets = ShapeBuckets()
    return pa.array([features(t, buckets) for t in as_texts(texts)], pa.list_(pa.float32()))


@dataclass(frozen=True)
class Model:
    """Linear scores over standardised features, carried to 0..1 around the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (np.clip((x - self.mean) / self.scale, -8, 8)) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bradley_terry(differences: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights w that minimise mean log(1 + exp(-d.w)) + ridge/2 |w|^2 over the rows d."""
    w = np.zeros(differences.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        gradient = -differences.T @ p / len(differences) + ridge * w
        curve = (differences * (p * (1 - p))[:, None]).T @ differences / len(differences) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_arrays(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Model:
    """The model of labelled feature rows; without both labels all scores are 0.5."""
    width = DENSE + SHAPES
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(CUT / (1 - CUT))), 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    # Every document of the rarer label, and as many of the other, meets PAIRS_PER_DOCUMENT partners.
    count = PAIRS_PER_DOCUMENT * max(len(good), len(bad))
    weights = bradley_terry(z[rng.choice(good, count)] - z[rng.choice(bad, count)])
    raw = z @ weights
    cut = float(np.quantile(raw, len(bad) / len(y)))
    spread = float(np.mean(raw[good]) - np.mean(raw[bad]))
    return Model(mean, scale, weights, cut, 4 / max(spread, 1e-6))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, seed: int = SEED) -> Model:
    """Fit on at most ``most`` labelled documents, the first in the order of a hash of their id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("_label"))
    sample = known.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(most)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "_label", features_of("text").alias("x"))
    rows = rows.groupBy("_id", "_label").agg(F.min("x").alias("x")).orderBy("_id").collect()
    return fit_arrays(np.array([r.x for r in rows], np.float64).reshape(len(rows), DENSE + SHAPES), np.array([r._label for r in rows], np.int64), seed)


def _gathered(docs: DataFrame, labels: DataFrame, label: str, seed: int) -> DataFrame:
    """All labelled documents as rows of about IN_GROUP of them: the group, labels, features, and which belong to it (others are lent to it).

    A label that is rare is lent to further groups, so that every group holds both.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("_label"))
    # The labels grow with the corpus, so they are never broadcast.
    rows = docs.select("doc_id", "text").join(known.hint("shuffle_merge"), F.col("doc_id") == F.col("_id")).select("_id", F.col("_label").cast("long").alias("_label"), features_of("text").alias("x"))
    rows = settle(rows.groupBy("_id", "_label").agg(F.min("x").alias("x")), "labelled")
    count = {r._label: r["count"] for r in rows.groupBy("_label").count().collect()}
    groups = max(-(-sum(count.values()) // IN_GROUP), 1)
    places = F.lit(1)
    for value, n in count.items():
        places = F.when(F.col("_label") == value, min(groups, max(1, -(-groups * LEAST // n)))).otherwise(places)
    turn = F.explode(F.sequence(F.lit(0), places - 1)).alias("_turn")
    dealt = rows.select("*", turn).withColumn("_group", F.pmod(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(groups)) + F.col("_turn"), F.lit(groups)))

    def packed(key, part):
        part = part.sort_by("_id")
        x = np.array(part.column("x").to_pylist(), np.float32)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int64()), "y": [part.column("_label").to_numpy().astype(np.int64).tobytes()], "x": [x.tobytes()], "own": [(part.column("_turn").to_numpy() == 0).tobytes()]})

    return settle(dealt.groupBy("_group").applyInArrow(packed, "g long, y binary, x binary, own binary"), "groups")


def fit_all(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = SEED) -> Model:
    """Fit on every labelled document.

    Each document of a group meets partners of the group, drawn as ``fit_arrays`` draws them.  Groups add up the moments, the steps of Newton's method and
    the histograms of the quantile; the driver holds sums only, added in the order of the groups.
    """
    groups = _gathered(docs, labels, label, seed)
    width = DENSE + SHAPES

    def over(work) -> list:
        """``work(x, y, own, g)`` of every group, in their order: a list of arrays each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = np.frombuffer(row["x"], np.float32).reshape(-1, width).astype(np.float64)
                    out = work(x, np.frombuffer(row["y"], np.int64), np.frombuffer(row["own"], bool), row["g"])
                    yield pa.RecordBatch.from_pydict({"g": [row["g"]], "v": [np.asarray(out, np.float64).ravel().tolist()]}, pa.schema([("g", pa.int64()), ("v", pa.list_(pa.float64()))]))

        return [np.array(r.v) for r in sorted(groups.mapInArrow(run, "g long, v array<double>").collect())]

    def moments(x, y, own, g):
        x, y = x[own], y[own]
        return np.concatenate([[len(y), (y == 1).sum(), (y == 0).sum()], x.sum(0)])

    sums = sum(over(moments), np.zeros(3 + width))
    total, good, bad = (int(v) for v in sums[:3])
    if not good or not bad:
        return fit_arrays(np.zeros((0, width)), np.zeros(0, np.int64), seed)
    mean = sums[3:] / total
    scale = np.sqrt(sum(over(lambda x, y, own, g: ((x[own] - mean) ** 2).sum(0))) / total) + 1e-3

    def differences(x, y, g):
        z = np.clip((x - mean) / scale, -8, 8)
        rng = np.random.default_rng([seed, g])
        up, down = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        pairs = PAIRS_PER_DOCUMENT * max(len(up), len(down)) if len(up) and len(down) else 0
        return z[rng.choice(up, pairs)] - z[rng.choice(down, pairs)] if pairs else np.zeros((0, width))

    w = np.zeros(width)
    for _ in range(25):

        def slopes(x, y, own, g):
            d = differences(x, y, g)
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            return np.concatenate([[len(d)], -d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        sums = sum(over(slopes))
        gradient, curve = sums[1 : 1 + width] / sums[0] + RIDGE * w, sums[1 + width :].reshape(width, width) / sums[0] + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    raw = lambda x: np.clip((x - mean) / scale, -8, 8) @ w
    sides = sum(over(lambda x, y, own, g: [raw(x[own & (y == 1)]).sum(), raw(x[own & (y == 0)]).sum()]))
    cut = _quantile(lambda count: over(lambda x, y, own, g: count(raw(x[own]))), total, bad / total)
    return Model(mean, scale, w, cut, 4 / max(float(sides[0] / good - sides[1] / bad), 1e-6))


def _quantile(over, total: int, share: float) -> float:
    """The quantile of all values, as ``np.quantile`` defines it: histograms narrow the range until few values are left to sort."""
    place = share * (total - 1)
    wanted = [int(np.floor(place)), int(np.ceil(place))]
    ends = np.array(over(lambda v: [v.min(initial=np.inf), v.max(initial=-np.inf)]))
    low, high, below = float(ends[:, 0].min()), float(ends[:, 1].max()), 0
    while True:
        inside = lambda v: v[(v >= low) & (v <= high)]
        edges = np.linspace(low, high, 4_097)
        counts = sum(over(lambda v: np.histogram(inside(v), edges)[0])) if high > low else np.zeros(1)
        if counts.sum() <= MOST_SORTED or high <= low:
            break
        upto = below + np.cumsum(counts)
        first, last = (int(np.searchsorted(upto, k, side="right")) for k in wanted)
        narrowed = float(edges[first]), float(edges[last + 1])
        if narrowed == (low, high):
            break
        below = sum(int(c[0]) for c in over(lambda v: [(v < narrowed[0]).sum()]))
        low, high = narrowed
    if high <= low:
        return low
    values = np.sort(np.concatenate(over(inside)))
    a, b = (values[k - below] for k in wanted)
    return float(a + (b - a) * (place - wanted[0]))


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of each text, 0 to 1; at CUT or more a document lies above the model's quantile."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = ShapeBuckets()
        for texts in batches:
            x = np.array([features(t, buckets) for t in as_texts(texts)], np.float64).reshape(len(texts), DENSE + SHAPES)
            yield pa.array(held.value.score(x), pa.float64())

    return scored(text)


def keep_best(docs: DataFrame, model: Model, quantile: float) -> DataFrame:
    """The documents above a quantile of all their scores (an approximate quantile over every document, relative error 1e-4)."""
    name = free_name(docs, "_score")
    rows = docs.withColumn(name, score(docs.sparkSession, model, F.col("text")))
    cut = rows.agg(F.percentile_approx(name, quantile, 10_000)).first()[0]
    return (rows if cut is None else rows.where(F.col(name) >= cut)).select(*docs.columns)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_all(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
