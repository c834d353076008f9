"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles (SHINGLE normalised words each): how often a shingle comes times the mean
inverse document frequency of its words.  The frequencies are counted over all documents, in IDF_BUCKETS hashed buckets
(a table of fixed size, so it can be broadcast at any scale).  Two documents are near copies when the weighted Jaccard
similarity of their sets, sum of minima over sum of maxima, is SIMILARITY or more.

Candidates come from BANDS bands: a band is a fixed choice of ROWS out of SAMPLES consistent weighted samples.  Two
documents agree in one sample with a probability of just that similarity, so a pair at 0.8 meets in some band with probability 0.97,
one at 0.85 with 0.997, one at 0.5 with 0.2.  Exact copies are put together first and stand as one text.  The documents that share a band
value (a bucket) are never paired with each other: all are compared with the smallest id among them.  Each
comparison reads both whole texts and computes the similarity itself.  Verified links make the classes (connected
components).  Where a bucket still holds several classes, one of its documents in the largest class is its anchor, and the documents outside the
anchor's class, the outsiders, go on: in each pass they are compared with the next documents of the bucket, GROWTH times as many as before,
until they have joined the anchor's class or have met the whole bucket.  Classes only grow, so whoever is an outsider in the end was one
all along: every two documents that share a bucket are then in one class or were compared, or cannot be similar.  A member of a large group
joins it after a few comparisons.

Which pairs cannot be similar follows from weights alone.  The similarity of two sets is at most what they can share over all they hold,
so a set has a reach: the weight of the heaviest set it can be similar to.  In crowded buckets (more than HUBS documents) what a document can share
with another class counts only shingles that another class holds, and of these only the common ones; two documents of different classes that share
a rare shingle (at most RARE of these documents hold it) are compared on their own.  So a member of a large group whose own edits keep it apart
from all others is done without meeting them.

Only samples, identifiers and links are shuffled, and the texts (of crowded buckets also the shingles) of documents that share a bucket.  Joins are plain equi-joins, which
adaptive execution splits where a hub is hot; minima per bucket are combined before the shuffle.

Defined cases: texts without words (null and empty ones too) are copies of each other if they are equal, null counting as empty;
a text of fewer than SHINGLE words is one shingle; rows with one and the same id count as one document (the smallest text stands
for it); rows with a null id are in no class and stay; an empty table stays empty; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetflow.llm.decontaminate import words_of
from packetflow.llm.tables import as_bytes, free_name, table
from packetflow.session import settle

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES, BANDS, ROWS = 30, 40, 7
IDF_BUCKETS = 1 << 18
SEED = 20_11

#: Documents of a mixed bucket that its outsiders meet in the first pass, and how many times as many in each that follows.
HUBS, GROWTH = 8, 8
#: A shingle that so many documents of crowded buckets hold is rare: those documents are compared with each other.
RARE = 8
#: Sums of weights are compared with this much room for rounding.
_ROOM = 1e-6

_U64 = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U64)
_MIX = (_U64(0xFF51AFD7ED558CCD), _U64(0xC4CEB9FE1A85EC53))
#: Shingles that are sampled together: arrays of this length stay in a core's cache.
_CHUNK = 8192


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _MIX[0]
    x = (x ^ (x >> _U64(33))) * _MIX[1]
    return x ^ (x >> _U64(33))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U64(46)).astype(np.int64)  # the top 18 bits


def weighted_set(text: bytes, idf: np.ndarray, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a text, in order, and their weights."""
    words = words_of(text)
    if not words:
        return np.zeros(0, _U64), np.zeros(0, np.float32)
    hashes = np.fromiter(map(known.__getitem__, words), _U64, len(words))
    rarity, size = idf[bucket_of(hashes)], min(SHINGLE, len(words))
    count = len(words) - size + 1
    shingles, weights = np.zeros(count, _U64), np.zeros(count, np.float32)
    for j in range(size):  # summed in one order everywhere, so equal shingles weigh exactly the same
        shingles += hashes[j : j + count] * _FACTORS[j]
        weights += rarity[j : j + count]
    shingles, at, times = np.unique(mixed(shingles), return_index=True, return_counts=True)
    return shingles, weights[at] / np.float32(size) * times.astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (x, v), (y, w) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    shared = float(np.minimum(v[both], w[at[both]]).sum(dtype=np.float64))
    return shared / (float(v.sum(dtype=np.float64)) + float(w.sum(dtype=np.float64)) - shared)


def samples(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` consistent weighted samples of each set (sets begin at ``starts``, none is empty): hashes, one row per set.

    For a shingle with weight w and r, c ~ Gamma(2, 1), b ~ U(0, 1) drawn by its hash: t = floor(ln w / r + b),
    ln y = r (t - b), ln a = ln c - ln y - r.  The shingle with the least a is the sample, together with its t.
    """
    log_w = np.log(weights)
    sizes = np.diff(np.append(starts, len(shingles)))
    out = np.empty((len(starts), count), _U64)
    rng = np.random.default_rng(seed)
    for k in range(count):
        salt = rng.integers(1, 2**63, 2, dtype=_U64)
        x, y = mixed(shingles ^ salt[0]), mixed(shingles + salt[1])
        u = lambda bits: ((bits & _U64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-21)
        r = -np.log(u(x) * u(x >> _U64(21)))
        c = -np.log(u(y) * u(y >> _U64(21)))
        b = u(x >> _U64(43))
        t = np.floor(log_w / r + b)
        a = np.log(c) - r * (t - b + np.float32(1))
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        at = least[np.searchsorted(least, starts)]
        out[:, k] = mixed(shingles[at] + t[at].astype(np.int64).astype(_U64) * _FACTORS[0])
    return out


def bands_of(texts: list[bytes], idf: np.ndarray) -> tuple[list[list[int] | None], list[float]]:
    """BANDS band values of each text, none for a text without words, and its total weight."""
    rng = np.random.default_rng(SEED)
    chosen = np.array([rng.choice(SAMPLES, ROWS, replace=False) for _ in range(BANDS)])
    known, out, sums = WordHashes(), [None] * len(texts), [0.0] * len(texts)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if held:
            sizes = [len(s) for _, s, _ in held]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            got = samples(np.concatenate([s for _, s, _ in held]), np.concatenate([w for _, _, w in held]), starts, SAMPLES)
            value = got[:, chosen[:, 0]]
            for j in range(1, ROWS):
                value = mixed(value * _FACTORS[1] + got[:, chosen[:, j]])
            for (i, _, _), row in zip(held, value.view(np.int64).tolist()):
                out[i] = row
            held.clear()

    total = 0
    for i, text in enumerate(texts):
        shingles, weights = weighted_set(text, idf, known)
        if len(shingles):
            held.append((i, shingles, weights))
            sums[i] = float(weights.sum(dtype=np.float64))
            total += len(shingles)
        if total >= _CHUNK:
            flush()
            total = 0
    flush()
    return out, sums


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """1 + ln((N + 1) / (df + 1)) / ln(N + 1) of each bucket of words, over all documents: IDF_BUCKETS numbers.

    Between 1 and 2 at every size, so a rare word tells more than a common one, and one edit never outweighs a text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, n = WordHashes(), np.zeros(IDF_BUCKETS + 1, np.int64), 0
        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                words = set(words_of(raw))
                if words:
                    df[np.unique(bucket_of(np.fromiter(map(known.__getitem__, words), _U64, len(words))))] += 1
                n += 1
        df[IDF_BUCKETS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(IDF_BUCKETS + 1)
    df[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    total = df[IDF_BUCKETS] + 1
    return (1 + np.log(total / (df[:IDF_BUCKETS] + 1)) / max(np.log(total), 1.0)).astype(np.float32)


def are_stars(edges: DataFrame) -> bool:
    """Whether every id of ``edges`` (a, b) is either below one other or above some."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where("below > 1 or below = 1 and above = 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each connected component of ``links`` (a, b); ids without links are absent.

    Large star and small star in turn: each round links every id to the smallest in its neighbourhood, so hubs flatten
    in a few rounds, until all that is left are stars.  Every round is written, so a lost executor costs one round.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not are_stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.union(least.where("u <> m")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(small.where("a <> b").union(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (id, root) after further links (a, b): only the classes that the links join are followed."""
    known = roots.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("id").agg(F.min("root").alias("root"))
    ends = links.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    tops = components(ends).toDF("root", "top")
    return known.join(tops, "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def as_pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a > b, of documents and the hubs they meet."""
    return met.where("rep <> hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()


def shingle_rows(texts: DataFrame, idf) -> DataFrame:
    """(id, shingle, weight): the weighted sets of texts (id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [weighted_set(x, idf.value, known) for x in as_bytes(part.column(1))]
                of = np.repeat(np.arange(len(found)), [len(shingles) for shingles, _ in found])
                shingles, weights = (np.concatenate(column) for column in zip(*found))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(shingles.view(np.int64)), pa.array(weights.astype(np.float64))], names=["id", "shingle", "weight"])

    return texts.select("id", "text").mapInArrow(sets, T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("shingle", T.LongType()), T.StructField("weight", T.DoubleType())]))


def reach_of(weight, common, similarity: float):
    """The weight of the heaviest set that a set of some weight, which shares ``common`` of it at most, can be similar to."""
    return (common * ((1 + similarity) / similarity) - weight) * (1 + _ROOM)


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """The rows (band, value, rep, root, ...) of buckets that hold several classes, with the bucket's size and its anchor."""
    parts = rows.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("anchor"))
    whole = parts.groupBy("band", "value").agg(F.sum("n").alias("size"), F.max(F.struct("n", "anchor"))["anchor"].alias("anchor"), F.count(F.lit(1)).alias("classes"))
    return rows.join(whole.where("classes > 1").drop("classes"), ["band", "value"])


def can_meet(rows: DataFrame) -> DataFrame:
    """The rows (band, value, weight, reach, ...) that some other row of their bucket can be similar to, as far as the bucket's extremes tell."""
    limits = rows.groupBy("band", "value").agg(F.min("weight").alias("lightest"), F.max("reach").alias("farthest"))
    return rows.join(limits, ["band", "value"]).where("reach >= lightest and weight <= farthest").drop("lightest", "farthest")


def within_crowds(rows: DataFrame, involved: DataFrame, copies: DataFrame, idf, similarity: float) -> tuple[DataFrame, DataFrame]:
    """What crowded buckets (rows: rep, root, ...) need: (rep, weight, reach) of their documents, and the pairs (a, b) that share a rare shingle.

    Documents of different classes that share no rare shingle have at most the lesser ``common`` of the two in common, and reach tells
    which of them can be similar.  The pairs share a bucket and are of different classes.
    """
    members = rows.select(F.col("rep").alias("id"), "root").distinct()
    sets = settle(shingle_rows(involved.join(members.select("id"), "id"), idf).join(members, "id"), "shingles")
    holders = settle(sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle", "n"), "holders")
    common = sets.join(holders.where(F.col("n") > RARE), "shingle").groupBy("id").agg(F.sum("weight").alias("common"))
    totals = sets.groupBy("id").agg(F.sum("weight").alias("weight")).join(common, "id", "left")
    reaches = totals.select(F.col("id").alias("rep"), "weight", reach_of(F.col("weight"), F.coalesce("common", F.lit(0.0)), similarity).alias("reach"))
    few = sets.join(holders.where(F.col("n") <= RARE), "shingle").groupBy("shingle").agg(F.collect_list(F.struct("id", "root")).alias("held"))
    left = few.select(F.explode("held").alias("x"), "held").select("x", F.explode("held").alias("y")).where("x.id > y.id and x.root <> y.root")
    pairs = left.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    bands = copies.where(F.col("bands").isNotNull()).select("rep", "bands")
    pairs = pairs.join(bands.toDF("a", "p"), "a").join(bands.toDF("b", "q"), "b")
    return reaches, pairs.where(F.exists(F.zip_with("p", "q", lambda x, y: x == y), lambda same: same)).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are similar enough."""

    @F.arrow_udf(T.BooleanType())
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = WordHashes()
        for left, right in batches:
            sets: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            out = []
            for x, y in zip(as_bytes(left), as_bytes(right)):
                if len(sets) > 200:
                    sets.clear()
                if y not in sets:  # hubs come again and again
                    sets[y] = weighted_set(y, idf.value, known)
                out.append(weighted_jaccard(weighted_set(x, idf.value, known), sets[y]) >= similarity)
            yield pa.array(out, pa.bool_())

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(similar("x", "y")).select("a", "b")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): the smallest id of the class of near copies each document with an id belongs to."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))

    signature = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("weight", T.DoubleType())])

    @F.arrow_udf(signature)
    def signatures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            raw = as_bytes(texts)
            digests = [xxhash.xxh3_128_digest(b"w" + b" ".join(words) if words else b"t" + x) for x in raw for words in [words_of(x)]]
            bands, sums = bands_of(raw, idf.value)
            yield pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sums, pa.float64())], ["digest", "bands", "weight"])

    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = settle(own.select("id", signatures("text").alias("s")).select("id", "s.digest", "s.bands", "s.weight"), "bands")
    # Exact copies stand as one text: the smallest id.  Texts without words have no bands.
    copies = signed.groupBy("digest").agg(F.min("id").alias("rep"), F.min("bands").alias("bands"), F.max("weight").alias("weight"))
    copies = settle(copies, "copies")
    members = signed.select("id", "digest").join(copies.select("digest", "rep"), "digest").select("id", "rep").distinct()
    buckets = copies.where(F.col("bands").isNotNull()).select("rep", F.posexplode("bands").alias("band", "value"))
    hubs = buckets.groupBy("band", "value").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    shared = settle(buckets.join(hubs.drop("high"), ["band", "value"]), "buckets")
    involved = settle(own.join(shared.select(F.col("rep").alias("id")).distinct(), "id").groupBy("id").agg(F.min("text").alias("text")), "texts")
    tested = settle(as_pairs(shared.select("rep", F.col("low").alias("hub"))), "pairs")
    links = settle(verified(tested, involved, idf, similarity), "similar")
    roots = settle(components(links), "roots")
    labelled = shared.select("band", "value", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # An id with several texts has a weight for each.
    weighed = copies.groupBy("rep").agg(F.min("weight").alias("weight"), reach_of(F.lit(0.0), F.max("weight") / (1 + similarity), similarity).alias("reach"))
    waiting = settle(mixed_buckets(labelled).join(weighed, "rep"), "waiting")
    crowded = F.col("size") > HUBS
    reaches, rare = within_crowds(waiting.where(crowded), involved, copies, idf, similarity)
    limited = waiting.where(crowded).drop("weight", "reach").join(reaches, "rep")
    limited = mixed_buckets(can_meet(limited.select("band", "value", "rep", "root", "weight", "reach")))
    columns = ["band", "value", "rep", "size", "anchor", "weight", "reach"]
    waiting = settle(limited.select(*columns).union(waiting.where(~crowded).select(*columns)), "waiting")
    rare = settle(rare, "rare")
    largest = waiting.agg(F.max("size")).first()[0] or 0
    met_before, meets = 0, HUBS
    while met_before < largest or rare is not None:
        anchors = roots.select(F.col("id").alias("anchor"), F.col("root").alias("main"))
        labelled = waiting.join(roots.withColumnRenamed("id", "rep"), "rep", "left").join(anchors, "anchor", "left")
        labelled = labelled.withColumns({"root": F.coalesce("root", "rep"), "main": F.coalesce("main", "anchor")})
        labelled = settle(labelled, "labelled")
        outsiders = labelled.where("root <> main").select("band", "value", "rep", "root", "weight", "reach")
        if rare is None and outsiders.isEmpty():
            break
        # One order of the documents for all buckets, so an outsider meets much the same ones in each of its buckets.
        turn = F.expr(f"pmod(xxhash64(rep, {SEED}L), {1 << 24}L) * size div {1 << 24}L")
        hubs = labelled.where((turn >= met_before) & (turn < meets))
        hubs = hubs.select("band", "value", F.col("rep").alias("hub"), F.col("root").alias("hub_root"), F.col("weight").alias("hub_weight"), F.col("reach").alias("hub_reach"))
        met = outsiders.join(hubs, ["band", "value"]).where("root <> hub_root and hub_weight <= reach and weight <= hub_reach").select("rep", "hub")
        pairs = as_pairs(met) if rare is None else as_pairs(met).union(rare).distinct()
        pairs = settle(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        rare = None
        found = settle(verified(pairs, involved, idf, similarity), "similar")
        open_ones = outsiders.select("band", "value").distinct()
        waiting = labelled.where(F.col("size") > meets).join(open_ones, ["band", "value"], "left_semi").select(*waiting.columns)
        tested = settle(tested.union(pairs), "tested")
        if not found.isEmpty():
            roots = settle(joined(roots, found), "roots")
        met_before, meets = meets, meets * GROWTH
    return members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("id").alias("doc_id"), F.coalesce("root", "rep").alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the near copies of a document with a smaller id."""
    gone = classes(docs, similarity).where("doc_id <> class_id").select(F.col("doc_id").alias(free_name(docs, "_gone")))
    return docs.join(gone, F.col("doc_id") == F.col(gone.columns[0]), "left_anti")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
