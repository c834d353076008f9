"""Benchmark decontamination by a broadcast set of word windows.

Every benchmark item is cut into windows of WINDOW consecutive normalised words (a shorter item is one window).  The
windows of all items form a hash set that is broadcast.  A benchmark of more than MOST_WINDOWS words is broadcast in parts of about that many
words each; a task holds the set of one part at a time, and a document is judged by the items and spans of all of them.  A task walks each document once: a
rolling hash of its words (numbered by the benchmark's own vocabulary, 0 for any other word) finds candidates, and each
candidate is compared word by word before it counts.  Documents are never shuffled.

Normalised words: A-Z lower-cased, then runs of ASCII letters and digits and of any characters beyond ASCII.

Defined cases: a null or empty text has no words, no hit and is kept; an item without words has no window; equal items
are found under each of their ids; repeated documents are judged alike; empty tables work; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetflow.llm.tables import as_bytes, free_name, table
from packetflow.session import settle

WINDOW = 13
#: Words of benchmark that are broadcast as one set: about 100 bytes a window in every Python worker.
MOST_WINDOWS = 1_000_000
#: Text that a task holds while it walks it with one part after another.
GROUP_BYTES = 32 << 20

#: Bytes that separate words become spaces, A-Z becomes a-z; all separators are ASCII, so UTF-8 stays whole.
_NORMAL = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<first:int,last:int>>>"
_ARROW_HITS = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class WindowSet:
    """The windows of all items, looked up by a rolling hash and then word by word."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.by_words: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                self.by_words.setdefault(tuple(ids[i : i + size]), set()).add(item_id)
        rng = np.random.default_rng(7)  # a random value for each word and an odd factor for each place
        self.values = rng.integers(1, 2**63, len(self.numbers) + 1, dtype=np.uint64)
        self.factors = rng.integers(1, 2**63, window, dtype=np.uint64) | np.uint64(1)
        self.hashes = {n: np.sort(np.array([self._hash(np.array(k))[0] for k in self.by_words if len(k) == n], np.uint64)) for n in {len(k) for k in self.by_words}}

    def _hash(self, ids: np.ndarray, size: int = 0) -> np.ndarray:
        """One hash for each run of ``size`` numbers (all of them by default)."""
        size = size or len(ids)
        values, total = self.values[ids], np.zeros(len(ids) - size + 1, np.uint64)
        for j in range(size):
            total += values[j : len(ids) - size + 1 + j] * self.factors[j]
        return total

    def find(self, words: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """(first word, word after the last, item ids) of every occurrence."""
        ids = np.fromiter(map(self.numbers.get, words, [0] * len(words)), np.int64, len(words))
        found = []
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            # Only runs without a foreign word can match: most documents end here.
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            got = self._hash(ids, size)[starts]
            at = np.searchsorted(hashes, got)
            for i in starts[hashes[np.minimum(at, len(hashes) - 1)] == got].tolist():
                items = self.by_words.get(tuple(ids[i : i + size].tolist()))
                if items:
                    found.append((i, i + size, items))
        return found


def merged(found: list[tuple[int, int, set[str]]]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for first, last in sorted((a, b) for a, b, _ in found):
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
        else:
            spans.append((first, last))
    return spans


def distinct_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct()


def count_words(benchmark: DataFrame) -> int:
    return distinct_items(benchmark).agg(F.sum(F.size(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))))).first()[0] or 0


def collect_items(benchmark: DataFrame, window: int = WINDOW, most: int = MOST_WINDOWS) -> list[tuple[str, bytes]]:
    """The benchmark's distinct items, after a check that their windows are few enough to be broadcast."""
    items, words = distinct_items(benchmark), count_words(benchmark)
    if words > most:
        raise ValueError(f"the benchmark has {words} words, more than the {most} that are broadcast; split it and call once for each part")
    return [("" if r.item_id is None else r.item_id, bytes(r.text)) for r in items.collect()]


def pieces(benchmark: DataFrame, window: int, most: int) -> list[DataFrame]:
    """The benchmark in parts that ``collect_items`` takes; an item of more words is cut into pieces that share window - 1 words."""
    pieces_of = max(most // 4, window)

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for raw in as_bytes(texts):
                words = words_of(raw)
                out.append([b" ".join(words[i : i + pieces_of + window - 1]) for i in range(0, max(len(words) - window + 1, 1), pieces_of)])
            yield pa.array(out, pa.list_(pa.binary()))

    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.explode(cut("text")).alias("text"))
    texts = texts.withColumn("text", F.col("text").cast("string")).distinct()
    cuts = settle(texts.withColumn("n", F.size(F.split("text", " "))), "benchmark")
    slots = 1 << 16
    sizes = {r.slot: r.n for r in cuts.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(slots)).alias("slot")).agg(F.sum("n").alias("n")).collect()}
    parts, first, total = [], 0, 0
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(slots))
    for at in sorted(sizes):
        if total and total + sizes[at] > most:
            parts.append(cuts.where(slot.between(first, at - 1)).select("item_id", "text"))
            first, total = at, 0
        total += sizes[at]
    return [*parts, cuts.where(slot >= first).select("item_id", "text")]


def groups(batches: Iterator[pa.Array], least: int) -> Iterator[list[pa.Array]]:
    """The batches in lists of about ``least`` bytes."""
    held: list[pa.Array] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= least:
            yield held
            held = []
    if held:
        yield held


def hits(spark: SparkSession, benchmark: DataFrame, text: Column, window: int = WINDOW, most: int = MOST_WINDOWS) -> Column:
    """A struct for each text: its words, its hit words, the items found (sorted as strings) and the hit spans in words."""
    parts = [benchmark] if count_words(benchmark) <= most else pieces(benchmark, window, most)
    held = [spark.sparkContext.broadcast([("" if r.item_id is None else r.item_id, bytes(r.text)) for r in distinct_items(x).collect()]) for x in parts]

    @F.arrow_udf(HITS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only = WindowSet(held[0].value, window) if len(held) == 1 else None
        for group in groups(batches, 0 if only else GROUP_BYTES):
            texts = [raw for batch in group for raw in as_bytes(batch)]
            sizes, items, spans = [0] * len(texts), [set() for _ in texts], [[] for _ in texts]
            for part in held:  # one set at a time
                known = only or WindowSet(part.value, window)
                for i, raw in enumerate(texts):
                    words = words_of(raw)
                    found = known.find(words)
                    sizes[i] = len(words)
                    items[i].update(*[x for _, _, x in found])
                    spans[i] = merged(found + [(a, b, set()) for a, b in spans[i]])
                del known
            rows = [{"n_words": n, "n_hit": sum(b - a for a, b in cut), "items": sorted(x), "spans": [{"first": a, "last": b} for a, b in cut]} for n, x, cut in zip(sizes, items, spans)]
            at = 0
            for batch in group:
                yield pa.array(rows[at : at + len(batch)], _ARROW_HITS)
                at += len(batch)

    return scan(text)


def contaminated(found: Column) -> Column:
    """At least a twentieth of the words lies in benchmark windows."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


@F.arrow_udf(T.StringType())
def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the words of their spans (and what stands between the words of one span)."""
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        if text is not None and cuts:
            at = [m.span() for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010FFFF]+", text)]
            for cut in reversed(cuts):
                text = text[: at[cut["first"]][0]] + text[at[cut["last"] - 1][1] :]
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated (``mode="document"``), or all documents without the hit spans (``"span"``)."""
    name = free_name(docs, "_hits")
    found = docs.withColumn(name, hits(docs.sparkSession, benchmark, F.col("text"), window))
    if mode == "document":
        return found.where(~contaminated(F.col(name))).select(*docs.columns)
    return found.withColumn("text", without_spans(F.col("text"), F.col(name)["spans"])).select(*docs.columns)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = docs.select("doc_id", hits(spark, benchmark, F.col("text")).alias("h"))
    h = F.col("h")
    return found.select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(h).alias("contaminated"),
    )


#: The same result in DuckDB's SQL: windows as texts, joined.
ORACLE_SQL = rf"""
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), sizes AS (SELECT DISTINCT least(len(w), {WINDOW}) AS n FROM words WHERE kind = 'b' AND len(w) > 0
), items AS (
  SELECT DISTINCT id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)
), found AS (
  SELECT r, i, x.n, items.id
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE kind = 'd' AND len(w) >= n) x
  JOIN items ON items.n = x.n AND items.win = array_to_string(w[i : i + x.n - 1], ' ')
), hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id::VARCHAR AS id FROM found) GROUP BY r
)
SELECT words.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN named USING (r) WHERE kind = 'd'
"""
