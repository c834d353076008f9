"""Phrases whose words keep company, counted over a prefix-free parse of the texts.

A text is a sequence of symbols: its words, and a break wherever a piece ends.  OVERLAP breaks are put before it.  Wherever the hash
of OVERLAP symbols in a row is divisible by PERIOD (a trigger), a chunk ends with those symbols and the next one begins with
them, so equal passages fall into equal chunks wherever they stand.  The distinct chunks with their frequencies are the
dictionary of the parse; its size follows the different passages, not the copies.  A phrase of at most OVERLAP + 1 words lies inside some chunk;
one that lies inside the overlap belongs to the chunk that the overlap ends, so a chunk counts just the phrases that end behind its
first OVERLAP symbols, each as often as the chunk occurs.

Phrases are counted length by length: one of k words is counted only where both phrases of k - 1 words in it may be frequent.
"May be" is a bit table of bounded size (at most 2^MAX_BITS bits) made of the frequent shorter phrases, which never misses one; a full table lets more
phrases be counted, and the counts, which are keyed by the words themselves, stay exact.  From RUNS words on only the parts of the
chunks are read again that can still hold a longer one.

For a phrase of frequency a and each cut into a first part (frequency l) and a rest (r): floor(1000 a n / (l r)), n being the words of the
language; the least of them is the score, ties to the earliest cut.  A phrase is dropped if a longer frequent one holds it and comes at least
SUBSUMED percent as often.  That longer phrase may be taken one word longer: what lies between comes at least as often.

Defined cases: null texts are empty; a null language is NO_LANG; equal rows count each time; one word of any length is one
symbol; a text without triggers is one chunk; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetflow.llm.near_dedup import WordHashes, mixed
from packetflow.llm.tables import as_bytes, table
from packetflow.session import settle

SHORTEST, LONGEST = 2, 5
LEAST = 100
SUBSUMED = 100
TOP = 2000
NO_LANG = "und"

OVERLAP, PERIOD = LONGEST - 1, 32
#: The length at whose count chunks shrink to the runs of words in which longer phrases may be frequent.
RUNS = 3
#: Bits of a table for each phrase in it, and the bound of its size: 2^26 bits are 8 MB.
BITS, MAX_BITS = 16, 26
#: Parts of a language that are ranked on their own first.
SPREAD = 64
#: Distinct chunks or phrases a task holds before it hands their counts on, and bytes of text they may come from.
HELD, HELD_BYTES = 400_000, 64 << 20

_U64 = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U64)
_BREAK = b"\n"
#: Lower-cases A-Z, makes every end of a piece a line feed and every gap a space.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def symbols_of(text: bytes) -> list[bytes]:
    """Words and breaks of a text, in order."""
    return [s for s in text.translate(_PLAIN).replace(_BREAK, b" \n ").split(b" ") if s]


def hashed(symbols: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, symbols), _U64, len(symbols))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` symbols in a row."""
    count = len(hashes) - size + 1
    total = np.zeros(max(count, 0), _U64)
    for j in range(size):
        total += hashes[j : j + len(total)] * _FACTORS[j]
    return mixed(total)


def parse(text: bytes, known: WordHashes, overlap: int = OVERLAP, period: int = PERIOD) -> list[bytes]:
    """The chunks of a text, symbols joined by spaces; the first ``overlap`` symbols of each belong to the one before."""
    symbols = [_BREAK] * overlap + symbols_of(text)
    last = len(symbols) - overlap
    triggers = np.flatnonzero(windows(hashed(symbols, known), overlap) % _U64(period) == 0)
    starts = [0, *triggers[(triggers > 0) & (triggers < last)].tolist()]
    return [b" ".join(symbols[a : b + overlap]) for a, b in zip(starts, [*starts[1:], last])]


class Counts:
    """Counts of keys per language, handed on when there are many."""

    def __init__(self, names: list[str]):
        self.names = names
        self.held: dict[str, dict[bytes, int]] = defaultdict(dict)

    def full(self) -> bool:
        return sum(map(len, self.held.values())) > HELD

    def drain(self) -> Iterator[pa.RecordBatch]:
        for lang, held in self.held.items():
            columns = [pa.array([lang] * len(held), pa.string()), pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=self.names)
        self.held.clear()


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", period: int = PERIOD) -> DataFrame:
    """(lang, chunk, n): the distinct chunks of each language and how often they occur."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, read = WordHashes(), Counts(["lang", "chunk", "n"]), 0
        for batch in batches:
            for language, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                held = counts.held[language]
                for chunk in parse(raw, known, OVERLAP, period) if raw else ():
                    held[chunk] = held.get(chunk, 0) + 1
                read += len(raw)
                if read > HELD_BYTES:
                    yield from counts.drain()
                    read = 0
        yield from counts.drain()

    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("string"))
    found = texts.mapInArrow(chunks, "lang string, chunk string, n long")
    return settle(found.groupBy("lang", "chunk").agg(F.sum("n").alias("n")), "chunks")


def words(chunks: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all single words."""
    own = F.slice(F.split("chunk", " "), F.lit(OVERLAP + 1), F.lit(2**31 - 1))
    each = chunks.select("lang", "n", F.explode(own).alias("phrase")).where(F.col("phrase") != "\n")
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


class Maybe:
    """A bit table: says of every phrase in it, and of some others, that it may be there."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, _U64(len(cells) * 64 - 1)

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [hashes & self.mask, (hashes >> _U64(32)) & self.mask]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        a, b = ((self.cells[at >> _U64(6)] >> (at & _U64(63))) & _U64(1) for at in self.places(hashes))
        return (a & b).astype(bool)


def language_hash(lang: str, known: WordHashes) -> np.uint64:
    return _U64(known[b" " + lang.encode()])


def maybe(phrases: DataFrame, size: int) -> Maybe:
    """The bit table of phrases of ``size`` words."""
    count = phrases.count()
    bits = min(max(10, (BITS * count).bit_length()), MAX_BITS)
    cells = np.zeros(1 << (bits - 6), _U64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = WordHashes(), Maybe(np.zeros(1 << (bits - 6), _U64))
        for batch in batches:
            texts = as_bytes(batch.column(1))
            if texts:
                hashes = hashed(list(chain.from_iterable(t.split(b" ") for t in texts)), known)
                langs = np.array([language_hash(x, known) for x in batch.column(0).to_pylist()], _U64)
                for at in own.places(mixed(windows(hashes, size)[::size] ^ langs)):
                    np.bitwise_or.at(own.cells, at >> _U64(6), _U64(1) << (at & _U64(63)))
        used = np.flatnonzero(own.cells)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(own.cells[used].view(np.int64))], names=["cell", "bits"])

    marked = phrases.select("lang", "phrase").mapInArrow(mark, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells[marked.column("cell").to_numpy()] = marked.column("bits").to_numpy().view(_U64)
    return Maybe(cells)


def longer(chunks: DataFrame, size: int, shorter: Maybe, runs: bool = False) -> DataFrame:
    """(lang, phrase, lead, f) of the phrases of ``size`` words whose shorter phrases may be frequent; ``lead`` is null.

    ``chunks`` are (lang, chunk, lead, n); phrases that end within the first ``lead`` symbols belong to another chunk.  With ``runs``
    there are also rows with a ``lead``: the parts of the chunks in which still longer phrases may be frequent.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(shorter)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, frequent = WordHashes(), Counts(["lang", "phrase", "f"]), shared.value
        parts = [Counts(["lang", "phrase", "f"]) for _ in range(OVERLAP + 1)] if runs else []
        stop = _U64(known[_BREAK])

        def drain() -> Iterator[pa.RecordBatch]:
            for lead, held in [(None, counts), *enumerate(parts)]:
                for rows in held.drain():
                    yield rows.append_column("lead", pa.array([lead] * rows.num_rows, pa.int32()))

        for batch in batches:
            split = [c.split(b" ") + [_BREAK] for c in as_bytes(batch.column(1))]
            symbols = list(chain.from_iterable(split))
            if len(symbols) < size:
                continue
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            starts = np.cumsum(sizes) - sizes
            langs, weights = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            first_own = starts + batch.column(2).to_numpy()
            hashes = hashed(symbols, known)
            broken = np.cumsum(hashes == stop)
            salt = np.repeat(np.array([language_hash(x, known) for x in langs], _U64), sizes)
            short = len(hashes) - size + 2
            whole = (broken[size - 2 :] == broken[:short]) & (hashes[:short] != stop)
            may = whole & frequent.holds(mixed(windows(hashes, size - 1) ^ salt[:short]))
            both = may[:-1] & may[1:]
            at = np.flatnonzero(both)
            chunk = np.searchsorted(starts, at, side="right") - 1
            own = at + size - 1 >= first_own[chunk]
            for i, c in zip(at[own].tolist(), chunk[own].tolist()):
                held, key = counts.held[langs[c]], b" ".join(symbols[i : i + size])
                held[key] = held.get(key, 0) + weights[c]
            if runs:
                edges = np.flatnonzero(np.diff(may.astype(np.int8), prepend=0, append=0))
                for a, b in zip(edges[::2].tolist(), (edges[1::2] + size - 2).tolist()):  # symbols a ... b - 1
                    if b - a > size:
                        c = int(np.searchsorted(starts, a, side="right")) - 1
                        held, key = parts[max(int(first_own[c]) - a, 0)].held[langs[c]], b" ".join(symbols[a:b])
                        held[key] = held.get(key, 0) + weights[c]
            if counts.full() or any(p.full() for p in parts):
                yield from drain()
        yield from drain()

    found = chunks.select("lang", "chunk", "lead", "n").mapInArrow(count, "lang string, phrase string, f long, lead int")
    return found.groupBy("lang", "phrase", "lead").agg(F.sum("f").alias("f"))


def frequent_phrases(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every phrase of 1 to ``longest`` words that occurs ``least`` times, and (lang, n)."""
    counted = settle(words(chunks), "words")
    totals = settle(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    found = [settle(counted.where(F.col("f") >= least), "phrases")]
    chunks = chunks.withColumn("lead", F.lit(OVERLAP))
    for size in range(2, longest + 1):
        runs = size == RUNS < longest
        level = settle(longer(chunks, size, maybe(found[-1], size - 1), runs).where(F.col("lead").isNotNull() | (F.col("f") >= least)), "phrases")
        found.append(level.where(F.col("lead").isNull()).select("lang", "phrase", "f"))
        if runs:
            chunks = level.where(F.col("lead").isNotNull()).select("lang", F.col("phrase").alias("chunk"), "lead", F.col("f").alias("n"))
    out = found[0].withColumn("size", F.lit(1))
    for size, level in enumerate(found[1:], 2):
        out = out.union(level.withColumn("size", F.lit(size)))
    return out.select("lang", "phrase", "size", "f"), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, period: int = PERIOD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best ``top`` phrases of each language."""
    phrases, totals = frequent_phrases(dictionary(docs, text, lang, period), least)
    candidates = phrases.where(F.col("size") >= SHORTEST)
    # Whoever holds a phrase: its own first words and last words, one fewer than it has.
    outer = phrases.where(F.col("size") > SHORTEST).select(
        "lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase")
    )
    outer = outer.groupBy("lang", "phrase").agg(F.max("f").alias("_outer"))
    kept = candidates.join(outer, ["lang", "phrase"], "left").where(F.coalesce(F.col("_outer"), F.lit(0)) * 100 < F.col("f") * subsumed)
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.expr("sequence(1, size - 1)")).alias("cut"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - size)")})
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    wide = "CAST({} AS DECIMAL(18,0))".format
    cuts = cuts.withColumn("score", F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_cut"))
    best = best.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    spread = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(spread)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE_SQL = rf"""WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, range(1, {LONGEST + 1}) AS s(size)),
grams AS MATERIALIZED (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= {LEAST}),
kept AS (SELECT * FROM grams g WHERE size >= {SHORTEST} AND NOT EXISTS (
  SELECT 1 FROM grams o WHERE o.lang = g.lang AND o.size > g.size AND 100 * o.f >= {SUBSUMED} * g.f AND contains(' ' || o.phrase || ' ', ' ' || g.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, size, unnest(range(1, size)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : cut], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1 : c.size], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {TOP}"""
