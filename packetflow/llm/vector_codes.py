"""Codes of vectors: the nearest entry of a codebook for each part, found through memoised grid cells.

A component x counts as the integer floor(SCALE * x).  A vector is cut into PARTS equal consecutive parts, each with a codebook of up
to ENTRIES integer entries.  The codebooks start as the parts of the vectors with the smallest ids; each of ROUNDS rounds gives
every part to its nearest entry (squared distance, ties to the lower index) and moves each entry to the floored mean of its parts.

Nearest entries come from a grid: the part's coarse cell (components divided by CELL, floored) is hashed into a memo.  A cell seen for
the first time gets the list of entries that can be nearest to some point of its box: an entry whose least distance to
the box is above another entry's greatest one is dominated and left out.  Only the listed entries are evaluated, exactly, in
64-bit integers.  The memo belongs to a task and a round, and forgets everything when it holds MEMO cells.

A round is one scan of the vectors: tasks add up the parts of each entry, and Spark adds those sums, PARTS * ENTRIES * length of a part
numbers however many vectors there are.  Only the codebooks travel to the driver and back.

Defined cases: a row whose vector is null or holds null or non-finite components is dropped, and so is one whose vector has another length
than that of the smallest id, or is not divisible into PARTS; rows of one id are all coded, the smallest vector is their seed;
rows without an id are coded and never a seed; without seeds there are no rows; integers beyond 2^27 either way count as that bound;
an empty table has no rows; other columns stay as they are, but ``code`` and ``error`` are written anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from packetflow.llm.tables import free_name, quoted, table
from packetflow.session import settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CELL = 32
MEMO = 1 << 16
BOUND = 1 << 27
#: Labels up to which their sums are broadcast (40 bytes each); beyond, they are joined by a shuffle.
LABELS = 100_000

#: Cells whose lists are made together: their arrays stay in a core's cache.
_TOGETHER = 64


class Grid:
    """The nearest entries of one part's codebook (entries as rows of integers)."""

    def __init__(self, book: np.ndarray, cell: int = CELL):
        self.book, self.cell = book, cell
        self.memo: dict[bytes, np.ndarray] = {}

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that no other entry dominates in its box, ascending.

        The distances are kept a little too near and too far, so rounding only lengthens a list.
        """
        half = np.float32((self.cell - 1) / 2)
        centre = cells.astype(np.float32) * np.float32(self.cell) + half
        book, out = self.book.astype(np.float32), []
        for at in range(0, len(cells), _TOGETHER):
            off = np.abs(centre[at : at + _TOGETHER, None, :] - book[None])
            inside = np.maximum(off - half, 0)
            outside = off + half
            near = np.einsum("mkd,mkd->mk", inside, inside)
            far = np.einsum("mkd,mkd->mk", outside, outside).min(axis=1, keepdims=True)
            possible = near * np.float32(1 - 1e-4) <= far * np.float32(1 + 1e-4) + 1
            out += [np.flatnonzero(row) for row in possible]
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point (the lowest of equal ones) and the squared distance."""
        cells = np.ascontiguousarray(np.floor_divide(points, self.cell).astype(np.int32))
        raw, step = cells.tobytes(), cells.shape[1] * 4
        keys = [raw[i : i + step] for i in range(0, len(raw), step)] if step else [b""] * len(points)
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = {k: i for i, k in enumerate(keys) if k not in self.memo}
        if new:
            self.memo.update(zip(new, self.candidates(cells[list(new.values())])))
        lists = [self.memo[k] for k in keys]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        entries, starts = np.concatenate(lists), np.cumsum(sizes) - sizes
        off = np.repeat(points, sizes, axis=0) - self.book[entries]
        distances = np.einsum("nd,nd->n", off, off)
        least = np.minimum.reduceat(distances, starts)
        hits = np.flatnonzero(distances == np.repeat(least, sizes))
        return entries[hits[np.searchsorted(hits, starts)]], least


class Codebooks:
    """The entries of every part: an array [part, entry, position] of integers."""

    def __init__(self, entries: np.ndarray, cell: int = CELL):
        self.entries, self.cell = entries.astype(np.int64), cell

    def grids(self) -> list[Grid]:
        return [Grid(book, self.cell) for book in self.entries]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * x)."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(values * scale), -BOUND, BOUND).astype(np.int64).reshape(len(vectors), -1)


def finite(vector: Column) -> Column:
    """The vector is there and holds neither nulls nor non-finite components."""
    known = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(known(x), F.lit(False))), F.lit(False))


def usable(vectors: DataFrame, parts: int, vec_id: str, vector: str) -> DataFrame:
    """The rows that take part, with the vector as an array of doubles."""
    rows = vectors.withColumn(vector, F.col(quoted(vector)).cast("array<double>"))
    rows = rows.where(finite(F.col(quoted(vector))) & (F.size(quoted(vector)) > 0) & (F.size(quoted(vector)) % parts == 0))
    size = rows.agg(F.min_by(F.size(quoted(vector)), F.struct(quoted(vec_id), F.size(quoted(vector))))).first()[0]
    return rows.where(F.size(quoted(vector)) == F.lit(-1 if size is None else size))


def seeds(rows: DataFrame, count: int, scale: int, vec_id: str, vector: str) -> np.ndarray:
    """The integer vectors of the ``count`` smallest ids, ascending.

    First the ids alone: each task hands on its ``count`` smallest.  Then the vectors up to the last of them.
    """
    kind = rows.schema[vec_id].dataType
    stored = to_arrow_type(kind)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set = set()
        for batch in batches:
            held.update(batch.column(0).unique().to_pylist())
            held = set(sorted(held)[:count])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(held), stored)], names=["id"])

    schema = T.StructType([T.StructField("id", kind)])
    ids = rows.where(F.col(quoted(vec_id)).isNotNull()).select(quoted(vec_id)).mapInArrow(smallest, schema)
    last = ids.distinct().orderBy("id").limit(count).agg(F.max("id")).first()[0]
    if last is None:
        return np.zeros((0, 0), np.int64)
    first = rows.where(F.col(quoted(vec_id)) <= F.lit(last)).groupBy(F.col(quoted(vec_id)).alias("id")).agg(F.min(quoted(vector)).alias("v"))
    found = sorted(first.collect(), key=lambda r: r["id"])
    return integers(pa.array([r["v"] for r in found], pa.list_(pa.float64())), scale)


def train(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, cell: int = CELL,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> Codebooks | None:
    """Codebooks fitted to all usable vectors; None where no row is usable."""
    rows = usable(vectors, parts, vec_id, vector)
    first = seeds(rows, entries, scale, vec_id, vector)
    if not len(first):
        return None
    books = Codebooks(first.reshape(len(first), parts, -1).transpose(1, 0, 2), cell)
    for _ in range(rounds):
        books = moved(rows, books, scale, vector)
    return books


def moved(rows: DataFrame, books: Codebooks, scale: int, vector: str) -> Codebooks:
    """Each entry at the floored mean of the parts nearest to it; unused ones stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, count, length = books.entries.shape
        sums, numbers = np.zeros((parts, count, length), np.int64), np.zeros((parts, count), np.int64)
        grids = books.grids()
        for batch in batches:
            if batch.num_rows:
                points = integers(batch.column(0), scale).reshape(-1, parts, length)
                for p, grid in enumerate(grids):
                    at, _ = grid.nearest(points[:, p])
                    order = np.argsort(at, kind="stable")
                    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                    sums[p, at[order][starts]] += np.add.reduceat(points[order, p], starts, axis=0)
                    numbers[p] += np.bincount(at, minlength=count)
        part, entry = np.nonzero(numbers)
        place = np.tile(np.arange(length), len(part))
        part, entry = np.repeat(part, length), np.repeat(entry, length)
        columns = [part.astype(np.int32), entry.astype(np.int32), place.astype(np.int32), sums[part, entry, place], numbers[part, entry]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "place", "total", "n"])

    added = rows.select(quoted(vector)).mapInArrow(add_up, "part int, entry int, place int, total long, n long")
    added = added.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n"))
    entries = books.entries.copy()
    for row in added.collect():  # one number for each position of each entry
        entries[row["part"], row["entry"], row["place"]] = int(row["total"]) // row["n"]
    shared.unpersist()
    return Codebooks(entries, books.cell)


def coded(vectors: DataFrame, books: Codebooks, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The usable rows with ``code`` (two hex digits a part) and ``error`` (squared distances summed over the parts)."""
    parts = books.entries.shape[0]
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kind = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    @F.arrow_udf(kind)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grids = shared.value.grids()
        for batch in batches:
            points = integers(batch, scale).reshape(len(batch), parts, -1)
            found = [grid.nearest(points[:, p]) for p, grid in enumerate(grids)] if len(batch) else []
            digits = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex() if found else ""
            texts = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            errors = sum((d for _, d in found), np.zeros(len(batch), np.int64))
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.int64())], ["code", "error"])

    rows = usable(vectors, parts, vec_id, vector)
    name = free_name(vectors, "_coded")
    rows = rows.withColumn(name, code(quoted(vector)))
    kept = [F.col(quoted(c)) for c in vectors.columns if c.lower() not in ("code", "error")]
    return rows.select(*kept, F.col(f"{name}.code").alias("code"), F.col(f"{name}.error").alias("error"))


def with_label_errors(rows: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_error``: ``error`` summed over the rows of a label, rows without one together."""
    same = free_name(rows, "_label")
    sums = settle(rows.groupBy(F.col(quoted(label)).alias(same)).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col(quoted(label)).eqNullSafe(F.col(same)), "left").drop(same)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = settle(coded(vectors, books).select("vec_id", "label", "code", "error"), "codes")
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds in SQL, with every entry compared with every part."""
    vector = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS row, vec_id, label, {vector} AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS (SELECT row, vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS p
        FROM kept, range({PARTS}) AS r(part))""",
        f"""first AS (SELECT row, rank FROM (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM kept) WHERE rank < {ENTRIES})""",
        "book0 AS (SELECT part, rank AS entry, p AS e FROM parts JOIN first USING (row))",
    ]
    distance = "list_sum(list_transform(list_zip(p, e), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT)))"
    for i in range(ROUNDS + 1):
        steps.append(
            f"""near{i} AS (SELECT row, part, p, min(struct_pack(d := CAST({distance} AS BIGINT), entry := entry)) AS best
            FROM parts JOIN book{i} USING (part) GROUP BY row, part, p)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""sums{i} AS (SELECT part, entry, list(CAST(floor_sum AS BIGINT) ORDER BY place) AS e FROM (
                SELECT part, best.entry AS entry, place, (sum(p[place]) - (sum(p[place]) % count(*) + count(*)) % count(*)) // count(*) AS floor_sum
                FROM near{i}, range(1, 1 + (SELECT max(len(p)) FROM parts)) AS r(place) GROUP BY ALL) GROUP BY part, entry)"""
            )
            steps.append(f"book{i + 1} AS (SELECT part, entry, coalesce(s.e, b.e) AS e FROM book{i} b LEFT JOIN sums{i} s USING (part, entry))")
    return f"""WITH {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
    codes AS (SELECT row, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row),
    digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM codes JOIN kept USING (row), digest"""


ORACLE_SQL = _oracle()
