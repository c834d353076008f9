"""Small helpers that several of these operators share."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a regular expression of Java and of DuckDB.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a column of texts; null is empty."""
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def as_texts(texts: pa.Array) -> list[str]:
    return [x or "" for x in texts.to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where the table already has such a column (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + re.sub("`", "``", name) + "`"
