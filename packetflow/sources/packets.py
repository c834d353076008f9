"""Packet tables and streams, and their merge over capture points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetflow.schemas import PACKETS


def _utc(df: DataFrame) -> DataFrame:
    """Zone-less times become instants once, here."""
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({name: F.col(name).cast("timestamp") for name in zoneless}) if zoneless else df


def read_packets(spark: SparkSession, path, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Recorded packets.  Parquet carries its schema; text formats get ``schema`` (default: all packet columns)."""
    reader = spark.read.format(fmt)
    if fmt != "parquet" or schema is not None:
        wanted = schema or T.StructType([f for f in PACKETS.fields if not isinstance(f.dataType, T.BinaryType)])
        reader = reader.schema(wanted)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return _utc(reader.load(path))


def stream_packets(spark: SparkSession, path, schema: T.StructType = PACKETS, fmt: str = "parquet", **options) -> DataFrame:
    """Packets as they arrive in a folder."""
    return _utc(spark.readStream.schema(schema).format(fmt).options(**options).load(path))


def union_interfaces(tables: dict[str, DataFrame]) -> DataFrame:
    """Several capture points as one packet table with an ``interface`` column."""
    if not tables:
        raise ValueError("no interfaces given")
    named = [df.withColumn("interface", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
