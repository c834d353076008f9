"""Packet tables in several formats, several interfaces."""

import pytest

from helpers import collect, table
from packetflow.operators.ordering import global_rank, running_total
from packetflow.session import new_folder, settle, shared_dir
from packetflow.sources.packets import read_packets, union_interfaces
from pyspark.sql import functions as F


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_formats(spark, tmp_path, fmt):
    packets = table(spark, [{"t": 0.5}, {"t": 1, "src_port": 7}]).drop("ip_bytes")
    writer = packets.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(str(tmp_path / fmt))
    again = read_packets(spark, str(tmp_path / fmt), fmt)
    assert collect(again, *packets.columns) == collect(packets, *packets.columns)


def test_zoneless_times_become_instants(spark, tmp_path):
    df = spark.sql("SELECT 1L AS packet_id, TIMESTAMP_NTZ'2024-01-01 00:00:01' AS ts")
    df.write.parquet(str(tmp_path / "n"))
    again = read_packets(spark, str(tmp_path / "n"))
    assert again.schema["ts"].dataType.typeName() == "timestamp"
    assert again.select(F.unix_seconds("ts")).first()[0] == 1704067201


def test_union(spark):
    a, b = table(spark, [{"t": 0}]), table(spark, [{"t": 1}]).drop("tos")
    merged = union_interfaces({"x": a, "y": b})
    assert collect(merged, "interface", "tos") == [("x", 0), ("y", None)]
    with pytest.raises(ValueError):
        union_interfaces({})


def test_shared_folder(spark):
    """Intermediate tables go to the folder the session names."""
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert new_folder(spark, "a") != new_folder(spark, "a")
    kept = settle(spark.range(5), "numbers")
    assert kept.count() == 5 and named in kept.inputFiles()[0]


def test_rank_and_running_total(spark):
    rows = [{"t": t, "interface": i} for t in (5, 3, 3, 100, 61) for i in ("a", "b")]
    ranked = global_rank(table(spark, rows).withColumn("_t", F.unix_micros("ts")), ["interface"], chunk="10 seconds")
    got = [(r["packet_id"], r["rank"]) for r in ranked.where("interface = 'a'").orderBy("rank").collect()]
    assert got == [(3, 1), (5, 2), (1, 3), (9, 4), (7, 5)]
    sums = running_total(spark.range(100).withColumn("v", F.lit(2)), "id", "v", "s", block=7)
    assert collect(sums, "id", "s") == sorted(((i, 2 * (i + 1)) for i in range(100)), key=repr)
