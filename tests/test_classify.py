"""Application rules by port and by host."""

import pytest
from pyspark.sql import functions as F

from helpers import collect, table
from packetflow.operators import classify
from packetflow.schemas import APP_RULES

RULES = [
    (1, "web", "port", 6, 80, 81, None, 10),
    (2, "voice", "port", 17, 5061, 5062, None, 20),
    (3, "all", "port", 6, 0, 70000, None, 99),
    (4, "wrong", "port", 6, 9, 3, None, 1),
    (7, "site", "host", None, None, None, "example.org", 2),
    (8, "shop", "host", None, None, None, "shop.", 1),
    (9, "empty", "host", None, None, None, "", 0),
]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, APP_RULES)


def test_ports(spark, rules):
    rows = [
        {"t": 0, "dst_port": 81}, {"t": 1, "src_port": 80, "dst_port": 9999}, {"t": 2, "dst_port": 5061, "protocol": 17},
        {"t": 3, "dst_port": 5063, "protocol": 17}, {"t": 4, "dst_port": 9999},
    ]
    packets = table(spark, rows)
    done = classify.classify_by_port(packets, rules)
    assert done.columns == [c for c in packets.columns if c != "app_id"] + ["app_id"]
    assert collect(done, "packet_id", "app_id") == [(1, 1), (2, 1), (3, 2), (4, 0), (5, 3)]


def test_port_table_is_bounded(rules):
    table_ = classify.port_table(rules)
    assert table_.count() == 65536 + 2
    assert table_.where("port > 65535 OR port < 0").count() == 0


@pytest.mark.parametrize("most_inline", [500, 0])
def test_hosts_override_ports(spark, rules, most_inline):
    hosts = ["www.example.org", "shop.example.org", "other.net", None, "x"]
    packets = table(spark, [{"t": i, "dst_port": 81} for i in range(5)])
    pairs = spark.createDataFrame(list(enumerate(hosts, 1)), "packet_id long, host string")
    packets = packets.join(pairs, "packet_id")
    done = classify.classify_by_host(classify.classify_by_port(packets, rules), rules, most_inline=most_inline)
    assert collect(done, "packet_id", "app_id") == [(1, 7), (2, 8), (3, 1), (4, 1), (5, 1)]


@pytest.mark.parametrize("most_inline", [500, 0])
def test_long_host_rules_count_on_both_paths(spark, most_inline):
    long = "a" * 300
    rules = spark.createDataFrame([(7, "long", "host", None, None, None, long, 1), (8, "short", "host", None, None, None, "aaa", 2)], APP_RULES)
    hosts = spark.createDataFrame([(1, f"x{long}.net"), (2, "baaab"), (3, "a" * 299)], "packet_id long, host string")
    done = classify.classify_by_host(hosts.withColumn("app_id", F.lit(0)), rules, most_inline=most_inline)
    assert collect(done, "packet_id", "app_id") == [(1, 7), (2, 8), (3, 8)]


def test_names(spark, rules):
    apps = spark.createDataFrame([(1, 1), (2, 0), (3, 55)], "packet_id int, app_id int")
    names = rules.select("app_id", "app_name")
    assert collect(classify.application_name(apps, names), "packet_id", "app_name") == [(1, "web"), (2, "Unknown"), (3, "Unknown")]
    assert collect(classify.application_name(apps, names, enabled=False), "app_name") == [("Unknown",)] * 3
    assert apps.select(classify.application_id(F.col("app_id")).alias("a")).first()["a"] == 0x06000001
