"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from packetflow.operators import classify, flows, keys, sampling
from packetflow.plans import events as E
from packetflow.plans.queries import APP_RULE_ROWS
from packetflow.schemas import APP_RULES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange (\w+)", text)


@pytest.fixture(scope="module")
def packets(spark):
    return E.packets(spark, SF)


def main_part(text):
    """The plan without its scalar subqueries (the one-row end of input)."""
    return re.sub(r"(?m)^.*Subquery.*\n(^[ :|+-]*(?:AdaptiveSpark|HashAgg|Exchange Single|Project|FileScan).*\n){1,8}", "", text)


def test_one_shuffle_without_hot_keys(packets):
    text = main_part(plan(flows.build_flows(packets, E.IDLE, measures=["packet_total", "octet_total"], biflow=True)))
    assert exchanges(text) == ["hashpartitioning"]
    assert "SortAggregate" not in text and "Python" not in text


def test_hot_keys_are_split_by_time(packets):
    cut = flows.build_flows(packets, E.IDLE, measures=["packet_total"], biflow=True, hot_rows=5)
    text = plan(cut)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert re.search(r"hashpartitioning\([^)]*_chunk", text)


def test_only_needed_columns_are_read(packets):
    text = plan(packets.select("packet_id", "interface"))
    assert re.search(r"ReadSchema: struct<event_id:bigint,user_id:bigint>", text)
    narrow = plan(sampling.sample_uniform(packets, 10).select("packet_id"))
    assert re.search(r"ReadSchema: struct<event_id:bigint>", narrow) and exchanges(narrow) == []


def test_filters_reach_the_scan(spark):
    packets = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("packet_id"), F.col("user_id"))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,5)]" in plan(packets.where("user_id = 5"))


def test_rank_has_no_single_partition(packets):
    ranked = plan(sampling.sample_n_of_N(packets, 4, 10))
    assert "SinglePartition" not in ranked


def test_rules_are_joined_by_equality(spark, packets):
    rules = spark.createDataFrame(APP_RULE_ROWS, APP_RULES)
    text = plan(classify.classify_by_port(packets, rules))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text
    assert "Join" not in plan(classify.classify_by_host(packets, rules))


def test_keys_are_narrow(packets):
    assert exchanges(plan(keys.flow_id(packets).select("flow_id"))) == []
