"""Packet selection rules and their limits."""

import pytest
from pyspark.sql import functions as F

from helpers import collect, table
from packetflow.operators import sampling


def ids(df):
    return sorted(r.packet_id for r in df.select("packet_id").collect())


@pytest.fixture(scope="module")
def packets(spark):
    """28 packets per interface, one per second, over several chunks."""
    rows = [{"t": i, "interface": name} for i in range(28) for name in ("eth0", "eth1")]
    return table(spark, rows).cache()


@pytest.mark.parametrize("chunk", ["1 minute", "3 seconds"])
def test_count_4_of_14(packets, chunk):
    kept = sampling.sample_count(packets.where("interface = 'eth0'"), 4, 10, chunk=chunk)
    assert [(i + 1) // 2 for i in ids(kept)] == [1, 2, 3, 4, 15, 16, 17, 18]
    inverted = sampling.sample_count(packets.where("interface = 'eth0'"), 4, 10, invert=True, chunk=chunk)
    assert [(i + 1) // 2 for i in ids(inverted)] == [n for n in range(1, 29) if n % 14 >= 4]


def test_count_scope(packets):
    per = sampling.sample_count(packets, 4, 10)
    assert {r["interface"]: r["count"] for r in per.groupBy("interface").count().collect()} == {"eth0": 8, "eth1": 8}
    together = sampling.sample_count(packets, 4, 10, scope="global")
    assert ids(together) == [n for n in range(1, 57) if (n - 1) % 14 < 4]


def test_time(packets):
    kept = sampling.sample_time(packets.where("interface = 'eth0'"), 4, 10)
    phase = 1704067200 % 14
    assert len(ids(kept)) == sum((phase + i) % 14 < 4 for i in range(28))
    inverted = sampling.sample_time(packets.where("interface = 'eth0'"), 4, 10, invert=True)
    assert set(ids(kept)) | set(ids(inverted)) == set(ids(packets.where("interface = 'eth0'")))


@pytest.mark.parametrize("seed", [0, 1])
def test_n_of_n_keeps_n_of_every_run(packets, seed):
    one = packets.where("interface = 'eth0'")
    kept = ids(sampling.sample_n_of_N(one, 3, 7, seed=seed, chunk="2 seconds"))
    ranks = [(i + 1) // 2 for i in kept]
    assert [sum((r - 1) // 7 == run for r in ranks) for run in range(4)] == [3, 3, 3, 3]
    assert kept == ids(sampling.sample_n_of_N(one, 3, 7, seed=seed))


def test_uniform_and_decay(packets):
    assert ids(sampling.sample_uniform(packets, 0)) == []
    assert len(ids(sampling.sample_uniform(packets, 100))) == 56
    start = 1704067200
    assert len(ids(sampling.sample_time_decay(packets, start, start + 100))) == 56
    late = ids(sampling.sample_time_decay(packets, 0, start // 100))
    assert late == []


def test_by_interface(packets):
    settings = [
        {"name": "eth0", "sampling_type": 1, "param1": 4, "param2": 10},
        {"name": "eth1", "sampling_type": 3, "param1": 3, "param2": 7},
    ]
    kept = sampling.sample_by_interface(packets, settings)
    assert {r["interface"]: r["count"] for r in kept.groupBy("interface").count().collect()} == {"eth0": 8, "eth1": 12}
    other = [{"name": "eth0", "sampling_type": 0, "param1": None, "param2": None}, {"name": "eth1", "sampling_type": 9, "param1": 1, "param2": 1}]
    assert collect(sampling.sample_by_interface(packets, other).groupBy("interface").agg(F.count("*").alias("n")), "interface", "n") == [("eth0", 28)]


def test_thousands_of_interfaces_are_a_join(packets):
    rules = [{"name": f"x{i}", "filter": "ip_length > 5" if i % 2 else None, "sampling_type": i % 6, "param1": 1 + i % 3, "param2": 4} for i in range(5000)]
    rules.append({"name": "eth0", "filter": "ip_length > 5", "sampling_type": 1, "param1": 4, "param2": 10})
    chosen = sampling.apply_interfaces(packets, rules)
    text = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in text and text.count("CASE WHEN") < 20
    assert chosen.count() == 8
    with pytest.raises(ValueError, match="twice"):
        sampling.sample_by_interface(packets, [rules[0], rules[0]])


@pytest.mark.parametrize(
    "call",
    [
        lambda p: sampling.sample_count(p, 0, 1),
        lambda p: sampling.sample_time(p, 1, -1),
        lambda p: sampling.sample_n_of_N(p, 5, 4),
        lambda p: sampling.sample_n_of_N(p, 5, 1001),
        lambda p: sampling.sample_uniform(p, 101),
        lambda p: sampling.sample_time_decay(p, 5, 1),
        lambda p: sampling.sample_count(p, 1, 1, scope="host"),
        lambda p: sampling.sample_by_interface(p, [{"name": "eth0", "sampling_type": 3, "param1": 9, "param2": 2}]),
    ],
)
def test_bad_parameters(packets, call):
    with pytest.raises(ValueError):
        call(packets)
