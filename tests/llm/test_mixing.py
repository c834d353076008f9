import random

import pytest

from packetflow.llm import mixing as m
from tests.llm.cases import COLUMNS, docs, odd_rows, sentence


def fill(sizes, weights, share, epochs):
    """Clamp and share again until none is above."""
    target, clamped, budget = {}, set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(epochs * sizes[s] for s in clamped)
        free = [s for s in sizes if s not in clamped]
        total = sum(weights[s] for s in free)
        target = {s: epochs * sizes[s] if s in clamped else rest * weights[s] / total for s in sizes}
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target
        clamped |= over


@pytest.mark.parametrize("seed", range(4))
def test_water_filling_equals_the_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 5, 100, 1000, 5000]) * rng.randrange(1, 9) for i in range(9)}
    weights = {s: rng.choice([5, 2, 1]) for s in sizes}
    table = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight int")
    got = {r.source: r.target for r in m.water_fill(table).collect()}
    assert got == pytest.approx(fill(sizes, weights, 1.5, 2), rel=1e-12)


def test_taken_words_come_near_their_targets(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randrange(1, 300)), "en", rng.choice("aaaabc")) for i in range(600)]
    table = docs(spark, rows)
    _, plan = m.fit(table)
    mixed = m.mix(table)
    assert mixed.columns == COLUMNS
    taken, times = {}, {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for r in plan.collect():
        assert abs(taken.get(r.source, 0) - r.target) <= 30
    assert max(times.values()) <= 2
    assert sorted(r.doc_id for r in m.mix(table.repartition(7)).collect()) == sorted(i for i, n in times.items() for _ in range(n))
    other = sorted(r.doc_id for r in m.mix(table, seed="another").collect())
    assert other != sorted(i for i, n in times.items() for _ in range(n))


def test_odd_rows_and_empty_tables(spark):
    table = docs(spark, odd_rows())
    assert m.mix(table).count() > 0
    assert m.mix(table.limit(0)).count() == 0
    assert m.mix(docs(spark, [(1, None, "en", None), (2, "", "en", "a")])).count() == 0


def test_columns_with_dots_and_inner_names_stay(spark):
    names = "doc_id long, text string, source string, `n.c` string, _doc string, _plan string, _times int"
    rows = [(i, "some words here", "a", "p", "q", "r", 3) for i in range(20)]
    mixed = m.mix(spark.createDataFrame(rows, names))
    assert mixed.columns == ["doc_id", "text", "source", "n.c", "_doc", "_plan", "_times"]
    assert {tuple(r)[3:] for r in mixed.collect()} == {("p", "q", "r", 3)}
