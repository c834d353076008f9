import random

from pyspark.sql import functions as F

from packetflow.llm import decontaminate as d
from tests.llm.cases import COLUMNS, docs, odd_rows, sentence


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_finds_planted_passages_and_leaves_others(spark):
    rng = random.Random(2)
    items = [(i, sentence(rng, 40)) for i in range(5)] + [(7, "only five words stand here"), (8, None), (9, "...")]
    plain = sentence(rng, 100)
    rows = [(1, plain), (2, plain + " " + items[0][1].upper()), (3, "so ONLY-five, words stand\nhere now"), (4, " ".join(items[1][1].split()[3:15])), (5, plain + " " + " ".join(items[2][1].split()[2:15]))]
    found = {r.doc_id: r.h for r in docs(spark, rows).select("doc_id", d.hits(spark, bench(spark, items), F.col("text")).alias("h")).collect()}
    assert [found[i].n_hit for i in range(1, 6)] == [0, 40, 5, 0, 13]  # twelve words are no window, thirteen are
    assert found[2]["items"] == ["0"] and found[3]["items"] == ["7"] and found[5]["items"] == ["2"]
    kept = d.decontaminate(docs(spark, rows), bench(spark, items))
    assert kept.columns == COLUMNS and sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_spans_are_cut_out(spark):
    rng = random.Random(4)
    item, head, tail = sentence(rng, 20).rstrip("."), "Before, it.", "After: é it!"
    got = d.decontaminate(docs(spark, [(1, f"{head} {item} {tail}"), (2, head)]), bench(spark, [(1, item)]), "span").orderBy("doc_id").collect()
    assert got[0].text == f"{head}  {tail}" and got[1].text == head


def test_odd_rows_empty_tables_and_the_bound(spark):
    table = docs(spark, odd_rows())
    assert d.decontaminate(table, bench(spark, [(1, None)])).count() == 14
    assert d.decontaminate(table, bench(spark, []), "span").count() == 14
    assert d.decontaminate(table.limit(0), bench(spark, [(1, "a b")])).count() == 0
    # An item of one word contaminates every text with enough of it.
    assert {r.doc_id for r in table.select("doc_id", d.hits(spark, bench(spark, [(1, "X")]), F.col("text")).alias("h")).where("h.n_hit > 0").collect()} == {11}
    try:
        d.collect_items(bench(spark, [(1, "a b c")]), most=2)
        raise AssertionError("not refused")
    except ValueError as error:
        assert "split it" in str(error)


def test_a_benchmark_in_parts_finds_what_one_set_finds(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, 40)) for i in range(6)] + [(7, "only five words stand here"), (8, None), (9, sentence(rng, 300)), (9, items_end := sentence(rng, 30))]
    bits = lambda k: " ".join(items[k][1].split()[5:20])
    rows = [(1, sentence(rng, 50)), (2, sentence(rng, 300) + " " + " ".join(bits(k) for k in (0, 3))), (3, items[8][1]), (4, " ".join(bits(k) for k in range(6)) + " " + items_end), (5, None)]
    whole = docs(spark, rows).select("doc_id", d.hits(spark, bench(spark, items), F.col("text")).alias("h")).collect()
    parts = docs(spark, rows).select("doc_id", d.hits(spark, bench(spark, items), F.col("text"), most=100).alias("h")).collect()
    assert len(d.pieces(bench(spark, items), d.WINDOW, 100)) > 3
    assert sorted(map(repr, parts)) == sorted(map(repr, whole)) and any(len(r.h["items"]) > 5 for r in whole)
    two = next(r.h for r in parts if r.doc_id == 2)
    assert two.n_hit == 30 and 20 * 15 < two.n_words <= 20 * 30  # contaminated by both parts together only
