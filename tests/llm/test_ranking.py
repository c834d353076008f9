import random

import numpy as np

from packetflow.llm import ranking as r
from tests.llm.cases import COLUMNS, docs, odd_rows, sentence


def test_bradley_terry_finds_the_minimum():
    rng = np.random.default_rng(1)
    d = rng.normal(size=(500, 4)) + [0.5, 0, -0.2, 0]
    w = r.bradley_terry(d)
    loss = lambda v: np.mean(np.log1p(np.exp(-d @ v))) + r.RIDGE / 2 * v @ v
    for i in range(4):
        for step in (-1e-3, 1e-3):
            assert loss(w) <= loss(w + step * np.eye(4)[i])


def labelled(spark, count=400):
    rng = random.Random(8)
    rows = []
    for i in range(count):
        words = sentence(rng, rng.randrange(20, 120)).split()
        junk = i % 5 == 0
        rows.append((i, " ".join(w + "%%" for w in words) if junk and i % 2 else " ".join(w for w in words[:20] for _ in range(5)) if junk else " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(count) if i % 3] + [(0, None, 0), (None, 1, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    return docs(spark, rows), labels


def test_held_out_accuracy_and_repeatability(spark):
    table, labels = labelled(spark)
    model = r.fit(table, labels)
    scores = {x.doc_id: x.s for x in table.select("doc_id", r.score(spark, model, table.text).alias("s")).collect()}
    held_out = [i for i in scores if i % 3 == 0]
    assert np.mean([(scores[i] >= r.CUT) == (i % 5 != 0) for i in held_out]) > 0.97
    assert all(0 <= s <= 1 for s in scores.values())
    again = r.fit(table.repartition(5), labels.repartition(3))
    assert np.array_equal(again.weights, model.weights) and again.cut == model.cut


def test_the_bound_on_labelled_rows_holds(spark):
    table, labels = labelled(spark)
    seen = []
    original, r.fit_arrays = r.fit_arrays, lambda x, y, seed: seen.append(len(y)) or original(x, y, seed)
    try:
        r.fit(table, labels, most=50)
    finally:
        r.fit_arrays = original
    assert seen[0] <= 50


def test_one_label_odd_rows_and_empty_tables(spark):
    table = docs(spark, odd_rows())
    labels = spark.createDataFrame([(4, 1, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    model = r.fit(table, labels)
    scores = [x[0] for x in table.select(r.score(spark, model, table.text)).collect()]
    assert len(scores) == 14 and all(abs(s - 0.5) < 1e-9 for s in scores)
    model = r.fit(*labelled(spark))
    assert r.keep_best(table, model, 0.5).columns == COLUMNS
    assert r.keep_best(table.limit(0), model, 0.5).count() == 0
    assert r.fit(table.limit(0), labels.limit(0)).cut == np.log(r.CUT / (1 - r.CUT))


def test_the_shape_is_that_of_the_whole_word():
    buckets = r.ShapeBuckets()
    assert buckets["a" * 250 + "99"] == buckets["a9"] != buckets["a"] and max(map(len, buckets)) == 2


def test_the_fit_on_all_labels_counts_every_document(spark, monkeypatch):
    """The moments are those of all labelled documents, in one group or many, and the cut is their quantile."""
    table, labels = labelled(spark)
    seen, original = [], r.fit_arrays
    monkeypatch.setattr(r, "fit_arrays", lambda a, b, seed: seen.append((a, b)) or original(a, b, seed))
    r.fit(table, labels)
    x, y = seen[0]
    monkeypatch.setattr(r, "MOST_LABELLED", 50)  # a bound on the sample does not bound this fit
    for size in (20_000, 40):
        monkeypatch.setattr(r, "IN_GROUP", size), monkeypatch.setattr(r, "LEAST", 4), monkeypatch.setattr(r, "MOST_SORTED", size)
        model = r.fit_all(table, labels)
        assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-3)
        raw = model.raw(x)
        assert np.isclose(model.cut, np.quantile(raw, (y == 0).mean()))
        assert np.mean((raw >= model.cut) == (y == 1)) > 0.97
        again = r.fit_all(table.repartition(5), labels.repartition(3))
        assert np.array_equal(again.weights, model.weights) and again.cut == model.cut
    rare = labels.where("quality = 1 OR doc_id = 5")
    model = r.fit_all(table, rare)
    assert np.any(model.weights != 0)
    one = r.fit_all(table, labels.where("quality = 1"))
    assert not one.weights.any() and r.fit_all(table.limit(0), labels).cut == one.cut
