import math
import random
import re

import pytest
from pyspark.sql import functions as F

from packetflow.llm import quality_rules as q
from tests.llm.cases import COLUMNS, docs, odd_rows, sentence


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered), sum("A" <= c <= "Z" for c in text)


def test_measures_equal_brute_force(spark):
    rng = random.Random(3)
    rows = odd_rows() + [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40))) + rng.choice(["", "\nA#\nA#\n \n"])) for i in range(60)]
    measured = q.measure(docs(spark, rows))
    name = measured.columns[-1]  # the input has a column of the usual name
    assert name != "measures" and measured.columns[:-1] == COLUMNS
    got = sorted(((r.text or "", tuple(r[name][c] for c in q.MEASURES)) for r in measured.collect()), key=repr)
    assert got == sorted(((t or "", brute(t)) for _, t, *_ in rows), key=repr)


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.3), (50, 3, 0.1), (2000, 4, 0.01), (500_000, 1480, 0.0033)])
def test_binomial_tail_is_exact(spark, n, k, p):
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    got = spark.range(1).select(q.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-7)
    assert spark.range(1).select(q.binomial_tail(F.lit(n).cast("long"), F.lit(n).cast("long"), p)).first()[0] == 1.0


def labelled(spark, good, bad, lang="en"):
    rng = random.Random(5)
    rows = [(i, sentence(rng, 60), lang, "s") for i in range(good)] + [(10_000 + i, " ".join(w + "$$$" for w in sentence(rng, 60).split()), lang, "s") for i in range(bad)]
    return docs(spark, rows), spark.createDataFrame([(i, int(i < 10_000), 0) for i, *_ in rows] + [(1, None, 0), (77_777, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_certified_cutoffs_reject_the_bad_and_keep_the_good(spark):
    table, labels = labelled(spark, 400, 40)
    cutoffs = q.fit(table, labels, max_false_rejection=0.06).collect()
    assert len(cutoffs) == 1 and cutoffs[0].n_good == 400 and cutoffs[0].cutoff_symbols == 0.02
    kept = {r.doc_id for r in q.keep_good(table, labels, max_false_rejection=0.06).collect()}
    assert kept == set(range(400))


def test_too_few_labels_certify_nothing(spark):
    table, labels = labelled(spark, 30, 40)
    assert q.fit(table, labels).first().cutoff_symbols is None
    assert q.keep_good(table, labels).count() == 70  # the base rules alone


def test_guarantee_counts_false_rejections(spark):
    """Good documents above a cutoff stop its certification."""
    rng = random.Random(6)
    rows = [(i, sentence(rng, 60) + (" " + "#" * 40 if i % 4 == 0 else ""), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    cutoff = q.fit(docs(spark, rows), labels, max_false_rejection=0.06).first().cutoff_symbols
    share = max(40 / brute(t)[1] for i, t, *_ in rows if i % 4 == 0)
    assert cutoff > 0.08 and cutoff <= share + 0.05


def test_odd_rows_and_empty_tables(spark):
    table = docs(spark, odd_rows())
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.keep_good(table, labels)
    assert got.columns == COLUMNS
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 4, 4, 5, 6, 9, 12]
    assert q.keep_good(table.limit(0), labels.limit(0)).count() == 0
