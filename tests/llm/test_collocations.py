import random
import re
from collections import Counter

import pytest

from packetflow.llm import collocations as m
from packetflow.llm.near_dedup import WordHashes
from tests.llm.cases import docs, odd_rows


def brute(rows, least, subsumed, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    frequent = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = {}
    for (lang, p), a in frequent.items():
        if any(x == lang and len(q) > len(p) and inside(p, q) and 100 * b >= subsumed * a for (x, q), b in frequent.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


@pytest.mark.parametrize("subsumed,period", [(100, 16), (60, 2), (100, 1)])
def test_equals_counting_all_phrases(spark, subsumed, period):
    rng = random.Random(subsumed + period)
    words = ["a", "B", "cé", "d'", "e\x00", "漢"]
    fixed = ["a b cé d' a b", "cé cé cé", "B a. e\x00"]
    text = lambda: " ".join(rng.choice(words + fixed) + rng.choice(["", "", ",", "\n", "\t", "!?"]) for _ in range(rng.randrange(1, 60)))
    rows = [(i, text(), rng.choice(["en", "de", None]), "s") for i in range(150)]
    rows += [(200 + i, "a " * 50, "en", "s") for i in range(5)] + [(300 + i, rows[0][1], "en", "s") for i in range(30)]
    table = docs(spark, rows).repartition(5)
    got = [tuple(r) for r in m.collocations(table, least=20, subsumed=subsumed, top=25, period=period).collect()]
    assert sorted(got) == sorted(brute([(lang, t) for _, t, lang, _ in rows], 20, subsumed, 25)) and got


def test_every_short_phrase_belongs_to_one_chunk():
    rng = random.Random(5)
    for _ in range(60):
        symbols = [rng.choice(["a", "b", "c", "\n"]) for _ in range(rng.randrange(0, 80))]
        text = " ".join(symbols).encode()
        want = Counter(tuple(symbols[i : i + k]) for k in range(1, 6) for i in range(len(symbols) - k + 1))
        got = Counter()
        for chunk in m.parse(text, WordHashes(), m.OVERLAP, 3) if text else ():
            s = chunk.decode().split(" ")
            got.update(tuple(s[i : i + k]) for k in range(1, 6) for i in range(len(s) - k + 1) if i + k > m.OVERLAP)
        pure = lambda counts: {p: n for p, n in counts.items() if "\n" not in p}
        assert pure(got) == pure(want)


def test_copies_do_not_grow_the_dictionary(spark):
    rng = random.Random(2)
    passage = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(300))
    one, many = (m.dictionary(docs(spark, [(i, passage) for i in range(n)])).count() for n in (1, 50))
    assert one == many


def test_a_full_table_only_costs_time(spark, monkeypatch):
    rows = [(i, "a b c d e f g h " * 3) for i in range(12)]
    want = [tuple(r) for r in m.collocations(docs(spark, rows), least=10).collect()]
    monkeypatch.setattr(m, "MAX_BITS", 10)
    assert sorted(want) == sorted(tuple(r) for r in m.collocations(docs(spark, rows), least=10).collect())


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**12
    row = spark.range(1).selectExpr(f"(1000 * CAST({big} AS DECIMAL(18,0)) * CAST({big * 3} AS DECIMAL(18,0))) div (CAST({big} AS DECIMAL(18,0)) * CAST({big + 7} AS DECIMAL(18,0))) AS score").first()
    assert row.score == 1000 * big * big * 3 // (big * (big + 7))


def test_odd_rows_and_empty_tables(spark):
    table = docs(spark, odd_rows())
    got = [tuple(r) for r in m.collocations(table, least=2).collect()]
    assert sorted(got) == sorted(brute([(r.lang, r.text) for r in table.collect()], 2, 100, m.TOP))
    assert m.collocations(table.limit(0)).count() == 0
    assert m.collocations(docs(spark, [(1, None), (2, "")]), least=1).count() == 0
