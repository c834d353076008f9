import random
import re
from collections import Counter

import numpy as np
import pytest

from packetflow.llm import near_dedup as nd
from tests.llm.cases import COLUMNS, VOCABULARY, docs, odd_rows, sentence


def brute(rows):
    """Classes by comparing every pair: weighted Jaccard over dictionaries, then connected components."""
    texts = {}
    for i, t in sorted(((i, t or "") for i, t, *_ in rows if i is not None)):
        texts.setdefault(i, t)
    words = {i: re.findall(r"[0-9a-z\u0080-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in texts.items()}
    df, known = Counter(), nd.WordHashes()
    bucket = lambda w: int(nd.bucket_of(np.array([known[w.encode()]], np.uint64))[0])
    everything = [re.findall(r"[0-9a-z\u0080-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, *_ in rows]
    for ws in everything:
        df.update({bucket(w) for w in ws})
    n = len(rows) + 1
    idf = lambda w: 1 + np.log(n / (df[bucket(w)] + 1)) / max(np.log(n), 1)
    sets = {}
    for i, ws in words.items():
        size = min(5, len(ws))
        grams = Counter(tuple(ws[j : j + size]) for j in range(len(ws) - size + 1)) if ws else {}
        sets[i] = {g: c * sum(map(idf, g)) / size for g, c in grams.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b:
                x, y = sets[a], sets[b]
                same = words[a] == words[b] if words[a] else not words[b] and texts[a] == texts[b]
                shared = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
                if same or (x and y and shared / (sum(x.values()) + sum(y.values()) - shared) >= nd.SIMILARITY):
                    p, q = top(a), top(b)
                    root[max(p, q)] = min(p, q)
    return {i: top(i) for i in texts}


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def planted(seed):
    rng = random.Random(seed)
    rows, passage = [], sentence(rng, 60)
    for group in range(12):
        text = sentence(rng, 120)
        for k in range(rng.choice([1, 2, 5, 9])):
            rows.append((len(rows) * 3 + 1, edited(rng, text, rng.choice([0, 0, 1, 2, 3]))))
    for _ in range(30):  # a shared passage does not make copies
        rows.append((len(rows) * 3 + 1, sentence(rng, 60) + " " + passage + " " + sentence(rng, 60)))
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    rows = planted(1) + [(5000 + (i or 0), t) if i else (i, t) for i, t, *_ in odd_rows()]
    got = {r.doc_id: r.class_id for r in nd.classes(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_links_beyond_the_first_hub_are_found(spark):
    """A chain in which only neighbours are similar is one class."""
    rng = random.Random(4)
    words = sentence(rng, 200).split()
    rows = []
    for i in range(6):
        rows.append((i, " ".join(words)))
        at = rng.randrange(0, 190)
        words = words[:at] + [rng.choice(VOCABULARY) for _ in range(9)] + words[at + 9 :]
    assert {r.class_id for r in nd.classes(docs(spark, rows)).collect()} == set(brute(rows).values())


def test_samples_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(3)
    shingles = np.sort(rng.integers(1, 2**63, 300, dtype=np.uint64))
    a, b = rng.uniform(1, 3, 300).astype(np.float32), rng.uniform(1, 3, 300).astype(np.float32)
    a[:40], b[-40:] = 0, 0
    x, y = a > 0, b > 0
    got = nd.samples(np.concatenate((shingles[x], shingles[y])), np.concatenate((a[x], b[y])), np.array([0, x.sum()]), 3000)
    want = nd.weighted_jaccard((shingles[x], a[x]), (shingles[y], b[y]))
    assert abs((got[0] == got[1]).mean() - want) < 0.03
    assert want == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), rel=1e-5)


def test_components_of_paths_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 6), (7, 7), (200, 150)]
    got = {r.id: r.root for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 150, 150: 150}


def test_keep_one(spark):
    kept = nd.keep_one(docs(spark, odd_rows()))
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 4, 6, 7, 8, 9, 10, 11, 12]
    assert nd.keep_one(docs(spark, odd_rows()).limit(0)).count() == 0


def test_pairs_of_non_hubs_in_a_bucket_of_many_classes_are_found(spark, monkeypatch):
    """Documents that all share one bucket, most of them alone in their class, with a few pairs between documents that are no early hub."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, 120)) for i in range(60)]
    rows += [(100 + i, edited(rng, rows[k][1], 1)) for i, k in enumerate([7, 19, 33, 48])]
    real = nd.bands_of

    def one_bucket(texts, idf):
        got = real(texts, idf)
        one = lambda bands: [b and [1] for b in bands]
        return (one(got[0]), *got[1:]) if isinstance(got, tuple) else one(got)

    monkeypatch.setattr(nd, "bands_of", one_bucket)
    monkeypatch.setattr(nd, "HUBS", 1)
    monkeypatch.setattr(nd, "GROWTH", 2)
    got = {r.doc_id: r.class_id for r in nd.classes(docs(spark, rows)).collect()}
    want = brute(rows)
    assert len(set(want.values())) < len(rows) and got == want


def test_a_crowd_of_edited_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Documents that share a bucket and most of their text, yet are kept apart by edits of their own; some are similar through a rare edit."""
    rng = random.Random(13)
    base = sentence(rng, 150)
    rows = [(i, edited(rng, base, 9)) for i in range(150)]
    rows += [(500 + i, edited(rng, rows[k][1], 1)) for i, k in enumerate([3, 60, 61, 149])] + [(600 + i, edited(rng, base, 1)) for i in range(6)]
    real, compared, verified = nd.bands_of, [], nd.verified

    def one_bucket(texts, idf):
        bands, sums = real(texts, idf)
        return [b and [1] for b in bands], sums

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(nd, "bands_of", one_bucket)
    monkeypatch.setattr(nd, "verified", counted)
    got = {r.doc_id: r.class_id for r in nd.classes(docs(spark, rows)).collect()}
    assert got == brute(rows) and 100 < len(set(got.values())) < len(rows) - 6
    assert sum(compared) < 5 * len(rows)


def test_further_links_join_classes(spark):
    roots = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (5, 2), (3, 3), (6, 3)], "id long, root long")
    got = {r.id: r.root for r in nd.joined(roots, spark.createDataFrame([(9, 5), (5, 4), (12, 11)], "a long, b long")).collect()}
    assert got == {1: 1, 4: 1, 2: 1, 5: 1, 9: 1, 3: 3, 6: 3, 11: 11, 12: 11}
