import hashlib
import math
import random

import numpy as np
import pytest

from packetflow.llm import vector_codes as m

SCHEMA = "vec_id long, embedding array<double>, label int, code string, `a.b` int, _label string, _coded int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in rows], SCHEMA)


def brute(rows, parts, entries, rounds, scale):
    """Every part against every entry, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    length = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * length : (p + 1) * length]
    first = sorted({i: v for i, v in reversed(kept) if i is not None}.items())[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v in kept:
                groups.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(book)]
    codes = []
    for i, v in kept:
        best = [near(cut(v, p), book) for p, book in enumerate(books)]
        codes.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return books, codes


@pytest.mark.parametrize("spread,cell", [(0.02, 8), (0.3, 32), (3.0, 1)])
def test_equals_comparing_all(spark, spread, cell):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, spread) for _ in range(12)], rng.choice([None, 1, 2])) for i in range(220)]
    rows += [(300 + i, rows[3][1], 1) for i in range(40)] + [(500, [0.0] * 12, 2)]
    rng.shuffle(rows)
    books = m.train(table(spark, rows).repartition(5), 4, 16, 3, 64, cell)
    want, codes = brute(sorted((i, v) for i, v, _ in rows), 4, 16, 3, 64)
    assert books.entries.tolist() == want
    assert books.sha256 == hashlib.sha256(",".join(str(x) for b in want for e in b for x in e).encode()).hexdigest()
    got = m.coded(table(spark, rows), books, 64)
    assert got.columns == ["vec_id", "embedding", "label", "a.b", "_label", "_coded", "code", "error"]
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == sorted(codes)
    errors = {}
    for i, v, label in rows:
        errors[label] = errors.get(label, 0) + dict((c[0], c[2]) for c in codes)[i]
    assert {(r.label, r.label_error) for r in m.with_label_errors(got).collect()} == set(errors.items())


def test_lists_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    grid = m.Grid(rng.integers(-300, 300, (256, 6)), 64)
    points = rng.integers(-400, 400, (3000, 6))
    at, distance = grid.nearest(points)
    full = ((points[:, None] - grid.book[None]) ** 2).sum(2)
    assert (full.argmin(1) == at).all() and (full.min(1) == distance).all()
    assert sum(map(len, grid.memo.values())) < len(grid.memo) * 256


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2, 0.3, 0.4], 1), (1, [0.1, 0.2, 0.3, 0.3], 1), (2, [1e300, -1e300, 0.0, 0.5], None), (None, [0.1, 0.2, 0.3, 0.4], 3)]
    bad = [(0, None, 1), (0, [], 1), (0, [0.1, None, 0.3, 0.4], 1), (0, [nan, 0.2, 0.3, 0.4], 1), (0, [0.1, -inf, 0.3, 0.4], 1), (5, [0.1] * 8, 1), (6, [0.1] * 3, 1)]
    books = m.train(table(spark, good + bad))
    assert books.entries[:, :, 0].tolist() == [[102, m.BOUND], [204, -m.BOUND], [307, 0], [375, 512]]
    got = m.coded(table(spark, good + bad), books).collect()
    assert sorted((r.vec_id or 0, r.code) for r in got) == [(0, "00000000"), (1, "00000000"), (1, "00000000"), (2, "01010101")]
    assert m.train(table(spark, bad[:4])) is None and m.train(table(spark, [])) is None and m.train(table(spark, good[3:])) is None
