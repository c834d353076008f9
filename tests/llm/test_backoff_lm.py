import math
import random
import re
from collections import Counter

import pytest

from packetflow.llm import backoff_lm as lm
from tests.llm.cases import odd_rows, sentence


def brute(rows, mu=lm.MU):
    """The same model with counts in dictionaries, walked token by token."""
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"]
    one, two = Counter(), Counter()
    for _, text, held in rows:
        if not held:
            ws = tokens(text)
            one.update(ws)
            two.update(zip(["</s>", *ws], ws))
    n, v = sum(one.values()), len(one)
    out = []
    for i, text, held in rows:
        ws, state, base, score = tokens(text), "</s>", 0.0, 0.0
        for w in ws:
            p = (one[w] + 1) / (n + v + 1)
            base += math.log10(p)
            if two[state, w]:
                score += math.log10((two[state, w] + mu * p) / (one[state] + mu))
            else:
                score += math.log10(mu / (one[state] + mu)) + math.log10(p)
            state = w
        out.append((i, held, len(ws), sum(one[w] > 0 for w in ws), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_mb", [8, 0.002])
def test_equals_brute_force_in_one_block_and_in_many(spark, block_mb):
    rng = random.Random(3)
    rows = [(i, t, i is not None and i % 7 == 2) for i, t, *_ in odd_rows()] + [(50 + i, sentence(rng, rng.randrange(80)).title(), i % 3 == 0) for i in range(60)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, held_out boolean, block string")
    assert rows_of(lm.score(table, block_mb=block_mb)) == brute(rows)


def test_weights_of_a_state_sum_to_one():
    """Over all words and the unknown one: arcs plus failure arc times the empty state's."""
    one, two, mu = {"a": 3, "b": 2, "c": 1}, {"a": 2, "b": 1}, lm.MU
    n, v, c = 6, 3, 3
    p = {w: (one[w] + 1) / (n + v + 1) for w in one} | {"?": 1 / (n + v + 1)}
    assert sum((two.get(w, 0) + mu * p[w]) / (c + mu) for w in p) == pytest.approx(1)


def test_no_training_rows_and_empty_table(spark):
    table = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in lm.score(table).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score == 0.0
    assert lm.score(table.limit(0)).count() == 0
