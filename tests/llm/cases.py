"""Small tables for these operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, measures int, _hits string, _gone int, size long, `key` string, block int"
COLUMNS = [c.strip().split()[0].strip("`") for c in SCHEMA.split(",")]
VOCABULARY = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lo", "mi")]


def sentence(rng, words):
    return " ".join(rng.choice(VOCABULARY) for _ in range(words)) + "."


def docs(spark, rows):
    """Documents from (doc_id, text[, lang, source]) with further columns whose names the operators use inside."""
    full = [(i, t, *(rest or ["en", "s"]), None if t is None else len(t), False, 7, "x", 1, 5, "k", 3) for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows(seed=1):
    """Null, empty, blank and very long texts, ties, repeated rows, null columns."""
    rng = random.Random(seed)
    same = sentence(rng, 80)
    long = "\n".join(sentence(rng, 200) for _ in range(150))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, same), (4, same), (5, same, "de", None), (6, long), (7, "word"), (8, "é ü 漢字 😀 ß"), (None, sentence(rng, 60)),
        (9, sentence(rng, 70), None, None), (10, "a\x00b   c"), (11, "x " * 300), (12, sentence(rng, 90), "en", "t"),
    ]
