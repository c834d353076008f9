import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from packetflow.llm import lexicon_bpe as m
from packetflow.llm.tables import table
from packetflow.llm.token_files import tokenizer_path
from tests.llm.cases import COLUMNS, docs, odd_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    return m.Vocabulary(open(tokenizer_path()).read())


def texts(seed, count=400):
    rng = random.Random(seed)
    # The last four: a letter and a digit of later Unicode versions, a no-break space, a separator control.
    some = [*"ab '\n\t 1é中😀<|>s.,", "<|endoftext|>", "aaaa", "'s", "'LL", " ", "　", "\r\n", "\U00010940", "\U00011de1", "\xa0", " \x1c"]
    return ["".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(count)] + ["a" * 3000, "ab" * 900, "x" * 257, "", "\x00" * 300]


def test_merging_equals_the_library(library, vocabulary):
    rows = texts(1)
    for want, got in zip(library.encode_batch(rows, add_special_tokens=False), m.Encoder(vocabulary, None).ids(rows)):
        assert want.ids == got.tolist()
    words = [w.encode() for t in rows for w in t.split(" ") if w]
    assert all((a == vocabulary.merge_long(w)).all() for a, w in zip(vocabulary.merge(words), words))


def test_decoding_equals_the_library(library, vocabulary):
    rows = [np.random.default_rng(i).integers(0, 50_257, 30) for i in range(300)]
    assert vocabulary.texts(rows) == [library.decode(r.tolist(), skip_special_tokens=False) for r in rows]
    assert vocabulary.texts([np.array([60_000, -1]), np.zeros(0, np.int64)]) == ["", ""]


def test_the_automaton_is_minimal_and_whole(vocabulary, tmp_path):
    rng = random.Random(4)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randrange(1, 7))) + rng.choice([b"", b"ing", b"ed"]) for _ in range(500)})
    lexicon = m.Lexicon.compiled(words, vocabulary.merge(words))
    (tmp_path / "lexicon").write_bytes(lexicon.packed())
    lexicon = m.Lexicon.mapped(str(tmp_path / "lexicon"))
    others = [w + b"x" for w in words] + [b"", b"z", words[0][:-1] + b"\xff", b"a" * 500]
    assert lexicon.numbers_of(words + others).tolist() == [*range(len(words)), *[words.index(w) if w in words else -1 for w in others]]
    # As many states as there are different sets of endings (the empty set aside).
    endings = {p: frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(lexicon.final) - 4 == len(set(endings.values()))
    for k, w in enumerate(words):
        assert lexicon.ids[lexicon.at[k] : lexicon.at[k + 1]].tolist() == vocabulary.merge([w])[0].tolist()
    empty = m.Lexicon.compiled([], [])
    assert empty.numbers_of([b"a", b""]).tolist() == [-1, -1]


@pytest.mark.parametrize("lexicon", [0, 5, 10_000])
def test_any_lexicon_gives_the_same_ids(spark, library, lexicon):
    rows = [(i, t) for i, t in enumerate(texts(2, 60))] + odd_rows()
    data = docs(spark, rows).withColumnRenamed("key", "ids").repartition(3)
    codes = m.coding(data, tokenizer_path(), lexicon=lexicon)
    out = m.encoded(data, codes)
    assert out.columns == [*[c if c != "key" else "ids" for c in COLUMNS], "_ids"]
    got = out.withColumn("decoded", codes.decode(out["_ids"])).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r._ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert m.encoded(data.limit(0), codes).count() == 0


def test_empty_tables(spark):
    empty = docs(spark, odd_rows()).limit(0)
    assert m.encoded(empty, m.coding(empty, tokenizer_path())).count() == 0


def test_frequent_words_are_counted_over_all_texts(spark, vocabulary):
    data = docs(spark, [(i, "common words here" if i % 2 else f"rare{i} common") for i in range(40)]).repartition(7)
    sent = spark.sparkContext.broadcast(m.Sent(open(tokenizer_path()).read()))
    assert m.frequent_words(data, sent, count=5) == sorted([b"common", b" common", b" words", b" here", b"rare"])


def test_the_query(spark, library):
    rows = {r.doc_id: r for r in m.op11_lexicon_bpe(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want = len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode()
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_sha256, rows[r.doc_id].decoded_sha256) == (want[0], *(hashlib.sha256(x).hexdigest() for x in want[1:]))


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        m.Vocabulary(open(tokenizer_path().replace("byte_bpe_50k", "word_bpe_49k")).read())
