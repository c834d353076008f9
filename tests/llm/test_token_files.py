import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetflow.llm import token_files as tf
from packetflow.session import new_folder
from tests.llm.cases import docs, odd_rows, sentence


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 65_535), max_size=120), st.sampled_from([1, 7, 64]))
def test_any_ids_come_back(ids, block):
    coded = tf.encode_ids(np.array(ids, np.int64), block)
    assert tf.decode_ids(coded, len(ids), block).tolist() == ids


def test_long_runs_come_back_and_predictable_ids_are_short():
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 50_257, 20_000)
    cycle = np.tile(rng.integers(0, 50_257, 50), 400)
    skewed = np.minimum(rng.zipf(1.3, 20_000), 50_000)
    sizes = []
    for ids in (noise, cycle, skewed, np.zeros(20_000, np.int64)):
        blocks = tf.encode_ids(ids)
        assert np.array_equal(tf.decode_ids(blocks, len(ids)), ids)
        sizes.append(sum(map(len, blocks)) / len(ids))
    assert sizes[0] < 2.2 and sizes[1] < 0.35 and sizes[2] < 1.8 and sizes[3] < 0.1


def test_blocks_stand_alone_and_damage_is_seen():
    ids = np.random.default_rng(2).integers(0, 3_000, 3 * tf.BLOCK)
    blocks, checks = tf.packed(ids)
    assert np.array_equal(tf.decode_ids(blocks[1:2], tf.BLOCK), ids[tf.BLOCK : 2 * tf.BLOCK])
    assert np.array_equal(tf.unpacked(blocks, checks, len(ids)), ids)
    broken = bytearray(blocks[2])
    broken[40] ^= 1
    with pytest.raises(ValueError, match="block 2 is damaged"):
        tf.unpacked([blocks[0], blocks[1], bytes(broken)], checks, len(ids))


TEXTS = ["", " ", "a", " a", "a ", "a  b", "a\n b \n\nc", "x  y", "tab\t here", "don't we'll 12 345 ... !?", "é ü 漢字 😀  ß", "<|endoftext|> in <|endoftext|>text", "a <|endoftext|>", "\r\n \r\n", "a  b", "ﬁ ́x"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1' .\n\t é!<|>")), max_size=40))
def test_words_have_the_tokenizers_ids(text):
    pieces = tf.piece_ids(tf.tokenizer_path())
    for t in [text, *TEXTS]:
        assert np.frombuffer(pieces.ids([t])[0], "<u2").tolist() == pieces.tokenizer.encode(t, add_special_tokens=False).ids


def test_words_are_asked_together_and_forgotten_when_they_are_many():
    rng = random.Random(7)
    texts = [*TEXTS, *("".join(rng.choice(["é", "a", "b", "'s", "7", ".", "\n", " ", " ", "Ġ", "<|endoftext|>", "漢"]) for _ in range(rng.randrange(60))) for _ in range(400))]
    pieces = tf.PieceIds(tf.tokenizer_path(), most=50)
    words = sorted({w for t in texts for w in t.split(" ") if w and not w[0].isspace() and not w[-1].isspace()})
    want = [pieces.tokenizer.encode(" " + w, add_special_tokens=False).ids for w in words]
    assert len(words) > 256 and pieces.coded_words(words).to_pylist() == want and pieces.coded_words([]).to_pylist() == []
    for size in (1, 500, 1_000_000):
        portions = list(tf.in_portions(pa.array(texts), size))
        assert [t for p in portions for t in p.to_pylist()] == texts and (len(portions) == 1) == (size == 1_000_000)
        got = [np.frombuffer(x, "<u2").tolist() for p in portions for x in pieces.ids(p)]
        assert got == [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip_in_order(spark):
    rng = random.Random(5)
    rows = odd_rows() + [(50 + i, sentence(rng, rng.randrange(200))) for i in range(40)]
    path = new_folder(spark, "tokens")
    tf.write_tokens(docs(spark, rows), path, tf.tokenizer_path())
    got = sorted(tf.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    tokenizer = tf.piece_ids(tf.tokenizer_path()).tokenizer
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *map(len, want[:-1])]).tolist()
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4 for r in got)


def test_chunks_close_at_documents(spark, monkeypatch):
    assert tf.CHUNK % tf.BLOCK == 0
    path = new_folder(spark, "tokens")
    tf.write_tokens(docs(spark, [(1, None)]).limit(0), path, tf.tokenizer_path())
    assert tf.read_tokens(spark, path).count() == 0


def test_an_id_takes_one_coding_step(monkeypatch):
    """The class of an id that no model predicted is part of the same step; it was a step of its own."""
    ids = np.random.default_rng(3).integers(0, 65_536, 5 * 64)
    steps, narrow = [], tf.Coder.narrow
    monkeypatch.setattr(tf.Coder, "narrow", lambda self, *parts: (steps.append(self.reading), narrow(self, *parts))[1])
    assert tf.decode_ids(tf.encode_ids(ids, 64), len(ids), 64).tolist() == ids.tolist()
    assert steps == [False] * 64 + [True] * 64


def test_words_are_looked_up_once_a_portion(monkeypatch):
    """The table is made ready for look-ups once, also if words are added; it was twice."""
    pieces, calls, index_in = tf.PieceIds(tf.tokenizer_path()), [], tf.pc.index_in
    monkeypatch.setattr(tf.pc, "index_in", lambda *a: (calls.append(1), index_in(*a))[1])
    for text in ("a new word", "a new word and newer ones", "a new word"):
        assert np.frombuffer(pieces.ids([text])[0], "<u2").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) == 3


def test_a_carry_runs_through_full_words():
    coder = tf.Coder(2, 4)
    coder.out[:] = [5, 0xFFFFFFFF, 0xFFFFFFFF, 0, 7, 8, 0, 0]
    coder.at += [3, 2]
    coder.carry(np.array([0, 1]))
    assert coder.out.tolist() == [6, 0, 0, 0, 7, 9, 0, 0]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([3, 40, 2_000]), st.integers(1, 700))
def test_long_blocks_of_any_skew_come_back(seed, most, block):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([rng.integers(0, most, 900), np.tile(rng.integers(0, 65_536, 5), 100), rng.integers(65_000, 65_536, 300)])
    assert np.array_equal(tf.decode_ids(tf.encode_ids(ids, block), len(ids), block), ids)
    coded = tf.encode_ids(ids, block)
    at = int(rng.integers(len(coded)))
    broken = bytearray(coded[at])
    broken[int(rng.integers(4, len(broken)))] ^= 1 << int(rng.integers(8))
    coded[at] = bytes(broken)
    got = tf.decode_ids(coded, len(ids), block)  # ends, and harms no other block
    assert np.array_equal(np.delete(got, np.s_[at * block : (at + 1) * block]), np.delete(ids, np.s_[at * block : (at + 1) * block]))
