"""Language-model scoring with a weighted backoff automaton.

States are histories: the empty one and every word seen in training.  A seen bigram is an arc of its history's state, with
the smoothed weight log10((c(h,w) + MU P(w)) / (c(h) + MU)).  Any other word takes the state's failure arc, weight
log10(MU / (c(h) + MU)), to the empty state, whose arcs are the words with P(w) = (c(w) + 1) / (N + V + 1); an unknown word
has 1 / (N + V + 1).  This is Dirichlet-smoothed backoff: the weights of a state sum to one.  Documents are read from left to
right: each token moves from one state to the next and adds its arc's weight.

The automaton grows with the corpus, so it is never gathered or broadcast.  Documents are dealt into blocks of about
BLOCK_MB of text.  Each block sends the distinct n-grams it holds (64-bit hashes, with their training counts) to the
hash ranges they belong to; a range adds up the counts of all blocks and answers each block with the totals of just its
n-grams.  A block then builds the part of the automaton its own documents can reach, and walks it.  A frequent n-gram is one
entry per block, so no key is hot, and both sides are bounded: a block by its bytes, a range by the hash.

Defined cases: a null or empty text is the end token alone; words are equal after lower-casing A-Z; repeated documents count as
often as they come; without training documents every word is unknown and all words have the same probability; an empty
table stays empty; other columns are not read.  Two words share a hash with a probability of about V^2 / 2^65.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetflow.llm.tables import as_bytes, remainder, table
from packetflow.session import settle

MU = 500.0
BLOCK_MB = 8
#: Ranges of hashes: each takes about as many bytes of counts as a block takes of text.
END = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_SENT = "part int, block int, grams binary, counts binary, words int"
_ANSWERED = "block int, part int, totals binary, train_tokens long, vocabulary long"
_SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) | 1
        return h


def read_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts in turn, each closed by END, and the number of tokens of each text."""
    hashes = WordHashes()
    parts, sizes = [], []
    for text in texts:
        words = text.translate(_LOWER).split()
        parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        parts.append(np.array([END]))
        sizes.append(len(words) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def bigrams(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of each token after the one before it (END before the first), even; those of single words are odd."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[:1] = END
    mixed = (before * _ODD) ^ (tokens + (before >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
    return (mixed ^ (mixed >> np.uint64(29))) & ~np.uint64(1)


def requests(tokens: np.ndarray, pairs: np.ndarray, parts: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The block's distinct n-grams, cut into ``parts`` ranges of the hash, and all of them in order."""
    grams = np.unique(np.concatenate((tokens, pairs)))
    cuts = [0, *np.searchsorted(grams, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)).tolist(), len(grams)]
    return [grams[a:b] for a, b in zip(cuts, cuts[1:])], grams


def _ordered(rows: pa.Table) -> tuple[pa.Table, list[bytes]]:
    texts = rows.column("text").combine_chunks()
    return rows, as_bytes(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)


def _count(parts: int):
    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows, texts = _ordered(rows)
        tokens, sizes = read_block(texts)
        pairs = bigrams(tokens, sizes)
        train = np.repeat(~np.array(rows.column("held_out").to_pylist(), bool), sizes)
        ranges, grams = requests(tokens, pairs, parts)
        seen = np.concatenate((tokens[train], pairs[train]))
        counts = np.bincount(np.searchsorted(grams, seen), minlength=len(grams)).astype(np.uint32)
        at, out = 0, []
        for part, piece in enumerate(ranges):
            if len(piece):
                out.append((part, key[0].as_py(), piece.tobytes(), counts[at : at + len(piece)].tobytes(), len(piece)))
            at += len(piece)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()))], names=["part", "block", "grams", "counts", "words"])

    return count


def _add_up(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Totals of one range of hashes; each block gets those of its own n-grams, in its order."""
    pieces = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()])
    grams, at = np.unique(np.concatenate(pieces), return_inverse=True)
    totals = np.bincount(at, weights=counts, minlength=len(grams)).astype(np.uint64)
    words = (grams & np.uint64(1)).astype(bool)
    train, vocabulary = int(totals[words].sum()), int(np.count_nonzero(totals[words]))
    own = np.split(totals[at], np.cumsum([len(p) for p in pieces])[:-1])
    n = len(pieces)
    answer = [x.astype(np.uint32 if x.max(initial=0) < 2**32 else np.uint64).tobytes() for x in own]
    # The range's share of N and V stands on one of its rows.
    return pa.table(
        [rows.column("block").cast(pa.int32()).combine_chunks(), pa.array([key[0].as_py()] * n, pa.int32()), pa.array(answer, pa.binary()), pa.array([train] + [0] * (n - 1), pa.int64()), pa.array([vocabulary] + [0] * (n - 1), pa.int64())],
        names=["block", "part", "totals", "train_tokens", "vocabulary"],
    )


def _score(parts: int, train: int, vocabulary: int, mu: float, id_type: pa.DataType):
    def score(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, texts = _ordered(rows)
        tokens, sizes = read_block(texts)
        pairs = bigrams(tokens, sizes)
        ranges, grams = requests(tokens, pairs, parts)
        got = dict(zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist()))
        totals = np.concatenate([np.frombuffer(got[i], np.uint32 if len(got[i]) == 4 * len(p) else np.uint64).astype(np.int64) for i, p in enumerate(ranges) if len(p)])
        c = totals[np.searchsorted(grams, tokens)]
        state = np.concatenate(([0], c[:-1]))  # the count of the history: of END it is the number of documents
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        end = np.searchsorted(grams, END)
        state[first] = totals[end]
        arc = totals[np.searchsorted(grams, pairs)]
        p = (c + 1) / (train + vocabulary + 1)
        # A seen pair takes its arc, any other word the failure arc and then the word's arc of the empty state.
        weight = np.where(arc > 0, np.log10((arc + mu * p) / (state + mu)), np.log10(mu / (state + mu)) + np.log10(p))
        add = lambda x: np.add.reduceat(x, first)
        n = len(sizes)
        return pa.table(
            [rows.column("doc_id").combine_chunks(), rows.column("held_out").combine_chunks(), pa.array(sizes), pa.array(add((c > 0).astype(np.int64))), pa.array([train] * n, pa.int64()), pa.array(add(np.log10(p))), pa.array(add(weight))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return score


def score(docs: DataFrame, held_out: str = "held_out", mu: float = MU, block_mb: float = BLOCK_MB) -> DataFrame:
    """Train on the documents that are not held out and score all of them: ``docs`` has doc_id, text and a boolean."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / (block_mb * 1e6)))
    # Rows are dealt by what is in them, so a second reading deals them alike.
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(held_out).alias("held_out"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    sent = dealt.groupBy("block").applyInArrow(_count(blocks), _SENT)
    answered = settle(sent.groupBy("part").applyInArrow(_add_up, _ANSWERED), "grams")
    train, vocabulary = answered.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    walk = _score(blocks, train, vocabulary, mu, None)
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(walk, _SCORED.format(id=id_type))


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out")))
