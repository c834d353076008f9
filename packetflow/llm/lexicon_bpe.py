"""Byte-level BPE with a lexicon: frequent words are looked up in a memory-mapped automaton, all others are merged exactly.

A text is cut at the tokenizer's special tokens and then into words by its pattern.  The frequent words of the corpus and their ids are compiled
into a minimal acyclic transducer: one state for all words that go on alike, so common endings are stored once.  An arc carries a
number, a path adds them up, and the sum is the word's place in the table of its ids.  The transducer is one file of flat arrays; Spark hands it
to every executor, whose tasks map the same pages into memory, and a batch of words is looked up side by side, byte by byte.

A word that is not in it is merged by the tokenizer's own list, the pair with the least rank first and leftmost, for many words side by side;
a very long word has a heap of its own.  So the lexicon decides how fast a text is encoded and never how.

The frequent words come from all texts: each task keeps a Misra-Gries summary of KEPT words, the summaries are added up, and the most
frequent LEXICON words of at most WORD_BYTES bytes go in; that bounds the file at any size of the corpus.

The file must be a byte-level BPE without normalizer, prefix space, dropout or post-processor (ValueError otherwise); its truncation and padding are not used.

Defined cases: a null or empty text has no ids; bytes that are not UTF-8 count as U+FFFD; words of any length are merged whole; equal rows are
coded alike; an id the tokenizer does not have decodes to nothing; an empty table has no rows; other columns stay as they are.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from packetflow.llm.tables import free_name, quoted, table
from packetflow.llm.token_files import tokenizer_path
from packetflow.session import new_folder, settle

LEXICON, KEPT, WORD_BYTES = 1 << 16, 1 << 17, 64
#: Words longer than this are merged one by one with a heap.
LONG = 256
#: Words a task remembers between texts, and characters that are encoded together.
REMEMBERED, PORTION = 1 << 17, 1 << 20

# Fixed value: the pattern of byte-level BPE that cuts a text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the files of byte-level tokenizers."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE tokenizer: ids of bytes, ranks of pairs, bytes of ids, special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or not plain or odd or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("not a plain byte-level BPE file")
        if any(a.get(k) for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens with options are not supported")
        letters, vocab = byte_letters(), model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            known = all(c in letters for c in token)
            raw[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs] or [0], np.int32)
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts, self.raw = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(raw), np.uint8)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.own = Tokenizer.from_str(text).pre_tokenizer
        self.assigned: set[str] = set()

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token is one word."""
        if self.cut is None or not self.cut.search(text):
            return self._words(text)
        return list(chain.from_iterable([x] if x in self.special else self._words(x) for x in self.cut.split(text)))

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            fresh = set(text) - self.assigned
            if fresh:
                self.assigned |= {c for c in fresh if unicodedata.category(c) != "Cn"}
                if not fresh <= self.assigned:  # characters of a later Unicode, which ``regex`` may class in another way than the tokenizer
                    return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, _NONE where they do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.merge_long(w)
        for at in range(0, len(short), 8192):
            some = short[at : at + 8192]
            for i, ids in zip(some, self.merge_together([words[i] for i in some])):
                out[i] = ids
        return out

    def merge_together(self, words: list[bytes]) -> list[np.ndarray]:
        """In each round every word merges its pair of least rank, all occurrences of it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        which, out = np.arange(len(words)), [np.zeros(0, np.int32)] * len(words)
        ranks = np.full(len(ids), _NONE)
        ends = np.cumsum(sizes) - 1
        ranks[:-1] = self.rank(ids[:-1], ids[1:])
        ranks[ends] = _NONE
        while len(which):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            done = least == _NONE
            if done.any():
                for w, a, n in zip(which[done].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[w] = ids[a : a + n].copy()
                stay = np.repeat(~done, sizes)
                ids, ranks, which, sizes, least = ids[stay], ranks[stay], which[~done], sizes[~done], least[~done]
                if not len(which):
                    break
            hit = ranks == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # Of overlapping pairs (a a a) the first, third, ... merge.
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.merged[ranks[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ranks[at] = ranks[at + 1]  # the end of a word stays one; others are looked up again below
            sizes = np.add.reduceat(stay.astype(np.int64), np.cumsum(sizes) - sizes)
            moved = np.cumsum(stay)[at] - 1
            ids, ranks = ids[stay], ranks[stay]
            last = np.zeros(len(ids), bool)
            last[np.cumsum(sizes) - 1] = True
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            changed = changed[~last[changed]]
            ranks[changed] = self.rank(ids[changed], ids[changed + 1])
            ranks[last] = _NONE
        return out

    @lru_cache(1)  # noqa: B019  one vocabulary per task
    def table(self) -> dict[tuple[int, int], int]:
        return {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(self.keys.tolist(), self.ranks.tolist())}

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word: a heap of pairs over a linked list."""
        table, ids = self.table(), self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := table.get((a, b))) is not None]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = int(self.merged[rank]), -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := table.get((ids[x], ids[y]))) is not None:
                    heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def texts(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each row of ids."""
        flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        known = (flat >= 0) & (flat < len(self.sizes))
        flat = np.where(known, flat, 0)
        sizes = np.where(known, self.sizes[flat], 0)
        raw = self.raw[spans(self.starts[flat], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every span, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Lexicon:
    """Words and their ids as a minimal acyclic transducer in flat arrays: ``arcs`` (state * 256 + byte, sorted), their ``targets`` and
    ``numbers``, which states are ``final``, and word number k has ``ids[at[k] : at[k + 1]]``."""

    FIELDS = {"arcs": np.int64, "targets": np.int32, "numbers": np.int32, "final": np.uint8, "at": np.int32, "ids": np.int32}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compiled(cls, words: list[bytes], ids: list[np.ndarray]) -> Lexicon:
        """From distinct words in ascending order, adding one after the other to an automaton that is minimal behind the last of them."""
        register: dict[tuple, int] = {}
        arcs: list[tuple] = []  # of each finished state: final, ((byte, state), ...)
        # The path of the last word: final flag and arcs of each open state.
        path: list[list] = [[False, []]]

        def close(depth: int) -> None:
            while len(path) > depth:
                final, out = path.pop()
                key = (final, tuple(out))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(arcs)
                    arcs.append(key)
                if path:
                    byte, _ = path[-1][1][-1]
                    path[-1][1][-1] = (byte, state)

        before = b""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
            close(same + 1)
            for byte in word[same:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            before = word
        close(0)
        count, start = [0] * len(arcs), len(arcs) - 1  # the first state is closed last
        rows = []
        for state, (final, out) in enumerate(arcs):  # targets are closed before their sources
            number = int(final)
            for byte, target in out:
                rows.append((state * 256 + byte, target, number))
                number += count[target]
            count[state] = number
        table = np.array(rows, np.int64).reshape(-1, 3)
        table = table[np.argsort(table[:, 0])]
        final = np.array([f for f, _ in arcs] + [start & 0xFF, start >> 8 & 0xFF, start >> 16 & 0xFF, start >> 24], np.uint8)
        sizes = np.array([0, *map(len, ids)], np.int64)
        arrays = {"arcs": table[:, 0], "targets": table[:, 1], "numbers": table[:, 2], "final": final, "at": np.cumsum(sizes), "ids": np.concatenate([*ids, np.zeros(0, np.int32)])}
        return cls({k: arrays[k].astype(kind) for k, kind in cls.FIELDS.items()})

    def packed(self) -> bytes:
        arrays = [getattr(self, k) for k in self.FIELDS]
        head = np.array([len(a) for a in arrays], np.int64).tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The file's arrays, mapped into memory."""
        head = np.memmap(path, np.int64, "r", shape=len(cls.FIELDS))
        arrays, at = {}, head.nbytes
        for (name, kind), size in zip(cls.FIELDS.items(), head.tolist()):
            arrays[name] = np.memmap(path, kind, "r", at, size) if size else np.zeros(0, kind)
            at += -(-size * np.dtype(kind).itemsize // 8) * 8
        return cls(arrays)

    def numbers_of(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon does not have it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        start = int.from_bytes(self.final[-4:].tobytes(), "little")
        state, number = np.full(len(words), start, np.int64), np.zeros(len(words), np.int64)
        going = np.flatnonzero((sizes <= WORD_BYTES) & (len(self.arcs) > 0))
        state[(sizes > WORD_BYTES) | (len(self.arcs) == 0)] = -1
        for place in range(WORD_BYTES):
            going = going[sizes[going] > place]
            if not len(going):
                break
            key = state[going] * 256 + text[starts[going] + place]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = self.arcs[at] == key
            state[going] = np.where(found, self.targets[at], -1)
            number[going] += self.numbers[at]
            going = going[found]
        return np.where((state >= 0) & (self.final[state] == 1), number, -1)


class Encoder:
    """Texts to ids: remembered words, then the lexicon, then merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.forget()

    def forget(self) -> None:
        outer = self

        class Index(dict):
            def __missing__(self, word: str) -> int:
                self[word] = n = len(self)
                outer.new.append(word)
                return n

        self.new: list[str] = []
        self.index, self.pool = Index(), np.zeros(0, np.int32)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Ids of the words met since the last call."""
        special = self.vocabulary.special
        words = [b"" if w in special else w.encode("utf-8", "replace") for w in self.new]
        ids: list[np.ndarray | None] = [np.array([special[w]], np.int32) if w in special else None for w in self.new]
        if self.lexicon is not None:
            for i, k in enumerate(self.lexicon.numbers_of(words).tolist()):
                if k >= 0 and ids[i] is None:
                    ids[i] = self.lexicon.ids[self.lexicon.at[k] : self.lexicon.at[k + 1]]
        missing = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(missing, self.vocabulary.merge([words[i] for i in missing])):
            ids[i] = x
        sizes = np.array([len(x) for x in ids], np.int64)
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size, self.pool = np.concatenate([self.size, sizes]), np.concatenate([self.pool, *ids])
        self.new = []

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        portion: list[list[str]] = []
        room = PORTION
        for i, text in enumerate(texts):
            portion.append(self.vocabulary.words(text))
            room -= len(text)
            if room <= 0 or i == len(texts) - 1:
                yield from self.together(portion)
                portion, room = [], PORTION

    def together(self, portion: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.index) > REMEMBERED:
            self.forget()
        counts = np.fromiter(map(len, portion), np.int64, len(portion))
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(portion)), np.int64, int(counts.sum()))
        if self.new:
            self.learn()
        sizes = self.size[which]
        ids = self.pool[spans(self.at[which], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return (ids[a:b] for a, b in zip(ends, ends[1:]))


def plain_texts(texts: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()]


def frequent_words(docs: DataFrame, vocabulary, text: str = "text", count: int = LEXICON) -> list[bytes]:
    """At most ``count`` of the most frequent words of all texts, ascending: those above the least frequency that still leaves so few."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = Counter(), vocabulary.value.opened
        for batch in batches:
            for t in plain_texts(batch.column(0)):
                held.update(known.words(t))
                if len(held) > 2 * KEPT:
                    least = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -KEPT)[-KEPT])
                    held = Counter({w: n - least for w, n in held.items() if n > least})
        rows = [(raw, n) for w, n in held.items() if w not in known.special and len(raw := w.encode("utf-8", "replace")) <= WORD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    words = docs.select(F.col(text).cast("string")).mapInArrow(summary, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Words by the power of 2^(1/8) of their frequency: a few hundred classes.
    words = settle(words.select("word", F.floor(F.log2("n") * 8).cast("int").alias("class")), "words")
    room, least = count, None
    for row in words.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect():
        room -= row["n"]
        if room < 0:
            break
        least = row["class"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in words.where(F.col("class") >= least).select("word").collect())


class Coding:
    """A tokenizer and a lexicon that Spark has handed to all executors."""

    def __init__(self, spark: SparkSession, path: str, words: list[bytes]):
        self.text = open(path, encoding="utf-8").read()
        vocabulary = Vocabulary(self.text)
        self.vocabulary = spark.sparkContext.broadcast(Sent(self.text))
        folder = new_folder(spark, "lexicon")
        place = f"{folder}/{PurePosixPath(folder).name}.bin"
        words = sorted(set(words))
        where = spark._jvm.org.apache.hadoop.fs.Path(place)
        stream = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where)
        stream.write(bytearray(Lexicon.compiled(words, vocabulary.merge(words)).packed()))
        stream.close()
        spark.sparkContext.addFile(place)
        self.name = PurePosixPath(place).name

    def encode(self, text: Column) -> Column:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        vocabulary, name = self.vocabulary, self.name

        @F.arrow_udf(T.BinaryType())
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = Encoder(vocabulary.value.opened, Lexicon.mapped(SparkFiles.get(name)))
            for texts in batches:
                yield pa.array([x.astype("<u4").tobytes() for x in encoder.ids(plain_texts(texts))], pa.binary())

        return encoded(text)

    def round_trip(self, text: Column) -> Column:
        """The ids of a text and the text of those ids, from one Python worker: a struct of ``ids`` and ``decoded``."""
        vocabulary, name = self.vocabulary, self.name
        kind = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

        @F.arrow_udf(kind)
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = vocabulary.value.opened
            encoder = Encoder(known, Lexicon.mapped(SparkFiles.get(name)))
            for texts in batches:
                ids, decoded = [], []
                for at in range(0, len(texts), 1000):
                    some = list(encoder.ids(plain_texts(texts[at : at + 1000])))
                    ids += [x.astype("<u4").tobytes() for x in some]
                    decoded += known.texts(some)
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

        return both(text)

    def decode(self, ids: Column) -> Column:
        """The text of ids as ``encode`` returns them."""
        vocabulary = self.vocabulary

        @F.arrow_udf(T.StringType())
        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            opened = vocabulary.value.opened
            for rows in batches:
                yield pa.array(opened.texts([np.frombuffer(x or b"", "<u4") for x in rows.to_pylist()]), pa.string())

        return decoded(ids)


class Sent:
    """The tokenizer's file on its way to the tasks; each Python worker opens it once."""

    def __init__(self, text: str):
        self.text = text

    def __getstate__(self) -> dict:
        return {"text": self.text}

    @cached_property
    def opened(self) -> Vocabulary:
        return opened(self.text)


@lru_cache(2)
def opened(text: str) -> Vocabulary:
    return Vocabulary(text)


def coding(docs: DataFrame, path: str, text: str = "text", lexicon: int = LEXICON) -> Coding:
    """The tokenizer of the file ``path`` with a lexicon of the frequent words of ``docs``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Sent(open(path, encoding="utf-8").read()))
    return Coding(spark, path, frequent_words(docs, sent, text, lexicon))


def encoded(docs: DataFrame, codes: Coding, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with their ids."""
    return docs.withColumn(free_name(docs, ids), codes.encode(F.col(quoted(text)).cast("string")))


def op11_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codes = coding(docs, tokenizer_path())
    rows = docs.select("doc_id", codes.round_trip(F.col("text")).alias("r")).select("doc_id", "r.ids", "r.decoded")
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
