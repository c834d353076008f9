"""Token ids in compressed binary blocks: an adaptive context-mixing range coder.

Texts are encoded by a public tokenizer, END is put after each document, and the ids are written in ascending order of the documents.
The file format is a folder of Parquet files; one row is a chunk of whole documents: ``part`` and ``chunk`` (its place), the documents' ids
and token counts, ``blocks`` and ``checks``.  A block is BLOCK ids (the last of a chunk may be shorter) coded on its own: the
models start anew, and a CRC-32 of the ids guards it.

Three models predict the next id: the id that followed the last two ids (order 2), the one that followed the last id
(order 1), and adaptive frequencies of the 64 id classes (order 0).  Two logistic mixers turn the confidence in the order-2 and
order-1 prediction into the probabilities of "order 2 is right" and "else order 1 is right"; an id that neither
predicted is coded by its class in the same coding step, and its ten bits in the class stand as they are.  Predictions follow
every id; mixers and frequencies take in all ids too, but PERIOD ids at a time.  All models are integers, so encoder and
decoder agree on any machine.  The blocks of a chunk are coded side by side in numpy: step t codes the t-th id of every block.

Defined cases: a null or empty text is END alone; documents of one id are ordered by their text; a null id comes first; a document
longer than a chunk is a chunk of its own; no documents make an empty folder with a schema; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from packetflow.llm.tables import table
from packetflow.session import new_folder

END = 0
BLOCK = 2048
#: Ids of a chunk: its blocks are coded side by side.
CHUNK = 2048 * 4000
SLOTS = 2048  # contexts of each order and block
CLASSES = 64
_SPACE = "\u0120"  # a space, in the vocabulary of a byte-level tokenizer

_LINE = 1 << 12  # probabilities are twelve bits
_SHIFT, _ASKED = 1 << 13, 1 << 14
# The probability of a no by the mixed sum (one half at _ASKED + _SHIFT, in 1/256 steps); below _ASKED the question is not asked.
_NO = np.clip(np.rint(_LINE / (1 + np.exp((np.arange(2 * _ASKED) - _ASKED - _SHIFT) / 256))), 16, _LINE - 16).astype(np.int32)
_NO[:_ASKED] = _LINE
_STRETCH = np.clip(np.rint(256 * np.log((np.arange(_LINE) + 0.5) / (_LINE - np.arange(_LINE) - 0.5))), -2047, 2047).astype(np.int32)
# A coding step has 26 bits: twelve of each question's answer, the rest is for the shares of the classes.
_STEP, _SHARES = 26, 9
# Registers of 64 bits that move by 32.
_WORD, _BITS, _MOST = np.uint64(32), np.uint64(_STEP), np.uint64((1 << 32) - 1)


class Coder:
    """Range coders side by side: ``narrow`` takes each lane to a part of its range."""

    def __init__(self, lanes: int, room: int = 0, data: list[bytes] | None = None):
        self.range = np.full(lanes, np.uint64((1 << 64) - 1))
        self.reading = data is not None
        if data is not None:
            words = [np.frombuffer(x, "<u4") for x in data]
            self.at = np.cumsum([0, *[len(x) for x in words[:-1]]]).astype(np.int64)
            self.data = np.concatenate([*words, np.zeros(8, "<u4")]).astype(np.uint64)
            self.value = (self.data[self.at] << _WORD) | self.data[self.at + 1]
            self.at += 2
        else:
            self.low, self.room, self.out = np.zeros(lanes, np.uint64), room, np.zeros(lanes * room, np.uint32)
            self.at = np.arange(lanes, dtype=np.int64) * room

    def target(self) -> np.ndarray:
        """The place of each lane's value in its range, which has 2^26 places."""
        return (self.value // (self.range >> _BITS)).astype(np.int32)

    def narrow(self, start: np.ndarray, stop: np.ndarray) -> None:
        part = (self.range >> _BITS).view(np.int64)
        before, span = (part * start).view(np.uint64), (part * (stop - start)).view(np.uint64)
        if self.reading:
            self.value -= before
        else:
            self.low += before
            self.carry((self.low < before).nonzero()[0])
        move = (span <= _MOST).nonzero()[0]
        at = self.at.take(move)
        if self.reading:
            self.value[move] = (self.value.take(move) << _WORD) | self.data.take(at, mode="clip")
        else:
            low = self.low.take(move)
            self.out[at] = low >> _WORD
            self.low[move] = low << _WORD
        self.at[move] = at + 1
        span[move] <<= _WORD
        self.range = span

    def carry(self, lanes: np.ndarray) -> None:
        """One more in the words written before; a lane's first word never runs over."""
        at = self.at.take(lanes) - 1
        while len(at):
            more = self.out.take(at) + np.uint32(1)
            self.out[at] = more
            at = at[more == 0] - 1

    def finish(self) -> list[bytes]:
        for _ in range(2):
            self.out[self.at] = self.low >> _WORD
            self.low <<= _WORD
            self.at += 1
        return [self.out[i * self.room : end].astype("<u4").tobytes() for i, end in enumerate(self.at.tolist())]


class Question:
    """The probability of a yes from two confidences, mixed in the logistic domain; all of it per block, in flat arrays."""

    def __init__(self, lanes: int):
        self.asked = [np.full(lanes * 32, 2, np.int32) for _ in range(2)]
        self.yes = [np.ones(lanes * 32, np.int32) for _ in range(2)]
        self.weights = [np.full(lanes, 1 << 15, np.int32) for _ in range(2)]
        self.inputs = [np.zeros(lanes * 32, np.int32) for _ in range(2)]

    def shares(self, i: int) -> np.ndarray:
        """What each context of a confidence adds to the mixed sum."""
        weighted = self.inputs[i].reshape(-1, 32) * self.weights[i][:, None] >> 16
        return _within(weighted.reshape(-1), 2 - _SHIFT // 2, _SHIFT // 2 - 1) + _SHIFT // 2

    def learn(self, contexts: list[np.ndarray], counts: list[tuple[np.ndarray, np.ndarray]], error: np.ndarray) -> None:
        """From a period: contexts and errors of each id; how often each context was asked, and was right."""
        for i, (asked, yes) in enumerate(counts):
            change = np.einsum("ij,ij->j", self.inputs[i].take(contexts[i]), error)
            self.weights[i] = _within(self.weights[i] + (change >> 14), -(1 << 19), 1 << 19).astype(np.int32)
            self.asked[i] += asked
            self.yes[i] += yes
            self.inputs[i] = _STRETCH.take((self.yes[i] << 12) // self.asked[i])


def _within(values: np.ndarray, least: int, most: int) -> np.ndarray:
    return np.minimum(np.maximum(values, least), most)


#: The next confidence by the confidence and, from 4 on, for a right prediction; it stands above the sixteen bits of an id.
_LEVELS = np.array([0, 0, 1, 1, 1, 2, 3, 3], np.int32) << 16
#: The mixers and the frequencies learn after these ids of a block, and then after every PERIOD ids.
PERIOD = 128
_EARLY = (8, 16, 32, 64)
#: So many ids of a block are written at once; all the periods are whole groups.
GROUP = 4


class Models:
    """What has been seen of each block: ids predicted by order 2 and order 1 with their confidence, classes of order 0.

    Predictions and confidences follow every id.  The mixers and frequencies follow all ids, but a period at a time, so a
    writer, who knows the ids, asks them about a group of ids at once.
    """

    def __init__(self, lanes: int, reading: bool):
        self.lanes, self.reading = lanes, reading
        self.slots, self.asked = np.arange(2 * lanes).reshape(2, lanes) * SLOTS, np.arange(lanes) * 32
        self.next = np.zeros(2 * lanes * SLOTS, np.int32)
        self.counts = np.full((lanes, CLASSES), 4, np.int32)
        self.questions = [Question(lanes), Question(lanes)]
        self.last, self.before, self.misses = (np.zeros(lanes, np.int32) for _ in range(3))
        # The ids of the period: contexts, the probability of a no to each question, and the answers.
        self.contexts, self.given = np.empty((2, PERIOD, lanes), np.int64), np.empty((2, PERIOD, lanes), np.int32)
        self.differ, self.denied, self.none = (np.empty((PERIOD, lanes), bool) for _ in range(3))
        self.missed: list[np.ndarray] = []
        self.steps = self.held = 0
        self.renew()

    def follow(self, slots: np.ndarray, guess: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> None:
        """Learn what followed the contexts."""
        self.next[slots] = np.where(sure > 1, guess, ids) | _LEVELS.take(sure + 4 * (guess == ids))

    def remember(self, none: np.ndarray) -> None:
        self.misses = ((self.misses << 1) | none) & 7

    def weigh(self, rows: int | slice, guess: np.ndarray, sure: np.ndarray, misses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of 2^26 places, the first ones go to the classes (the size of a share, their end), then come order 1 (the end) and order 2."""
        contexts, differ = self.contexts[:, rows], self.differ[rows]
        np.not_equal(guess[0], guess[1], out=differ)
        np.add(self.asked, sure[0] * 8 + sure[1] * 2 + differ, out=contexts[0])
        np.add(self.asked, misses * 4 + sure[0], out=contexts[1])
        sums = self.shares[0].take(contexts[0])
        sums += self.shares[1].take(contexts[1])
        p = self.given[0, rows] = _NO.take(sums >> 16)
        q = self.given[1, rows] = _NO.take(sums & 0xFFFF)
        share = p * q >> 24 + _SHARES - _STEP
        return share, share << _SHARES, p << _STEP - 12

    def parts(self, denied: np.ndarray, missed: np.ndarray, kinds: np.ndarray, share: np.ndarray, none: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of each id begins and ends; of the missed ones, by their classes and the size of their shares."""
        start, stop = np.where(denied, none, some), np.where(denied, some, np.int32(1 << _STEP))
        bounds = self.bounds.take(kinds)
        start.reshape(-1)[missed], stop.reshape(-1)[missed] = share * (bounds >> 16), share * (bounds & 0xFFFF)
        self.missed.append(kinds)
        return start, stop

    def look(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The slots of both contexts."""
        slots = np.empty((2, *last.shape), np.int64)
        np.add(last, before * 30_011, out=slots[0])
        slots[1] = last
        slots &= SLOTS - 1
        slots += self.slots if last.ndim == 1 else self.slots[:, None]
        return slots

    def write(self, coder: Coder, ids: np.ndarray) -> np.ndarray:
        """Code the next group of ids of each block; tells which of them no model predicted."""
        ids = ids.astype(np.int32)
        rows, n = slice(self.held, self.held + len(ids)), len(ids)
        last = np.concatenate([self.last[None], ids[:-1]])
        slots = self.look(last, np.concatenate([self.before[None], last[:-1]]))
        guess, sure, misses = np.empty((2, n, self.lanes), np.int32), np.empty((2, n, self.lanes), np.int32), np.empty((n, self.lanes), np.int32)
        denied, none = self.denied[rows], self.none[rows]
        for t in range(n):
            held = self.next.take(slots[:, t])
            self.follow(slots[:, t], np.bitwise_and(held, 0xFFFF, out=guess[:, t]), np.right_shift(held, 16, out=sure[:, t]), ids[t])
        np.not_equal(ids, guess[0], out=denied)
        np.logical_and(denied, ids != guess[1], out=none)
        for t in range(n):
            misses[t] = self.misses
            self.remember(none[t])
        share, classes, some = self.weigh(rows, guess, sure, misses)
        missed = none.reshape(-1).nonzero()[0]
        kinds = missed % self.lanes * CLASSES + (ids.reshape(-1).take(missed) >> 10)
        start, stop = self.parts(denied, missed, kinds, share.reshape(-1).take(missed), classes, some)
        for t in range(n):
            coder.narrow(start[t], stop[t])
        self.last, self.before = ids[-1], last[-1]
        none = none.copy()
        self.done(n)
        return none

    def read(self, coder: Coder, spare: Places) -> np.ndarray:
        """The next id of each block."""
        i, slots = self.held, self.look(self.last, self.before)
        held = self.next.take(slots)
        guess, sure = held & 0xFFFF, held >> 16
        share, classes, some = self.weigh(i, guess, sure, self.misses)
        at = coder.target()
        denied, none = np.less(at, some, out=self.denied[i]), np.less(at, classes, out=self.none[i])
        out = np.where(denied, guess[1], guess[0])
        # An id that was not predicted: its class by the frequencies so far; its place in the class stands as it is.
        missed = none.nonzero()[0]
        share = share.take(missed)
        kind = self.kinds.take((missed << _SHARES) + at.take(missed) // share, mode="clip")
        coder.narrow(*self.parts(denied, missed, missed * CLASSES + kind, share, classes, some))
        out[missed] = (kind.astype(np.int32) << 10) | spare.take(missed, none)
        self.follow(slots, guess, sure, out)
        self.remember(none)
        self.last, self.before = out, self.last
        self.done(1)
        return out

    def done(self, n: int) -> None:
        self.steps, self.held = self.steps + n, self.held + n
        if self.held == PERIOD or self.steps in _EARLY:
            self.learn()

    def learn(self) -> None:
        """Take in the ids of the period."""
        n, self.held = self.held, 0
        contexts, given = self.contexts[:, :n], self.given[:, :n]
        denied, none, differ = self.denied[:n], self.none[:n], self.differ[:n]
        # 0: order 2 was right, 1: order 1, 2: neither, 3: neither, and order 1 was not asked.
        answer = denied.view(np.int8) + none.view(np.int8) + (none > differ)
        counts = [np.bincount((c * 4 + answer).reshape(-1), minlength=self.lanes * 128).reshape(-1, 4).T.astype(np.int32) for c in contexts]
        errors = [given[0] - denied * np.int32(_LINE), (given[1] - none * np.int32(_LINE)) * (denied & differ)]
        self.questions[0].learn(contexts, [(c[0] + c[1] + c[2] + c[3], c[0]) for c in counts], errors[0])
        self.questions[1].learn(contexts, [(c[1] + c[2], c[1]) for c in counts], errors[1])
        if self.missed:
            self.counts += 24 * np.bincount(np.concatenate(self.missed), minlength=self.lanes * CLASSES).reshape(-1, CLASSES).astype(np.int32)
            self.missed = []
        self.renew()

    def renew(self) -> None:
        """The tables of a period: both questions' sums side by side, and where each class begins among the shares."""
        both = [[q.shares(i) for q in self.questions] for i in range(2)]
        # A context is odd if the predictions differ: else order 1 is not asked what order 2 has denied.
        both[0] = [both[0][0] + _ASKED, (both[0][1] + _ASKED) * (np.arange(self.lanes * 32, dtype=np.int32) & 1)]
        self.shares = [(p << 16) + q for p, q in both]
        sums = self.counts.cumsum(1, dtype=np.int32)
        starts = np.zeros((self.lanes, CLASSES + 1), np.int32)
        starts[:, 1:] = sums * ((1 << _SHARES) - CLASSES) // sums[:, -1:] + np.arange(1, CLASSES + 1, dtype=np.int32)
        self.bounds = ((starts[:, :-1] << 16) + starts[:, 1:]).reshape(-1)
        if self.reading:
            # Classes begun up to each share, over all blocks: a block begins 64, so modulo 64 it is the block's own.
            begun = np.zeros(self.lanes << _SHARES, np.uint8)
            begun[(starts[:, :-1] + (np.arange(self.lanes)[:, None] << _SHARES)).reshape(-1)] = 1
            self.kinds = np.add.accumulate(begun, out=begun) - np.uint8(1) & np.uint8(CLASSES - 1)


class Places:
    """Ten bits for each id that no model predicted, per block: the low bytes, then the rest, four to a byte."""

    def __init__(self, blocks: list[bytes], block: int):
        self.values, self.at = np.zeros((len(blocks), block + 1), np.int32), np.arange(len(blocks)) * (block + 1)
        for i, x in enumerate(blocks):
            data, n = np.frombuffer(x, np.uint8), len(x) * 4 // 5
            high = data[n:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
            self.values[i, :n] = data[:n] + (high.reshape(-1)[:n].astype(np.int32) << 8)

    def take(self, lanes: np.ndarray, taken: np.ndarray) -> np.ndarray:
        values = self.values.take(self.at.take(lanes))
        self.at += taken
        return values

    @staticmethod
    def packed(ids: np.ndarray) -> bytes:
        high = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
        high[: len(ids)] = ids >> 8 & 3
        return ids.astype(np.uint8).tobytes() + np.bitwise_or.reduce(high.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8), axis=1).tobytes()


def _lanes(n: int, block: int) -> tuple[int, int]:
    """The number of blocks of n ids, and the ids of the first; the last is filled up with zeros."""
    return -(-n // block), min(n, block)


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The blocks of some ids (below 65,536)."""
    if not len(ids):
        return []
    lanes, steps = _lanes(len(ids), block)
    padded = np.zeros(lanes * steps, np.uint16)
    padded[: len(ids)] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    coder, models = Coder(lanes, steps + 4), Models(lanes, False)
    missed = np.ascontiguousarray(np.concatenate([models.write(coder, grid[t : t + GROUP]) for t in range(0, steps, GROUP)]).T)
    # A block: the length of the coded part, the coded part, the packed places.
    return [len(x).to_bytes(4, "little") + x + Places.packed(row[m]) for x, row, m in zip(coder.finish(), padded.reshape(lanes, steps), missed)]


def decode_ids(blocks: list[bytes], n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of some blocks, ``n`` in all."""
    if not n:
        return np.zeros(0, np.uint16)
    lanes, steps = _lanes(n, block)
    ends = [4 + int.from_bytes(x[:4], "little") for x in blocks]
    coder, spare = Coder(lanes, data=[x[4:e] for x, e in zip(blocks, ends)]), Places([x[e:] for x, e in zip(blocks, ends)], steps)
    grid, models = np.zeros((steps, lanes), np.uint16), Models(lanes, True)
    for t in range(steps):
        grid[t] = models.read(coder, spare)
    return grid.T.reshape(-1)[:n]


class PieceIds:
    """Ids of texts, from a table of words: the ids of each word after a space, and whether it may be cut off.

    The tokenizer cuts a text into words before it merges bytes, and a single space between two characters that are no
    white space always begins a word.  So a text may be cut there, and equal words have equal ids wherever they stand.
    The tokenizer is asked once for each word not seen before; the table forgets older words when it has grown too large.
    Cutting, looking up and joining are done by Arrow over a portion of texts at once.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(1 + max(vocabulary.values()), bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self.words, self.known, self.loose = pa.array([], pa.large_string()), _lists([]), np.zeros(0, bool)

    def coded(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text as the tokenizer gives them; a bounded number of its results is held at once."""
        parts = []
        for i in range(0, len(texts), 100):
            encodings = self.tokenizer.encode_batch_fast(texts[i : i + 100], add_special_tokens=False)
            parts.append(_lists([e.ids for e in encodings]))
        return pa.concat_arrays(parts) if parts else _lists([])

    def coded_words(self, words: list[str]) -> pa.ListArray:
        """The ids of each word after a space: many words are one text, in which an id that begins with a space begins a word."""
        texts = ["".join([" " + w for w in words[i : i + 256]]) for i in range(0, len(words), 256)]
        flat = self.coded(texts).flatten()
        starts = np.flatnonzero(self.spaced[flat.to_numpy()])
        if len(starts) != len(words) or (len(starts) and starts[0]):
            return self.coded([" " + w for w in words])
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), flat)

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each of some different words in the table, to which new ones are added."""
        place = pc.index_in(words, self.words)
        if place.null_count:
            if len(self.words) > self.most:
                self.words, self.known, self.loose = self.words.slice(0, 0), self.known.slice(0, 0), self.loose[:0]
                place = pc.index_in(words, self.words)
            unknown = place.is_null().to_numpy(zero_copy_only=False)
            new = words.filter(pa.array(unknown))
            place = place.fill_null(0).to_numpy().copy()
            place[unknown] = len(self.words) + np.arange(len(new))  # they come behind the words of the table, in their order
            plain = _strings(new)
            self.words = pa.concat_arrays([self.words, new])
            loose = np.array([not w or w[0].isspace() or w[-1].isspace() for w in plain], bool)
            # No ids are looked up for words that may not be cut off.
            lists = self.coded_words([w for w, x in zip(plain, loose.tolist()) if not x])
            at = np.where(loose, len(lists), np.cumsum(~loose) - 1)
            self.known = pa.concat_arrays([self.known, pa.concat_arrays([lists, _lists([[]])]).take(pa.array(at))])
            self.loose = np.concatenate([self.loose, loose])
            return place
        return place.to_numpy()

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as 16-bit numbers."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        # Every text has a first word, which no space precedes.
        start, words = cut.offsets.to_numpy()[:-1], cut.values.dictionary_encode()
        firsts = cut.values.take(pa.array(start)).dictionary_encode()
        place = self.places(words.dictionary)[words.indices.to_numpy()]
        loose = np.logical_or.reduceat(self.loose[place], start)
        place[start] = len(self.known) + firsts.indices.to_numpy()
        lists = pa.concat_arrays([self.known, self.coded(_strings(firsts.dictionary))])
        flat = lists.take(pa.array(place)).flatten().to_numpy()
        sizes = lists.value_lengths().to_numpy()[place]
        ends = np.cumsum(np.add.reduceat(sizes.astype(np.int64), start))
        # White space beside a space: the text may not be cut there, it is encoded whole.
        whole = np.flatnonzero(loose)
        out = [flat[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for i, x in zip(whole.tolist(), self.coded(_strings(texts.take(pa.array(whole))))):
            out[i] = x.values.to_numpy().tobytes()
        return out


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _lists(ids: list[list[int]]) -> pa.ListArray:
    """Lists of ids (below 65,536) as one array."""
    flat = np.fromiter(chain.from_iterable(ids), np.uint16)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))


@lru_cache(maxsize=1)
def piece_ids(path: str) -> PieceIds:
    """One table for all tasks of a worker."""
    return PieceIds(path)


def in_portions(texts: pa.Array, size: int = 16_000_000) -> Iterator[pa.Array]:
    """Texts without nulls in slices of about ``size`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1
        yield texts.slice(at, upto - at)
        at = upto


def packed(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Blocks and checksums; a long run of ids is coded in portions, so memory is bounded."""
    blocks = [b for i in range(0, len(ids), CHUNK) for b in encode_ids(ids[i : i + CHUNK])]
    return blocks, [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]


def unpacked(blocks: list[bytes], checks: list[int], n: int) -> np.ndarray:
    """The ids of a chunk, checked block by block."""
    per = CHUNK // BLOCK
    ids = np.concatenate([np.zeros(0, np.uint16), *[decode_ids(blocks[i : i + per], min(n - i * BLOCK, CHUNK)) for i in range(0, len(blocks), per)]])
    for i, check in enumerate(checks):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != check:
            raise ValueError(f"block {i} is damaged")
    return ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode doc_id and text into a folder of token files, ascending by doc_id; every partition writes one file."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("n_ids", T.LongType()), T.StructField("blocks", T.ArrayType(T.BinaryType())), T.StructField("checks", T.ArrayType(T.LongType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, pieces = TaskContext.get().partitionId(), 0, piece_ids(tokenizer)
        held: list[tuple[object, bytes]] = []
        end, total = np.array([END], "<u2").tobytes(), 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u2")
            blocks, checks = packed(ids)
            row = {"part": part, "chunk": chunk, "doc_ids": [i for i, _ in held], "sizes": [len(x) // 2 for _, x in held], "n_ids": len(ids), "blocks": blocks, "checks": checks}
            return pa.RecordBatch.from_pylist([row], arrow)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            coded = chain.from_iterable(map(pieces.ids, in_portions(batch.column(1))))
            for doc_id, ids in zip(doc_ids, coded):
                if held and total + len(ids) // 2 + 1 > CHUNK:
                    yield closed()
                    held, total, chunk = [], 0, chunk + 1
                held.append((doc_id, ids + end))
                total += len(ids) // 2 + 1
        if held:
            yield closed()

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of ids go to partitions in ascending order; equal ids share one.
    ordered = ordered.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(encode, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of token files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (32-bit, little-endian)."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, sizes = unpacked(row["blocks"], row["checks"], row["n_ids"]).astype("<u4"), np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                raw = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                n = len(sizes)
                columns = [[row["part"]] * n, [row["chunk"]] * n, row["doc_ids"], ends - sizes, sizes, [zlib.crc32(x) for x in raw]] + [raw] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    # One row per chunk, then one per part: sums before a chunk in two levels, neither of which holds documents.
    sizes = files.select("part", "chunk", "n_ids")
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    firsts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(before, "part")
    firsts = firsts.select("part", "chunk", (F.col("before") + F.col("inside")).alias("first"))
    rows = files.mapInArrow(decode, schema).join(firsts, ["part", "chunk"])
    return rows.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_tokens(spark, path)
