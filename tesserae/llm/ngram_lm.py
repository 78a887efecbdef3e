"""Language-model scores by a weighted backoff automaton over smoothed word n-grams.

An n-gram that may be a context is a state.  An arc leaves a state for each
word that training texts have after it, weighs the word's smoothed log-probability,
and leads to the longest state that the text then ends with.  Where a state
has no arc for a word, its failure arc leads to the state without the
first word and weighs what smoothing leaves to it.  A text is scored in one
traversal from left to right, which carries the state and adds weights.

Counts cover all training texts, and so does the model: texts are cut into
blocks, each block asks for the n-grams that it holds, sums by n-gram answer,
and the block's texts walk through that part of the automaton that they can
reach.  No task or driver holds more of the model.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import Workspace, small_batches
from tesserae.llm.text import _ODD, mix

#: Bytes of text in a block, but for a longer text, which is a block of its own.
BLOCK = 8 << 20
#: Bytes of text whose n-grams one sum answers, on average.
PART = 8 << 20
#: Hash of the end of a text, which also stands before its first word.
END = np.uint64(0x51AB1E0FC0FFEE05)

#: The bits of a hash by which n-grams of two words or more are told apart; the others are 0 and take no room.  Words have all 64.
GRAM_BITS = ~np.uint64(0xFF)

BLOCKS = "block long, doc_ids array<long>, trained array<boolean>, sizes array<int>, ids binary, words binary"
PIECES = "block long, gram int, part int, keys binary, counts binary"
TOTALS = "block long, gram int, part int, totals binary, tokens long, seen long"
SCORES = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Smoothing:
    """The longest n-gram, how often a context must be seen to be a state, and Dirichlet strengths.

    A word after a state of order k has the probability (its count there +
    ``strength[k - 1]`` * its probability after the shorter state) / (the state's
    count + ``strength[k - 1]``); without a state, (count + 1) / (tokens + distinct
    tokens + 1).  Probabilities of all words, an unknown one included, sum to 1.
    """

    least: int = 2
    strength: tuple[float, ...] = (200.0, 50.0)

    @property
    def order(self) -> int:
        return len(self.strength) + 1


@dataclass(frozen=True)
class Size:
    """Training tokens and distinct training tokens."""

    tokens: int
    seen: int


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """An array, the bytes of equal rank beside each other, compressed."""
    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=level).compress(a.view(np.uint8).reshape(-1, width).T.tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the number of each place's key."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(first, dtype=np.int32) - 1
    return ordered[first], order[first], number


class LocalIds(dict):
    """Numbers of a block's words by first occurrence, and their hashes; 0 is the end."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q", [int(END)])

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return k


def _cut(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as numbers of words, an end before and after each text."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held, ids, docs = 0, LocalIds(), ([], [], [], [])

    def out() -> pa.RecordBatch:
        words = np.frombuffer(ids.hashes, np.uint64)
        lists = [pa.array([x], pa.list_(k)) for x, k in zip(docs, (pa.int64(), pa.bool_(), pa.int32()), strict=False)]
        blobs = [pa.array([pack(x, 5)], pa.binary()) for x in (np.concatenate(docs[3]), words)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *blobs], names=[x.split()[0] for x in BLOCKS.split(", ")])

    for batch in batches:
        for doc_id, trained, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = raw or b""
            if held and held + len(raw) > block:
                yield out()
                number, held, ids, docs = number + 1, 0, LocalIds(), ([], [], [], [])
            words = raw.lower().split()
            row = np.zeros(len(words) + 2, np.int32)
            row[1:-1] = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
            for x, v in zip(docs, (doc_id, trained, len(words) + 1, row), strict=True):
                x.append(v)
            held += len(raw) + 1
    if docs[0]:
        yield out()


class Grams:
    """The n-grams of a block, numbered in the order of their hashes.

    ``number[k]`` has the k-gram that ends at each place, -1 where there is none
    or, from three words on, where its context isn't a state; ``total[k]`` the training counts by number.
    """

    def __init__(self, row: dict, totals: dict[int, np.ndarray], least: int):
        self.sizes = np.array(row["sizes"], np.int64)
        self.ids, words = unpack(row["ids"], np.int32), unpack(row["words"], np.uint64)
        self.trained = np.repeat(np.array(row["trained"], bool), self.sizes + 1)
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]])  # the end before each text
        # a block without k-grams asks for none
        self.totals = defaultdict(partial(np.zeros, 0, np.int64), totals)
        self.least = least
        order = np.argsort(words)
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        self.keys = {1: words[order]}
        self.number = {1: rank[self.ids]}
        self.at: dict[int, np.ndarray] = {}
        self.words = words
        self._hash = words[self.ids]
        # the end before a text is a context, but no word that is read
        self.read = np.ones(len(self.ids), bool)
        self.read[self.first] = False

    def state(self, k: int) -> np.ndarray:
        """Whether each k-gram is a state, by number."""
        return self.totals[k] >= self.least

    def extend(self, k: int) -> None:
        """Number the k-grams; those below must be, in order.  From three words on, only where the context is a state."""
        before = self.number[k - 1][:-1]
        fits = self.read[1:] & (before >= 0)
        if k > 2:
            fits &= self.read[:-1]
            fits[fits] = self.state(k - 1)[before[fits]]
        place = np.flatnonzero(fits) + 1
        keys = mix(self._hash[place - 1] * _ODD + self.words[self.ids[place]]) & GRAM_BITS
        self._hash[:] = 0
        self._hash[place] = keys
        del before, fits
        self.keys[k], at, which = numbered(keys)
        self.at[k] = place[at]
        self.number[k] = np.full(len(self.ids), -1, np.int32)
        self.number[k][place] = which

    def counts(self, k: int) -> np.ndarray:
        """How often training texts of the block have each k-gram."""
        here = self.number[k][self.trained & self.read & (self.number[k] >= 0)]
        return np.bincount(here, minlength=len(self.keys[k])).astype(np.int64)


def _totals(table: pa.Table) -> dict[int, np.ndarray]:
    """Answers of all parts by order; parts are ranges of hashes, so they follow each other as keys do."""
    rows = sorted(table.select(["gram", "part", "totals"]).to_pylist(), key=lambda r: (r["gram"], r["part"]))
    return {g: np.concatenate([unpack(r["totals"], np.int64) for r in rows if r["gram"] == g]) for g in {r["gram"] for r in rows}}


def _pieces(block: int, grams: Grams, orders: list[int], parts: int) -> pa.RecordBatch:
    """The keys and counts of the block's n-grams, a row for each part of the keys."""
    rows = []
    for k in orders:
        keys, counts = grams.keys[k], grams.counts(k)
        of = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edges = np.searchsorted(of, np.arange(parts + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            here = slice(edges[p], edges[p + 1])
            rows.append((block, k, p, pack(np.diff(keys[here], prepend=np.uint64(0))), pack(counts[here])))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def _ask_first(batches: Iterator[pa.RecordBatch], parts: int, least: int) -> Iterator[pa.RecordBatch]:
    """Words and pairs of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            grams = Grams(row, {}, least)
            grams.extend(2)
            yield _pieces(row["block"], grams, [1, 2], parts)


def _ask(blocks: pa.Table, totals: pa.Table, order: int, parts: int, least: int) -> pa.Table:
    """The block's n-grams of one order whose contexts are states."""
    row = blocks.to_pylist()[0]
    grams = Grams(row, _totals(totals), least)
    for k in range(2, order + 1):
        grams.extend(k)
    return pa.Table.from_batches([_pieces(row["block"], grams, [order], parts)])


def _sum(table: pa.Table) -> pa.Table:
    """The training count of each n-gram that a block asks for, in the order in which it asks; and the part's tokens and distinct ones, once."""
    rows = table.to_pylist()
    keys = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    counts = np.concatenate([unpack(r["counts"], np.int64) for r in rows])
    distinct, _, which = numbered(np.concatenate(keys))
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, which, counts)
    edges = np.cumsum([len(k) for k in keys])[:-1]
    answers = [pack(x) for x in np.split(total[which], edges)]
    once = [0] * (len(rows) - 1)
    cols = [[r["block"] for r in rows], [r["gram"] for r in rows], [r["part"] for r in rows], answers, [int(total.sum()), *once], [int(np.count_nonzero(total)), *once]]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in TOTALS.split(", ")])


class Automaton:
    """The part of the automaton that a block's texts can reach.

    States are numbered by level (the length of their n-gram), the root first.
    ``arcs[k]`` has, for each place, the arc by which a state of level k reads the
    word there, or -1; so an arc is found by the number of the n-gram that it spells.
    """

    def __init__(self, grams: Grams, size: Size, smoothing: Smoothing):
        n = smoothing.order
        seen = grams.totals[1]
        chance = (seen + 1) / (size.tokens + size.seen + 1)
        self.base = np.log10(chance)[grams.number[1]]
        self.known = (seen > 0)[grams.number[1]]
        states, level, fail, weight, known_state = 1, [np.zeros(1, np.int8)], [np.zeros(1, np.int32)], [np.zeros(1)], {}
        for k in range(1, n):
            is_state = grams.state(k)
            known_state[k] = np.where(is_state, states + np.cumsum(is_state) - 1, 0)
            if k > 1:  # where it isn't one, the shorter one that it ends with
                shorter = known_state[k - 1][grams.number[k - 1][grams.at[k]]]
                known_state[k] = np.where(is_state, known_state[k], shorter)
                fail.append(shorter[is_state].astype(np.int32))
            else:
                fail.append(np.zeros(int(is_state.sum()), np.int32))
            mu = smoothing.strength[k - 1]
            weight.append(np.log10(mu / (grams.totals[k][is_state] + mu)))
            level.append(np.full(int(is_state.sum()), k, np.int8))
            states += int(is_state.sum())
        after_word = known_state.get(1, np.zeros(len(chance), np.int32))
        logs, targets, self.arcs, arcs = [np.log10(chance)], [after_word], [grams.number[1].astype(np.int32)], len(chance)
        for k in range(2, n + 1):
            at = grams.at[k]
            context, shorter = grams.number[k - 1][at - 1], grams.number[k - 1][at]
            mu = smoothing.strength[k - 2]
            has = (grams.totals[k] > 0) & grams.state(k - 1)[context]
            chance = (grams.totals[k] + mu * chance[shorter]) / (grams.totals[k - 1][context] + mu)
            logs.append(np.log10(chance))
            targets.append(known_state[k] if k < n else known_state[k - 1][shorter])
            number = grams.number[k]
            self.arcs.append(np.where(np.append(has, False)[number], arcs + number, -1).astype(np.int32))
            arcs += len(chance)
        del grams._hash
        self.level, self.fail = array("b", np.concatenate(level).tobytes()), array("i", np.concatenate(fail).tobytes())
        self.weight = array("d", np.concatenate(weight).tobytes())
        self.logs, self.targets = array("d", np.concatenate(logs).tobytes()), array("i", np.concatenate(targets).astype(np.int32).tobytes())
        #: After an end.
        self.start = int(after_word[grams.number[1][grams.first[0]]])

    def walk(self, first: int, last: int) -> float:
        """The log10 probability of the words from one place to another (exclusive), from the state after an end."""
        state, total = self.start, 0.0
        level, fail, weight, logs, targets = self.level, self.fail, self.weight, self.logs, self.targets
        for arcs in zip(*(memoryview(a[first:last]) for a in self.arcs), strict=True):
            arc = arcs[level[state]]
            while arc < 0:
                total += weight[state]
                state = fail[state]
                arc = arcs[level[state]]
            total += logs[arc]
            state = targets[arc]
        return total


def _score(blocks: pa.Table, totals: pa.Table, size: Size, smoothing: Smoothing) -> pa.Table:
    row = blocks.to_pylist()[0]
    grams = Grams(row, _totals(totals), smoothing.least)
    for k in range(2, smoothing.order + 1):
        grams.extend(k)
    automaton = Automaton(grams, size, smoothing)
    first = (grams.first + 1).tolist()
    last = (grams.first + 1 + grams.sizes).tolist()
    spans = list(zip(first, last, strict=True))
    cols = [
        pa.array(row["doc_ids"], pa.int64()), pa.array(row["trained"], pa.bool_()), pa.array(grams.sizes, pa.int64()),
        pa.array([int(np.count_nonzero(automaton.known[a:b])) for a, b in spans], pa.int64()),
        pa.array([float(automaton.base[a:b].sum()) for a, b in spans], pa.float64()),
        pa.array([automaton.walk(a, b) for a, b in spans], pa.float64()),
    ]
    return pa.Table.from_arrays(cols, names=[x.split()[0] for x in SCORES.split(", ")])


def _answered(asked: DataFrame) -> DataFrame:
    return asked.groupBy("gram", "part").applyInArrow(_sum, TOTALS)


def _met(blocks: DataFrame, totals: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(totals.select("block", "gram", "part", "totals").groupBy("block")).applyInArrow(f, schema)


def score_texts(docs: DataFrame, trained, smoothing: Smoothing = Smoothing(), block: int = BLOCK, part: int = PART) -> DataFrame:
    """A row for each document: doc_id, trained, n_tokens, n_known, base_score, score and train_tokens.

    Tokens are the words of the text with A-Z lower-cased, then one end; the
    model learns from rows for which the condition ``trained`` holds.
    ``base_score`` takes each token by itself, ``score`` is the model's log10
    probability of the text; ``n_known`` tokens occur in training texts.  A
    null or empty text is an end.  Rows stay as they come, repeated ones and
    null ids too (each counts as training text where the condition holds);
    without training rows all words are equally unlikely; an empty table
    gives none.  Only ``doc_id``, ``text`` and what the condition names are read.

    Words are told apart by 64-bit hashes, longer n-grams by 56 bits: of 10^10
    distinct ones some 700 pairs would share a count.  A task holds one block, or the
    n-grams of one part of the hashes; the number of blocks and of parts grows with
    the text, and a frequent n-gram is one entry of each block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "ngrams")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 8 + size // part
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(trained, F.lit(False)).alias("trained"), F.col("text").cast("binary"))
    blocks = ws.save(texts.mapInArrow(partial(_cut, block=block), BLOCKS), "blocks")
    first = blocks.mapInArrow(partial(_ask_first, parts=parts, least=smoothing.least), PIECES)
    totals = ws.save(_answered(first), "totals_2")
    sums = totals.where("gram = 1").agg(F.sum("tokens"), F.sum("seen")).first()
    size = Size(sums[0] or 0, sums[1] or 0)
    for k in range(3, smoothing.order + 1):
        asked = _met(blocks, totals, partial(_ask, order=k, parts=parts, least=smoothing.least), PIECES)
        totals = totals.unionByName(ws.save(_answered(asked), f"totals_{k}"))
    scored = _met(blocks, totals, partial(_score, size=size, smoothing=smoothing), SCORES)
    return scored.withColumn("train_tokens", F.lit(size.tokens).cast("long"))
