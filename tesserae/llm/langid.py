"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rotated) by its place; a
document's vector bundles (adds) the vectors of its n-grams, and a language's
prototype bundles the directions of its documents.  The prediction is the
prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import small_batches
from tesserae.llm.text import mix

DIM = 2048
GRAM = 3
#: Documents of each language that its prototype is learned from, at most in expectation, chosen by a hash of doc_id and text.
MAX_TRAIN = 4_000
#: Languages that are learned, at most: those with the most documents.
MAX_LANGS = 1_000
#: Characters of text that are counted at once; longer texts are counted in pieces.
CHUNK = 1 << 19
#: n-gram vectors that are held at once.
BLOCK = 4_096
#: Directions are kept as whole numbers of this unit, so that sums don't depend on their order.
UNIT = 1 << 20
UNKNOWN = "und"
#: Dimensions of a sum that lie in one row.
PART = 32


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """A letter's code point at its place, 0 for anything else; worked out once a process."""
    table = np.arange(0x110000, dtype=np.uint32)
    # lower case is applied before; str.isalpha holds for the letter categories
    table[[not chr(c).isalpha() for c in range(0x110000)]] = 0
    return table


class Letters:
    """Ids of letters: 0 is anything that parts words, a letter is its code point; vectors follow from the id alone."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.id_of = _letter_table()
        self.known: dict[int, np.ndarray] = {}

    def vector(self, letter: int) -> np.ndarray:
        if letter not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            seeds = np.arange(self.dim // 64, dtype=np.uint64) + np.uint64(letter << 16)
            bits = np.unpackbits(mix(mix(seeds + np.uint64(0x632BE59BD9B4E019))).view(np.uint8))
            self.known[letter] = (2 * bits.astype(np.int8) - 1).astype(np.int8)
        return self.known[letter]

    def grams(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-gram codes (21 bits a letter), and for each n-gram of the pieces its code's index and its piece.

        N-grams with two neighbouring breaks don't count, so two breaks keep pieces apart.
        """
        at = self.id_of[np.frombuffer("  ".join(pieces).encode("utf-32-le", "replace"), np.uint32)]
        piece = np.repeat(np.arange(len(pieces)), [len(p) + 2 for p in pieces])[: max(len(at) - 2, 0)]
        seen = np.zeros(0x110000, bool)
        seen[at] = True
        letters = np.flatnonzero(seen)
        rank = np.zeros(0x110000, np.int64)
        rank[letters] = np.arange(len(letters))
        at, k = rank[at], len(letters)
        a, b, c = at[:-2], at[1:-1], at[2:]
        codes = (a * k + b) * k + c
        if k and letters[0] == 0:
            fine = ((a != 0) | (b != 0)) & ((b != 0) | (c != 0))
            codes, piece = codes[fine], piece[fine]
        if k**3 <= 1 << 22:  # few letters: a table instead of a sort
            there = np.zeros(k**3, bool)
            there[codes] = True
            distinct = np.flatnonzero(there)
            index = np.zeros(k**3, np.int64)
            index[distinct] = np.arange(len(distinct))
            which = index[codes]
        else:
            distinct, which = np.unique(codes, return_inverse=True)
        of = letters.astype(np.int64)
        return (of[distinct // (k * k)] << 42) | (of[distinct // k % k] << 21) | of[distinct % k] if k else distinct, which, piece

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code: its letters' vectors, rotated by 2, 1 and 0 places, multiplied."""
        out = np.ones((len(codes), self.dim), np.int8)
        for place in range(GRAM):
            letters, which = np.unique((codes >> (21 * (GRAM - 1 - place))) & 0x1FFFFF, return_inverse=True)
            table = np.stack([np.roll(self.vector(int(x)), GRAM - 1 - place) for x in letters])
            out *= table[which]
        return out.astype(np.float32)


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Texts between breaks, in groups of about CHUNK characters; a longer text in pieces that share two, so that each n-gram is in one."""
    group, held = [], 0
    for k, text in enumerate(texts):
        text = f" {text.lower()} " if text else ""
        for start in range(0, max(len(text) - GRAM + 1, 0), CHUNK):
            piece = text[start : start + CHUNK + GRAM - 1]
            if held + len(piece) > CHUNK and group:
                yield group
                group, held = [], 0
            group.append((k, piece))
            held += len(piece)
    if group:
        yield group


def bundle(texts: list[str | None], letters: Letters) -> np.ndarray:
    """A row for each text: the sum of its n-grams' vectors.  Pieces of a long text add up."""
    out = np.zeros((len(texts), letters.dim), np.float32)
    for group in _pieces(texts):
        rows = np.array([k for k, _ in group])
        codes, which, row = letters.grams([t for _, t in group])
        for first in range(0, len(codes), BLOCK):
            here = (which >= first) & (which < first + BLOCK) if len(codes) > BLOCK else slice(None)
            wide = min(BLOCK, len(codes) - first)
            count = np.bincount(row[here] * wide + which[here] - first, minlength=len(group) * wide).reshape(len(group), wide)
            np.add.at(out, rows, count.astype(np.float32) @ letters.bound(codes[first : first + wide]))
    return out


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by language and dimension over a task's rows."""
    letters, total = Letters(), {}
    for batch in batches:
        langs, texts = (c.to_pylist() for c in batch.columns)
        v = bundle(texts, letters).astype(np.float64)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        unit = np.rint(np.divide(v, size, out=np.zeros_like(v), where=size > 0) * UNIT).astype(np.int64)
        langs = np.array(langs, dtype=object)
        for lang in set(langs):
            total[lang] = total.get(lang, 0) + unit[langs == lang].sum(axis=0)
    for lang, v in total.items():
        for first in range(0, len(v), PART):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([first], pa.int32()), pa.array([v[first : first + PART]], pa.list_(pa.int64()))], names=["lang", "d", "v"])


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages in order and a unit prototype for each.

    Learns from rows with a text and a lang: ``max_train`` of each language in
    expectation, so that a rare language is learned from all its rows and a
    common one costs no more; of MAX_LANGS languages (the most frequent) at
    most.  Sums combine by language and part before they reach the driver:
    languages times DIM numbers, however many documents.
    """
    small_batches(docs.sparkSession)
    known = docs.where("text is not null and lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    rates = [(r["lang"], (1 << 63) - 1 if r["count"] <= max_train else (max_train << 64) // r["count"] - (1 << 63)) for r in counts]
    rates = docs.sparkSession.createDataFrame(rates, "lang string, _most long")
    known = known.join(F.broadcast(rates), "lang").where(F.xxhash64("doc_id", "text", F.lit(7)) <= F.col("_most"))
    sums = known.select("lang", "text").mapInArrow(_directions, "lang string, d int, v array<long>").groupBy("lang", "d")
    sums = sums.agg(F.array(*(F.sum(F.get("v", F.lit(k))) for k in range(PART))).alias("v")).collect()
    langs = sorted({r["lang"] for r in sums})
    place = {lang: k for k, lang in enumerate(langs)}
    proto = np.zeros((len(langs), DIM))
    for r in sums:
        proto[place[r["lang"]], r["d"] : r["d"] + PART] = r["v"]
    size = np.linalg.norm(proto, axis=1, keepdims=True)
    return langs, np.divide(proto, size, out=np.zeros_like(proto), where=size > 0)


def predictor(docs: DataFrame, model: tuple[list[str], np.ndarray]):
    """A column function of texts to (lang, score): the nearest prototype and its cosine, at least 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, proto = shared.value
        letters = Letters()
        for texts in batches:
            v = bundle(texts.tolist(), letters).astype(np.float64)
            size = np.linalg.norm(v, axis=1)
            if not langs:
                yield pd.DataFrame({"lang": [UNKNOWN] * len(v), "score": 0.0})
                continue
            cos = np.divide(v @ proto.T, size[:, None], out=np.zeros((len(v), len(langs))), where=size[:, None] > 0)
            best = cos.argmax(axis=1)
            empty = size == 0
            lang = np.array(langs, dtype=object)[best]
            for k in np.flatnonzero(empty):  # no letter, or n-grams that cancel out
                lang[k] = UNKNOWN if not any(c.isalpha() for c in texts.iloc[k] or "") else langs[0]
            yield pd.DataFrame({"lang": lang, "score": np.where(empty, 0.0, np.clip(cos[np.arange(len(v)), best], 0.0, 1.0))})

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    ``und`` with score 0 where the text is null or has no letter, or nothing
    was learned; ties go to the first language by name.  Rows stay as they
    come, repeated ones too; only doc_id and text are read.
    """
    guess = predictor(docs, model)(F.col("text"))
    return docs.select("doc_id", guess.alias("_guess")).select("doc_id", F.col("_guess.lang").alias("lang_pred"), F.col("_guess.score").alias("score"))
