"""Benchmark decontamination by spaced seeds.

Fixed masks hash some token positions of a window and ignore the others, so a
substituted token inside a window need not break a hit.  The hashes of
documents and benchmark items are joined (in memory while the benchmark's
are few, else first by a shuffle), and hits are verified along their diagonal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.shared import Workspace, small_batches
from tesserae.llm.text import WordHasher, mix, tokens

#: Masks of 8 tokens, 5 of them compared.
MASKS = ("11010011", "11100101", "10110011", "11011001")
#: An overlap counts from so many tokens and this share of equal ones; a shorter item must be matched as a whole.
MIN_TOKENS, MIN_IDENTITY = 13, 0.75
#: A benchmark up to so many characters is broadcast as one index of some 20 bytes a character; a larger one in blocks.
BLOCK_CHARS = 8_000_000
#: Candidates of one document that are verified at once.
AT_ONCE = 1 << 18
#: Items of fewer tokens with fewer bytes of letters and digits say too little to be searched for (``too_short`` lists them).
MIN_ITEM, MIN_BYTES = 5, 20
#: Ids of documents that may be broadcast to their texts; beyond, these are joined by a shuffle.
MOST_IDS = 2_000_000

PAIRS = "doc_id long, item_id long, doc_start long, doc_end long, item_start long, n_equal long, n_item_tokens long, identity double, coverage double"
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Scripts that are written without spaces: Thai, Lao, Burmese, Khmer, Japanese, Chinese.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_LOW_BYTES = bytes(range(0xE0))


def units(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits; of scripts without spaces each character."""
    if not text.isascii() and text.encode("utf-8", "replace").translate(None, _LOW_BYTES):
        text = _UNSPACED.sub(r" \1 ", text)
    return tokens(text)


def masks_for(n: int) -> tuple[str, ...]:
    """The masks that find items of ``n`` tokens.

    Items shorter than MIN_TOKENS are matched as wholes with up to k =
    floor(n / 4) substitutions: their positions are dealt to groups of which
    k cannot spoil all that one of the masks compares, so no place of the
    substitutions is missed.
    """
    if n >= MIN_TOKENS:
        return MASKS
    k = int(n * (1 - MIN_IDENTITY))
    groups = n if n < 6 else k + 2
    kept = groups - k if k else groups
    return tuple("".join("01"[p % groups in some] for p in range(n)) for some in combinations(range(groups), kept))


def masked(w: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window's kept positions."""
    n = len(w) - len(mask) + 1
    if n <= 0:
        return w[:0]
    h = np.zeros(n, np.uint64)
    for k, keep in enumerate(mask):
        if keep == "1":
            h = h * _MULT + w[k : k + n]
    return mix(h)


def _searched(words: list[bytes]) -> bool:
    return len(words) >= MIN_ITEM or sum(map(len, words)) >= MIN_BYTES


@dataclass
class Index:
    """Seeds of a block of items: by mask, sorted hashes with their item and position, and a filter of their leading bits."""

    ids: list[int]
    words: list[np.ndarray]
    tables: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        hasher = WordHasher()
        cut = [(i, units(t)) for i, t in items if t]
        ready = [(i, hasher.of(w)) for i, w in cut if _searched(w)]
        by_mask: dict[str, list[int]] = {}
        for k, (_, w) in enumerate(ready):
            for mask in masks_for(len(w)):
                by_mask.setdefault(mask, []).append(k)
        tables = []
        for mask, those in by_mask.items():
            parts = [masked(ready[k][1], mask) for k in those]
            h = np.concatenate(parts)
            item = np.repeat(np.array(those, np.int32), [len(p) for p in parts])
            at = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])
            order = np.argsort(h, kind="stable")
            bits = min(max(int(len(h)).bit_length() + 6, 10), 24)
            seen = np.zeros(1 << bits, bool)
            seen[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
            tables.append((mask, h[order], item[order], at[order], seen, bits))
        return cls([i for i, _ in ready], [w for _, w in ready], tables)

    def candidates(self, w: np.ndarray) -> Iterator[np.ndarray]:
        """Distinct (item, diagonal) of hits, in portions of about AT_ONCE, so that a seed of many items takes no more memory."""
        for mask, hashes, item, at, seen, bits in self.tables:
            h = masked(w, mask)
            where = np.flatnonzero(seen[(h >> np.uint64(64 - bits)).astype(np.int64)])
            lo = np.searchsorted(hashes, h[where], "left")
            count = np.searchsorted(hashes, h[where], "right") - lo
            where, lo, count = where[count > 0], lo[count > 0], count[count > 0]
            total = np.concatenate([[0], np.cumsum(count)])
            start = 0
            while start < len(where):
                end = max(start + 1, int(np.searchsorted(total, total[start] + AT_ONCE, "right")) - 1)
                some = count[start:end]
                nth = np.arange(int(some.sum())) - np.repeat(total[start:end] - total[start], some)
                hit = np.repeat(lo[start:end], some) + nth
                diagonal = np.repeat(where[start:end], some) - at[hit]
                yield np.unique(np.stack([item[hit].astype(np.int64), diagonal.astype(np.int64)], axis=1), axis=0)
                start = end

    def overlaps(self, w: np.ndarray) -> list[tuple]:
        """The best verified overlap of a document's tokens with each item, as PAIRS without doc_id."""
        best: dict[int, tuple] = {}
        for found in self.candidates(w):
            for k, diagonal in found.tolist():
                row = _verified(w, self.words[k], diagonal)
                if row and (k not in best or (row[3], -row[0]) > (best[k][3], -best[k][0])):
                    best[k] = row
        return [(self.ids[k], *row) for k, row in sorted(best.items())]

    def meets(self, w: np.ndarray) -> bool:
        """Whether any item has a verified overlap."""
        return any(_verified(w, self.words[k], d) for found in self.candidates(w) for k, d in found.tolist())


def _verified(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple | None:
    """The overlap along a diagonal, if it counts.

    That is the segment with the largest sum of +1 for an equal and -2 for
    another token; where it is too short, the one with the most equal tokens
    (then the shortest, then the first) of all that are long enough and
    reach the identity.
    """
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = doc[a + diagonal : b + diagonal] == item[a:b]
    least = min(MIN_TOKENS, len(item))
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmax(total[: end + 1] == low[end]))
    equal, size = int(same[start:end].sum()), end - start
    if size < least or equal < MIN_IDENTITY * size:
        if (best := _long_enough(same, least)) is None:
            return None
        start, end, equal = best
        size = end - start
    return (a + diagonal + start, a + diagonal + end, a + start, equal, len(item), equal / size, equal / len(item))


def _long_enough(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """Start, end and equal tokens of the best segment of at least ``least`` tokens with MIN_IDENTITY, if there is one."""
    n = len(same)
    if n < least or same.sum() < MIN_IDENTITY * least:
        return None
    sums = np.concatenate([[0], np.cumsum(same)])
    # a segment reaches the identity where this does not fall from its start to its end
    over = sums - MIN_IDENTITY * np.arange(n + 1)
    if not (over[least:] >= np.minimum.accumulate(over)[: n + 1 - least]).any():
        return None
    best = None
    for start in range(n + 1 - least):
        ends = start + least + np.flatnonzero(over[start + least :] >= over[start])
        if len(ends):
            end = int(ends[np.argmax(sums[ends])])
            row = (int(sums[end] - sums[start]), start - end, -start, end)
            best = row if best is None or row > best else best
    return None if best is None else (-best[2], best[3], best[0])


def too_short(benchmark: DataFrame) -> DataFrame:
    """item_id and text of the items that aren't searched for, as they say too little."""

    @F.pandas_udf("boolean")
    def short(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and not _searched(units(t)) for t in texts], dtype=bool)

    return benchmark.where(short("text")).select("item_id", "text")


def _seeds(keep: np.ndarray | None, bits: int, items: bool):
    """Key and distinct seeds (with the mask mixed in) of each text; only those in a filter, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        every = [m for n in range(1, MIN_TOKENS + 1) for m in masks_for(n)] if not items else []
        seen = None if keep is None else keep.value
        for batch in batches:
            ids, ks, hs = [], [], []
            for i, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = units(t) if t else []
                if items and not _searched(words):
                    continue
                w = hasher.of(words)
                for mask in masks_for(len(w)) if items else every:
                    h = mix(masked(w, mask) + np.uint64(hasher[mask.encode()]))
                    if seen is not None:
                        bit = h >> np.uint64(64 - bits)
                        h = h[(seen[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    h = np.unique(h)
                    ids += [i] * len(h)
                    ks += [k] * len(h)
                    hs.append(h.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(np.concatenate(hs))], names=["i", "k", "h"])

    return run


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("i"), F.xxhash64("text").alias("k"), "text")


def _met(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents and items (i, k, text) that have a seed in common, by joins of both sides' hashes.

    A bitmap of the items' seeds, of 2**28 bits at most, is broadcast first, so
    that few of the documents' seeds are shuffled.  Both joins are semi-joins
    of written tables: a seed that many have is neither multiplied nor stuck
    in one task.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "seeds")
    ours = ws.save(_keyed(items, "item_id").mapInArrow(_seeds(None, 0, True), "i long, k long, h long"), "items")
    bits = min(max(ours.count().bit_length() + 4, 16), 28)
    byte = F.shiftrightunsigned("h", 64 - bits + 3).cast("int").alias("byte")
    bit = F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - bits}) & 7 AS int))")
    filled = ours.select(byte, bit.alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    seen = np.zeros(1 << (bits - 3), np.uint8)
    seen[filled["byte"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint8)
    shared = spark.sparkContext.broadcast(seen)
    theirs = ws.save(_keyed(docs, "doc_id").mapInArrow(_seeds(shared, bits, False), "i long, k long, h long"), "docs")

    def those(left: DataFrame, right: DataFrame, rows: DataFrame, key: str) -> DataFrame:
        other = ws.save(right.select("h").distinct(), f"{key}_seeds")
        met = ws.save(left.join(other, "h", "left_semi").select(F.col("i").alias("_i"), F.col("k").alias("_k")).distinct(), f"{key}_met")
        keyed = _keyed(rows, key)
        same = (F.col("k") == F.col("_k")) & F.col("i").eqNullSafe(F.col("_i"))
        few = met.count() <= MOST_IDS
        return ws.save(keyed.join(F.broadcast(met) if few else met, same, "left_semi"), key)

    return those(theirs, ours, docs, "doc_id").withColumnRenamed("i", "doc_id"), those(ours, theirs, items, "item_id").withColumnRenamed("i", "item_id")


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")


def _chars(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]


def _blocks(spark: SparkSession, items: DataFrame, chars: int):
    """Broadcast indexes, one for each block of items; a block's size is bounded by BLOCK_CHARS, on average."""
    n = -(-max(chars, 1) // BLOCK_CHARS)
    items = items.select("item_id", "text")
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        index = Index.of(sorted((r[0], r[1]) for r in block.collect()))
        if index.ids:
            yield spark.sparkContext.broadcast(index)


def _pairs(index) -> object:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        kinds = [pa.int64()] * 7 + [pa.float64()] * 2
        for batch in batches:
            rows = [(d, *row) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t for row in index.value.overlaps(hasher.of(units(t)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PAIRS.split(", ")])

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that share an overlap; columns as in PAIRS.

    Tokens are lower-cased runs of letters and digits (single characters in
    scripts without spaces); positions count tokens.  An overlap lies on one
    diagonal, has MIN_TOKENS or more and MIN_IDENTITY or more of them equal;
    an item of fewer tokens must overlap as a whole, one of three or fewer exactly.
    Null and empty texts, items without an id and items that ``too_short``
    lists match nothing; an empty benchmark or table gives no rows; repeated
    documents and repeated items give their rows again (repeated ids of items
    too).  Only doc_id, item_id and the texts are read.

    A benchmark of up to BLOCK_CHARS characters is broadcast, and documents
    are not shuffled.  For a larger one both sides' hashes are joined first;
    only documents and items with a common hash go on, in blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow, items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _items(benchmark)
    chars = _chars(items)
    if chars > BLOCK_CHARS:
        narrow, items = _met(narrow, items)
        narrow, chars = narrow.select("doc_id", "text"), _chars(items)
    out = None
    for index in _blocks(spark, items, chars):
        part = narrow.mapInArrow(_pairs(index), PAIRS)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], PAIRS) if out is None else out


def _contaminated(index):
    @F.pandas_udf("boolean")
    def contaminated(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = WordHasher()
        for text in texts:
            yield pd.Series([bool(t) and index.value.meets(hasher.of(units(t))) for t in text], dtype=bool)

    return contaminated


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap an item as in ``find_contamination``; columns as they were.

    There is no join or shuffle up to BLOCK_CHARS characters of benchmark;
    beyond, the found documents (a doc_id with a text) are anti-joined.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = _items(benchmark)
    chars = _chars(items)
    if chars <= BLOCK_CHARS:
        for index in _blocks(spark, items, chars):
            docs = docs.where(~_contaminated(index)(F.col("text")))
        return docs
    met, items = _met(docs.select("doc_id", "text"), items)
    bad = None
    for index in _blocks(spark, items, _chars(items)):
        part = met.where(_contaminated(index)(F.col("text"))).select("doc_id", "k")
        bad = part if bad is None else bad.union(part)
    if bad is None:
        return docs
    # names that no column of docs has
    mark = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    bad = Workspace(spark, "contaminated").save(bad.distinct().toDF(f"{mark}id", f"{mark}k"), "bad")
    same = (F.xxhash64(docs["text"]) == bad[f"{mark}k"]) & docs["doc_id"].cast("long").eqNullSafe(bad[f"{mark}id"])
    return docs.join(F.broadcast(bad) if bad.count() <= MOST_IDS else bad, same, "left_anti")
