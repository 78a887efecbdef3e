"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed; runs that occur
elsewhere before are joined globally, and the sentences that they cover go.

From each sentence only the shortest run that is long enough is hashed: a
longer repeated run is covered by the short ones that start in it, so the
covered sentences are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import Workspace

#: A run is extended until it has so many sentences and so many words.
SENTENCES, WORDS = 2, 20
#: A sentence of more words counts as several of so many each, so that text without punctuation has sentences, too.
LONG = 40
#: Documents and runs to remove that may be broadcast to the texts; beyond, these are joined by a shuffle.
MOST_RUNS = 2_000_000
#: After ., ! or ? that ends a word, closing marks included, or at a line break.
BREAK = re.compile(rb"(?<=[.!?])[\x22\x27)\]]*[\x20\t\r]+|[\r\n]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
SPANS = "doc_id long, k long, hashes array<long>, checks array<int>, starts array<int>, own int"
RESULT = "doc_id long, k long, n_sentences int, n_removed int, n_words_removed int, removed array<struct<start:int,end:int>>, text string"


def sentences(raw: bytes) -> list[tuple[int, int, int, int]]:
    """Start and end in bytes, 128-bit hash and words of each sentence that has a word; case and spacing don't count."""
    out, at = [], 0
    for m in [*BREAK.finditer(raw), None]:
        end = len(raw) if m is None else m.start()
        words = raw[at:end].lower().split()
        if len(words) > LONG:
            places = [w.start() + at for w in WORD.finditer(raw[at:end])][::LONG]
            for k, (a, b) in enumerate(zip(places, [*places[1:], end], strict=True)):
                some = words[LONG * k : LONG * (k + 1)]
                out.append((a, b, xxhash.xxh3_128_intdigest(b" ".join(some)), len(some)))
        elif words:
            out.append((at, end, xxhash.xxh3_128_intdigest(b" ".join(words)), len(words)))
        at = len(raw) if m is None else m.end()
    return out


def runs(parts: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, a second hash, first sentence and end of the shortest run of enough sentences and words from each sentence."""
    n = len(parts)
    total = np.concatenate([[0], np.cumsum(np.array([p[3] for p in parts], np.int64))])
    start = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + WORDS), start + SENTENCES)
    fits = end <= n
    start, end = start[fits], end[fits]
    # two polynomial hashes over independent halves of the sentences' hashes: equal runs are told by 96 bits
    low = np.array([p[2] & 0xFFFFFFFFFFFFFFFF for p in parts], np.uint64)
    high = np.array([p[2] >> 64 for p in parts], np.uint64)
    out, check = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for k in range(int((end - start).max(initial=0))):
        more = start + k < end
        at = start[more] + k
        out[more] = out[more] * _ODD + low[at]
        check[more] = check[more] * _ODD2 + high[at]
    size = (end - start).astype(np.uint64)
    return (out ^ (out >> np.uint64(29))) + size, (check >> np.uint64(32)) + size, start, end


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, checks, starts, own = [], [], [], []
        for raw in batch.column(2):
            h, c, start, _ = runs(sentences(raw.as_py() or b""))
            _, first = np.unique(h, return_index=True)  # a document's later runs are its own affair
            hashes.append(h[first].view(np.int64))
            checks.append(c[first].astype(np.uint32).view(np.int32))
            starts.append(start[first].astype(np.int32))
            own.append(len(h) - len(first))
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(checks, ints), pa.array(starts, ints), pa.array(own, pa.int32())],
            names=[x.split()[0] for x in SPANS.split(", ")],
        )


def remove(raw: bytes, gone: list[int]) -> tuple[int, list[tuple[int, int]], int, bytes]:
    """Sentences, removed ranges of them, words removed, and what is left, with the runs at ``gone`` and own repeats taken out."""
    parts = sentences(raw)
    h, _, start, end = runs(parts)
    _, first = np.unique(h, return_index=True)
    repeat = np.ones(len(h), bool)
    repeat[first] = False
    repeat |= np.isin(start, np.array(gone, np.int64))
    depth = np.zeros(len(parts) + 1, np.int64)
    np.add.at(depth, start[repeat], 1)
    np.add.at(depth, end[repeat], -1)
    covered = np.cumsum(depth[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    ranges = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    left, at = [], 0
    for a, b in ranges:
        left.append(raw[at : parts[a][0]])
        at = parts[b][0] if b < len(parts) else len(raw)
    left.append(raw[at:])
    return len(parts), ranges, int(sum(parts[k][3] for k in np.flatnonzero(covered))), b"".join(left)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws, gone = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        rows = [remove(r or b"", g or []) for r, g in zip(raws, gone, strict=True)]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([sum(b - a for a, b in r[1]) for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], span),
                pa.array([r[3].decode("utf-8", "replace") for r in rows]),
            ],
            names=[x.split()[0] for x in RESULT.split(", ")[:5]] + ["removed", "text"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the text: the first two are a row's key, so that a repeated or null id parts its texts."""
    raw = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(raw).alias("k"), raw.alias("raw"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, k (the text's hash), gone (first sentences of runs that another document holds first) and kept_in (those documents).

    A document is a doc_id with a text: rows equal in both are one, rows with
    one id and different texts are two, as are rows without an id.  The first
    occurrence of a run is that in the smallest doc_id (null comes last), then
    in the smallest hash of the text.  Counts combine before the shuffle, and
    only runs that occur twice are joined back, on a key that a skewed join
    can split.
    """
    ws = Workspace(docs.sparkSession, "spans")
    spans = ws.save(_keyed(docs).mapInArrow(_spans, SPANS), "spans")
    rows = spans.select("doc_id", "k", F.explode(F.arrays_zip("hashes", "checks", "starts")).alias("s"))
    rows = rows.select("doc_id", "k", F.col("s.hashes").alias("h"), F.col("s.checks").alias("c"), F.col("s.starts").alias("start"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")
    firsts = rows.groupBy("h", "c").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first != final").drop("final")
    firsts = ws.save(firsts, "firsts")  # a join with an aggregate's rows could not split a run that many documents have
    again = rows.join(firsts, ["h", "c"]).where(~F.col("first.doc_id").eqNullSafe(F.col("doc_id")) | (F.col("first.k") != F.col("k")))
    cross = again.groupBy("doc_id", "k").agg(F.collect_set("start").alias("gone"), F.collect_set("first.doc_id").alias("kept_in"))
    own = spans.where("own > 0").select("doc_id", "k", F.array().cast("array<int>").alias("gone"), F.array().cast("array<long>").alias("kept_in"))
    own = own.distinct()
    both = cross.union(own).groupBy("doc_id", "k").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("kept_in")))).alias("kept_in"))
    return ws.save(both, "gone")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """The documents that lose sentences: doc_id, text_hash, n_sentences, n_removed, n_words_removed, removed, text and kept_in.

    ``text_hash`` (64 bits, of the text as it was) tells texts of one id apart.

    ``removed`` are ranges of sentences (counted from 0, ends exclusive) that
    are covered by a repeated run which is not its first occurrence;
    ``text`` is what is left, byte for byte; kept_in names documents that keep
    such a run (none for repeats within one document, or for keepers without
    an id).  A text that occurs once loses nothing, whatever its id.  Null and
    empty texts and texts shorter than a run give no row; rows that repeat an
    id and its text give a row each, an empty table none.
    """
    gone = repeated_spans(docs)
    size = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("runs")).first()
    few = size["rows"] + size["runs"] <= MOST_RUNS

    def on_key(left: DataFrame, what: str) -> DataFrame:
        right = gone.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), what)
        same = F.col("k").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        return left.join(F.broadcast(right) if few else right, same).drop("_id", "_k")

    texts = on_key(_keyed(docs), "gone").select("doc_id", "k", "raw", "gone")
    out = texts.mapInArrow(_removed, RESULT).where("n_removed > 0")
    return on_key(out, "kept_in").withColumnRenamed("k", "text_hash")


def clean(docs: DataFrame) -> DataFrame:
    """All rows of ``docs``, their columns as they were, each text less the sentences that :func:`dedup_substrings` removes from it.

    Rows are matched by id and text, so of two texts with one id, or without
    any, each loses its own sentences only.  A text that loses all becomes empty.
    """
    gone = repeated_spans(docs)
    size = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("runs")).first()
    few = size["rows"] + size["runs"] <= MOST_RUNS
    # names that no column of docs has
    mark = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    right = gone.select(F.col("doc_id").alias(f"{mark}id"), F.col("k").alias(f"{mark}k"), F.col("gone").alias(f"{mark}gone"))
    same = F.xxhash64(F.col("text").cast("binary")).eqNullSafe(F.col(f"{mark}k")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{mark}id"))
    joined = docs.join(F.broadcast(right) if few else right, same, "left")

    @F.pandas_udf("string")
    def left_over(texts: pd.Series, gone_: pd.Series) -> pd.Series:
        return pd.Series([remove(t.encode(), g)[3].decode("utf-8", "replace") for t, g in zip(texts, gone_, strict=True)], dtype=object)

    text = F.when(F.col(f"{mark}gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(left_over(F.coalesce("text", F.lit("")), F.coalesce(F.col(f"{mark}gone"), F.array().cast("array<int>"))))
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns))
