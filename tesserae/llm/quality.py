"""Quality rules: word counts and zstandard compression bands that are learned by length."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import Workspace, small_batches
from tesserae.llm.text import WordHasher, rolling

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

#: Bands of length to a doubling of the bytes; the band of a chunk, whatever its text's length.
PER_DOUBLING, CHUNKS = 2, -1
#: Bytes of a chunk (the last one ends with the text), and the share of a text's chunks that may fall out of their limits.
CHUNK, MOST_CHUNKS_OUT = 4_096, 0.34
#: Ratios are counted in cells of 1 / CELLS.
CELLS = 2_000
#: The spread is that of a normal distribution with these two quantiles, taken above the middle: junk, which is
#: repetitive and lies below, doesn't widen it.
MIDDLE, ABOVE, ABOVE_DEVIATIONS = 0.5, 0.85, 1.036
#: Deviations below and above the middle that are still fine, for a text and for a chunk.
BELOW, OVER = 4.0, 6.0
CHUNK_BELOW, CHUNK_OVER = 6.0, 6.0
#: Texts or chunks that a band's limits are learned from, at least; fewer have the fixed ones.
LEAST = 30
#: Fixed limits: (up to so many bytes, least, most compressed bytes per byte).
FIXED = ((256, 0.35, 1.20), (1_024, 0.30, 0.95), (4_096, 0.25, 0.85), (16_384, 0.20, 0.80), (None, 0.15, 0.80))
FIXED_CHUNK = (0.20, 0.85)

MEASURED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, n_bytes long, band int, ratio double, chunk_ratios array<double>"
)


@dataclass(frozen=True)
class Limits:
    """Least and most ratio of each band that was learned, by band."""

    of: dict[int, tuple[float, float]]


def text_counts(raw: bytes, hasher: WordHasher) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, duplicate lines, words in repeated 3-word windows."""
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, SPACES).decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 3:
        _, at, times = np.unique(rolling(hasher.of(words), 3), return_inverse=True, return_counts=True)
        hot = times[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hot
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def ratios(raw: bytes, press: zstandard.ZstdCompressor) -> tuple[int | None, float, list[float]]:
    """A text's band of length (None for an empty one), its ratio, and those of its chunks; a text below CHUNK has none."""
    if not raw:
        return None, 1.0, []
    starts = [*range(0, len(raw) - CHUNK, CHUNK), len(raw) - CHUNK] if len(raw) >= CHUNK else []
    band = math.floor(math.log2(len(raw)) * PER_DOUBLING)
    return band, len(press.compress(raw)) / len(raw), [len(press.compress(raw[at : at + CHUNK])) / CHUNK for at in starts]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, press = WordHasher(), zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
    for batch in batches:
        rows = []
        for raw in batch.column(1):
            raw = raw.as_py() or b""
            n, chars, symbols, dup, repeat = text_counts(raw, hasher)
            rows.append((n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n, len(raw), *ratios(raw, press)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in MEASURED.split(",")])


def measure(docs: DataFrame) -> DataFrame:
    """Counts, base rules and ratios of each document; columns as in MEASURED.  No shuffle; memory is one Arrow batch and the longest text."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(_measured, MEASURED)


def learn(measured: DataFrame) -> Limits:
    """Limits of each band with LEAST members or more, from all documents that the base rules keep.

    Ratios are counted by band and cell, which combines before the shuffle; the
    driver gets those counts, whose number doesn't grow with the documents.
    """
    fine = measured.where("NOT base_failed AND band IS NOT NULL")
    each = fine.select("band", "ratio").unionAll(fine.select(F.lit(CHUNKS).alias("band"), F.explode("chunk_ratios")))
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in each.groupBy("band", F.floor(F.col("ratio") * CELLS).alias("cell")).count().collect():
        counts.setdefault(r["band"], []).append((r["cell"], r["count"]))
    enough = {band: cells for band, cells in counts.items() if sum(n for _, n in cells) >= LEAST}
    return Limits({band: limits(cells, *((CHUNK_BELOW, CHUNK_OVER) if band == CHUNKS else (BELOW, OVER))) for band, cells in enough.items()})


def limits(cells: list[tuple[int, int]], under: float = BELOW, over: float = OVER) -> tuple[float, float]:
    """Least and most ratio by the counts of cells: so many deviations from the middle."""
    at, n = (np.array(x) for x in zip(*sorted(cells), strict=True))
    below = np.cumsum(n)
    middle, above = ((at[np.searchsorted(below, q * below[-1])] + 0.5) / CELLS for q in (MIDDLE, ABOVE))
    spread = max((above - middle) / ABOVE_DEVIATIONS, 1 / CELLS)
    return float(middle - under * spread), float(middle + over * spread)


def judge(measured: DataFrame, found: Limits) -> DataFrame:
    """``measured`` with low and high (its band's limits), n_chunks, n_chunks_out, kept, and rejected_by: base, whole or chunks."""
    low, high = (F.lit(None).cast("double") for _ in range(2))
    for most, lo, hi in reversed(FIXED):
        inside = F.lit(True) if most is None else F.col("n_bytes") <= most
        low, high = F.when(inside, lo).otherwise(low), F.when(inside, hi).otherwise(high)
    bands = {b: x for b, x in found.of.items() if b != CHUNKS}
    if bands:
        low, high = (F.coalesce(F.element_at(F.create_map(*(F.lit(v) for b, x in sorted(bands.items()) for v in (b, x[k]))), F.col("band")), fixed) for k, fixed in enumerate((low, high)))
    least, most = found.of.get(CHUNKS, FIXED_CHUNK)
    rows = measured.withColumns({"low": low, "high": high, "n_chunks": F.size("chunk_ratios").cast("long"), "n_chunks_out": F.size(F.filter("chunk_ratios", lambda r: (r < least) | (r > most))).cast("long")})
    by = F.when(F.col("base_failed"), "base").when(~F.col("ratio").between(F.col("low"), F.col("high")), "whole").when(F.col("n_chunks_out") > F.lit(MOST_CHUNKS_OUT) * F.col("n_chunks"), "chunks")
    return rows.drop("chunk_ratios").withColumn("rejected_by", by).withColumn("kept", by.isNull())


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row of counts and the verdict for each document; columns as in MEASURED and :func:`judge`.

    ``kept`` needs the base rules (50 words or more, at most half of them in
    repeated 3-word windows), a whole-text ratio inside the limits of its
    band of length, and at most MOST_CHUNKS_OUT of the chunks outside theirs.
    The limits follow the corpus' own ratios: a text that compresses much better
    than texts of its length do is repetitive, one that hardly compresses is
    noise.  A null or empty text has no words and fails.  Rows stay as they come:
    repeated rows and null ids give a row each, an empty table none.  Only
    doc_id and text are read, once: measures are written, then judged.
    """
    measured = Workspace(docs.sparkSession, "quality").save(measure(docs), "measured")
    return judge(measured, learn(measured))


def rejections(judged: DataFrame) -> DataFrame:
    """low_bytes (where the band begins), documents, and how many are rejected by the base rules, as a whole and by chunks."""
    by = [F.count_if(F.col("rejected_by") == k).alias(f"by_{k}") for k in ("base", "whole", "chunks")]
    rows = judged.groupBy("band").agg(F.count("*").alias("documents"), *by)
    return rows.select(F.ceil(F.pow(F.lit(2.0), F.col("band") / PER_DOUBLING)).alias("low_bytes"), "documents", "by_base", "by_whole", "by_chunks").orderBy("low_bytes")
