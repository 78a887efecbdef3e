"""Fill-in-middle transformation: a byte automaton finds units, code points and sentinels in one scan.

The automaton's table has a row for each state and a column for each byte.  A
transition may carry marks: a unit ends before this byte, a code point starts
with it, a sentinel is complete.  Marks are counted per text; a second pass over
the marked unit ends locates the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import small_batches

SPACES = b" \t\n\x0b\x0c\r"
SENTINELS = ("<P>", "<S>", "<M>")
#: A byte that no UTF-8 text has; it stands behind each text.
END = 0xFF
#: Marks of a transition.
UNIT_END, CODE_POINT, SENTINEL = 1, 2, 4
#: States: before any byte of a text, in white space, in a word, and in a word after ``<``, ``<P``, ``<S`` and ``<M``.
START, BLANK, WORD, OPEN, LETTER = 0, 1, 2, 3, 4
N_STATES = LETTER + len(SENTINELS)
#: The state depends on so many bytes before at most, so a scan may start anywhere after them.
MEMORY = 2
#: Places of a text that are scanned side by side.
LANES = 4096

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Plan:
    """What is transformed: the seed of the draws, the per cent of texts that are, and the per cent of those in suffix-first form."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks of each (state, byte), as flat tables."""
    step = np.full((N_STATES, 256), WORD, np.uint8)
    marks = np.zeros((N_STATES, 256), np.uint8)
    blank = list(SPACES)
    step[:, blank] = BLANK
    step[:, ord("<")] = OPEN
    for k, name in enumerate(SENTINELS):
        step[OPEN, ord(name[1])] = LETTER + k
        marks[LETTER + k, ord(name[2])] |= SENTINEL
    step[:, END] = START
    # a word's unit ends at white space or the text's end; white space at the text's end is a unit of its own
    marks[WORD:, [*blank, END]] |= UNIT_END
    marks[BLANK, END] |= UNIT_END
    lead = np.array([b & 0xC0 != 0x80 for b in range(END)])
    marks[:, :END] |= np.where(lead, CODE_POINT, 0).astype(np.uint8)
    return step.ravel().astype(np.intp), marks.ravel()


STEP, MARKS = _automaton()


def scan(raw: np.ndarray) -> np.ndarray:
    """The marks of each byte.

    Bytes are cut into lanes that advance together; a lane's first state comes
    from the MEMORY bytes before it.
    """
    lanes = max(1, min(LANES, len(raw) // 64))
    width = max(-(-len(raw) // lanes), MEMORY)
    padded = np.full(lanes * width + MEMORY, END, np.uint8)
    padded[MEMORY : MEMORY + len(raw)] = raw
    across = np.ascontiguousarray(padded[MEMORY:].reshape(lanes, width).T)
    before = np.arange(lanes) * width
    state = np.full(lanes, START, np.intp)
    for back in range(MEMORY):
        state = STEP[(state << 8) | padded[before + back]]
    out = np.empty((width, lanes), np.uint8)
    for at in range(width):
        cell = (state << 8) | across[at]
        out[at] = MARKS[cell]
        state = STEP[cell]
    return out.T.reshape(-1)[: len(raw)]


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that seed and id decide; a null id counts as no digits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


def _transform(plan: Plan):
    p, s, m = (x.encode() for x in SENTINELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
            joined = bytes([END]).join([*raws, b""])
            marks = scan(np.frombuffer(joined, np.uint8))
            ends = np.flatnonzero(marks & UNIT_END)
            last = np.cumsum([len(r) + 1 for r in raws]) - 1  # the end behind each text
            upto = np.searchsorted(ends, last, side="right")
            hits = np.searchsorted(np.flatnonzero(marks & SENTINEL), last)
            rows, first, unit, hit = [], 0, 0, 0
            for doc_id, raw, end, units, found in zip(ids, raws, last.tolist(), upto.tolist(), hits.tolist(), strict=True):
                n = units - unit
                h1, h2, h3, h4 = draws(doc_id, plan.seed)
                if not raw or found > hit or h3 % 100 >= plan.rate:
                    rows.append((n, "plain", None, None, raw))
                else:
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = (int(ends[unit + k - 1]) - first if k else 0 for k in (low, high))
                    chars = [int(np.count_nonzero(marks[first + x : first + y] & CODE_POINT)) for x, y in ((0, a), (a, b))]
                    form = "spm" if h4 % 100 < plan.suffix_first else "psm"
                    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
                    out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
                    rows.append((n, form, *chars, out))
                first, unit, hit = end + 1, units, found
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:4], arrays[4].cast(pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """A row for each document: doc_id, n, form, prefix_chars, middle_chars and output; columns as in SCHEMA.

    A text's units are words with the white space before them, and white space
    that ends it; ``n`` counts them.  Form ``plain`` leaves the text as it is:
    an empty or null one, one that holds a sentinel, and those that the draw
    leaves out.  The draws depend on ``doc_id`` and the seed alone, so equal
    rows give equal rows; a null id draws as no digits.  Rows stay as they
    come; an empty table gives none.  Only doc_id and text are read.  No
    shuffle; a task holds one Arrow batch and the longest text.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(_transform(plan), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output in a form was made from."""
    part = F.split(output, "|".join(SENTINELS), -1)
    spm = F.concat(part[2], part[3], part[1])
    psm = F.concat(part[1], part[3], part[2])
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
