"""Exact quantiles of many columns by selection: range counts, never a buffer of all rows.

Each wanted order statistic is enclosed by two values.  A pass over the rows
counts, for all of them at once, how many rows lie below and within, and takes
a sketch of those within; the sketch's error is bounded, so the next enclosure holds
a few hundredths of the rows.  Once few rows are left within all enclosures,
they are fetched and the values picked.  A pass is one aggregate row, whose size
depends on columns and quantiles only; 10^12 rows take four passes and the fetch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.sources.storage import written

#: Places of the sketch that are asked for, and its accuracy: ranks are right within a share of 1 / ACCURACY.
GRID, ACCURACY = 100, 1_000
#: Rows that are fetched to finish, at most.
MOST_FETCHED = 50_000


@dataclass
class _Wanted:
    """The order statistics ``low`` and ``high`` (from 0) of ``n`` values, and the two values that enclose both.

    ``below`` rows are under the floor, ``at_floor`` equal it, ``inside`` lie
    strictly between, ``at_ceiling`` equal the ceiling.
    """

    name: str
    p: float
    n: int
    floor: float
    ceiling: float
    before: tuple[float, float] = (0.0, 0.0)
    slack: int = 1
    below: int = 0
    at_floor: int = 0
    inside: int = 0
    at_ceiling: int = 0

    @property
    def position(self) -> float:
        return self.p * (self.n - 1)

    @property
    def low(self) -> int:
        return int(self.position)

    @property
    def high(self) -> int:
        return min(self.low + (self.position > self.low), self.n - 1)

    @property
    def column(self) -> Column:
        return F.col(self.name)

    @property
    def between(self) -> Column:
        return (self.column > F.lit(self.floor)) & (self.column < F.lit(self.ceiling))

    def holds(self) -> bool:
        return self.below <= self.low and self.high < self.below + self.at_floor + self.inside + self.at_ceiling

    def is_open(self) -> bool:
        """Whether a wanted value lies strictly between the ends."""
        first = self.below + self.at_floor
        return any(first <= r < first + self.inside for r in (self.low, self.high))

    def _at(self, rank: int, ordered: Sequence[float]) -> float:
        k = rank - self.below - self.at_floor
        return self.floor if k < 0 else ordered[k] if k < self.inside else self.ceiling

    def value(self, ordered: Sequence[float] = ()) -> float:
        """The quantile, from the ordered values strictly between the ends."""
        a, b = self._at(self.low, ordered), self._at(self.high, ordered)
        return a if a == b or self.low == self.high else (self.high - self.position) * a + (self.position - self.low) * b

    def value_of(self, ordered: Sequence[float]) -> float:
        """The quantile, from all values in order."""
        a, b = ordered[self.low], ordered[self.high]
        return a if a == b or self.low == self.high else (self.high - self.position) * a + (self.position - self.low) * b

    def narrow(self, inside: int, first: int, sketch: Sequence[float]) -> None:
        """Tighten the ends by a sketch of ``inside`` rows, the first of which has the rank ``first``, with room for its error."""
        self.before = self.floor, self.ceiling
        a = (self.low - first) * GRID // inside - self.slack
        b = -((first - self.high) * GRID // inside) + self.slack
        self.floor = sketch[a] if a > 0 else self.floor
        self.ceiling = sketch[b] if b < GRID else self.ceiling


_PLACES = "array(" + ", ".join(f"{k / GRID}D" for k in range(GRID + 1)) + ")"


def _sketch(value: Column) -> Column:
    return F.percentile_approx(value, F.expr(_PLACES), ACCURACY)


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """The quantiles of each column, interpolated between neighbours at ``p * (n - 1)``; None for a column without values.

    Nulls don't count; NaN is larger than any number.  The driver holds a
    sketch for each wanted quantile, and MOST_FETCHED values at most.
    """
    names = list(wanted)
    if not names:
        return {}
    # written once: each pass, and each of its aggregates, would work the columns out anew
    df = written(df.select(*(F.col(n).cast("double").alias(n) for n in names)), "quantiles")
    ends = df.agg(*(F.struct(F.count(n).alias("n"), F.min(n).alias("min"), F.max(n).alias("max")).alias(f"c{i}") for i, n in enumerate(names))).first()
    if sum(first["n"] for first in ends) <= MOST_FETCHED:
        return _of_few(df, wanted)
    sketches = df.agg(*(_sketch(F.col(n)).alias(f"s{i}") for i, n in enumerate(names))).first()
    found: dict[tuple[str, float], float | None] = {}
    todo: list[_Wanted] = []
    for n, first, sketch in zip(names, ends, sketches, strict=True):
        for p in dict.fromkeys(wanted[n]):
            if not first["n"]:
                found[n, p] = None
                continue
            w = _Wanted(n, p, first["n"], first["min"], first["max"])
            w.narrow(w.n, 0, sketch)
            todo.append(w)
    while todo:
        sketches = _count(df, todo)
        for w in [w for w in todo if w.holds() and not w.is_open()]:
            found[w.name, w.p] = w.value()
        todo = [w for w in todo if (w.name, w.p) not in found]
        # so few that a sketch's places would not tell them apart are always fetched
        if all(w.holds() for w in todo) and sum(w.inside for w in todo) <= max(MOST_FETCHED, 2 * GRID * len(todo)):
            return {n: [(found | _fetched(df, todo))[n, p] for p in wanted[n]] for n in names}
        for w in todo:
            if w.holds():
                w.narrow(w.inside, w.below + w.at_floor, sketches[w.name, w.p])
            else:  # the sketch missed: back to the ends before, then with more room
                (w.floor, w.ceiling), w.slack = w.before, 2 * w.slack
    return {n: [found[n, p] for p in wanted[n]] for n in names}


def _of_few(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """The quantiles of a table that is as small as what would be fetched at last."""
    names = list(wanted)
    out = {}
    for n, values in zip(names, zip(*df.select(*names).collect(), strict=True) if names else (), strict=False):
        ordered = sorted((v for v in values if v is not None), key=lambda x: (x != x, x))
        some = [_Wanted(n, p, len(ordered), ordered[0], ordered[-1]) for p in wanted[n]] if ordered else []
        out[n] = [w.value_of(ordered) for w in some] or [None] * len(wanted[n])
    return {n: out.get(n, [None] * len(wanted[n])) for n in names}


def _count(df: DataFrame, todo: list[_Wanted]) -> dict[tuple[str, float], list[float]]:
    """One pass: rows below, at the ends and strictly between them; and a sketch of the last."""
    parts = []
    for i, w in enumerate(todo):
        counts = (("below", w.column < F.lit(w.floor)), ("at_floor", w.column == F.lit(w.floor)), ("inside", w.between), ("at_ceiling", (w.column == F.lit(w.ceiling)) & (F.lit(w.floor) < F.lit(w.ceiling))))
        parts.append(F.struct(*(F.count_if(c).alias(k) for k, c in counts), _sketch(F.when(w.between, w.column)).alias("s")).alias(f"w{i}"))
    row = df.agg(*parts).first()
    for got, w in zip(row, todo, strict=True):
        w.below, w.at_floor, w.inside, w.at_ceiling = got["below"], got["at_floor"], got["inside"], got["at_ceiling"]
    return {(w.name, w.p): got["s"] for got, w in zip(row, todo, strict=True)}


def _fetched(df: DataFrame, todo: list[_Wanted]) -> dict[tuple[str, float], float]:
    """The few rows strictly between the ends, in order, and the quantiles they give."""
    if not todo:
        return {}
    hits = F.array_compact(F.array(*(F.when(w.between, F.struct(F.lit(i).alias("i"), w.column.alias("v"))) for i, w in enumerate(todo))))
    held: list[list[float]] = [[] for _ in todo]
    for r in df.select(F.inline(hits)).collect():
        held[r["i"]].append(r["v"])
    return {(w.name, w.p): w.value(sorted(v)) for w, v in zip(todo, held, strict=True)}
