"""Carts as a fold over their events: add, remove, toggle, reorder, clear and top_n.

What an event does to one item of a cart is a function from the item's state
(absent, or present with a place) to the next, and such functions compose.  So
a cart's events need not meet in one task: ranges of events are folded to one
function an item each, which are then composed in order.  Of the events that
concern a whole cart, ``clear`` voids all earlier ones and the last ``top_n`` says how
many items count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import cut
from tesserae.operators.slices import ranked_within

ITEM_KINDS = ("add", "remove", "toggle", "reorder")
EVENTS = "cart_id, item, seq, kind, value"
#: A function of one item's state: where an absent one leads (null: absent, else its place), and where a present one does
#: (``stays``: present; at ``moved``, or at its old place if that is null).
FUNCTION = "from_absent double, stays boolean, moved double"


def _then(f: tuple, g: tuple) -> tuple:
    """First ``f``, then ``g``."""

    def apply(place: float | None) -> float | None:
        if place is None:
            return g[0]
        return None if not g[1] else place if g[2] is None else g[2]

    if not f[1]:  # a present item became absent
        return apply(f[0]), g[0] is not None, g[0]
    return apply(f[0]), g[1], None if not g[1] else f[2] if g[2] is None else g[2]


IDENTITY = (None, True, None)


def _event(kind: str, seq: float, value: float | None) -> tuple:
    """The function of one event; an item that comes in takes its event's number as its place."""
    return {"add": (seq, True, None), "remove": (None, False, None), "toggle": (seq, False, None), "reorder": (None, True, value)}[kind]


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (cart_id, item, seq, kind, value) by cart and number, as one function for each item of the part."""
    found: dict[tuple, list] = {}
    for frame in frames:
        for cart, item, seq, kind, value in frame.itertuples(index=False):
            known = found.setdefault((cart, item), [seq, IDENTITY])
            known[1] = _then(known[1], _event(kind, float(seq), None if pd.isna(value) else float(value)))
    rows = [(*key, seq, *f) for key, (seq, f) in found.items()]
    out = pd.DataFrame(rows, columns=["cart_id", "item", "first_seq", "from_absent", "stays", "moved"])
    yield out.astype({"from_absent": "float64", "stays": "bool", "moved": "float64"})


def _composed(functions: Column) -> Column:
    """The place to which functions of one item (first_seq and FUNCTION), one for each part of the events that has it, bring an absent one; null: absent."""

    def step(place: Column, f: Column) -> Column:
        return F.when(place.isNull(), f["from_absent"]).when(f["stays"], F.coalesce(f["moved"], place))

    return F.aggregate(F.array_sort(functions), F.lit(None).cast("double"), step)


def cart_state(events: DataFrame, parts: int | None = None) -> DataFrame:
    """cart_id, item and position (from 1) of what carts hold after all events (cart_id, item, seq, kind, value).

    ``add`` puts an item at the end and leaves one that is there; ``toggle`` adds
    or removes; ``reorder`` gives an item that is there the place ``value`` among
    the others, whose places are the numbers of the events that brought them;
    ``clear`` empties the cart; the last ``top_n`` with a value keeps that
    many first items.  Equal places are ordered by item.  Numbers are unique within
    a cart; events without cart, number or (but for clear and top_n) item, and other
    kinds, do nothing.  Repeated rows count once.
    """
    known = events.where("cart_id IS NOT NULL AND seq IS NOT NULL").select("cart_id", "item", "seq", "kind", F.col("value").cast("double").alias("value")).distinct()
    whole = known.groupBy("cart_id").agg(F.max(F.when(F.col("kind") == "clear", F.col("seq"))).alias("_cleared"), F.max_by("value", F.when((F.col("kind") == "top_n") & F.col("value").isNotNull(), F.col("seq"))).alias("_top"))
    items = known.where(F.col("kind").isin(*ITEM_KINDS) & F.col("item").isNotNull()).join(whole.select("cart_id", "_cleared"), "cart_id").where(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared"))).drop("_cleared")
    dealt = items.repartitionByRange(parts, "cart_id", "seq") if parts else items.repartitionByRange("cart_id", "seq")
    types = dict(items.dtypes)
    keys = f"cart_id {types['cart_id']}, item {types['item']}"
    functions = cut(dealt.sortWithinPartitions("cart_id", "seq").mapInPandas(_folded, f"{keys}, first_seq {types['seq']}, {FUNCTION}"))
    # an item has a function for each part of the events at most
    found = F.collect_list(F.struct("first_seq", "from_absent", "stays", "moved"))
    places = functions.groupBy("cart_id", "item").agg(_composed(found).alias("place")).where("place IS NOT NULL AND NOT isnan(place)")
    rows = ranked_within(places, ["cart_id"], "place", "item", name="position")
    return rows.join(whole.select("cart_id", "_top"), "cart_id").where(F.col("_top").isNull() | (F.col("position") <= F.col("_top"))).select("cart_id", "item", "position")
