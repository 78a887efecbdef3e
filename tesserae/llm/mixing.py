"""Mixing sources to target weights by iterative proportional fitting (raking).

Built from SQL functions only.  Tokens are summed by cell (source, language,
topic); the cells' weights are scaled to one marginal after another until all
three hold; a document is kept with the probability that its cell's weight
asks for.

Topics are learned from the corpus: stems (the first letters of longer words)
that come in bursts, that is in far fewer documents than their number would
fill if it were spread at random (residual inverse document frequency), are
the anchors of topics, and a document belongs to the anchor that it holds most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import Workspace
from tesserae.llm.text import n_words

DIMS = ("source", "lang", "topic")
#: A marginal's target shares are its observed token shares to this power, made to add up to 1.
POWERS = {"source": 0.6, "lang": 0.8, "topic": 0.9}
#: Rounds over the three marginals at most, how many lie between two written tables, and the largest miss of a marginal at which they end.
ROUNDS, EACH, CLOSE = 12, 4, 1e-12
#: Tokens that are asked for, as a share of all.
BUDGET = 0.5
NONE = "(none)"
#: Cells that may be broadcast to documents, and raked in one task instead of by a shuffle for each marginal.
MOST_CELLS = 100_000
#: Topics; an anchor lies in at least one of RARE documents with text, and in at most one of COMMON of each language.
TOPICS, RARE, COMMON = 12, 200, 4
#: Words of so many letters or more have a stem, which is so many letters long.
STEM = 5
OTHER = "(other)"


def stems(text: Column) -> Column:
    """The first STEM letters of each word that has as many, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(\p{{L}}{{{STEM}}})\p{{L}}*"), F.lit(1))


def anchors(docs: DataFrame) -> list[str]:
    """The stems that part the corpus into topics, the most bursty first (by stem where equal).

    Counts are over all documents and combine before the shuffle; the number
    of stems is bounded by the languages, not by the documents, and TOPICS of
    them reach the driver.
    """
    known = docs.where("text is not null").select(F.coalesce("lang", F.lit(NONE)).alias("lang"), "text")
    texts = known.select("lang", F.array_sort(stems(F.col("text"))).alias("s"))
    # in a sorted list a stem's first place is the one that differs from the place before
    marked = F.transform("s", lambda s, i: F.struct(s.alias("stem"), F.when(s == F.get("s", i - 1), 0).otherwise(1).alias("first")))
    counts = texts.select("lang", F.inline(marked)).groupBy("stem", "lang").agg(F.count("*").alias("cf"), F.sum("first").alias("df"))
    of = known.groupBy("lang").agg(F.count("*").alias("n"))
    # a stem that much of a language has is a trait of the language, not a topic
    counts = counts.join(of, "lang").groupBy("stem").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.max(F.col("df") * COMMON - F.col("n")).alias("over"))
    n = known.count()
    fit = counts.where((F.col("df") * RARE >= n) & (F.col("over") <= 0) & (F.col("df") < F.col("cf")))
    burst = F.round(F.log(F.lit(float(n)) / F.col("df")) + F.log(1 - F.exp(-F.col("cf") / F.lit(float(n)))), 6)
    return [r["stem"] for r in fit.orderBy(F.desc(burst), "stem").limit(TOPICS).collect()]


def held(text: Column, of: list[str]) -> Column:
    """The anchors that the words of a text start with, each as often as it comes: its stems that are anchors."""
    if not of:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<!\p{{L}})(?:{'|'.join(of)})"), F.lit(0))


def topic(held_: Column, of: list[str]) -> Column:
    """The anchor that a text holds most, the first in order where equal; OTHER without any."""
    if not of:
        return F.lit(OTHER)
    every = F.array(*map(F.lit, of))
    counts = F.transform(every, lambda a, k: F.struct(F.size(F.filter(held_, lambda s: s == a)).alias("n"), (-k).alias("k")))
    # never null: else a join on topics would first filter rows by a copy of this expression, patterns included
    return F.when(F.size(held_) == 0, OTHER).otherwise(F.coalesce(F.get(every, -F.array_max(counts)["k"]), F.lit(OTHER)))


def features(docs: DataFrame, of: list[str]) -> DataFrame:
    """doc_id, the three dimensions (null as NONE), tokens and the sampling number of every row; further columns aren't read."""
    # a projection of its own, so that the pattern runs once over a text
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit(NONE)).alias("source"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        held(F.col("text"), of).alias("held"),
        n_words(F.col("text")).alias("tokens"),
        uniform(F.col("doc_id"), F.col("text")).alias("u"),
    )
    return rows.select("doc_id", "source", "lang", topic(F.col("held"), of).alias("topic"), "tokens", "u")


def rake(rows: DataFrame, ws: Workspace, powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """A row for each cell with tokens: its values, tokens, weight (calibrated token share), targets and ``miss``.

    A cell cannot give more than it has, so its weight is at most
    ``most`` = its tokens over the tokens that are asked for; what it lacks
    is asked of the other cells of its marginals, by scaling only those below
    their most.  ``miss`` is the largest difference between a marginal and
    its target (a target that all its cells together cannot give stays missed).
    Rounds end when it is CLOSE to 0.

    Documents meet in sums that combine before the shuffle; the windows run
    over cells, so a hot source costs as little as another.
    """
    powers = powers or POWERS
    cells = ws.save(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")
    few = cells.count() <= MOST_CELLS
    cells = cells.coalesce(1) if few else cells
    for dim in DIMS:
        cells = cells.withColumn(f"own_{dim}", F.sum("tokens").over(Window.partitionBy(dim)))
    # a value's share counts once: its cells' parts add up to it
    once = [F.sum(F.pow(f"own_{d}", F.lit(powers[d])) * F.col("tokens") / F.col(f"own_{d}")).alias(d) for d in DIMS]
    sums = cells.agg(F.sum("tokens").alias("all"), *once).first()
    total = float(sums["all"] or 1)
    targets = [(F.pow(f"own_{d}", F.lit(powers[d])) / F.lit(sums[d] or 1.0)).alias(f"to_{d}") for d in DIMS]
    now = cells.select(*DIMS, "tokens", *targets, (F.col("tokens") / F.lit(total)).alias("weight"), (F.col("tokens") / F.lit(total * budget)).alias("most"))
    for turn in range(rounds):
        for dim in DIMS:
            now = _scaled(now, dim)
        if turn % EACH == EACH - 1 or turn == rounds - 1:
            now = ws.save(now, f"raked_{turn}")
            now = now.coalesce(1) if few else now
            misses = [F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"to_{d}")).alias(d) for d in DIMS]
            worst = now.select(*misses).agg(F.max(F.greatest(*DIMS)).alias("miss")).first()["miss"] or 0.0
            if worst <= CLOSE:
                break
    return now.withColumns({"all_tokens": F.lit(sums["all"] or 0).cast("long"), "miss": F.lit(float(worst))})


def _scaled(now: DataFrame, dim: str) -> DataFrame:
    """``now`` with the weights of the cells below their most scaled so that each value of ``dim`` has its target."""
    same = Window.partitionBy(dim)
    full = F.col("weight") >= F.col("most")
    fixed = F.sum(F.when(full, F.col("most")).otherwise(0.0)).over(same)
    free = F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(same)
    all_ = F.sum("weight").over(same)
    lacks = F.col(f"to_{dim}") - F.col("_fixed")
    # where full cells alone have the target or more, all of them are scaled
    scale = F.when(lacks <= 0, F.col(f"to_{dim}") / F.col("_all")).when(full, 1.0).otherwise(lacks / F.col("_free"))
    now = now.withColumns({"_fixed": fixed, "_free": free, "_all": all_})
    return now.withColumn("weight", F.least(F.col("most"), F.col("weight") * scale)).drop("_fixed", "_free", "_all")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number from 0 to 1 (exclusive) that a document's id decides; its text's MD5 does where the id is null."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _shares(cells: DataFrame, budget: float) -> Column:
    return F.least(F.lit(1.0), F.lit(budget) * F.col("all_tokens") * F.col("weight") / F.col("tokens"))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability and sampled for every row.

    ``weight`` is the cell's calibrated share of tokens, ``probability`` the
    share of the cell's documents to keep so that the kept tokens are
    ``budget`` of all and lie as the weights say; no cell is asked for more
    than it has (see ``rake``).  A row is sampled when its id's hash is below
    (its text's where the id is null); rows without tokens are never asked for
    (weight and probability 0); repeated rows share their fate.  Null sources
    and languages are a value of their own; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.save(features(docs, anchors(docs)), "rows")
    cells = rake(rows, ws, powers, budget, rounds)
    cells = cells.select(*DIMS, "weight", _shares(cells, budget).alias("probability"))
    small = cells.count() <= MOST_CELLS
    out = rows.join(F.broadcast(cells) if small else cells, list(DIMS), "left")
    weight, probability = F.coalesce("weight", F.lit(0.0)), F.coalesce("probability", F.lit(0.0))
    sampled = (F.col("tokens") > 0) & (F.col("u") < probability)
    return out.select("doc_id", *DIMS, "tokens", weight.alias("weight"), probability.alias("probability"), sampled.alias("sampled"))


def sample(docs: DataFrame, powers: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of ``docs``; columns as they were."""
    ws = Workspace(docs.sparkSession, "mixing")
    of = anchors(docs)
    cells = rake(features(docs, of), ws, powers, budget)
    # names that no column of docs has
    mark = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    cells = cells.select(*(F.col(d).alias(f"{mark}{d}") for d in DIMS), _shares(cells, budget).alias(f"{mark}share"))
    # cells may number too many to broadcast; a skewed join can split a hot cell
    own = {"source": F.coalesce("source", F.lit(NONE)), "lang": F.coalesce("lang", F.lit(NONE)), "topic": topic(F.col(f"{mark}held"), of)}
    keyed = docs.select("*", held(F.col("text"), of).alias(f"{mark}held")).select(*docs.columns, *(c.alias(f"{mark}{d}") for d, c in own.items()))
    small = cells.count() <= MOST_CELLS
    kept = keyed.join(F.broadcast(cells) if small else cells, [f"{mark}{d}" for d in DIMS])
    return kept.where((n_words(F.col("text")) > 0) & (uniform(F.col("doc_id"), F.col("text")) < F.col(f"{mark}share"))).select(*docs.columns)
