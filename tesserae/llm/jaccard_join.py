"""Exact Jaccard join of documents in the metric space of their shingle sets.

``d = 1 - J`` is a metric, and documents link when ``d <= 1 - t``.  Fixed
pivot documents don't part such a space: two unrelated documents are at a
distance of almost 1 from each other and from every pivot, so each document
would lie in every pivot's window.  So candidates are found without pivots,
and pivots with windows of distances are used where distances differ, inside
the regions of candidates:

* Leaves.  A document's set is cut by the leading bits of its shingle
  hashes, again and again, until a part has at most ``leaf_size`` shingles.  If
  two sets are within 1 - t, so is, by averaging over the cut, at least one
  pair of their parts; and two parts of that size are that near only when they
  are equal.  So linked sets have equal leaves, which hold a known share of
  their shingles; a join on equal leaves finds the sets that may have a link.
* Regions.  Sets that meet others with that share of their shingles are joined
  anew by single shingles, rarest first.  In a region a set's rank of the
  shingle bounds its overlap with any other; the shingles that no other set
  has are a distance that every partner has to cross.
* Pivots.  In each region the most central set (with the smallest share of
  shingles of its own) is the first pivot; it is compared exactly with every
  set that can be linked to it, which gives their distances from it.  Sets that are
  linked to a pivot share its class, so only pairs across classes are left.
  Further sets take their turn as pivots, with more of them in each round,
  until all pairs across classes are compared but those that the triangle
  inequality parts: two sets whose distances from the first pivot differ by
  more than 1 - t are not linked.

Every comparison is exact, and no pair within 1 - t whose classes differ is
left out.  Equal sets are one set throughout, so copies cost nothing.  A
region whose sets share their rarest shingles without being linked goes
through its pairs; they are joined on the region, which a skewed join splits.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import Workspace
from tesserae.llm.text import WordHasher, mix, shingles

#: Sets in the sample that finds hot leaves, and how many of them make a leaf hot; it only saves shuffling.
SAMPLE, HOT = 20_000, 8
#: Ids that may be broadcast to pick texts; beyond, the texts are joined by a shuffle.
MOST_IDS = 4_000_000
#: Shingles whose leaves are worked out at once.
PORTION = 300_000
#: Each round takes so many times the pivots of the one before, up to so many in a region (Spark limits groups of up to 1,000 before they are shuffled).
WIDEN, MOST_TAKEN = 8, 1_000


@dataclass(frozen=True)
class Near:
    """Words in a shingle, and the least similarity as a fraction: 100 * shared >= 90 * union for 90, 100."""

    words: int = 3
    num: int = 90
    den: int = 100

    @property
    def leaf_size(self) -> int:
        """The largest set that is linked to no other than itself, given that both are parts of equal standing."""
        if self.num >= self.den:
            return 63
        union = -(-self.den // (self.den - self.num))
        return min(63, -(-self.num * union // self.den) - 1)

    @property
    def least_met(self) -> int:
        """Of ``den`` shingles, those that lie in leaves which a linked set has, too.

        Two parts of which one is a leaf and which differ are at least
        1 / (leaf_size + 1) apart, so such parts hold at most
        (leaf_size + 1) * (1 - t) of the union.
        """
        return self.den - (self.leaf_size + 1) * (self.den - self.num)

    def shared(self, n_a: Column, n_b: Column) -> Column:
        """The least overlap of two linked sets of these sizes."""
        return F.ceil(F.lit(self.num) * (n_a + n_b) / F.lit(float(self.num + self.den)) - F.lit(1e-9))

    def sizes_fit(self, n_a: Column, n_b: Column) -> Column:
        return F.lit(self.den) * F.least(n_a, n_b) >= F.lit(self.num) * F.greatest(n_a, n_b)


def leaves(h: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the leaves of sorted sets that lie one behind the other (the last 6 bits are the size), and each leaf's set.

    A shingle's leaf is at the first depth at which no run of ``most + 1``
    neighbours that holds it shares its leading bits.
    """
    n = len(h)
    depth = np.zeros(n, np.int64)
    if n > most:
        equal_bits = 53 - np.frexp(((h[:-most] ^ h[most:]) >> np.uint64(11)).astype(np.float64))[1]
        need = np.where(owner[most:] == owner[:-most], equal_bits + 1, 0)
        for s in range(most + 1):
            np.maximum(depth[s : s + len(need)], need, out=depth[s : s + len(need)])
    prefix = np.where(depth == 0, np.uint64(0), h >> np.minimum(64 - depth, 63).astype(np.uint64))
    first = np.ones(n, bool)
    first[1:] = (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1]) | (prefix[1:] != prefix[:-1])
    at = np.flatnonzero(first)
    node = mix(prefix[at] * np.uint64(64) + depth[at].astype(np.uint64))
    key = mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at) + node)
    size = np.minimum(np.diff(np.append(at, n)), 63).astype(np.uint64)
    return (key & ~np.uint64(63)) | size, owner[at]


def _sets(near: Near):
    """doc_id, the text's hash, the set's id and a second hash of it, its size, and its leaves where this task meets it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, met = WordHasher(), set()
        for batch in batches:
            own = [shingles(hasher.of((raw.as_py() or b"").lower().split()), near.words) for raw in batch.column(2)]
            size = np.array([len(x) for x in own], np.int64)
            sid = [int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in own]
            chk = [int(mix(x ^ np.uint64(0xDA942042E4DD58B5)).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in own]
            new = []
            for k, s in enumerate(sid):
                if size[k] and s not in met:
                    if len(met) > 200_000:
                        met.clear()
                    met.add(s)
                    new.append(k)
            keys: list[np.ndarray | None] = [None] * len(own)
            for some in _portions(new, size) if near.num < near.den else ():
                key, of = leaves(np.concatenate([own[k] for k in some]), np.repeat(np.arange(len(some)), size[some]), near.leaf_size)
                cuts = np.searchsorted(of, np.arange(len(some) + 1))
                for j, k in enumerate(some):
                    keys[k] = key[cuts[j] : cuts[j + 1]].view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(sid, pa.int64()), pa.array(chk, pa.int64()), pa.array(size), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "sid", "chk", "n", "keys"])

    return run


def _portions(rows: list[int], size: np.ndarray) -> Iterator[list[int]]:
    """Rows in portions of about PORTION shingles."""
    part, held = [], 0
    for k in rows:
        part.append(k)
        held += size[k]
        if held >= PORTION:
            yield part
            part, held = [], 0
    if part:
        yield part


def _shingled(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            own = [shingles(hasher.of((raw.as_py() or b"").lower().split()), near.words) for raw in batch.column(0)]
            sid = [int(mix(x).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["sid", "tokens"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and the shingles that both sets have."""
    for batch in batches:
        both = []
        for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
            x, y = ta.values.to_numpy(), tb.values.to_numpy()
            both.append(len(x) + len(y) - len(np.union1d(x, y)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64())], names=["a", "b", "shared"])


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """sid and comp, the smallest sid that links reach, for every sid that has a link.

    Each round takes the smallest class of the neighbours and then that
    class's own class, so that the rounds grow with the logarithm of the
    longest chain; each is a written table.
    """
    edges = ws.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}_edges")
    now = ws.save(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("sid"), F.least("a", "m").alias("comp")), f"{name}_0")
    turn = 0
    while True:
        turn += 1
        least = edges.join(now.select(F.col("sid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("comp").alias("m"))
        step = now.join(least, "sid").select("sid", F.col("comp").alias("old"), F.least("comp", "m").alias("c"))
        jump = now.select(F.col("sid").alias("c"), F.col("comp").alias("cc"))
        new = step.join(jump, "c").select("sid", "old", F.least("c", "cc").alias("comp"))
        new = ws.save(new, f"{name}_{turn}")
        ws.drop(f"{name}_{turn - 1}")
        if new.where("old != comp").isEmpty():
            ws.drop(f"{name}_edges")
            return new.select("sid", "comp")
        now = new.select("sid", "comp")


def _free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _meeting(sets: DataFrame, near: Near) -> DataFrame:
    """sids of sets that share enough of their shingles in leaves with other sets to be linked to one.

    Leaves that a sample shows to be hot are known to be shared: their sets
    are taken without a shuffle, so no task gets a hot leaf's rows.
    """
    keyed = sets.where("keys is not null")
    rows = keyed.select("sid", F.explode("keys").alias("key"))
    distinct = keyed.select("sid").agg(F.approx_count_distinct("sid")).first()[0]
    part = keyed if distinct <= SAMPLE else keyed.where(F.xxhash64("sid", F.lit(3)) < F.lit(int(-(2**63) + 2**64 * (SAMPLE / distinct))))
    hot = part.select("sid", "keys").dropDuplicates(["sid"]).select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") >= HOT)
    hot = [r["key"] for r in hot.orderBy(F.desc("count"), "key").limit(100_000).collect()]
    found = None
    if hot:
        table = F.broadcast(sets.sparkSession.createDataFrame([(k,) for k in hot], "key long"))
        found = rows.join(table, "key", "left_semi")
        rows = rows.join(table, "key", "left_anti")
    same = Window.partitionBy("key")
    met = rows.select("sid", "key", (F.min("sid").over(same) != F.max("sid").over(same)).alias("met")).where("met").select("sid", "key")
    met = met if found is None else met.unionByName(found)
    held = met.groupBy("sid").agg(F.sum(F.col("key").bitwiseAND(F.lit(63))).alias("held"))
    sizes = keyed.select("sid", "n").dropDuplicates(["sid"])
    return held.join(sizes, "sid").where(F.col("held") * near.den >= F.col("n") * near.least_met).select("sid")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the text: the first two are a row's key, so that a repeated or null id parts its texts."""
    raw = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(raw).alias("k"), raw.alias("raw"))


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return (left["k"] == right["_k"]) & left["doc_id"].eqNullSafe(right["_id"])


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of documents with these keys (_id, _k); a broadcast only while they are few."""
    few = ids.count() <= MOST_IDS
    keyed = _keyed(docs)
    return keyed.join(F.broadcast(ids) if few else ids, _same_row(keyed, ids), "left_semi").select("raw")


def _regions(shingled: DataFrame, near: Near, ws: Workspace) -> DataFrame:
    """g, sid, n, rank and turn: the rarest shingles of each set, of those that other sets have too.

    A set of n that is linked to another one misses at most n - ceil(t * n) of
    its shingles there, so in the order of count and hash, which all sets
    share, the first shared one has at most that rank.  ``turn`` orders
    sets from central to outlying.
    """
    rows = shingled.select("sid", F.size("tokens").alias("n"), F.explode("tokens").alias("g"))
    # a table of its own: a join with an aggregate's rows could not split a shingle that many sets have
    shared = ws.save(rows.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    own = Window.partitionBy("sid")
    ranked = rows.join(shared, "g").select("g", "sid", "n", F.row_number().over(own.orderBy("df", "g")).alias("nth"), F.count("*").over(own).alias("known"))
    alone = F.col("n") - F.col("known")
    ranked = ranked.select("g", "sid", "n", (alone + F.col("nth") - 1).alias("rank"), ((F.floor(alone * 1000 / F.col("n")) * F.lit(1 << 52)) + F.shiftrightunsigned("sid", 12)).cast("long").alias("turn"))
    missed = F.col("n") - F.ceil(F.col("n") * near.num / F.lit(float(near.den)) - F.lit(1e-9))
    return ranked.where(F.col("rank") <= missed)


def _windowed(left: DataFrame, right: DataFrame, near: Near, across: Column | None = None) -> DataFrame:
    """Distinct pairs a < b of one region whose windows reach each other."""
    x, y = left.alias("x"), right.alias("y")
    reach = F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank")) >= near.shared(F.col("x.n"), F.col("y.n"))
    on = (F.col("x.g") == F.col("y.g")) & (F.col("x.sid") != F.col("y.sid")) & near.sizes_fit(F.col("x.n"), F.col("y.n")) & reach
    on = on if across is None else on & across
    return x.join(y, on).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()


def _classes(docs: DataFrame, near: Near) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, k, sid, n of every row), and sid, comp and the smallest doc_id of comp for every set that isn't empty."""
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    sets = ws.save(_keyed(docs).mapInArrow(_sets(near), "doc_id long, k long, sid long, chk long, n long, keys array<long>"), "sets")
    members = ws.save(sets.select("doc_id", "k", "sid", "n", "chk"), "members")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")
    of = members.where("n > 0").groupBy("sid").agg(F.min(place).alias("rep"), F.min("chk").alias("c0"), F.max("chk").alias("c1"))
    of = ws.save(of, "of")
    if not of.where("c0 != c1").isEmpty():
        raise ValueError("two shingle sets have one 64-bit hash")
    meeting = ws.save(_meeting(sets, near), "meeting")
    ws.drop("sets")
    _free(spark)
    linked = _link(docs, of, meeting, near, ws)
    named = of.select("sid", F.col("rep.doc_id").alias("rep")).join(linked, "sid", "left").select("sid", "rep", F.coalesce("comp", "sid").alias("comp"))
    named = ws.save(named, "named")
    first = ws.save(named.groupBy("comp").agg(F.min("rep").alias("first")), "first_of")
    return members, named.join(first, "comp").select("sid", "comp", "first")


def classes(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, sid and component_id of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; a set
    holds the distinct runs of ``near.words`` words, or all words as one
    run where they are fewer.  Without words the set is empty, linked with
    nothing, and the component is the row's own doc_id.  A component_id is
    the smallest non-null doc_id of a class; rows with a null doc_id carry
    their class's, which is null where no row of it has an id.  Repeated rows
    are copies of one text.  An empty table gives no rows.

    Sets are known by a 64-bit hash; a second one is compared, and a
    collision raises instead of merging two texts.
    """
    members, named = _classes(docs, near)
    out = members.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "sid", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def _link(docs: DataFrame, of: DataFrame, meeting: DataFrame, near: Near, ws: Workspace) -> DataFrame:
    """sid and comp of every set that is linked to another one."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "sid long, comp long")
    ids = of.join(meeting, "sid", "left_semi").select(F.col("rep.doc_id").alias("_id"), F.col("rep.k").alias("_k"))
    ids = ws.save(ids, "ids")
    shingled = _texts(docs, ids).mapInArrow(_shingled(near), "sid long, tokens array<long>")
    shingled = ws.save(shingled.dropDuplicates(["sid"]), "shingled")
    regions = ws.save(_regions(shingled, near, ws), "regions")
    if regions.isEmpty():
        return none

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        side = lambda s: shingled.select(F.col("sid").alias(s), F.col("tokens").alias(f"t{s}"), F.size("tokens").alias(f"n{s}"))
        with_sets = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
        return ws.save(with_sets.mapInArrow(_compare, "a long, b long, shared long"), name)

    sizes = shingled.select("sid", F.size("tokens").alias("n"))

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        return both.where(F.col("shared") * near.den >= near.num * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")

    # joins on a region are joins of two tables, so that Spark can split a large one
    lead = ws.save(regions.groupBy("g").agg(F.min("turn").alias("lead"), F.count("*").alias("c")).where("c > 1"), "lead")
    pivots = ws.save(regions.join(lead, "g").where("turn = lead").select("g", "sid", "n", "rank", "turn"), "pivots_0")
    tested = compared(ws.save(_windowed(regions, pivots, near), "pairs_0"), "shared_0")
    links = ws.save(linked(tested), "links_0")
    first = ws.save(pivots.groupBy("g").agg(F.min("sid").alias("sid"), F.min("n").alias("n"), F.min("turn").alias("turn")), "first")
    regions = ws.save(_with_distances(regions, first, tested), "placed")
    comp = components(links, ws, "comp0")
    edge, take, turn = first.select("g", F.struct("turn", "sid").alias("edge")), WIDEN, 0
    tested = tested.select("a", "b")
    while True:
        turn += 1
        now = regions.join(comp, "sid", "left").select("g", "sid", "n", "rank", "turn", "far", F.coalesce("comp", "sid").alias("comp"))
        split = now.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max(F.struct("turn", "sid")).alias("last")).where("c0 != c1")
        split = ws.save(split.join(edge, "g").where("last > edge").select("g", "edge"), f"split_{turn}")
        left = ws.save(now.join(split, "g"), f"left_{turn}")
        if left.isEmpty():
            return comp
        # each region's next sets: a task passes on no more of them than are taken, so none meets a whole region
        place = F.row_number().over(Window.partitionBy("g").orderBy("turn", "sid"))
        pivots = ws.save(left.where(F.struct("turn", "sid") > F.col("edge")).withColumn("place", place).where(F.col("place") <= take), f"pivots_{turn}")
        after = F.struct("x.turn", "x.sid") > F.struct("y.turn", "y.sid")
        # triangle inequality, with room for rounding; a set that was not compared with the first pivot has no distance
        apart = F.abs(F.col("x.far") - F.col("y.far")) > 1 - near.num / near.den + 1e-9
        across = after & (F.col("x.comp") != F.col("y.comp")) & ~F.coalesce(apart, F.lit(False))
        pairs = ws.save(_windowed(left, pivots, near, across).join(tested, ["a", "b"], "left_anti"), f"pairs_{turn}")
        if not pairs.isEmpty():
            tested = tested.union(pairs)
            more = ws.save(linked(compared(pairs, f"shared_{turn}")), f"links_{turn}")
            if not more.isEmpty():
                links = links.union(more)
                comp = components(links, ws, f"comp{turn}")
        edge = ws.save(pivots.groupBy("g").agg(F.max(F.struct("turn", "sid")).alias("edge")), f"edge_{turn}")
        take = min(take * WIDEN, MOST_TAKEN)


def _with_distances(regions: DataFrame, first: DataFrame, tested: DataFrame) -> DataFrame:
    """``regions`` with far: the distance from the region's first pivot, null where the two were not compared."""
    lead = first.select("g", F.col("sid").alias("p"), F.col("n").alias("pn"))
    known = regions.join(lead, "g", "left").withColumns({"a": F.least("sid", "p"), "b": F.greatest("sid", "p")}).join(tested, ["a", "b"], "left")
    far = F.when(F.col("sid") == F.col("p"), 0.0).otherwise(1 - F.col("shared") / (F.col("n") + F.col("pn") - F.col("shared")))
    return known.select("g", "sid", "n", "rank", "turn", far.alias("far"))


def keep_first(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest doc_id; columns as they were.

    A document is a doc_id with a text: of the texts of one id in a class one
    stays (by the text's hash), a text that is linked with nothing always
    stays, and rows equal in both stay or go together.  A null doc_id comes
    last.  Rows whose set is empty stay.
    """
    members, named = _classes(docs, near)
    ws = Workspace(docs.sparkSession, "near")
    placed = ws.save(members.where("n > 0").join(named, "sid").select("doc_id", "k", "comp"), "placed")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")
    kept = ws.save(placed.groupBy("comp").agg(F.min(place).alias("kept"), F.max(place).alias("final")).where("kept != final").drop("final"), "kept")
    gone = placed.join(kept, "comp").where(~F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) | (F.col("kept.k") != F.col("k")))
    gone = ws.save(gone.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k")).distinct(), "gone")
    few = gone.count() <= MOST_IDS
    # names that no column of docs has
    mark = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    gone = gone.toDF(f"{mark}id", f"{mark}k")
    same = (F.xxhash64(docs["text"].cast("binary")) == gone[f"{mark}k"]) & docs["doc_id"].cast("long").eqNullSafe(gone[f"{mark}id"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
