"""Sharding over fixed virtual slots with a stored, versioned slot-to-shard map.

The map lives in a folder that the caller names, a table for each version:
``load`` gives one, ``rebalanced``, ``grown`` and ``moved`` edit it, and
``save`` stores the next version.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import Workspace

N_SLOTS, N_SHARDS = 4096, 8
#: Repeated rows that may be broadcast; beyond, they are joined by a shuffle.
MOST_REPEATS = 1_000_000


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot; an edit makes the next version."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def first(cls, n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        """Version 0: slots dealt in turn."""
        return cls(0, n_shards, tuple(s % n_shards for s in range(n_slots)))

    @classmethod
    def load(cls, spark: SparkSession, store: str, version: int | None = None) -> SlotMap | None:
        """The latest or the given version of the map in ``store``; None where there is none."""
        try:
            table = spark.read.parquet(f"{store}/slot_map")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows)) if rows else None

    def save(self, spark: SparkSession, store: str) -> SlotMap:
        """Store this version; a version that is there already is never overwritten."""
        rows = [(slot, shard, self.n_shards) for slot, shard in enumerate(self.shard_of)]
        table = spark.createDataFrame(rows, "virtual_slot int, shard int, n_shards int").coalesce(1)
        table.write.mode("errorifexists").parquet(f"{store}/slot_map/version={self.version}")
        return self

    @property
    def n_slots(self) -> int:
        return len(self.shard_of)

    def grown(self, n_shards: int | None = None) -> SlotMap:
        """Further shards (one more, or up to ``n_shards``), which are empty until the map is rebalanced."""
        return SlotMap(self.version + 1, n_shards or self.n_shards + 1, self.shard_of)

    def moved(self, slot: int, shard: int) -> SlotMap:
        """An edit by hand: one slot in another shard."""
        if not 0 <= shard < self.n_shards:
            raise ValueError(f"there is no shard {shard}")
        return replace(self, version=self.version + 1, shard_of=(*self.shard_of[:slot], shard, *self.shard_of[slot + 1 :]))

    def rebalanced(self, size_of: dict[int, int]) -> SlotMap:
        """Move single slots from the fullest to the emptiest shard while that narrows the gap.

        A move takes the slot nearest to half the gap.  Slots that need not
        move keep their shard, so rebalancing rewrites little data.
        """
        held: list[dict[int, int]] = [{} for _ in range(self.n_shards)]
        for slot, shard in enumerate(self.shard_of):
            held[shard][slot] = size_of.get(slot, 0)
        total = [sum(x.values()) for x in held]
        for _ in range(4 * len(self.shard_of)):
            high = max(range(self.n_shards), key=lambda s: (total[s], -s))
            low = min(range(self.n_shards), key=lambda s: (total[s], s))
            gap = total[high] - total[low]
            fits = [(abs(2 * b - gap), slot) for slot, b in held[high].items() if 0 < b < gap]
            if not fits:
                break
            slot = min(fits)[1]
            held[low][slot] = moved = held[high].pop(slot)
            total[high] -= moved
            total[low] += moved
        shard_of = {slot: shard for shard, slots in enumerate(held) for slot in slots}
        return SlotMap(self.version + 1, self.n_shards, tuple(shard_of[s] for s in range(len(self.shard_of))))


def _with_slots(docs: DataFrame, n_slots: int, ws: Workspace) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row.

    A slot is a hash of the id and of the text's CRC, so neither a hot source
    nor a large group of copies gathers in one slot.  Rows that repeat both
    are told apart by their place in the written table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = ws.save(rows.withColumn("place", F.monotonically_increasing_id()), "rows")
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text_crc32", "size")
    keyed = rows.withColumn("key", key)
    repeats = ws.save(keyed.groupBy("key").count().where(F.col("count") > 1).select("key", F.lit(True).alias("again")), "repeats")
    few = repeats.count() <= MOST_REPEATS
    marked = keyed.join(F.broadcast(repeats) if few else repeats, "key", "left")
    slot = F.pmod(F.when(F.col("again"), F.xxhash64("key", "place")).otherwise(F.col("key")), F.lit(n_slots)).cast("int")
    return ws.save(marked.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot")), "slots")


def _start(spark: SparkSession, n_shards: int | None, n_slots: int | None, previous: SlotMap | None, store: str | None) -> SlotMap:
    """The map to start from; raises where the arguments contradict it."""
    known = previous or (SlotMap.load(spark, store) if store else None)
    if known is None:
        return SlotMap.first(n_shards or N_SHARDS, n_slots or N_SLOTS)
    if n_slots not in (None, known.n_slots):
        raise ValueError(f"the map has {known.n_slots} slots, not {n_slots}")
    if n_shards is not None and n_shards < known.n_shards:
        raise ValueError(f"the map has {known.n_shards} shards; fewer would need moves by hand")
    return known if n_shards in (None, known.n_shards) else known.grown(n_shards)


def shard_documents(docs: DataFrame, n_shards: int | None = None, n_slots: int | None = None, previous: SlotMap | None = None, store: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Deal documents out to shards of near equal bytes.

    Bytes and rows are summed by slot (``n_slots`` rows reach the driver,
    whatever the input).  The map to start from is ``previous``, else the
    latest in ``store``, else ``n_slots`` slots (N_SLOTS) dealt in turn to
    ``n_shards`` shards (N_SHARDS).  A given map has its own number of slots, and
    another ``n_slots`` raises; more shards than it has are added, fewer
    raise.  It is rebalanced by moving single slots.  Where ``store`` names a
    folder, the result is stored there as the next version, loaded again, and
    documents are dealt by what was loaded.

    Result: doc_id, size (UTF-8 bytes + 1; a null text has none), text_crc32
    (of no bytes for null), virtual_slot, shard and slot: the row's position
    within its shard, gapless from 0, by virtual slot, then doc_id, CRC and
    size (nulls first).  Repeated rows get a slot and a position each, so that
    many of them spread over the shards.  An empty table gives no rows and the
    map it started from, rebalanced.  Further columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    known = _start(spark, n_shards, n_slots, previous, store)
    rows = _with_slots(docs, known.n_slots, ws)
    by_slot = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}
    slot_map = known.rebalanced({k: v[0] for k, v in by_slot.items()})
    if store:
        slot_map.save(spark, store)
        slot_map = SlotMap.load(spark, store, slot_map.version)
    if unknown := [s for s in by_slot if not 0 <= s < slot_map.n_slots]:
        raise ValueError(f"the map lacks slots of documents: {unknown[:5]}")
    start, dealt = [0] * slot_map.n_shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        dealt.append((slot, shard, start[shard]))
        start[shard] += by_slot.get(slot, (0, 0))[1]
    table = spark.createDataFrame(dealt, "virtual_slot int, shard int, first_slot long")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("nth", F.row_number().over(within)).join(F.broadcast(table), "virtual_slot", "left")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first_slot") + F.col("nth") - 1).cast("long").alias("slot")), slot_map
