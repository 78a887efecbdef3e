"""Conversation prefix trie: what conversations share from their first turn on.

Each conversation's prefixes have chained digests: the digest of its first d
turns is the SHA-256 of the digest of its first d-1 turns and of turn d.  Equal
prefixes have equal digests, so the trie's nodes are the groups of all prefixes
by depth and digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import Workspace, small_batches
from tesserae.llm.text import n_words

#: Ids that one row of a chunk of member ids holds at most.
CHUNK = 4096
NODE = ["depth", "digest"]


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, ... by turn, nulls first; role, then text where equal), digest and n_words of every turn.

    Rows without a conv_id belong to no conversation.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), turn_digest(F.col("role"), F.col("text")).alias("digest"), n_words(F.col("text")).alias("n_words"))


def grafted(turns_: DataFrame, convs: DataFrame, every: int = 20, parts: int = 4) -> DataFrame:
    """The turns of conversations that begin with turns of another one.

    Conversation c takes its first h turns from conversation c - c % ``every``,
    h being the CRC-32 of c's digits modulo ``parts``, and its own after the first
    h.  At most ``parts`` - 1 turns of a conversation go to others.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(parts))
    own = turns_.where(F.col("pos") > h)
    heads = turns_.where(F.col("pos") < parts).withColumnRenamed("conv_id", "_from")
    wanting = convs.where(h > 0).select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("_from"), h.alias("_h"))
    taken = wanting.join(heads, "_from").where(F.col("pos") <= F.col("_h")).select(*turns_.columns)
    return own.unionByName(taken)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chains = []
        for conv in batch.column(1).to_pylist():
            digest, chain = b"", []
            for turn in conv:
                digest = hashlib.sha256(digest + turn["digest"]).digest()
                chain.append(digest)
            chains.append(chain)
        words = [[t["n_words"] for t in conv] for conv in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chains, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int64()))], names=["conv_id", "chain", "words"])


def chains(turns_: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, chain (digest of each prefix) and words (of each turn) of every conversation, turnless ones too."""
    small_batches(convs.sparkSession)
    rows = turns_.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n_words"))).alias("turns"))
    rows = convs.join(rows, "conv_id", "left").select("conv_id", F.coalesce("turns", F.array().cast(rows.schema["turns"].dataType)).alias("turns"))
    return rows.mapInArrow(_chained, "conv_id long, chain array<binary>, words array<long>")


def _suffix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a conversation's own nodes add to each node on its path: sums over own nodes at that depth or below."""
    for batch in batches:
        depth, digest, leaves, saved = [], [], [], []
        for chain, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first = len(chain) + 1 - len(own)  # own nodes are the last ones of the path
            value = np.array([[o["leaf"], o["saved"]] for o in own], np.int64)
            sums = np.cumsum(value[::-1], axis=0)[::-1]
            at = np.maximum(np.arange(len(chain) + 1) - first, 0)
            depth += range(len(chain) + 1)
            digest += [b"", *chain]
            leaves += sums[at, 0].tolist()
            saved += sums[at, 1].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(depth, pa.int32()), pa.array(digest, pa.binary()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names=[*NODE, "n_leaves", "saved_tokens"])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most CHUNK ids of one node, joined; rows come by node and id."""
    node, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=[*NODE, "first_id", "ids"])

    for batch in batches:
        for *here, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node is not None and (here != node or len(ids) == CHUNK):
                yield out()
                ids = []
            node = here
            ids.append(conv_id)
    if ids:
        yield out()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's joined ids; rows come by node and first id, and only the hash's state is kept."""
    node, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.binary()), pa.array([state.hexdigest()])], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *here, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here != node:
                if node is not None:
                    yield out()
                node, state = here, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield out()


def ends(chains_: DataFrame, ws: Workspace) -> DataFrame:
    """depth, digest and ends_sha256 of every node at which a conversation ends.

    Ids are dealt by range of node and id, so many conversations that end in
    one node are joined by many tasks; the hash then runs over the joined runs.
    """
    last = chains_.select(F.size("chain").alias("depth"), F.coalesce(F.get("chain", F.size("chain") - 1), F.lit(b"")).alias("digest"), "conv_id")
    runs = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_joined_ids, "depth int, digest binary, first_id long, ids string")
    runs = ws.save(runs, "runs")
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "first_id").select(*NODE, "ids").mapInArrow(_hashed_ids, "depth int, digest binary, ends_sha256 string")


def trie(chains_: DataFrame, ws: Workspace) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and digest.

    Prefixes combine in counts before the shuffle.  A node's smallest member
    is also that of every node below on its path, so each conversation knows its
    own nodes; it adds their sums up to each ancestor before the shuffle, which is
    a row for each node on its path instead of one for each pair of nodes.  No
    join has a key that the root or a frequent first turn could make hot,
    but for the lookup of parents, which reads written tables and may be split.
    """
    none = F.lit(b"").cast("binary")
    chains_ = ws.save(chains_, "chains")
    root = F.struct(F.lit(0).alias("depth"), none.alias("digest"), none.alias("parent"), F.lit(0).cast("long").alias("words"))
    below = F.transform("chain", lambda d, i: F.struct((i + 1).alias("depth"), d.alias("digest"), F.coalesce(F.get("chain", i - 1), none).alias("parent"), F.get("words", i).alias("words")))
    prefixes = chains_.select("conv_id", F.inline(F.concat(F.array(root), below)))
    # parent and words are the same in all rows of a node
    nodes = ws.save(prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("words").alias("words")), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = ws.save(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")

    value = F.struct("depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = nodes.groupBy("conv_id").agg(F.sort_array(F.collect_list(value)).alias("own"))
    sums = chains_.join(own, "conv_id").select("chain", "own").mapInArrow(_suffix_sums, "depth int, digest binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    full = ws.save(nodes.join(sums, NODE).join(ends(chains_, ws), NODE, "left"), "summed")

    # the root's member is the least id of all, which spares its children the lookup
    least = F.lit(chains_.agg(F.min("conv_id")).first()[0]).cast("long")
    far = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("_parent"))
    deep = full.where("depth > 1").join(far, ["depth", "parent"]).select(*full.columns, F.col("_parent").alias("parent_conv_id"))
    flat = full.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, least))
    every = deep.unionByName(flat)
    return every.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "digest",
    )


def prefix_trie(conversations: DataFrame, every: int | None = None) -> DataFrame:
    """The trie's nodes (see ``trie``) of conversations (conv_id, turn, role, text).

    ``every`` first grafts conversations (see ``grafted``).  Null roles and
    texts are empty ones; null turns come first; rows without a conv_id are
    left out; repeated rows are turns of their own; an empty table has no nodes,
    not even a root.  Further columns are not read.  A task holds the digests,
    not the texts, of its longest conversation.
    """
    ws = Workspace(conversations.sparkSession, "trie")
    own = ws.save(turns(conversations), "turns")
    convs = ws.save(own.select("conv_id").distinct(), "convs")
    return trie(chains(grafted(own, convs, every) if every else own, convs), ws)
