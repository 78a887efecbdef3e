"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: a reliable checkpoint in the session's folder.

    Only a local session without such a folder caches instead; on a cluster
    that would lose rows with an executor, so this raises.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir():
        return df.checkpoint()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return df.cache()


def components(edges: DataFrame) -> DataFrame:
    """id and root, the smallest id that edges (a, b) reach, for every id with an edge.

    Rounds of the neighbours' smallest root, then that root's root; their
    number grows with the logarithm of the longest chain.  The joins merge:
    Spark would else send a table of up to 10 MB by the driver in each of them.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "root").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        step = now.join(near.hint("merge"), "id").select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = now.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = cut(step.join(jump.hint("merge"), "root").select("id", "old", F.least("root", "far").alias("root")))
        now = new.select("id", "root")
        if new.where("old != root").isEmpty():
            return now
