"""Names of clusters from the percentiles of their mean features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.config import TAG_RULES
from tesserae.functions.scalars import tag_score


#: Lifts means of rounded numbers off exact ties, so that these round up whatever the sum's order.
TIE = 1e-9


def rule_table(spark, rules: dict = TAG_RULES) -> DataFrame:
    rows = [(gi, g, ti, t, f, d, w) for gi, (g, tags) in enumerate(rules.items()) for ti, (t, parts) in enumerate(tags.items()) for f, d, w in parts]
    return spark.createDataFrame(rows, "g int, grp string, t int, tag string, feature string, direction string, rule_weight double")


def tag_scores(percentiles: DataFrame, rules: dict = TAG_RULES, cluster: str = "cluster_id") -> DataFrame:
    """The weighted mean score of each tag whose features there are, by cluster."""
    table = F.broadcast(rule_table(percentiles.sparkSession, rules))
    scored = percentiles.join(table, "feature").withColumn("s", tag_score(F.col("percentile"), F.col("direction")))
    return scored.groupBy(cluster, "g", "grp", "t", "tag").agg((F.sum(F.col("s") * F.col("rule_weight")) / F.sum("rule_weight")).alias("score"))


def name_clusters(percentiles: DataFrame, rules: dict = TAG_RULES, cluster: str = "cluster_id", top: int = 5) -> DataFrame:
    """cluster, suggested_name, name_confidence and tags (group, tag, confidence).

    The best tag of each group counts if it scores above 0.1 (the first rule
    on ties), the name joins those above 0.15, best first.  Clusters without
    a tag are called balanced.
    """
    scores = tag_scores(percentiles, rules, cluster).withColumn("score", F.round("score", 12))
    best = F.row_number().over(Window.partitionBy(cluster, "g").orderBy(F.desc("score"), "t"))
    tags = scores.withColumn("_n", best).where("_n = 1 AND score > 0.1")
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "g"))
    tags = tags.withColumn("place", place).where(F.col("place") <= top)
    confidence = F.round(F.least("score", F.lit(1.0)), 4)
    lists = tags.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("place", F.col("grp").alias("group"), "tag", confidence.alias("confidence"), "score"))).alias("tags"), F.round(F.avg(confidence) + TIE, 4).alias("name_confidence"))
    name = F.array_join(F.transform(F.filter("tags", lambda x: x["score"] > 0.15), lambda x: x["tag"]), "_")
    every = percentiles.select(cluster).distinct().join(lists, cluster, "left")
    return every.select(
        cluster,
        F.coalesce(F.nullif(name, F.lit("")), F.lit("balanced")).alias("suggested_name"),
        F.coalesce("name_confidence", F.lit(0.0)).alias("name_confidence"),
        F.transform("tags", lambda x: F.struct(x["group"].alias("group"), x["tag"].alias("tag"), x["confidence"].alias("confidence"))).alias("tags"),
    )
