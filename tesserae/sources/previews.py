"""Preview clusterings beside the current one: create, list, get, apply, roll back.

Labels and pending moves are tables of a snapshot log, so that applying a preview
changes both at once, and of two applies from the same version one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.metrics import label_changes, recluster_risks
from tesserae.operators.overlay import merge_fields
from tesserae.sources import storage
from tesserae.sources.snapshots import SnapshotLog, Version

EDITS = "image_id string, cluster_id int, cluster_name string, seq long"


class ManualEdits(RuntimeError):
    """Applying would discard moves or names that a user made."""


class Previews:
    """Previews of one job under ``root``; each has six parts.

    ``points`` (image_id, cluster_id, coordinates), ``summary`` (cluster_id,
    count, ratio), ``names`` (cluster_id, cluster_name), ``diff`` (old_cluster,
    new_cluster, count of the rows that both labellings have), and the documents
    ``recipe`` and ``metrics``, which has the change's risks.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = SnapshotLog(spark, f"{self.root}/labels")

    def _at(self, name: str, part: str) -> str:
        return f"{self.root}/previews/{name}/{part}"

    def create(self, points: DataFrame, recipe: Mapping, metrics: Mapping, name: str | None = None) -> str:
        """Write a preview of rows (image_id, cluster_id and further columns); its name.

        A preview counts once its metrics are there, which come last; the
        difference is to the labels that are current now.
        """
        name = name or f"preview_{uuid.uuid4().hex[:12]}"
        at = self._at(name, "points")
        points.withColumn("cluster_id", F.col("cluster_id").cast("int")).write.parquet(at)
        points = self.spark.read.parquet(at)
        total = points.count()
        real = points.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("count"))
        summary = real.select("cluster_id", "count", F.round(F.col("count") / F.lit(max(total, 1)), 4).alias("ratio"))
        names = real.select("cluster_id", F.format_string("cluster_%03d", "cluster_id").alias("cluster_name"))
        base = self.log.version()
        current = self.log.read("labels", base)
        old = (points if current is None else current).select("image_id", F.col("cluster_id").alias("old_cluster"))
        both = points.select("image_id", F.col("cluster_id").alias("new_cluster")).join(old, "image_id")
        diff = both.groupBy("old_cluster", "new_cluster").agg(F.count("*").alias("count"))
        for part, df in (("summary", summary), ("names", names), ("diff", diff)):
            df.coalesce(1).write.json(self._at(name, part))
        changes, _ = label_changes(both, "image_id", "old_cluster", "new_cluster")
        found = {"base_version": base.number, "n_images": total, "risks": recluster_risks(changes).first()["risks"], "changes": changes.first().asDict()}
        recipe = {k: v for k, v in recipe.items() if k != "embedding"}
        storage.publish(self.spark, self._at(name, "recipe.json"), json.dumps(recipe, sort_keys=True))
        storage.publish(self.spark, self._at(name, "metrics.json"), json.dumps(dict(metrics) | found, sort_keys=True))
        return name

    def names(self) -> list[str]:
        """Finished previews, in order."""
        return [n for n in storage.names(self.spark, f"{self.root}/previews") if storage.exists(self.spark, self._at(n, "metrics.json"))]

    def get(self, name: str) -> dict:
        """A preview's parts: tables, and the two documents."""
        if name not in self.names():
            raise KeyError(name)
        schemas = {"summary": "cluster_id int, count long, ratio double", "names": "cluster_id int, cluster_name string", "diff": "old_cluster int, new_cluster int, count long"}
        tables = {p: self.spark.read.schema(s).json(self._at(name, p)) for p, s in schemas.items()}
        documents = {p: json.loads(storage.read_text(self.spark, self._at(name, f"{p}.json"))) for p in ("recipe", "metrics")}
        return {"points": self.spark.read.parquet(self._at(name, "points"))} | tables | documents

    def labels(self, version: Version | None = None) -> DataFrame | None:
        """The labels of the given or current version; None before any."""
        return self.log.read("labels", version)

    def edits(self) -> DataFrame:
        """Pending moves and names over the current labels: the last cluster_id and cluster_name of each image that is not null."""
        found = self.log.read("edits")
        return merge_fields(found if found is not None else self.spark.createDataFrame([], EDITS), "image_id", ["cluster_id", "cluster_name"])

    def edit(self, changes: DataFrame) -> Version:
        """Add moves or names (image_id, cluster_id, cluster_name, seq), all or none, over the labels that were current when this began."""
        base = self.log.version()
        changes = changes.select("image_id", "cluster_id", "cluster_name", "seq")
        before = self.log.read("edits", base)
        log = changes if before is None else before.unionByName(changes)
        return self.log.commit(base, "edit", base.tables | {"edits": self.log.put(log)})

    def apply(self, name: str, force: bool = False, base: Version | None = None) -> Version:
        """Make a preview's labels current.  Pending edits are for other clusters then: they raise ManualEdits, or go with ``force``.

        ``base`` is the version that the caller looked at; a later one raises Conflict.
        """
        base = base or self.log.version()
        if "edits" in base.tables and not force and not self.log.read("edits", base).isEmpty():
            raise ManualEdits(name)
        points = self.get(name)["points"]
        return self.log.commit(base, "apply", {"labels": self.log.put(points)}, {"preview": name})

    def rollback(self, number: int) -> Version:
        """Bring back labels and edits of an earlier version."""
        return self.log.rollback(number)
