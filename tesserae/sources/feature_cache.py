"""Features by content: only contents that were never seen are decoded.

The cache is a snapshot log with the files as last seen (path, time, length,
content hash) and generations of features by content hash.  A file whose time
and length are as before is not read; one with known content is not decoded.
New features become a generation; many generations are compacted to one that
holds the contents of files that are still there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources import storage
from tesserae.sources.copies import CHUNK
from tesserae.sources.snapshots import SnapshotLog, Version

#: Generations that are kept beside each other.
MOST_GENERATIONS = 8
FILES = ["path", "modificationTime", "length"]


def content_hashes(files: DataFrame) -> DataFrame:
    """``files`` with content_hash, 32 hex digits of the SHA-256 of what ``path`` holds; null where it can't be read.

    Files are read by their tasks, a few MB at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uri in batch["path"]:
                state = hashlib.sha256()
                try:
                    store, at = storage.opened(uri)
                    with store.open_input_stream(at) as f:
                        while part := f.read(CHUNK):
                            state.update(part)
                    out.append(state.hexdigest()[:32])
                except OSError:
                    out.append(None)
            yield batch.assign(content_hash=out)

    return files.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", content_hash string")


class FeatureCache:
    """The features that ``settings`` lead to; other settings start anew."""

    def __init__(self, spark: SparkSession, root: str, settings: dict):
        self.spark = spark
        key = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]
        self.log = SnapshotLog(spark, f"{root.rstrip('/')}/{key}")

    def _generations(self, version: Version) -> list[str]:
        return sorted(t for t in version.tables if t.startswith("features-"))

    def features(self, version: Version | None = None) -> DataFrame | None:
        """content_hash and features of the given or latest version."""
        version = version or self.log.version()
        parts = [self.log.read(g, version) for g in self._generations(version)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def refresh(self, files: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict]:
        """The features of all ``files`` (path, modificationTime, length), by path; and how many were read and decoded.

        ``compute`` takes rows (path), one for each unseen content, and gives
        path and features; a path that it leaves out has none, and is tried
        again next time.  Files that are gone have no row, repeated contents
        share one computation, and unreadable files have no features.
        """
        base = self.log.version()
        files = files.select(*FILES)
        before = self.log.read("files", base)
        if before is None:
            seen, fresh = None, files
        else:
            seen = files.join(before, FILES)
            fresh = files.join(before, FILES, "left_anti")
        now = self.log.put(content_hashes(fresh) if seen is None else seen.unionByName(content_hashes(fresh)))
        current = self.spark.read.parquet(f"{self.log.root}/{now}")
        read = fresh.count()

        known = self.features(base)
        first = current.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("path").alias("path"))
        missing = first if known is None else first.join(known.select("content_hash"), "content_hash", "left_anti")
        missing = storage.written(missing, "misses")
        decoded = missing.count()
        tables = {t: base.tables[t] for t in self._generations(base)} | {"files": now}
        if decoded:
            made = compute(missing.select("path")).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).join(missing, "path").drop("path")
            tables[f"features-{base.number + 1:09d}"] = self.log.put(made)
        version = self.log.commit(base, "refresh", tables, {"read": read, "decoded": decoded})
        if len(self._generations(version)) > MOST_GENERATIONS:
            version = self.compact(version)
        found = self.features(version)
        table = current if found is None else current.join(found, "content_hash")
        return table, {"read": read, "decoded": decoded, "version": version.number}

    def compact(self, base: Version | None = None) -> Version:
        """One generation with the features of files that are still there."""
        base = base or self.log.version()
        alive = self.log.read("files", base).select("content_hash").distinct()
        kept = self.features(base).join(alive, "content_hash", "left_semi")
        return self.log.commit(base, "compact", {"files": base.tables["files"], f"features-{base.number + 1:09d}": self.log.put(kept)})
