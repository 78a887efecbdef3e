"""Thumbnails as an incremental sink: only images that are new or were touched are decoded and written.

What has been written is a table of a snapshot log (path, modificationTime,
name); a file is written under its attempt's name and renamed, and counts once
the log names it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import kernels
from tesserae.sources import images, storage
from tesserae.sources.snapshots import SnapshotLog

#: The longer side of a thumbnail, and how many of a cluster are shown.
SIDE, PER_CLUSTER = 256, 16
WRITTEN = "path string, name string, thumb_width int, thumb_height int, bytes long, error string"


def png(rgb: np.ndarray) -> bytes:
    """An RGB image of bytes as a PNG file."""
    height, width, _ = rgb.shape
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = rgb.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def name_of(path: str) -> str:
    """A thumbnail's file name, which its image's path decides."""
    return hashlib.sha256(path.encode()).hexdigest()[:32] + ".png"


def _written(decoded: DataFrame, root: str, side: int) -> DataFrame:
    names = [x.split()[0] for x in WRITTEN.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()
        for batch in batches:
            rows = []
            for path, w, h, c, data in batch.itertuples(index=False):
                if w is None or w <= 0 or data is None or not len(data):
                    rows.append((path, None, None, None, None, "cannot decode"))
                    continue
                rgb, _ = images.pixels(int(w), int(h), int(c), data)
                small = np.rint(kernels.shrink(rgb, side) * 255).clip(0, 255).astype(np.uint8)
                body, name = png(small), name_of(path)
                store, at = storage.opened(root)
                store.create_dir(at, recursive=True)
                own = f"{at}/.{name}.{task}"
                with store.open_output_stream(own, compression=None) as out:
                    out.write(body)
                store.move(own, f"{at}/{name}")
                rows.append((path, name, small.shape[1], small.shape[0], len(body), None))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"thumb_width": "Int32", "thumb_height": "Int32", "bytes": "Int64"})

    same = decoded.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    return same.select("path", "width", "height", "nChannels", "data").mapInPandas(run, WRITTEN)


def refresh(spark: SparkSession, files: DataFrame, root: str, side: int = SIDE) -> tuple[DataFrame, int]:
    """Thumbnails below ``root`` for all ``files`` (path, modificationTime): their table, and how many were written now.

    Images are averaged over areas down to ``side``; smaller ones keep their
    size.  Files that are gone have no row; those that can't be decoded have an
    error instead of a name, and are tried again once they are touched.
    """
    root = root.rstrip("/")
    log = SnapshotLog(spark, f"{root}/_thumbnails")
    base = log.version()
    files = files.select("path", "modificationTime")
    before = log.read("written", base)
    fresh = files if before is None else files.join(before, ["path", "modificationTime"], "left_anti")
    fresh = storage.written(fresh, "fresh")
    n = fresh.count()
    if not n and before is not None and before.count() == files.count():
        return before, 0
    now = _written(images.read_paths(spark, fresh), root, side).join(fresh, "path").select("path", "modificationTime", *(x.split()[0] for x in WRITTEN.split(", ")[1:]))
    kept = None if before is None else before.join(files, ["path", "modificationTime"], "left_semi")
    table = log.put(now if kept is None else kept.unionByName(now))
    version = log.commit(base, "refresh", {"written": table}, {"written": n})
    return log.read("written", version), n


def first_of_clusters(rows: DataFrame, key: str = "path", cluster: str = "cluster_id", most: int = PER_CLUSTER) -> DataFrame:
    """``rows`` with their place, the first of each cluster by key.  Tasks keep ``most`` of a cluster before the shuffle, so no task gets a whole one."""
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(key))
    return rows.withColumn("place", place).where(F.col("place") <= most)
