"""Exports that copy files: a sink whose tasks may fail, run twice or be killed at any point.

A file is written under a name of its attempt in the export's hidden folder and
renamed when it is complete, so a target is there as a whole or not at all.  A
target that is there already is never overwritten: with the same content it
counts as copied, by an attempt or run before, else it is a conflict.  Running an
export again therefore finishes it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.export import contained, normal_path
from tesserae.sources import storage

CHUNK = 4 << 20
#: The states of a file; the first two are successes.
COPIED, PRESENT, CONFLICT, MISSING, OUTSIDE, FAILED = "copied", "present", "conflict", "missing", "outside", "failed"
STATUS = "rank int, image_id string, path string, target string, status string, bytes long, sha256 string, reason string"


def new_folder(spark: SparkSession, base: str, name: str) -> str:
    """A folder of that name, or with ``_001`` and so on, that nothing has been exported to."""
    taken = set(storage.names(spark, base))
    return next(f"{base.rstrip('/')}/{n}" for n in (name, *(f"{name}_{k:03d}" for k in range(1, len(taken) + 2))) if n not in taken)


def _digest(store: pafs.FileSystem, at: str) -> tuple[int, str]:
    size, state = 0, hashlib.sha256()
    with store.open_input_stream(at) as f:
        while part := f.read(CHUNK):
            state.update(part)
            size += len(part)
    return size, state.hexdigest()


def copy_file(source: str, root: str, target: str, attempt: str) -> tuple[str, int | None, str | None, str | None]:
    """Copy one file; status, bytes, SHA-256 and reason."""
    try:
        from_store, from_path = storage.opened(source)
        to_store, to_root = storage.opened(root)
        to_path = f"{to_root.rstrip('/')}/{target}"
        if from_store.get_file_info(from_path).type != pafs.FileType.File:
            return MISSING, None, None, "no such file"
        if to_store.get_file_info(to_path).type != pafs.FileType.NotFound:
            size, digest = _digest(from_store, from_path)
            same = to_store.get_file_info(to_path).size == size and _digest(to_store, to_path)[1] == digest
            return (PRESENT if same else CONFLICT), size, digest, None if same else "another file has this name"
        own = f"{to_root.rstrip('/')}/.copying/{attempt}"
        to_store.create_dir(own.rsplit("/", 1)[0], recursive=True)
        to_store.create_dir(to_path.rsplit("/", 1)[0], recursive=True)
        size, state = 0, hashlib.sha256()
        with from_store.open_input_stream(from_path) as f, to_store.open_output_stream(own) as out:
            while part := f.read(CHUNK):
                out.write(part)
                state.update(part)
                size += len(part)
        to_store.move(own, to_path)
        return COPIED, size, state.hexdigest(), None
    except OSError as e:
        return FAILED, None, None, str(e)[:200]


def write_files(files: DataFrame) -> DataFrame:
    """path and bytes of files written from rows (path, body); an existing file is replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, body in batch[["path", "body"]].itertuples(index=False):
                store, at = storage.opened(path)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(body.encode())
            yield pd.DataFrame({"path": batch["path"], "bytes": [len(b.encode()) for b in batch["body"]]})

    return files.select("path", "body").mapInPandas(run, "path string, bytes long")


def copy(plan: DataFrame, root: str, roots: list[str]) -> DataFrame:
    """Status rows (see STATUS) of a plan (rank, image_id, path, target) whose targets lie under ``root``.

    Sources must lie inside ``roots`` and targets inside ``root`` once ``..`` is
    resolved; others are ``outside`` and not touched.  Nothing is copied before
    the rows are read, and each reading copies what is not there yet.
    """
    bare = F.regexp_replace("path", "^file:/+", "/")
    inside = contained(bare, [r.removeprefix("file://") for r in roots]) & contained(F.concat(F.lit("root/"), F.col("target")), ["root"])
    rows = plan.select("rank", F.col("image_id").cast("string").alias("image_id"), "path", normal_path(F.col("target")).alias("target"), inside.alias("_inside"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()
        for batch in batches:
            done = []
            for rank, image_id, path, target, ok in batch.itertuples(index=False):
                attempt = f"{task}-{hashlib.sha256(target.encode()).hexdigest()[:32]}"
                found = copy_file(path, root, target, attempt) if ok else (OUTSIDE, None, None, "not inside the roots")
                done.append((rank, image_id, path, target, *found))
            out = pd.DataFrame(done, columns=[x.split()[0] for x in STATUS.split(", ")])
            yield out.astype({"bytes": "Int64"})

    return rows.mapInPandas(run, STATUS)


def export(plan: DataFrame, root: str, roots: list[str], records: str, export_id: str, kind: str = "images", tasks: int | None = None) -> dict:
    """Copy a plan's files and publish a record under ``records``; the record.

    ``tasks`` deals the files out by a hash of the target, so that one folder
    or cluster isn't one task.  The status rows are written first; the record
    names them and counts each status, and is published once: an export that has
    one returns it unchanged.  Killed before that, it is run again with the same
    plan and id.
    """
    spark = plan.sparkSession
    at = f"{records.rstrip('/')}/{export_id}.json"
    if storage.exists(spark, at):
        return json.loads(storage.read_text(spark, at))
    plan = plan.repartition(tasks, F.xxhash64("target")) if tasks else plan
    rows_at = f"{records.rstrip('/')}/{export_id}.rows"
    copy(plan, root, roots).write.mode("overwrite").parquet(rows_at)
    rows = spark.read.parquet(rows_at)
    counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
    bad = rows.where(~F.col("status").isin(COPIED, PRESENT)).orderBy("rank", "target").limit(20).collect()
    storage.delete(spark, f"{root.rstrip('/')}/.copying")
    done = counts.get(COPIED, 0) + counts.get(PRESENT, 0)
    record = {
        "export_id": export_id, "kind": kind, "root": root, "rows": rows_at, "counts": counts, "exported_count": done,
        "failed_count": sum(counts.values()) - done, "failed": [{k: r[k] for k in ("image_id", "path", "target", "status", "reason")} for r in bad],
    }
    try:
        storage.publish(spark, at, json.dumps(record, sort_keys=True))
    except storage.Taken:  # the same export ran twice at once
        return json.loads(storage.read_text(spark, at))
    return record


def records(spark: SparkSession, folder: str) -> list[dict]:
    """The published records, by id."""
    return [json.loads(storage.read_text(spark, f"{folder.rstrip('/')}/{n}")) for n in storage.names(spark, folder) if n.endswith(".json") and not n.startswith(".")]


def record_rows(spark: SparkSession, folder: str, export_id: str) -> DataFrame:
    """The status rows of one export."""
    return spark.read.parquet(json.loads(storage.read_text(spark, f"{folder.rstrip('/')}/{export_id}.json"))["rows"])
