"""Job states by batch and stream, and the log source, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.sources import log_source
from tesserae.sources.log_source import LogSource
from tesserae.streaming import jobs

START = datetime(2026, 1, 1)
EVENT = "job_id string, at timestamp, seq long, kind string, value double"


def events(n_jobs=25, seed=2):
    rng = random.Random(seed)
    rows, seq = [], 0
    for j in range(n_jobs):
        t = rng.randrange(600)
        kinds = ["submitted"] if j % 5 else []
        for _ in range(rng.randrange(9)):
            kinds.append(rng.choice(["started", "progress", "progress", "cancel", "done", "failed", "cancelled", "restarted", "noise"]))
        for k in kinds:
            rows.append((f"j{j}", START + timedelta(seconds=t), seq, k, round(rng.random(), 3) if k == "progress" and rng.random() < 0.9 else None))
            t += rng.choice([0, 5, 60, 900])
            seq += 1
    return rows


def by_loop(rows, now, silence):
    out = {}
    for job in {r[0] for r in rows if r[0] is not None}:
        mine = sorted({(r[1], r[2], r[3], r[4]) for r in rows if r[0] == job and r[3] in jobs.KINDS}, key=lambda r: r[:2])
        if not mine:
            continue
        begins = [k for k, r in enumerate(mine) if r[2] in jobs.BEGINS]
        last = mine[begins[-1] :] if begins else mine
        end = next((r for r in last if r[2] in jobs.ENDS), None)
        last = last[: last.index(end) + 1] if end else last
        kinds, seen = {r[2] for r in last}, last[-1][0]
        progress = next((r[3] for r in reversed(last) if r[2] == "progress" and r[3] is not None), None)
        cancels, runs = "cancel" in kinds, bool(kinds & set(jobs.RUNS))
        quiet = (now - seen) > timedelta(milliseconds=silence)
        status = end[2] if end else "interrupted" if quiet and (cancels or runs) else "cancelling" if cancels else "running" if runs else "queued"
        out[job] = (status, last[0][0] if begins else None, seen, end[0] if end else None, progress, len(begins))
    return out


def as_dict(df):
    return {r["job_id"]: tuple(r[c] for c in ("status", "begun_at", "seen_at", "ended_at", "progress", "n_attempts")) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_job_states_against_a_loop(spark, seed):
    rows = events(40, seed)
    now = START + timedelta(seconds=2500)
    odd = [(None, START, 9000, "done", None), ("x", None, 9001, "done", None)] + rows[:20]  # no job, no time, repeated
    df = spark.createDataFrame(rows + odd, EVENT).repartition(3)
    got = as_dict(jobs.job_states(df, F.lit(now)))
    want = by_loop(rows, now, jobs.SILENCE)
    assert got == want and len({v[0] for v in want.values()}) >= 6


def test_job_fold_gives_the_same(spark):
    rows, now = events(60, 9), START + timedelta(seconds=3000)
    ms = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1000)
    folds = {}
    for job, at, seq, kind, value in sorted(rows, key=lambda r: (r[1], r[2])):
        folds.setdefault(job, jobs.JobFold()).take(ms(at), seq, kind, value)
    got = {j: f.row(j, ms(now), jobs.SILENCE)[1:] for j, f in folds.items() if f.s["last"]}
    assert got == by_loop(rows, now, jobs.SILENCE)


def test_job_state_stream_agrees_with_the_batch(spark, tmp_path):
    rows = events(20, 4)
    rng = random.Random(1)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    # batches of files: late by less than the lateness, some events twice, then one far ahead to move the watermark
    times = sorted({r[1] for r in ordered})
    borders = [times[len(times) * k // 4] for k in range(1, 4)]
    parts = [[] for _ in range(4)]
    for r in ordered:
        k = sum(r[1] >= b for b in borders)
        late = k < 3 and (borders[k] - r[1]) < timedelta(seconds=50) and rng.random() < 0.5
        parts[k + late].append(r)
        if rng.random() < 0.3:
            parts[k].append(r)
    far = START + timedelta(days=2)
    parts.append([("clock", far, 10_000, "submitted", None)])
    parts.append([("clock", far + timedelta(seconds=1), 10_001, "started", None)])
    src = tmp_path / "in"
    src.mkdir()
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / f"p{k}"))
    import os
    import shutil

    for k in range(len(parts)):
        f = next(p for p in (tmp_path / f"p{k}").iterdir() if p.suffix == ".parquet")
        shutil.copy(f, src / f"{k}.parquet")
        os.utime(src / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(src))
        out = jobs.job_state_stream(stream, "1 minute")
        q = out.writeStream.foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").trigger(availableNow=True).start()
        assert q.awaitTermination(150)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = as_dict(jobs.latest(spark.read.parquet(str(tmp_path / "out"))))
    got.pop("clock", None)
    assert got == by_loop(rows, far, jobs.SILENCE)


# ---- log source -------------------------------------------------------------------------------------------------


@pytest.fixture
def log(spark, tmp_path):
    spark.dataSource.register(LogSource)
    rng = random.Random(3)
    text = "".join(f"{k} " + "é" * rng.choice([0, 1, 7, 300]) + rng.choice(["\n", "\n", "\n\n"]) for k in range(400)) + "no newline at the end"
    at = tmp_path / "job.log"
    at.write_bytes(text.encode())
    return at, text.encode()


def read(spark, at, **options):
    r = spark.read.format("log_bytes").option("path", str(at))
    for k, v in options.items():
        r = r.option(k, v)
    return sorted(map(tuple, r.load().collect()))


def sliced(raw, offset):
    out, place = [], offset
    for line in raw[offset:].split(b"\n"):
        out.append((place, line.decode("utf-8", "replace")))
        place += len(line) + 1
    return out[:-1] if raw.endswith(b"\n") or offset >= len(raw) else out


@pytest.mark.parametrize("length", [1, 7, 64, 100_000])
def test_log_lines_by_byte_ranges(log, length):
    at, raw = log
    for offset in (0, 1, 13, len(raw) // 2, len(raw) - 1, len(raw), len(raw) + 5):
        parts = log_source.spans(offset, len(raw), length)
        assert [x for p in parts for x in log_source.lines(str(at), p)] == sliced(raw, offset), offset


def test_log_tail(spark, log):
    at, raw = log
    for offset in (0, 5, len(raw) // 3, len(raw) + 9):
        assert read(spark, at, offset=offset, range=500) == sliced(raw, offset)
        assert read(spark, at, offset=offset, limit=3) == sliced(raw, offset)[:3]
    assert read(spark, at.parent / "none.log") == []


def test_log_stream_resumes_without_loss(spark, log, tmp_path):
    at, raw = log

    def run():
        stream = spark.readStream.format("log_bytes").option("path", str(at)).option("range", 900).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    done = sliced(raw[: raw.rindex(b"\n") + 1], 0)
    assert run() == done  # the line without an end is not there yet
    with at.open("ab") as f:
        f.write(b" but now\nand more\nhalf")
    raw = at.read_bytes()
    assert run() == sliced(raw[: raw.rindex(b"\n") + 1], 0)
    assert run() == sliced(raw[: raw.rindex(b"\n") + 1], 0)
