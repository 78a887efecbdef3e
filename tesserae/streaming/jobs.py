"""Job states from events, as a batch and as a stream with the same rules.

Events are (job_id, at, seq, kind, value).  ``submitted`` and ``restarted``
begin an attempt; only the last attempt counts.  In it the first of ``done``,
``failed`` and ``cancelled`` ends the job.  Before that a job is ``queued``,
``running`` once it ``started`` or made ``progress`` (value: a share),
``cancelling`` once that was asked for (``cancel``), and ``interrupted`` while a job that
runs or is being cancelled has been silent for longer than a limit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BEGINS, ENDS, RUNS = ("submitted", "restarted"), ("done", "failed", "cancelled"), ("started", "progress")
KINDS = (*BEGINS, *ENDS, *RUNS, "cancel")
STATE = "job_id string, status string, begun_at timestamp, seen_at timestamp, ended_at timestamp, progress double, n_attempts long"
#: Milliseconds of silence after which a running job counts as interrupted.
SILENCE = 600_000


def job_states(events: DataFrame, now, silence: int = SILENCE) -> DataFrame:
    """One row of STATE for each job, as of ``now`` (a timestamp column); repeated events (job_id, seq) count once.

    The beginning of the last attempt and the end of a job are largest and
    smallest values, which combine before the shuffle, so a job of any number of
    events costs as much.  The joins have a job's begin and end on one side.
    """
    e = events.where(F.col("kind").isin(*KINDS) & F.col("job_id").isNotNull() & F.col("at").isNotNull())
    e = e.select(F.col("job_id").cast("string").alias("job_id"), F.struct("at", "seq").alias("t"), "kind", "value")
    begun = e.groupBy("job_id").agg(F.max(F.when(F.col("kind").isin(*BEGINS), F.col("t"))).alias("begun"), F.count_distinct(F.when(F.col("kind").isin(*BEGINS), F.col("t"))).alias("n_attempts"))
    last = e.join(begun, "job_id").where(F.col("begun").isNull() | (F.col("t") >= F.col("begun")))
    ended = last.groupBy("job_id").agg(F.min_by("kind", F.when(F.col("kind").isin(*ENDS), F.col("t"))).alias("end"), F.min(F.when(F.col("kind").isin(*ENDS), F.col("t"))).alias("ended"))
    last = last.join(ended, "job_id").where(F.col("ended").isNull() | (F.col("t") <= F.col("ended")))
    is_ = lambda *kinds: F.max(F.col("kind").isin(*kinds))
    by = last.groupBy("job_id").agg(
        F.first("begun").alias("begun"), F.first("n_attempts").alias("n_attempts"), F.first("end").alias("end"), F.first("ended").alias("ended"), F.max("t").alias("seen"),
        is_(*RUNS).alias("runs"), is_("cancel").alias("cancels"), F.max_by("value", F.when((F.col("kind") == "progress") & F.col("value").isNotNull(), F.col("t"))).alias("progress"),
    )
    silent = (F.unix_millis(now) - F.unix_millis(F.col("seen.at").cast("timestamp"))) > silence
    active = F.col("runs") | F.col("cancels")
    status = F.when(F.col("end").isNotNull(), F.col("end")).when(active & silent, "interrupted").when(F.col("cancels"), "cancelling").when(F.col("runs"), "running").otherwise("queued")
    return by.select("job_id", status.alias("status"), F.col("begun.at").alias("begun_at"), F.col("seen.at").alias("seen_at"), F.col("ended.at").alias("ended_at"), "progress", "n_attempts")


class JobFold:
    """The same rules, event by event in order."""

    NEW = {"begun": None, "seen": None, "ended": None, "end": None, "runs": False, "cancels": False, "progress": None, "n": 0, "last": None}

    def __init__(self, known: dict | None = None):
        self.s = dict(known or self.NEW)

    def take(self, at: int, seq: int, kind: str, value: float | None) -> None:
        s = self.s
        if kind not in KINDS or s["last"] == [at, seq]:
            return
        s["last"] = [at, seq]
        if kind in BEGINS:
            self.s = dict(self.NEW) | {"begun": at, "seen": at, "n": s["n"] + 1, "last": s["last"]}
            return
        if s["end"]:
            return
        s["seen"] = at
        if kind in ENDS:
            s["end"], s["ended"] = kind, at
        elif kind == "cancel":
            s["cancels"] = True
        else:
            s["runs"] = True
            if kind == "progress" and value is not None:
                s["progress"] = value

    def active(self) -> bool:
        return not self.s["end"] and (self.s["runs"] or self.s["cancels"])

    def row(self, job_id: str, now: int, silence: int) -> tuple:
        s = self.s
        time = lambda ms: None if ms is None else datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)
        if s["end"]:
            status = s["end"]
        elif self.active() and now - s["seen"] > silence:
            status = "interrupted"
        else:
            status = "cancelling" if s["cancels"] else "running" if s["runs"] else "queued"
        return job_id, status, time(s["begun"]), time(s["seen"]), time(s["ended"]), s["progress"], s["n"]


class _Processor(StatefulProcessor):
    """Buffers a job's events until the watermark has passed them, then folds them in order; a timer wakes silent jobs.

    State is the fold and the events within the lateness, each event id once.
    """

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._load()[1]
        now = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for at, seq, kind, value in frame[["at_ms", "seq", "kind", "value"]].itertuples(index=False):
                if at > now:  # later than the lateness: an event that the batch would count, the stream can't
                    waiting[str(int(seq))] = [int(at), int(seq), kind, None if pd.isna(value) else float(value)]
        yield self._advance(key[0], waiting, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key[0], self._load()[1], timerValues.getCurrentWatermarkInMs())

    def _load(self) -> tuple[dict | None, dict]:
        if not self.state.exists():
            return None, {}
        known = json.loads(self.state.get()[0])
        return known["fold"], known["waiting"]

    def _advance(self, job_id: str, waiting: dict, now: int) -> pd.DataFrame:
        fold = JobFold(self._load()[0])
        for e in sorted(e for e in waiting.values() if e[0] <= now):
            fold.take(*e)
        waiting = {k: e for k, e in waiting.items() if e[0] > now}
        self.state.update((json.dumps({"fold": fold.s, "waiting": waiting}),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [e[0] for e in waiting.values()] + ([fold.s["seen"] + self.silence + 1] if fold.active() else [])
        if due := [t for t in due if t > now]:
            self.handle.registerTimer(min(due))
        names = [x.split()[0] for x in STATE.split(", ")] + ["as_of"]
        rows = [] if fold.s["last"] is None else [(*fold.row(job_id, now, self.silence), now)]
        out = pd.DataFrame(rows, columns=names)
        for c in ("begun_at", "seen_at", "ended_at"):
            out[c] = pd.to_datetime(out[c])
        return out.astype({"progress": "float64", "n_attempts": "int64", "as_of": "int64"})


def job_state_stream(events: DataFrame, lateness: str = "1 minute", silence: int = SILENCE) -> DataFrame:
    """Rows of STATE and as_of (the watermark in milliseconds) whenever a job's state is looked at; the last one of a job holds.

    Events may come in any order within ``lateness`` and repeatedly; later ones
    are left out.  Needs the RocksDB state store.  Times count in milliseconds.
    """
    rows = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull()).select(F.col("job_id").cast("string").alias("job_id"), "at", F.unix_millis("at").alias("at_ms"), F.col("seq").cast("long").alias("seq"), "kind", F.col("value").cast("double").alias("value"))
    rows = rows.withWatermark("at", lateness)
    return rows.groupBy("job_id").transformWithStateInPandas(_Processor(silence), f"{STATE}, as_of long", "Update", "EventTime")


def latest(rows: DataFrame) -> DataFrame:
    """The last state of each job among the rows that a stream has given."""
    fields = [x.split()[0] for x in STATE.split(", ")][1:]
    best = rows.groupBy("job_id").agg(F.max_by(F.struct(*fields), F.struct("as_of", F.coalesce("seen_at", F.lit(0).cast("timestamp")), "n_attempts")).alias("s"))
    return best.select("job_id", "s.*")
