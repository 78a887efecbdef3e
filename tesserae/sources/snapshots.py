"""A log of versions: tables that are replaced by publishing the next entry, never overwritten.

Version n is the file ``log/<n>.json``, which names its tables and its parent.
Tables are written first, under names of their own; the entry is then published
under a name that only one writer can take.  A failure at any step leaves the
latest version as it was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tesserae.sources import storage


class Conflict(RuntimeError):
    """The log has gone on since the version that a change started from."""


@dataclass(frozen=True)
class Version:
    """An entry of the log; version 0 is the empty one before any."""

    number: int
    kind: str
    tables: dict[str, str] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


class SnapshotLog:
    """The versions under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _entry(self, number: int) -> str:
        return f"{self.root}/log/{number:012d}.json"

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in storage.names(self.spark, f"{self.root}/log") if n.endswith(".json") and not n.startswith(".")]

    def version(self, number: int | None = None) -> Version:
        """The given version, else the latest."""
        if number is None:
            number = max(self.numbers(), default=0)
        return Version(**json.loads(storage.read_text(self.spark, self._entry(number)))) if number else Version(0, "empty")

    def history(self) -> list[Version]:
        return [self.version(n) for n in self.numbers()]

    def put(self, df: DataFrame) -> str:
        """Write a table that no version names yet; its name for ``commit``."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def commit(self, base: Version, kind: str, tables: dict[str, str], note: dict | None = None) -> Version:
        """Publish the version after ``base``; raises Conflict where another one came first."""
        made = Version(base.number + 1, kind, tables, note or {})
        if self.version().number != base.number:
            raise Conflict(f"version {base.number} is not the latest")
        try:
            storage.publish(self.spark, self._entry(made.number), json.dumps(made.__dict__, sort_keys=True))
        except storage.Taken as e:
            raise Conflict(f"version {made.number} was published meanwhile") from e
        return made

    def read(self, table: str, version: Version | None = None) -> DataFrame | None:
        """A table of the given or latest version; None where it has none of that name."""
        at = (version or self.version()).tables.get(table)
        return self.spark.read.parquet(f"{self.root}/{at}") if at else None

    def rollback(self, number: int) -> Version:
        """A new version with the tables of an old one."""
        old = self.version(number)
        return self.commit(self.version(), "rollback", old.tables, {"of": number})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete tables that none of the last ``keep`` versions names; their names.  For a time without writers."""
        used = {t for v in self.history()[-keep:] for t in v.tables.values()}
        gone = [f"data/{n}" for n in storage.names(self.spark, f"{self.root}/data") if f"data/{n}" not in used]
        for name in gone:
            storage.delete(self.spark, f"{self.root}/{name}")
        return gone
