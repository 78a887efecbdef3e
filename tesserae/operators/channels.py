"""One registry of analysis channels: builds them, says what they can do, and answers requests by that.

What a channel can be sorted and filtered by follows from its table's schema,
so a new column, a registered extra one included, needs no list of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tesserae.operators import slices

DESCRIPTOR = "channel string, built boolean, buildable boolean, field_count int, sort_fields array<string>, filter_fields array<string>, debug_only_fields array<string>"


@dataclass(frozen=True)
class Channel:
    """A channel's name, key and builder (from a mapping of input tables); ``labels`` that its label strings may hold; fields for debugging only."""

    name: str
    build: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None
    key: str = "image_path"
    labels: tuple[str, ...] = ()
    debug: tuple[str, ...] = ()
    extra: tuple[tuple[str, Column], ...] = field(default=(), compare=False)

    def sort_fields(self, table: DataFrame) -> list[str]:
        """Numeric columns but for the key and those for debugging."""
        return sorted(f.name for f in table.schema if isinstance(f.dataType, NumericType) and f.name not in (self.key, *self.debug))


class Refused(ValueError):
    """A request that a channel's capabilities don't cover."""


class Registry:
    """Channels by name."""

    def __init__(self, channels: Iterable[Channel] = ()):
        self.channels = {c.name: c for c in channels}

    def __getitem__(self, name: str) -> Channel:
        if name not in self.channels:
            raise Refused(f"no channel {name!r}; there are {', '.join(sorted(self.channels))}")
        return self.channels[name]

    def extend(self, name: str, column: str, value: Column, debug: bool = False) -> None:
        """Register a further column of a channel, computed from its others when it is built."""
        c = self[name]
        if column in (n for n, _ in c.extra):
            raise Refused(f"{name} has a column {column} already")
        self.channels[name] = replace(c, extra=(*c.extra, (column, value)), debug=(*c.debug, column) if debug else c.debug)

    def build(self, name: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
        """The channel's table with its extra columns; refused where it can't be built or an extra column hides one of its own."""
        c = self[name]
        if c.build is None:
            raise Refused(f"{name} can't be built")
        table = c.build(inputs)
        if hidden := [n for n, _ in c.extra if n in table.columns]:
            raise Refused(f"{name} has columns of its own named {', '.join(hidden)}")
        return table.withColumns(dict(c.extra)) if c.extra else table

    def describe(self, spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
        """A row of DESCRIPTOR for each channel; ``tables`` has those that are built.  Reads schemas only."""
        rows = []
        for name, c in sorted(self.channels.items()):
            table = tables.get(name)
            sort = c.sort_fields(table) if table is not None else []
            debug = sorted(d for d in c.debug if table is not None and d in table.columns)
            labels = sorted(c.labels) if table is not None and "labels" in table.columns else []
            rows.append((name, table is not None, c.build is not None, len(sort), sort, labels, debug))
        return spark.createDataFrame(rows, DESCRIPTOR)

    def page(self, name: str, table: DataFrame, sort_by: str, label: str | None = None, where: str | None = None, debug: bool = False, **more) -> tuple[DataFrame, int]:
        """A page of a built channel (see :func:`slices.page`) and its total; fields, labels and conditions are checked first."""
        c = self[name]
        allowed = set(c.sort_fields(table)) | (set(c.debug) & set(table.columns) if debug else set())
        if sort_by not in allowed:
            raise Refused(f"{name} can't be sorted by {sort_by}")
        if label is not None and label not in c.labels:
            raise Refused(f"{name} has no label {label}")
        rows = table if where is None else table.where(self.condition(name, table, where, allowed))
        return slices.page(rows, allowed, sort_by, label=label, key=c.key, **more)

    def condition(self, name: str, table: DataFrame, where: str, allowed: Iterable[str] | None = None) -> Column:
        """A condition in SQL over allowed fields, labels and the key; refused by its analysed plan where it names or reads anything else."""
        c = self[name]
        fields = dict.fromkeys([c.key, *(allowed if allowed is not None else c.sort_fields(table)), *(["labels"] if "labels" in table.columns else [])])
        try:
            # an empty table with these fields only: a selection of a table would still resolve its other columns
            plan = table.sparkSession.createDataFrame([], table.select(*fields).schema).where(where)._jdf.queryExecution().analyzed()
        except (AnalysisException, ParseException) as e:
            raise Refused(f"{name}: {where!r} is no condition over {', '.join(sorted(fields))}") from e
        if plan.subqueriesAll().nonEmpty():
            raise Refused(f"{name}: {where!r} reads other tables")
        return F.expr(where)
