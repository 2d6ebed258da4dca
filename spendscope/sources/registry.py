"""Named source tables and the analysis period."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DatetimeType,
    MapType,
    NumericType,
    StringType,
    StructType,
)

from .schemas import SOURCE_DDL, schema_of


class SchemaMismatch(ValueError):
    """A bound table lacks a column, or holds it with an unusable type."""


class MissingSource(LookupError):
    """An operator needs a source that is not bound."""


@dataclass(frozen=True)
class AnalysisWindow:
    """The period that is analysed.

    ``start`` and ``end`` are both included in date filters. ``as_of`` stands in for
    "now", so that a run can be repeated; node metrics are read from
    ``as_of - lookback_days`` on.
    """

    start: date
    end: date
    as_of: datetime
    lookback_days: int = 30

    @property
    def period_days(self) -> int:
        return (self.end - self.start).days

    @property
    def metrics_start(self) -> datetime:
        return self.as_of - timedelta(days=self.lookback_days)

    def metrics_window(self) -> AnalysisWindow:
        """The dates that the node metrics cover."""
        return AnalysisWindow(
            self.metrics_start.date(), self.as_of.date(), self.as_of, self.lookback_days
        )


class SourceTables:
    """Binds DataFrames to logical names, checking each schema when it is bound.

    ``layout`` tells, by table, which partition columns hold the date of a time stamp, as
    ``{"node_timeline": {"day": "start_time"}}``: Spark cannot know that a filter on the time stamp
    leaves out whole days.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame],
        layout: Mapping[str, Mapping[str, str]] | None = None,
    ):
        self.spark = spark
        self.layout = dict(layout or {})
        self._tables: dict[str, DataFrame] = {}
        for name, df in tables.items():
            if name not in SOURCE_DDL:
                raise KeyError(f"unknown source {name!r}")
            problems = list(_mismatches(schema_of(name), df.schema, name))
            if problems:
                raise SchemaMismatch("; ".join(problems))
            days = self.layout.get(name, {})
            if absent := {*days, *days.values()} - set(df.columns):
                raise SchemaMismatch(f"{name} has no {', '.join(sorted(absent))}")
            self._tables[name] = df

    @classmethod
    def from_catalog(
        cls, spark: SparkSession, names: Mapping[str, str], layout: Mapping[str, Mapping[str, str]] | None = None
    ) -> SourceTables:
        """Bind catalog tables; those that do not exist stay unbound."""
        return cls(
            spark,
            {
                logical: spark.table(table)
                for logical, table in names.items()
                if spark.catalog.tableExists(table)
            },
            layout,
        )

    @classmethod
    def from_parquet(
        cls, spark: SparkSession, paths: Mapping[str, str], layout: Mapping[str, Mapping[str, str]] | None = None
    ) -> SourceTables:
        return cls(spark, {name: spark.read.parquet(path) for name, path in paths.items()}, layout)

    def has(self, name: str) -> bool:
        return name in self._tables

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise MissingSource(f"source {name!r} is not bound")
        return self._tables[name]

    def get_or_empty(self, name: str) -> DataFrame:
        """The table, or no rows of its schema when it is not bound."""
        if name in self._tables:
            return self._tables[name]
        return self.spark.createDataFrame([], schema_of(name))

    def within(self, name: str, column: str, start: datetime, end: datetime | None = None) -> DataFrame:
        """The table, without partitions that hold no ``column`` from ``start`` (to ``end``, both included).

        Partitions are days, so the caller still filters the time stamps. Partitions of null stay.
        """
        df = self.get_or_empty(name)
        for day, stamp in self.layout.get(name, {}).items() if self.has(name) else ():
            if stamp == column:
                wanted = F.to_date(day) >= F.lit(start.date())
                if end is not None:
                    wanted &= F.to_date(day) <= F.lit(end.date())
                df = df.filter(wanted | F.col(day).isNull())
        return df

    def names(self) -> list[str]:
        return [name for name in SOURCE_DDL if name in self._tables]

    def without(self, *names: str) -> SourceTables:
        return SourceTables(
            self.spark,
            {n: df for n, df in self._tables.items() if n not in names},
            {n: days for n, days in self.layout.items() if n not in names},
        )

    def with_table(self, name: str, df: DataFrame) -> SourceTables:
        layout = {n: days for n, days in self.layout.items() if n != name}
        return SourceTables(self.spark, {**self._tables, name: df}, layout)


def _family(dtype: DataType) -> str:
    if isinstance(dtype, NumericType):
        return "number"
    if isinstance(dtype, (DatetimeType,)) and not isinstance(dtype, DateType):
        return "timestamp"
    for kind in (DateType, StringType, BooleanType, ArrayType, MapType, StructType):
        if isinstance(dtype, kind):
            return kind.__name__
    return dtype.typeName()


def _mismatches(expected: StructType, actual: StructType, path: str):
    for field in expected.fields:
        where = f"{path}.{field.name}"
        if field.name not in actual.fieldNames():
            yield f"{where} is missing"
            continue
        found = actual[field.name].dataType
        identifier = field.name.endswith("_id") and {
            _family(found),
            _family(field.dataType),
        } <= {"number", "StringType"}
        if _family(found) != _family(field.dataType) and not identifier:
            yield f"{where} is {found.simpleString()}, not {field.dataType.simpleString()}"
        elif isinstance(field.dataType, StructType) and isinstance(found, StructType):
            yield from _mismatches(field.dataType, found, where)
