"""Polls as a stream: what has changed since the last poll began, read with its conditions at the store.

A table of records (Parquet files with a column of change times) is read through a Python data source. As a batch it takes comparisons with constants off the
plan and applies them while it reads, so that only rows that pass leave the reader. As a stream its offset is a moment: a poll reads what has changed
between the moment at which the last one began and the one at which it begins itself, which is taken before anything is read, so that a
change made during a poll is met by the next one. The first poll looks back a number of days. Spark's checkpoint keeps the moment, so a restart goes on where
the last poll ended, and a batch that has to be done again reads the same span.

Files are listed on the driver, which opens none of them, and dealt to at most PARTS tasks. A task holds a few batches of one file at a time, and skips row
groups whose statistics show that nothing in them passes, the span included. Tasks open the files themselves, so the folder must be one that they reach by the
same path.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


#: Most tasks of a poll.
PARTS = 4096


class _Files(InputPartition):
    """Files of one task and the span of change times that is asked for."""

    def __init__(self, paths: list[str], after: str | None = None, upto: str | None = None):
        self.paths, self.after, self.upto = paths, after, upto


def _dealt(paths: list[str], after: str | None = None, upto: str | None = None) -> list[_Files]:
    n = min(len(paths), PARTS)
    return [_Files(paths[i::n], after, upto) for i in range(n)]


def _dataset(path: str) -> ds.Dataset:
    return ds.dataset(path.removeprefix("file://"), format="parquet")


def _literal(value: object, column: pa.DataType) -> pa.Scalar:
    """A constant in the type of its column; a moment without a zone is one in UTC, as in the files."""
    if isinstance(value, datetime) and pa.types.is_timestamp(column):
        value = value.astimezone(timezone.utc) if value.tzinfo else value
        value = value if column.tz else value.replace(tzinfo=None)
    return pa.scalar(value, column)


def _moment(text: str) -> datetime:
    return datetime.fromisoformat(text)


class _Reading:
    """Rows of a file that pass conditions, as batches in the schema of the source."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.column = options["changed"]
        self.conditions: list[tuple] = []

    def files(self) -> list[str]:
        return sorted(_dataset(self.options["path"]).files)

    def rows(self, part: _Files) -> Iterator[pa.RecordBatch]:
        for path in part.paths:
            yield from self._rows(_dataset(path), part)

    def _rows(self, data: ds.Dataset, part: _Files) -> Iterator[pa.RecordBatch]:
        kind = data.schema.field(self.column).type
        wanted = pc.scalar(True)
        for compare, column, value in self.conditions:
            wanted &= compare(pc.field(column), _literal(value, data.schema.field(column).type))
        if part.upto is not None:
            wanted &= (pc.field(self.column) >= _literal(_moment(part.after), kind)) & (pc.field(self.column) < _literal(_moment(part.upto), kind))
        out = to_arrow_schema(self.schema)
        for batch in data.to_batches(columns=self.schema.names, filter=wanted, batch_size=8192, use_threads=False):
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from pa.table([_in_type(table[f.name], f.type) for f in out], schema=out).to_batches()


def _in_type(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    if pa.types.is_timestamp(kind) and pa.types.is_timestamp(column.type) and kind.tz and not column.type.tz:
        return pc.assume_timezone(column.cast(pa.timestamp("us")), "UTC").cast(kind)
    return column.cast(kind)


class _Reader(_Reading, DataSourceReader):
    """A batch of all files; comparisons with constants are applied while reading, the rest is left to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARED and len(f.attribute) == 1 and f.value is not None and not isinstance(f.value, float):
                self.conditions.append((_COMPARED[type(f)], f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        return _dealt(self.files())

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)


class _StreamReader(_Reading, DataSourceStreamReader):
    """Changes between the beginnings of two polls."""

    def _now(self) -> datetime:
        return _moment(self.options["now"]) if "now" in self.options else datetime.now(timezone.utc)

    def initialOffset(self) -> dict:
        return {"since": (self._now() - timedelta(days=float(self.options.get("lookbackdays", 1)))).isoformat()}

    def latestOffset(self) -> dict:
        return {"since": self._now().isoformat()}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        return _dealt(self.files(), start["since"], end["since"])

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Polled(DataSource):
    """Options: path of a table of Parquet files, changed (its column of change times); for streams lookbackDays (of the first poll, 1 if not given) and now (the poll's
    moment in ISO form, the clock if not given)."""

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> StructType:
        return from_arrow_schema(_dataset(self.options["path"]).schema, prefer_timestamp_ntz=False)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known as format polled, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Polled)
