"""Tables of SQLite files, as a Spark data source.

A table is cut into ranges of row ids, and each range is read by its own task through a
read-only connection. The files must lie where all executors can open them.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from plumbline.functions.names import column_names, slug
from plumbline.sources.rows import Dataset, dataset

FORMAT = "plumbline_sqlite"
_ROWS_PER_RANGE = 1_000_000
_MOST_RANGES = 10_000


def _quoted(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def _connect(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True)


def _files(path: str) -> list[str]:
    local = path.removeprefix("file://").removeprefix("file:")
    files = [f for f in sorted(glob.glob(local)) if os.path.isfile(f)]
    if not files:
        raise ValueError(f"no SQLite file at {path}")
    return files


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return str(value)


@dataclass
class RowRange(InputPartition):
    file: str
    low: int | None
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.table = options["table"]
        self.files = _files(options["path"])
        self.rows_per_range = int(options.get("rowsperrange", _ROWS_PER_RANGE))
        self.columns = columns

    def partitions(self) -> list[RowRange]:
        ranges = []
        for file in self.files:
            with closing(_connect(file)) as connection:
                try:
                    low, high = connection.execute(
                        f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}"
                    ).fetchone()
                except sqlite3.OperationalError:
                    # a table without row ids has no cheap ranges
                    ranges.append(RowRange(file, None, None))
                    continue
            if low is None:
                continue
            step = max(self.rows_per_range, -(-(high - low + 1) // _MOST_RANGES))
            ranges += [
                RowRange(file, start, min(start + step - 1, high))
                for start in range(low, high + 1, step)
            ]
        return ranges or [RowRange(self.files[0], 0, -1)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        listed = ", ".join(_quoted(c) for c in self.columns)
        statement = f"SELECT {listed} FROM {_quoted(self.table)}"
        bounds: tuple = ()
        if partition.low is not None:
            statement += " WHERE rowid BETWEEN ? AND ?"
            bounds = (partition.low, partition.high)
        with closing(_connect(partition.file)) as connection:
            for row in connection.execute(statement, bounds):
                yield tuple(_text(cell) for cell in row)


class SqliteSource(DataSource):
    """Options: ``path`` (a file or a pattern), ``table``, ``rowsPerRange``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        columns = table_columns(_files(self.options["path"])[0], self.options["table"])
        return ", ".join(f"`{c.replace('`', '``')}` string" for c, _ in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema.names)


def table_columns(file: str, table: str) -> list[tuple[str, str]]:
    """Names and declared types of the columns."""
    with closing(_connect(file)) as connection:
        info = connection.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    return [(str(c[1]), str(c[2] or "")) for c in info]


def table_names(file: str) -> list[str]:
    """Tables in name order, without SQLite's own."""
    with closing(_connect(file)) as connection:
        rows = connection.execute(
            "SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name"
        ).fetchall()
    return [name for (name,) in rows if not name.startswith("sqlite_")]


def read_sqlite(
    spark: SparkSession, path: str, name: str = "dataset", rows_per_range: int = _ROWS_PER_RANGE
) -> list[Dataset]:
    """One dataset per table, named ``<name>_<table>``; a table without columns is left out.

    ``path`` may be a pattern over files that share the tables of the first.
    """
    spark.dataSource.register(SqliteSource)
    first = _files(path)[0]
    tables = table_names(first)
    if not tables:
        raise ValueError("the database has no table")
    found = []
    for table in tables:
        columns = table_columns(first, table)
        if not columns:
            continue
        names = column_names([c for c, _ in columns])
        declared = {n: kind for n, (_, kind) in zip(names, columns)}
        text = (
            spark.read.format(FORMAT)
            .option("path", path)
            .option("table", table)
            .option("rowsPerRange", rows_per_range)
            .load()
            .toDF(*names)
        )
        blobs = tuple(n for n, kind in declared.items() if "BLOB" in kind.upper())
        found.append(dataset(f"{slug(name)}_{slug(table)}", text, declared, blobs))
    if not found:
        raise ValueError("no table has columns")
    return found
