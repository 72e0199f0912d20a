"""Any supported file, by its suffix."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import SparkSession

from plumbline.sources.delimited import read_csv, read_tsv
from plumbline.sources.records import read_json
from plumbline.sources.rows import Dataset
from plumbline.sources.sqlite import read_sqlite
from plumbline.sources.xml import read_xml

# File suffixes.
_ONE_TABLE = {".csv": read_csv, ".tsv": read_tsv, ".json": read_json, ".xml": read_xml}
_SQLITE = (".sqlite", ".sqlite3", ".db")


def read_file(spark: SparkSession, path: str, name: str | None = None) -> list[Dataset]:
    """The datasets of a file: one per table of a SQLite file, else one."""
    file = PurePath(path)
    suffix, name = file.suffix.lower(), name or file.stem or "dataset"
    if suffix in _SQLITE:
        return read_sqlite(spark, path, name)
    if suffix not in _ONE_TABLE:
        raise ValueError(f"cannot read {suffix or 'a file without suffix'}: use CSV, TSV, JSON, XML or SQLite")
    return [_ONE_TABLE[suffix](spark, path, name)]
