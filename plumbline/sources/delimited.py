"""Comma- and tab-separated files with a header."""

from __future__ import annotations

import re

from pyspark.sql import DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.functions.names import column_names, slug
from plumbline.sources.rows import Dataset, dataset


def _reader(spark: SparkSession, separator: str, encoding: str, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("maxCharsPerColumn", -1)
    )


def has_cells_over_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line holds an odd number of quotes, so that a cell may go on in the next.

    A file without such lines can be cut anywhere between lines, and is read by many tasks.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_delimited(
    spark: SparkSession,
    path: str,
    separator: str = ",",
    name: str = "dataset",
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
) -> Dataset:
    """Rows as text cells: short rows padded, long rows cut, blank rows dropped.

    ``multi_line`` says whether quoted cells contain line breaks; by default the files are
    searched for them. Such a file cannot be split, so each is then read by one task, as is one
    in an encoding of two or four bytes a sign.

    All files of a folder must have the same header: a file with other names, or with them in
    another order, is an error. Only headers with blank or repeated names are not compared.
    """
    if re.match(r"utf-?(16|32)|ucs", encoding, re.IGNORECASE):
        multi_line = True
    if multi_line is None:
        multi_line = has_cells_over_lines(spark, path)
    reader = _reader(spark, separator, encoding, multi_line)
    header = reader.option("header", False).csv(path).head()
    if header is None:
        raise ValueError("the file is empty")
    if not any((cell or "").strip() for cell in header):
        raise ValueError("the file needs a header row")
    names, written = column_names(header), [cell or "" for cell in header]
    comparable = all(w.strip() for w in written) and len({w.lower() for w in written}) == len(written)
    schema = StructType([StructField(n, StringType()) for n in (written if comparable else names)])
    text = (
        _reader(spark, separator, encoding, multi_line)
        .option("header", True)
        .option("enforceSchema", not comparable)
        .schema(schema)
        .csv(path)
    )
    return dataset(slug(name), text.toDF(*names))


def read_csv(spark: SparkSession, path: str, name: str = "dataset", **options) -> Dataset:
    return read_delimited(spark, path, ",", name, **options)


def read_tsv(spark: SparkSession, path: str, name: str = "dataset", **options) -> Dataset:
    return read_delimited(spark, path, "\t", name, **options)
