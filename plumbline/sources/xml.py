"""XML records: the repeated elements of a document, wherever they are."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.cells import cell_text
from plumbline.functions.names import column_names, slug
from plumbline.sources.rows import Dataset, dataset

# Names given to attributes and to the text of an element.
ATTRIBUTE_PREFIX = "attr_"
TEXT_NAME = "value"

_OUTLINE = "file string, parent long, parent_tag string, tag string, place long, copies long"


def _outline(content: bytes) -> Iterator[tuple[int, str | None, str, int, int]]:
    """Per parent element and child tag: first place and number of copies.

    Elements are dropped once counted, so that a long document takes little memory. Only the
    root, and the first element in document order whose children repeat a tag, are told.
    """
    open_elements: list[tuple[int, str, dict[str, list[int]]]] = []
    number = 0
    root: tuple[int, str, dict[str, list[int]]] | None = None
    repeating: tuple[int, str, dict[str, list[int]]] | None = None
    for event, element in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
        if event == "start":
            if open_elements:
                tags = open_elements[-1][2]
                place = tags.setdefault(element.tag, [len(tags), 0])
                place[1] += 1
            open_elements.append((number, element.tag, {}))
            root = root or open_elements[0]
            number += 1
            continue
        done = open_elements.pop()
        repeats = any(copies > 1 for _, copies in done[2].values())
        if repeats and (repeating is None or done[0] < repeating[0]):
            repeating = done
        element.clear()
    yield (0, None, root[1], 0, 1)
    for parent in {p[0]: p for p in (root, repeating) if p}.values():
        for tag, (place, copies) in parent[2].items():
            yield (parent[0], parent[1], tag, place, copies)


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.split()[0] for field in _OUTLINE.split(", ")]
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            yield pd.DataFrame([(file, *line) for line in _outline(content)], columns=names)


def record_tags(spark: SparkSession, path: str) -> list[str]:
    """Tags of the record elements of all files.

    Of each file all children of the root if one of its tags repeats; else the children of the
    first element in document order that repeats a tag; else the root itself. Whole files are
    looked at, each by one task; only distinct tags come back to the driver.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    per_parent = (
        files.mapInPandas(_outlines, _OUTLINE)
        .groupBy("file", "parent", "parent_tag")
        .agg(
            ((F.max("copies") > 1) & F.col("parent_tag").isNotNull()).alias("repeats"),
            F.collect_list(F.struct("place", "tag")).alias("tags"),
        )
    )
    # the first repeating parent, else the line that holds the root
    order = F.struct(~F.col("repeats"), F.col("parent_tag").isNotNull(), "parent")
    chosen = per_parent.groupBy("file").agg(F.min_by("tags", order).alias("tags"))
    tags = (
        chosen.select(F.explode("tags").alias("t"))
        .groupBy("t.tag")
        .agg(F.min("t.place").alias("place"))
        .orderBy("place", "tag")
    )
    return [row["tag"] for row in tags.collect()]


def _records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", tag)
        .option("attributePrefix", ATTRIBUTE_PREFIX)
        .option("valueTag", TEXT_NAME)
        .option("inferSchema", False)
        .option("ignoreSurroundingSpaces", True)
        .load(path)
    )


def read_xml(
    spark: SparkSession, path: str, name: str = "dataset", tags: list[str] | None = None
) -> Dataset:
    """Records as text cells, nested and repeated elements as JSON.

    Name the record ``tags`` of large files: Spark then splits them between records, and no
    task reads a whole document.
    """
    records = None
    for tag in tags or record_tags(spark, path):
        found = _records(spark, path, tag)
        cells = found.select(*[cell_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in found.schema])
        records = cells if records is None else records.unionByName(cells, allowMissingColumns=True)
    if records is None or not records.columns:
        raise ValueError("no tabular records found")
    return dataset(slug(name), records.toDF(*column_names(records.columns)))
