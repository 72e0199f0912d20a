"""JSON records: lists of objects, objects wrapping such a list, and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.cells import variant_text
from plumbline.functions.names import column_names, slug
from plumbline.sources.rows import Dataset, dataset

_OBJECT = "map<string,variant>"
_VALUE_KEY = "value"


def _is_array(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _parsed(text: Column) -> Column:
    """JSON value of a text that is not blank; malformed JSON is an error."""
    return F.when(F.trim(text) != "", F.parse_json(text))


def _record(text: Column) -> Column:
    """A JSON text as a record: an object as it is, anything else under ``value``."""
    value = _parsed(text)
    return F.when(_is_object(value), F.from_json(text, _OBJECT)).otherwise(
        F.create_map(F.lit(_VALUE_KEY), value)
    )


def document_records(documents: DataFrame, column: str) -> DataFrame:
    """``record`` maps of JSON documents, one document per row.

    A list gives its items; an object the items of its first member that is a list, or itself;
    a bare value gives one record. Each document is taken apart by the task that holds it.
    """
    # one column at a time: what a later one uses twice is then worked out once
    listed = (
        documents.select(F.col(column).alias("text"), F.parse_json(column).alias("document"))
        .select("text", F.schema_of_variant("document").alias("kind"))
        # members in document order: a variant would sort them
        .withColumn(
            "members",
            F.when(F.col("kind").startswith("OBJECT"), F.map_entries(F.from_json("text", _OBJECT))),
        )
        .withColumn(
            "member",
            F.try_element_at(F.filter("members", lambda m: _is_array(m["value"])), F.lit(1))["key"],
        )
        .withColumn(
            "list",
            F.when(F.col("kind").startswith("ARRAY"), F.col("text")).when(
                F.col("member").isNotNull(),
                F.try_element_at(F.from_json("text", "map<string,string>"), F.col("member")),
            ),
        )
    )
    # items as JSON text, which keeps the order of their keys, beside what kind they are
    items = F.arrays_zip(
        F.from_json("list", "array<string>").alias("text"),
        F.from_json("list", "array<variant>").alias("value"),
    )
    itself = F.array(F.struct("text", F.parse_json("text").alias("value")))
    item = listed.select("text", "list").select(
        F.explode(F.when(F.col("list").isNull(), itself).otherwise(items)).alias("item")
    )
    return item.select(
        F.when(_is_object(F.col("item.value")), F.from_json("item.text", _OBJECT))
        .otherwise(F.create_map(F.lit(_VALUE_KEY), F.col("item.value")))
        .alias("record")
    )


def _member(key: str) -> Column:
    """The value of a key of ``record``; of a key that the record repeats, the last one."""
    keys = F.map_keys("record")
    last = F.try_element_at(F.filter(F.map_entries("record"), lambda m: m["key"] == key), F.lit(-1))["value"]
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.try_element_at("record", F.lit(key))).otherwise(last)


def record_keys(records: DataFrame) -> list[str]:
    """All keys of the records, in the order in which they first turn up. Schema metadata."""
    seen = (
        records.select(F.monotonically_increasing_id().alias("at"), F.posexplode(F.map_keys("record")))
        .groupBy(F.col("col").alias("key"))
        .agg(F.min(F.struct("at", "pos")).alias("first"))
        .orderBy("first")
    )
    return [row["key"] for row in seen.select("key").collect()]


def records_dataset(records: DataFrame, name: str = "dataset") -> Dataset:
    """Records as text cells, with an empty cell where a record lacks a key."""
    keys = record_keys(records)
    if not keys:
        raise ValueError("no tabular records found")
    names = column_names(keys)
    values = records.select(
        *[_member(key).alias(column) for key, column in zip(keys, names)]
    )
    kinds = F.struct(*[F.schema_of_variant(c).alias(c) for c in names])
    cells = values.select("*", kinds.alias("_kinds")).select(
        *[variant_text(F.col(c), F.col("_kinds")[c]).alias(c) for c in names]
    )
    # by way of a list of one line: conditions on cells cannot move below it and parse each text anew
    return dataset(slug(name), cells.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in names])))))


def _repeated_keys_allowed(spark: SparkSession) -> None:
    """An object may repeat a key, as JSON allows; the session then keeps the last value."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def read_json(spark: SparkSession, path: str, name: str = "dataset") -> Dataset:
    """Files that are one JSON document each. Of a repeated key the last value counts."""
    _repeated_keys_allowed(spark)
    documents = spark.read.text(path, wholetext=True)
    return records_dataset(document_records(documents, "value"), name)


def read_json_lines(spark: SparkSession, path: str, name: str = "dataset") -> Dataset:
    """Files with one JSON record per line; splittable, so the form for large data.

    Of a repeated key the last value counts.
    """
    _repeated_keys_allowed(spark)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return records_dataset(lines.select(_record(F.col("value")).alias("record")), name)
