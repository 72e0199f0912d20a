"""Files written from the test tables by Spark, and read back through the sources."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from plumbline import AggregateSpec
from plumbline.operators.exact import exact
from plumbline.operators.profile import column_profile, dataset_listing, text_cells
from plumbline.plans.ingest import import_dataset
from plumbline.plans.progressive import progressive_trace
from plumbline.session import scratch_path
from plumbline.sources import delimited, layout, records, sqlite, xml
from suite import sql
from suite.registry import LINEITEM_KEYS, query, table
from suite.sampled import PRICE_SUM, lineitem


def _written(spark, df, kind: str, **options) -> str:
    path = scratch_path(spark, kind)
    df.write.format(kind).options(**options).save(path)
    return path


def _messy_orders(spark, sf):
    """Orders with awkward headers, quoted cells, blank rows."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total (price)"),
        F.to_date("o_orderdate").alias("Date"),
        F.concat_ws('", "', "o_orderpriority", "o_orderstatus").alias("2nd Label"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("No").alias("done?"),
    )
    blank = orders.where(F.col("Order Key") % 10 == 0).select(
        *[F.lit(None).cast("string").alias(c) for c in orders.columns]
    )
    texts = orders.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in orders.columns])
    return texts.unionByName(blank)


_MESSY_SQL = """SELECT o_orderkey AS order_key, o_totalprice AS total_price,
    CAST(o_orderdate AS DATE) AS date,
    o_orderpriority || '", "' || o_orderstatus AS dataset_2nd_label,
    o_orderstatus = 'F' AS done FROM orders"""


@query("csv_source", _MESSY_SQL)
def csv_source(spark, sf):
    path = _written(spark, _messy_orders(spark, sf), "csv", header=True, escape='"')
    return delimited.read_csv(spark, path, "Messy Orders").typed()


@query(
    "csv_source_multiline",
    "SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations",
)
def csv_source_multiline(spark, sf):
    path = _written(spark, table(spark, sf, "conversations"), "csv", header=True, escape='"')
    return delimited.read_csv(spark, path).typed()


@query(
    "tsv_source",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id, event_type, value, props
       FROM events""",
)
def tsv_source(spark, sf):
    events = table(spark, sf, "events").withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    path = _written(spark, events, "csv", header=True, sep="\t", escape='"')
    return delimited.read_tsv(spark, path).typed()


@query(
    "csv_sum",
    """SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_total_price
       FROM orders""",
)
def csv_sum(spark, sf):
    path = _written(spark, _messy_orders(spark, sf), "csv", header=True, escape='"')
    orders = delimited.read_csv(spark, path).typed()
    return exact(orders, AggregateSpec("sum", "total_price", scale=2))


@query(
    "json_repeated_keys",
    """SELECT o_orderkey AS key, o_orderstatus AS status FROM orders""",
)
def json_repeated_keys(spark, sf):
    """Objects that say their status twice: the last one counts."""
    line = F.format_string(
        '{"key":%d,"status":"%s","status":"%s"}', "o_orderkey", F.lower("o_orderpriority"), F.col("o_orderstatus")
    )
    path = scratch_path(spark, "repeated")
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return records.read_json_lines(spark, path).stored(scratch_path(spark, "cells")).typed()


def _profile_sql(name: str, types: dict[str, str]) -> str:
    parts = [
        f"""SELECT {i} AS position, '{column}' AS "column", '{kind}' AS type,
              count(nullif(trim({column}::VARCHAR), '')) AS filled_rows, count(*) AS row_count,
              min(trim({column}::VARCHAR)) AS least FROM {name}"""
        for i, (column, kind) in enumerate(types.items())
    ]
    return " UNION ALL ".join(parts)


@query(
    "column_profile",
    _profile_sql(
        "customer",
        {
            "c_custkey": "INTEGER",
            "c_name": "TEXT",
            "c_nationkey": "INTEGER",
            "c_acctbal": "DOUBLE",
            "c_mktsegment": "TEXT",
        },
    ),
)
def profile_query(spark, sf):
    cells = text_cells(table(spark, sf, "customer"), fractions=True)
    return column_profile(cells).select(
        "position",
        "column",
        "type",
        "filled_rows",
        "row_count",
        F.element_at("examples", 1).alias("least"),
    )


def _examples_sql(name: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", v AS example FROM
              (SELECT DISTINCT {f"replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '')" if c == "ts" else f"CAST({c} AS VARCHAR)"} AS v
               FROM {name} ORDER BY v LIMIT 2)"""
        for c in columns
    )


@query("column_examples", _examples_sql("events", ("event_id", "ts", "user_id", "event_type", "value", "props")))
def column_examples(spark, sf):
    profile = column_profile(text_cells(table(spark, sf, "events"), fractions=True))
    return profile.select("column", F.explode("examples").alias("example"))


@query(
    "type_inference",
    """SELECT * FROM (VALUES ('flag', 'BOOLEAN'), ('whole', 'INTEGER'), ('half', 'DOUBLE'),
         ('day', 'DATE'), ('mixed', 'TEXT'), ('late', 'TEXT'), ('nothing', 'TEXT'))
         v("column", type) WHERE (SELECT count(*) FROM lineitem) > 0""",
)
def type_inference(spark, sf):
    # "mixed" and "late" differ from a number or a date in few rows: only a full scan finds them
    key = F.col("l_orderkey")
    cells = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "Yes").otherwise(" false ").alias("flag"),
        F.concat(F.lit("+"), "l_linenumber").alias("whole"),
        F.when(key % 2 == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit("e-1")))
        .otherwise(key.cast("string"))
        .alias("half"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.when((key == 1) & (F.col("l_linenumber") > 0), "1,5").otherwise("15").alias("mixed"),
        F.when(key == 2, "2025-13-01").otherwise("2025-12-01").alias("late"),
        F.lit("  ").alias("nothing"),
    )
    return column_profile(cells).select("column", "type")


@query(
    "dataset_listing",
    """SELECT 'orders' AS dataset, count(*) AS row_count, 6 AS columns,
              'count,count_distinct,sum,avg,group_by' AS capabilities FROM orders
       UNION ALL SELECT 'embeddings', count(*), 1, 'count,count_distinct' FROM embeddings""",
)
def listing_query(spark, sf):
    orders = dataset_listing(column_profile(text_cells(table(spark, sf, "orders"))), "orders")
    embeddings = column_profile(text_cells(table(spark, sf, "embeddings").select("embedding")))
    listings = orders.unionByName(dataset_listing(embeddings, "embeddings"))
    return listings.select(
        "dataset",
        "row_count",
        F.size("schema").alias("columns"),
        F.array_join("capabilities", ",").alias("capabilities"),
    )


@query(
    "cell_serialisation",
    """SELECT c_custkey, lower(hex(encode(c_name))) AS name_hex,
              CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS flag,
              '{"a":' || CAST(c_nationkey AS VARCHAR) || ',"z":"' || c_mktsegment || '"}' AS nested
       FROM customer""",
)
def cell_serialisation(spark, sf):
    typed = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_name").cast("binary").alias("name_hex"),
        (F.col("c_acctbal") > 0).alias("flag"),
        F.struct(F.col("c_mktsegment").alias("z"), F.col("c_nationkey").alias("a")).alias("nested"),
    )
    cells = text_cells(typed)
    return cells.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query(
    "json_lines_source",
    """SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price,
              o_orderpriority AS priority FROM orders""",
)
def json_lines_source(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Key"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )
    found = records.read_json_lines(spark, _written(spark, orders, "json"))
    return found.stored(scratch_path(spark, "cells")).typed()


@query(
    "json_documents",
    """SELECT o_orderkey AS key, o_totalprice AS price, CAST(NULL AS VARCHAR) AS status FROM orders
       UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders""",
)
def json_documents(spark, sf):
    # every document wraps a list of two records with different keys
    first = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    second = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    rows = F.concat_ws(",", F.to_json(first), F.to_json(second))
    documents = table(spark, sf, "orders").select(
        F.concat(F.lit('{"note":"[","rows":['), rows, F.lit('],"tail":[1]}')).alias("text")
    )
    found = records.records_dataset(records.document_records(documents, "text"))
    return found.stored(scratch_path(spark, "cells")).typed()


@query(
    "json_files",
    """SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY c_mktsegment""",
)
def json_files(spark, sf):
    # one small document per file, of the few rows of a report
    report = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("customers")
    )
    documents = report.select(F.concat(F.lit("[\n"), F.to_json(F.struct("*")), F.lit("\n]")))
    path = scratch_path(spark, "json")
    documents.repartition(5, F.col(documents.columns[0])).write.option("maxRecordsPerFile", 1).text(path)
    return records.read_json(spark, path).typed()


@query(
    "xml_source",
    """SELECT c_custkey AS attr_id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment
       FROM customer""",
)
def xml_source(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("attr_id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").cast("string").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    path = _written(
        spark, customers, "xml", rowTag="customer", rootTag="customers", attributePrefix="attr_"
    )
    return xml.read_xml(spark, path).stored(scratch_path(spark, "cells")).typed()


@query(
    "csv_many_files",
    """SELECT n_nationkey AS key, n_name AS name FROM nation
       UNION ALL SELECT c_custkey, c_name FROM customer""",
)
def csv_many_files(spark, sf):
    """All rows of two tables, written as many files of one folder."""
    path = scratch_path(spark, "csv")
    for name, key, label in (("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name")):
        part = table(spark, sf, name).select(F.col(key).alias("Key"), F.col(label).alias("Name"))
        part.repartition(3).write.mode("append").csv(path, header=True)
    return delimited.read_csv(spark, path).typed()


@query(
    "xml_many_files",
    """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def xml_many_files(spark, sf):
    """All rows of two tables, whose files name their records differently."""
    path = scratch_path(spark, "xml")
    tables = {"supplier": ("s_suppkey", "s_name", "s_acctbal"),
              "customer": ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")}
    for name, columns in tables.items():
        names = ("id", "name", "balance", "segment")
        part = table(spark, sf, name).select(*[F.col(c).cast("string").alias(n) for c, n in zip(columns, names)])
        part.repartition(2).write.mode("append").format("xml").options(rowTag=name, rootTag="rows").save(path)
    return xml.read_xml(spark, path).stored(scratch_path(spark, "cells")).typed()


def _write_sqlite(folder: str):
    """Writes each partition of a frame as a SQLite file of its own.

    The file gets its name when it is whole, so a task that runs twice leaves one file.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        draft = os.path.join(folder, f"{uuid.uuid4().hex}.draft")
        rows = 0
        with closing(sqlite3.connect(draft)) as connection:
            connection.execute(
                "CREATE TABLE orders ([Order Key] INTEGER, price REAL, status TEXT, note TEXT)"
            )
            for batch in batches:
                connection.executemany(
                    "INSERT INTO orders VALUES (?, ?, ?, NULL)", batch.values.tolist()
                )
                rows += len(batch)
            connection.commit()
        file = os.path.join(folder, f"part-{TaskContext.get().partitionId()}.db")
        os.replace(draft, file)
        yield pd.DataFrame({"file": [file], "rows": [rows]})

    return write


@query(
    "sqlite_source",
    """SELECT o_orderkey AS order_key, o_totalprice AS price, o_orderstatus AS status,
              CAST(NULL AS VARCHAR) AS note FROM orders""",
)
def sqlite_source(spark, sf):
    folder = scratch_path(spark, "sqlite").removeprefix("file:")
    if "://" in folder:
        raise ValueError("SQLite files need a scratch folder that all executors have mounted")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    files = orders.repartition(4).mapInPandas(_write_sqlite(folder), "file string, rows long")
    files.agg(F.sum("rows")).collect()
    shop = sqlite.read_sqlite(spark, f"{folder}/*.db", "shop", rows_per_range=10_000)
    return shop[0].stored(scratch_path(spark, "cells")).typed()


def _layout(spark, sf):
    df, order = lineitem(spark, sf)
    path = scratch_path(spark, "layout")
    layout.write_sample_layout(df, path, order)
    return layout.open_sample_layout(spark, path)


@query(
    "layout_manifest",
    f"""WITH RECURSIVE pop AS (SELECT count(*) AS n FROM lineitem), {sql.ladder("pop")}
        SELECT it AS sample_step, size - coalesce(lag(size) OVER (ORDER BY it), 0) AS rows FROM ladder
        UNION ALL SELECT max(it) + 1, max(n) - max(c) FROM ladder""",
)
def layout_manifest(spark, sf):
    return layout.manifest(_layout(spark, sf).frame).select("sample_step", "rows")


@query(
    "layout_prefix",
    f"""WITH RECURSIVE pop AS (SELECT count(*) AS n FROM lineitem), {sql.ladder("pop")}
        SELECT l_returnflag, count(*) AS rows,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM (SELECT *, row_number() OVER
                (ORDER BY {sql.priority(LINEITEM_KEYS)}, l_extendedprice) AS rk FROM lineitem)
        WHERE rk <= (SELECT size FROM ladder WHERE it = 4) GROUP BY l_returnflag""",
)
def layout_prefix(spark, sf):
    prefix = layout.up_to(_layout(spark, sf).frame, 4)
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return prefix.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), total.alias("total")
    )


_STEP_COLUMNS = [
    "iteration",
    "estimate",
    "relative_error",
    "ci_low",
    "ci_high",
    "sample_rows",
    "total_rows",
    "target_met",
    "is_final",
    "stopped_reason",
]


@query(
    "progressive_sum",
    sql.scalar_trace(0.02, "lineitem", LINEITEM_KEYS, "l_extendedprice", tie="l_extendedprice")
    + sql.SCALAR_COLUMNS,
)
def progressive_sum(spark, sf):
    return progressive_trace(_layout(spark, sf), PRICE_SUM, 0.02).select(*_STEP_COLUMNS)


@query(
    "progressive_grouped_avg",
    sql.scalar_trace(
        0.03,
        "lineitem",
        LINEITEM_KEYS,
        "l_extendedprice",
        mean=True,
        group="l_returnflag",
        tie="l_extendedprice",
    )
    + sql.GROUPED_COLUMNS,
)
def progressive_grouped_avg(spark, sf):
    spec = AggregateSpec("avg", "l_extendedprice", group_by="l_returnflag", scale=2)
    return progressive_trace(_layout(spark, sf), spec, 0.03).select(
        *_STEP_COLUMNS, "group_value", "population_rows", "scanned_rows", "overall_error"
    )


@query("typed_table", "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY o_orderpriority")
def typed_table(spark, sf):
    path = scratch_path(spark, "typed")
    layout.write_typed(table(spark, sf, "orders"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


def _imported(spark, sf):
    path = _written(spark, table(spark, sf, "customer"), "csv", header=True, escape='"')
    return import_dataset(
        delimited.read_csv(spark, path, "customers"), scratch_path(spark, "import")
    )


@query(
    "file_import",
    """SELECT c_mktsegment, count(*) AS customers,
              CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance,
              min(c_custkey) AS first_key, max(c_custkey) AS last_key
       FROM customer GROUP BY c_mktsegment""",
)
def file_import(spark, sf):
    stored = layout.read_sample_layout(spark, _imported(spark, sf).layout_path)
    balance = F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double")
    return stored.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"),
        balance.alias("balance"),
        F.min("c_custkey").alias("first_key"),
        F.max("c_custkey").alias("last_key"),
    )
