"""Collects queries and their oracle SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.order import SampleOrder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: columns that identify a row of each table; md5, so that plain SQL finds the same order
LINEITEM_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINEITEM_ORDER = SampleOrder(LINEITEM_KEYS, "md5", ties=("l_extendedprice",), bucket_bits=8)
ORDERS_ORDER = SampleOrder(("o_orderkey",), "md5", bucket_bits=8)
EVENTS_ORDER = SampleOrder(("event_id",), "md5", bucket_bits=8)
CUSTOMER_ORDER = SampleOrder(("c_custkey",), "md5", bucket_bits=8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(order: SampleOrder, df: DataFrame) -> SampleOrder:
    """The order with buckets to suit the table; the count is read from file footers."""
    return order.for_rows(df.count())


def query(name: str, sql: str | None = None):
    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
