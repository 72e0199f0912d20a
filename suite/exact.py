"""Exact aggregates, filters, ordering and the choice of method."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import AggregateSpec, Comparison
from plumbline.functions.display import group_label
from plumbline.operators import exact as ex
from plumbline.operators.method import choose_method
from suite.registry import query, table

URGENT = Comparison("o_orderpriority", "=", "1-URGENT")
LARGE = Comparison("o_totalprice", ">=", 100000.0)


@query("exact_count", "SELECT count(*) AS row_count FROM lineitem")
def exact_count(spark, sf):
    return ex.exact(table(spark, sf, "lineitem"), AggregateSpec("count"))


@query(
    "exact_count_filtered",
    "SELECT count(*) AS urgent_orders FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def exact_count_filtered(spark, sf):
    spec = AggregateSpec("count", where=(URGENT,), alias="urgent_orders")
    return ex.exact(table(spark, sf, "orders"), spec)


@query("exact_count_col", "SELECT count(nullif(l_quantity, 1)) AS count_q FROM lineitem")
def exact_count_col(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("q", F.nullif("l_quantity", F.lit(1.0)))
    return ex.exact(df, AggregateSpec("count", "q"))


@query(
    "exact_sum",
    """SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_l_extendedprice
       FROM lineitem""",
)
def exact_sum(spark, sf):
    return ex.exact(table(spark, sf, "lineitem"), AggregateSpec("sum", "l_extendedprice", scale=2))


@query("exact_sum_of_nothing", "SELECT CAST(0 AS DOUBLE) AS total FROM orders LIMIT 1")
def exact_sum_of_nothing(spark, sf):
    spec = AggregateSpec(
        "sum", "o_totalprice", where=(Comparison("o_totalprice", "<", 0.0),), alias="total", scale=2
    )
    return ex.exact(table(spark, sf, "orders"), spec)


@query(
    "exact_avg",
    """SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice)
         AS average_order_value FROM orders""",
)
def exact_avg(spark, sf):
    spec = AggregateSpec("avg", "o_totalprice", alias="average_order_value", scale=2)
    return ex.exact(table(spark, sf, "orders"), spec)


@query("exact_distinct", "SELECT count(DISTINCT o_custkey) AS unique_customers FROM orders")
def exact_distinct(spark, sf):
    spec = AggregateSpec("count", "o_custkey", distinct=True, alias="unique_customers")
    return ex.exact(table(spark, sf, "orders"), spec)


@query(
    "conjunctive_filter",
    """SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem
       WHERE l_returnflag = 'R' AND l_linestatus != 'O' AND l_quantity >= 5 AND l_quantity <= 45
         AND l_discount > 0.01 AND l_tax < 0.07""",
)
def conjunctive_filter(spark, sf):
    where = (
        Comparison("l_returnflag", "=", "R"),
        Comparison("l_linestatus", "!=", "O"),
        Comparison("l_quantity", ">=", 5),
        Comparison("l_quantity", "<=", 45),
        Comparison("l_discount", ">", 0.01),
        Comparison("l_tax", "<", 0.07),
    )
    spec = AggregateSpec("sum", "l_extendedprice", where, alias="total", scale=2)
    return ex.exact(table(spark, sf, "lineitem"), spec)


@query(
    "null_filter",
    """SELECT count(*) AS row_count FROM (SELECT nullif(l_quantity, 1) AS q FROM lineitem)
       WHERE q != 2""",
)
def null_filter(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("q", F.nullif("l_quantity", F.lit(1.0)))
    return ex.exact(df, AggregateSpec("count", where=(Comparison("q", "!=", 2.0),)))


@query(
    "sampling_projection",
    "SELECT o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 100000",
)
def sampling_projection(spark, sf):
    spec = AggregateSpec("sum", "o_totalprice", (LARGE,), group_by="o_orderstatus")
    return spec.projected(table(spark, sf, "orders"))


@query(
    "grouped_count", "SELECT event_type, count(*) AS row_count FROM events GROUP BY event_type"
)
def grouped_count(spark, sf):
    return ex.exact(table(spark, sf, "events"), AggregateSpec("count", group_by="event_type"))


@query(
    "grouped_count_col",
    """SELECT l_returnflag, count(nullif(l_quantity, 1)) AS count_q
       FROM lineitem GROUP BY l_returnflag""",
)
def grouped_count_col(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("q", F.nullif("l_quantity", F.lit(1.0)))
    return ex.exact(df, AggregateSpec("count", "q", group_by="l_returnflag"))


@query(
    "grouped_sum",
    """SELECT o_orderpriority,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM orders GROUP BY o_orderpriority""",
)
def grouped_sum(spark, sf):
    spec = AggregateSpec("sum", "o_totalprice", group_by="o_orderpriority", alias="revenue", scale=2)
    return ex.exact(table(spark, sf, "orders"), spec)


@query(
    "grouped_avg",
    """SELECT l_returnflag,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice)
                AS avg_l_extendedprice
       FROM lineitem GROUP BY l_returnflag""",
)
def grouped_avg(spark, sf):
    spec = AggregateSpec("avg", "l_extendedprice", group_by="l_returnflag", scale=2)
    return ex.exact(table(spark, sf, "lineitem"), spec)


@query(
    "grouped_distinct",
    """SELECT event_type, count(DISTINCT user_id) AS unique_users
       FROM events GROUP BY event_type""",
)
def grouped_distinct(spark, sf):
    spec = AggregateSpec(
        "count", "user_id", group_by="event_type", distinct=True, alias="unique_users"
    )
    return ex.exact(table(spark, sf, "events"), spec)


@query(
    "grouped_null_group",
    """SELECT coalesce(CAST(g AS VARCHAR), 'NULL') AS group_value, total FROM (
         SELECT nullif(l_linenumber, 1) AS g,
                CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total
         FROM lineitem GROUP BY ALL)""",
)
def grouped_null_group(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("g", F.nullif("l_linenumber", F.lit(1)))
    spec = AggregateSpec("sum", "l_quantity", group_by="g", alias="total", scale=2)
    return ex.exact(df, spec).select(group_label(F.col("g")).alias("group_value"), "total")


@query(
    "ordered_by_value",
    """SELECT p_brand, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM part GROUP BY p_brand ORDER BY total DESC, p_brand""",
)
def ordered_by_value(spark, sf):
    spec = AggregateSpec(
        "sum",
        "p_retailprice",
        group_by="p_brand",
        order_by="total",
        descending=True,
        alias="total",
        scale=2,
    )
    return ex.ordered(ex.exact(table(spark, sf, "part"), spec), spec)


@query(
    "ordered_by_label",
    """SELECT p_size, count(*) AS row_count FROM part GROUP BY p_size
       ORDER BY CAST(p_size AS VARCHAR)""",
)
def ordered_by_label(spark, sf):
    spec = AggregateSpec("count", group_by="p_size")
    return ex.ordered(ex.exact(table(spark, sf, "part"), spec), spec)


@query(
    "population_count",
    "SELECT count(*) AS population_rows FROM orders WHERE o_totalprice >= 100000",
)
def population_count(spark, sf):
    spec = AggregateSpec("sum", "o_totalprice", (LARGE,))
    return ex.population(table(spark, sf, "orders"), spec)


@query(
    "strata_profile",
    """SELECT o_orderpriority AS group_value, count(*) AS population_rows FROM orders
       WHERE o_totalprice >= 100000 GROUP BY o_orderpriority ORDER BY population_rows DESC""",
)
def strata_profile(spark, sf):
    spec = AggregateSpec("sum", "o_totalprice", (LARGE,), group_by="o_orderpriority")
    return ex.largest_first(ex.strata_profile(table(spark, sf, "orders"), spec))


def _sql_method(source: str, distinct: bool = False, count: bool = False) -> str:
    return f"""SELECT method, reason, group_count, CAST(filtered_rows AS BIGINT) AS filtered_rows
    FROM (SELECT *, CASE WHEN reason = 'groups are few and large enough'
                         THEN '{"hyperloglog" if distinct else "stratified_sampling"}'
                         ELSE 'exact' END AS method
      FROM (SELECT *, CASE
              WHEN {str(count).lower()} THEN 'grouped counts are answered exactly'
              WHEN group_count = 0 THEN 'no rows pass the filters'
              WHEN group_count > 16 THEN 'more than 16 groups'
              WHEN {str(not distinct).lower()} AND filtered_rows < 5000
                THEN 'fewer than 5000 filtered rows'
              ELSE 'groups are few and large enough' END AS reason
        FROM (SELECT count(*) AS group_count, coalesce(sum(n), 0) AS filtered_rows
              FROM (SELECT g, count(*) AS n FROM ({source}) GROUP BY g))))"""


_METHOD_CASES = {
    "sum by priority": (
        "orders",
        AggregateSpec("sum", "o_totalprice", group_by="o_orderpriority"),
        _sql_method("SELECT o_orderpriority AS g FROM orders"),
    ),
    "sum by nation": (
        "customer",
        AggregateSpec("sum", "c_acctbal", group_by="c_nationkey"),
        _sql_method("SELECT c_nationkey AS g FROM customer"),
    ),
    "sum by segment": (
        "customer",
        AggregateSpec("sum", "c_acctbal", group_by="c_mktsegment"),
        _sql_method("SELECT c_mktsegment AS g FROM customer"),
    ),
    "sum of nothing": (
        "orders",
        AggregateSpec(
            "sum",
            "o_totalprice",
            (Comparison("o_totalprice", "<", 0.0),),
            group_by="o_orderstatus",
        ),
        _sql_method("SELECT o_orderstatus AS g FROM orders WHERE o_totalprice < 0"),
    ),
    "count by type": (
        "events",
        AggregateSpec("count", group_by="event_type"),
        _sql_method("SELECT event_type AS g FROM events", count=True),
    ),
    "distinct by type": (
        "events",
        AggregateSpec("count", "user_id", group_by="event_type", distinct=True),
        _sql_method("SELECT event_type AS g FROM events", distinct=True),
    ),
    "distinct": (
        "events",
        AggregateSpec("count", "user_id", distinct=True),
        """SELECT 'hyperloglog' AS method, 'distinct counts use registers' AS reason,
                  CAST(0 AS BIGINT) AS group_count, count(*) AS filtered_rows FROM events""",
    ),
    "plain sum": (
        "lineitem",
        AggregateSpec("sum", "l_quantity"),
        """SELECT 'adaptive_sampling' AS method, 'no groups' AS reason,
                  CAST(0 AS BIGINT) AS group_count, count(*) AS filtered_rows FROM lineitem""",
    ),
}


@query(
    "method_choice",
    " UNION ALL ".join(
        f"SELECT '{case}' AS question, * FROM ({sql})" for case, (_, _, sql) in _METHOD_CASES.items()
    ),
)
def method_choice(spark, sf):
    chosen = None
    for case, (name, spec, _) in _METHOD_CASES.items():
        one = choose_method(table(spark, sf, name), spec).select(F.lit(case).alias("question"), "*")
        chosen = one if chosen is None else chosen.unionByName(one)
    return chosen


@query(
    "sum_with_nan",
    """SELECT l_returnflag, l_linestatus, sum(v) AS total FROM (
         SELECT l_returnflag, l_linestatus,
                CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 'NaN'::DOUBLE
                     WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL
                     WHEN l_linestatus = 'O' AND l_linenumber = 3 THEN 'Infinity'::DOUBLE
                     ELSE l_quantity END AS v
         FROM lineitem) GROUP BY l_returnflag, l_linestatus""",
)
def sum_with_nan(spark, sf):
    """Sums with a scale over values that have NaN, infinities and NULL among them."""
    value = (
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7), float("nan"))
        .when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), None)
        .when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 3), float("inf"))
        .otherwise(F.col("l_quantity"))
    )
    df = table(spark, sf, "lineitem").withColumn("v", value)
    df = df.withColumn("g", F.concat("l_returnflag", "l_linestatus"))
    found = ex.exact(df, AggregateSpec("sum", "v", group_by="g", alias="total", scale=2))
    return found.selectExpr("substr(g, 1, 1) AS l_returnflag", "substr(g, 2, 1) AS l_linestatus", "total")
