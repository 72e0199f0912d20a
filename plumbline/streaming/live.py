"""Live summaries of a stream: reservoir, windows, distinct counts, estimates with an error.

Everything is a native incremental aggregate of bounded state; the same functions run over a
batch frame and give the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumbline.functions import registers as hll
from plumbline.functions.numbers import exact_total
from plumbline.functions.order import SampleOrder
from plumbline.operators.adaptive import with_estimates
from plumbline.spec import AggregateSpec

_BATCH, _NEWEST = "update_batch", "update_newest"


def _slot(order: SampleOrder, slots: int) -> Column:
    """Slot of a row, from a hash of its keys that does not depend on the priority."""
    if order.method == "xxhash64":
        return F.pmod(F.xxhash64(F.lit("slot"), *[F.col(k) for k in order.keys]), F.lit(slots))
    piece = F.substring(F.md5(F.concat_ws("|", F.lit("slot"), *order.keys)), 1, 8)
    return F.pmod(F.conv(piece, 16, 10).cast("long"), F.lit(slots))


def slot_reservoir(stream: DataFrame, order: SampleOrder, slots: int) -> DataFrame:
    """A random sample of ``slots`` rows, one per slot once every slot was hit.

    Each slot keeps its row of least priority, so the state never exceeds ``slots`` rows, a task
    sends at most one row per slot, and two reservoirs merge into one.
    """
    row = F.struct(*stream.columns)
    place = F.struct(order.priority().alias("priority"), *[F.col(t) for t in order.ties])
    return (
        stream.groupBy(_slot(order, slots).alias("slot"))
        .agg(F.min_by(row, place).alias("row"))
        .select("slot", "row.*")
    )


def event_time(df: DataFrame, column: str, lateness: str) -> DataFrame:
    """Gives a timestamp column a watermark; zone-less ones are read in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def window_totals(
    stream: DataFrame,
    time: str,
    length: str,
    by: tuple[str, ...] = (),
    value: str | None = None,
    slide: str | None = None,
    scale: int = 2,
) -> DataFrame:
    """Rows, and the sum and mean of ``value``, per tumbling or sliding window."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return _totals(stream, window, by, value, scale)


def session_totals(
    stream: DataFrame, time: str, gap: str, by: tuple[str, ...], value: str | None = None, scale: int = 2
) -> DataFrame:
    """The same per session: rows of a key that follow each other within ``gap``."""
    return _totals(stream, F.session_window(time, gap), by, value, scale)


def _totals(
    stream: DataFrame, window: Column, by: tuple[str, ...], value: str | None, scale: int
) -> DataFrame:
    sums = [F.count(F.lit(1)).alias("rows")]
    if value is not None:
        sums += [
            exact_total(value, scale).alias("total"),
            (exact_total(value, scale) / F.nullif(F.count(value), F.lit(0))).alias("mean"),
        ]
    return stream.groupBy(window.alias("window"), *by).agg(*sums).select(*_bounds(), *by, "rows", *(
        ["total", "mean"] if value is not None else []
    ))


def _bounds() -> list[Column]:
    return [
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
    ]


def window_registers(
    stream: DataFrame,
    time: str,
    length: str,
    column: str,
    precision: int,
    method: str = "xxhash64",
) -> DataFrame:
    """HyperLogLog registers per window; at most ``2**precision`` rows of state each."""
    index, rank = hll.register_and_rank(F.col(column), precision, method)
    return (
        stream.where(F.col(column).isNotNull())
        .groupBy(F.window(time, length).alias("window"), index.alias("register_index"))
        .agg(F.max(rank).alias("register_rank"))
        .select(*_bounds(), "register_index", "register_rank")
    )


def window_sketches(
    stream: DataFrame, time: str, length: str, column: str, precision: int = 12
) -> DataFrame:
    """Spark's own sketch per window, with its estimate."""
    return (
        stream.groupBy(F.window(time, length).alias("window"))
        .agg(F.hll_sketch_agg(column, precision).alias("sketch"))
        .select(*_bounds(), "sketch", F.hll_sketch_estimate("sketch").alias("estimate"))
    )


def window_samples(
    stream: DataFrame, time: str, length: str, value: str, order: SampleOrder, slots: int
) -> DataFrame:
    """Per window and slot the row count, and the value of the sampled row."""
    return (
        stream.groupBy(F.window(time, length).alias("window"), _slot(order, slots).alias("slot"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min_by(F.struct(F.col(value).alias("v")), F.struct(order.priority(), *order.ties)).alias("drawn"),
        )
        .select(*_bounds(), "slot", "rows", F.col("drawn.v").alias("value"))
    )


def window_estimates(
    samples: DataFrame, agg: str = "sum", confidence: float = 0.95, scale: int = 2
) -> DataFrame:
    """Estimated sum or mean per window from ``window_samples``, with its relative error."""
    number = F.coalesce(F.col("value").cast(f"decimal(18,{scale})"), F.lit(0))
    weight = F.lit(1) if agg == "sum" else F.when(F.col("value").isNull(), 0).otherwise(1)
    sums = (
        samples.select("window_start", "window_end", "rows", number.alias("y"), weight.alias("x"))
        .groupBy("window_start", "window_end")
        .agg(
            F.sum("rows").alias("population_rows"),
            F.count(F.lit(1)).alias("sample_rows"),
            F.sum("y").alias("sum_y"),
            F.sum(F.col("y") * F.col("y")).alias("sum_yy"),
            F.sum("x").alias("sum_x"),
        )
        .withColumn("sum_xx", F.col("sum_x"))
        .withColumn("sum_xy", F.col("sum_y"))
    )
    spec = AggregateSpec(agg, "value", scale=scale)
    return with_estimates(sums, spec, confidence).select(
        "window_start",
        "window_end",
        "estimate",
        "relative_error",
        "ci_low",
        "ci_high",
        "sample_rows",
        "population_rows",
    )


def start_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes closed windows to Parquet, exactly once, with all data that is there now."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what every batch changes under its number, with all data that is there now.

    The watermark drops the state of closed windows, which keep the last line written for them. A batch that
    is run again after a failure replaces its own lines; readers (``read_updates``) never find the
    table gone.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{_BATCH}={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_updates(spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...]) -> DataFrame:
    """The newest line of every key of a table that ``start_updates`` writes."""
    lines = spark.read.schema(StructType([*schema.fields]).add(_BATCH, "long")).parquet(path)
    newest = Window.partitionBy(*keys).orderBy(F.desc(_BATCH))
    return (
        lines.withColumn(_NEWEST, F.row_number().over(newest)).where(F.col(_NEWEST) == 1).drop(_NEWEST, _BATCH)
    )
