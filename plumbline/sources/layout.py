"""Tables on disk: typed Parquet, and the sample layout.

The sample layout keeps every row once, in folders by the step of the random order at which a
growing sample would draw it. The first k folders are a simple random sample of the table, so
an approximate answer reads just those folders; the last folder holds the rows beyond the
largest sample. Folder sizes follow the ladder: the first one has 512 rows, whatever the table.

Beside the folders stands a statistics table: rows of every step, and rows of every value of the
columns that questions group or filter by. Sizes of groups and of filtered tables come from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.order import SampleOrder
from plumbline.operators.sampling import PRIORITY, STEP, placed_rows
from plumbline.spec import AggregateSpec

_ROW_PLACE = ("row_file", "row_index")
#: the random order of a table without a key of its own, after ``with_row_place``
ROW_PLACE_ORDER = SampleOrder(_ROW_PLACE)


#: the statistics table, inside the layout; Spark passes over names that begin so
_STATISTICS = "_statistics"
#: a column with more values is left out of the statistics
MOST_VALUES = 1_000


def write_typed(df: DataFrame, path: str) -> None:
    """The table as Parquet."""
    df.write.parquet(path)


def with_row_place(table: DataFrame) -> DataFrame:
    """Adds the file and the place in it of every row of a Parquet table: a key for any table.

    A hash of the values would not do: equal rows would be drawn together.
    """
    return table.select(
        "*",
        F.col("_metadata.file_name").alias(_ROW_PLACE[0]),
        F.col("_metadata.row_index").alias(_ROW_PLACE[1]),
    )


def _slice(priority: Column, order: SampleOrder, slices: int) -> Column:
    """Number of the slice of the random order that a row lies in; all slices are equally long."""
    if order.method == "xxhash64":
        place = priority.cast("double") / float(1 << 64) + 0.5
    else:
        place = F.conv(F.substring(priority, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.least(F.floor(place * slices), F.lit(slices - 1)).cast("int")


def write_sample_layout(
    df: DataFrame, path: str, order: SampleOrder, slices: int | None = None
) -> None:
    """Writes the rows by sample step, each task holding one slice of the random order.

    A hash is spread evenly, so slices are equally large whatever the data, and a task writes to
    the few folders that its slice meets. ``slices`` should make files of a good size; it
    defaults to the shuffle partitions of the session. The rows beyond the largest sample, at least 60 %
    of a large table, need no order: every task writes its own, without a shuffle.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    within, past, cut = placed_rows(df, order, past_cap=True)
    drawn = within.unionByName(cut).repartitionById(slices, _slice(F.col(PRIORITY), order, slices))
    drawn.unionByName(past).drop(PRIORITY).write.partitionBy(STEP).parquet(path)


def write_statistics(spark: SparkSession, path: str, columns: tuple[str, ...]) -> None:
    """Counts the rows of every step and value of ``columns``, in one scan of these columns.

    Columns with more than ``MOST_VALUES`` values are left out. Values are kept as text.
    """
    frame = spark.read.parquet(path)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    counted = (
        frame.select(STEP, F.explode(cells).alias("cell"))
        .groupBy(STEP, "cell.column", "cell.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    few = counted.groupBy("column").agg((F.count_distinct("value") <= MOST_VALUES).alias("few"))
    # a column with many values has as many lines as it has values: they are not broadcast, the verdicts are
    kept = counted.join(F.broadcast(few.where("few")), "column").select(STEP, "column", "value", "rows")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_STATISTICS}")


def _read_statistics(spark: SparkSession, path: str) -> DataFrame | None:
    """The statistics table, or None where none was written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_STATISTICS}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    schema = f"{STEP} int, column string, value string, rows long"
    return spark.read.schema(schema).parquet(f"{path}/{_STATISTICS}")


@dataclass(frozen=True)
class SampleLayout:
    """A stored layout and what is known about its steps: rows, files and bytes of each.

    ``statistics`` has the rows per step and value of ``counted`` columns.
    """

    frame: DataFrame
    steps: dict[int, Row]
    statistics: DataFrame | None = None
    counted: frozenset[str] = frozenset()

    def sizes(self, spec: AggregateSpec) -> dict[str | None, int] | None:
        """Filtered rows of every group as text (of None without a group), if the statistics hold them.

        They do when the filters and the group read one counted column, or none.
        """
        wanted = {c.column for c in spec.where} | ({spec.group_by} if spec.group_by else set())
        if not wanted:
            return {None: self.rows}
        if len(wanted) > 1 or not wanted <= self.counted:
            return None
        (column,) = wanted
        kind = self.frame.schema[column].dataType
        values = self.statistics.where(F.col("column") == column).select(
            F.col("value").cast(kind).alias(column), "value", "rows"
        )
        found = spec.filtered(values).groupBy("value").agg(F.sum("rows").alias("n")).collect()
        if spec.group_by is None:
            return {None: sum(r["n"] for r in found)}
        return {r["value"]: r["n"] for r in found}

    @property
    def rows(self) -> int:
        return sum(s["rows"] for s in self.steps.values())

    @property
    def sampled(self) -> list[int]:
        """The steps, without the folder of the rows beyond the largest sample."""
        steps = sorted(self.steps)
        return steps[:-1] if len(steps) > 1 else steps


def open_sample_layout(spark: SparkSession, path: str) -> SampleLayout:
    """Reads file footers and statistics once; runs over the layout then start without doing so."""
    frame = read_sample_layout(spark, path)
    steps = {r[STEP]: r for r in manifest(frame).collect()}
    statistics = _read_statistics(spark, path)
    counted = statistics.select("column").distinct().collect() if statistics is not None else []
    return SampleLayout(frame, steps, statistics, frozenset(r["column"] for r in counted))


def read_sample_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def manifest(layout: DataFrame) -> DataFrame:
    """Rows, files and bytes of every step. Reads file footers only."""
    per_file = layout.groupBy(
        STEP, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return per_file.groupBy(STEP).agg(
        F.sum("rows").alias("rows"), F.count("file").alias("files"), F.sum("bytes").alias("bytes")
    )


def up_to(layout: DataFrame, step: int) -> DataFrame:
    """The random sample of the first steps; other folders are not opened."""
    return layout.where(F.col(STEP) <= step)
