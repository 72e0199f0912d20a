"""From files to tables that samples can be read from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.profile import column_types, dataset_listing, typed
from plumbline.sources import layout
from plumbline.sources.files import read_file
from plumbline.sources.rows import Dataset


@dataclass(frozen=True)
class Imported:
    """A dataset on disk: its profile, its typed table, its sample layout."""

    name: str
    listing: DataFrame
    table_path: str
    layout_path: str


def import_dataset(source: Dataset, folder: str, slices: int | None = None) -> Imported:
    """Parses once, types by full scan, writes the typed table and its sample layout.

    Files have no key, so rows are told apart by their place in the typed table. A table of less
    than two rows needs no layout other than itself, but gets one all the same.
    """
    spark = source.text.sparkSession
    base = f"{folder}/{source.name}"
    cells = source.stored(f"{base}/cells")
    profile = cells.profile()
    layout.write_typed(typed(cells.text, column_types(profile)), f"{base}/table")
    table = layout.with_row_place(spark.read.parquet(f"{base}/table"))
    order = layout.ROW_PLACE_ORDER.for_rows(table.count())
    layout.write_sample_layout(table, f"{base}/sample", order, slices)
    listing = dataset_listing(profile, source.name)
    return Imported(source.name, listing, f"{base}/table", f"{base}/sample")


def import_file(
    spark: SparkSession, path: str, folder: str, name: str | None = None, slices: int | None = None
) -> list[Imported]:
    return [import_dataset(d, folder, slices) for d in read_file(spark, path, name)]
