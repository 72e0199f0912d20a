"""What every file source does with its rows: clean names, drop blank rows, profile, cast."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import stripped
from plumbline.operators.profile import column_profile, column_types, dataset_listing, typed


def without_blank_rows(df: DataFrame) -> DataFrame:
    """Rows of text cells of which at least one is not blank."""
    return df.where(F.coalesce(*[stripped(F.col(f"`{c}`")) for c in df.columns]).isNotNull())


@dataclass(frozen=True)
class Dataset:
    """Text cells under clean names, and what the file said about their types."""

    name: str
    text: DataFrame
    declared: Mapping[str, str]
    forced_text: tuple[str, ...] = ()

    def stored(self, path: str) -> "Dataset":
        """The same cells from Parquet at ``path``, so that later scans do not parse again.

        Worth it for large files of an expensive format: typing takes three scans.
        """
        self.text.write.parquet(path)
        schema = self.text.schema
        return replace(self, text=self.text.sparkSession.read.schema(schema).parquet(path))

    def profile(self) -> DataFrame:
        return column_profile(self.text, self.declared, self.forced_text)

    def listing(self) -> DataFrame:
        return dataset_listing(self.profile(), self.name)

    def typed(self) -> DataFrame:
        """Rows cast to the types that all of them allow. Scans the file for its profile."""
        return typed(self.text, column_types(self.profile()))


def dataset(
    name: str,
    text: DataFrame,
    declared: Mapping[str, str] | None = None,
    forced_text: tuple[str, ...] = (),
) -> Dataset:
    return Dataset(name, without_blank_rows(text), declared or {}, forced_text)


def register(dataset_frames: Mapping[str, DataFrame]) -> None:
    """Makes datasets known to ``spark.sql`` by name."""
    for name, frame in dataset_frames.items():
        frame.createOrReplaceTempView(name)
