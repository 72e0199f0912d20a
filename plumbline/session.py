"""Session helpers: a local session for tests and benchmarks, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Python gets rows in batches of bounded bytes, not of 10,000 rows however long
_SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: settings of a stored step: its shuffle files go when it ends, not when the driver happens to collect its garbage
_STORING = _SMALL_BATCHES | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session. Cluster jobs bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # looking up the Python call site of every column takes most of the time to build a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="plumbline-")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a block runs; then they are as before."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python gets in this session from now on, for frames that a caller will run."""
    for key, value in _SMALL_BATCHES.items():
        spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame from a table written to the scratch folder: computed once, its size known.

    Spark broadcasts such a table in a join only if its files are small. The shuffle files of the step are removed.
    """
    path = scratch_path(df.sparkSession, name)
    with _set(df.sparkSession, _STORING):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_parts(spark: SparkSession, parts: Iterable[DataFrame], name: str, schema: str) -> DataFrame:
    """The rows of all frames from one table, each frame written when the one before it is done.

    Only one of them has shuffle files at a time.
    """
    path = scratch_path(spark, name)
    with _set(spark, _STORING):
        for part in parts:
            part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
