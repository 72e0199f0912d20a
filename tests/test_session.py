"""The scratch folder is the one that the session names."""

import glob
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline import session


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Session:
    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master})


def test_named_folder():
    cluster = Session("yarn", **{"spark.checkpoint.dir": "hdfs://shared/scratch"})
    first, second = (session.scratch_path(cluster, "marks") for _ in range(2))
    assert first.startswith("hdfs://shared/scratch/marks-") and first != second


def test_a_cluster_must_name_one():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Session("yarn"), "marks")


def test_a_local_session_may_go_without():
    assert "plumbline-" in session.scratch_path(Session("local[2]"), "marks")


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before, settings = shuffle_files(spark), {key: spark.conf.get(key, None) for key in session._STORING}
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    first, second = session.stored(counts, "counts"), session.stored(counts, "counts")
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert first.count() == second.count() == counts.count() == 100
    assert {key: spark.conf.get(key, None) for key in session._STORING} == settings


def test_python_gets_long_rows_of_a_stored_step_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([len(batch)])], names=["n", "rows"])

    texts = spark.range(0, 4_000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    got = session.stored(texts.mapInArrow(sizes, "n long, rows long"), "sizes").collect()
    assert sum(r.rows for r in got) == 4_000
    assert max(r.n for r in got) < 16 << 20
