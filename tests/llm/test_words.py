"""Shared helpers: words, hashes, components and the meeting of keys."""

import numpy as np
import pyarrow as pa

from plumbline.llm.common import text_slices, word_hashes, words_of
from plumbline.llm.components import components
from plumbline.llm.meeting import shared_rows


def test_words_and_hashes():
    texts = pa.array(["The cat\tsat", None, "", "THE  cät\n", "cat"])
    ((first, last, data, offsets),) = text_slices(texts)
    starts, ends, owner = words_of(data, offsets)
    assert (first, last) == (0, 5)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["The", "cat", "sat", "THE", "cät", "cat"]
    assert owner.tolist() == [0, 0, 0, 3, 3, 4]
    h = word_hashes(data, starts, ends)
    assert h[0] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 4


def test_words_end_with_their_text():
    ((_, _, data, offsets),) = text_slices(pa.array(["ab", "cd", "ef gh"]))
    _, _, owner = words_of(data, offsets)
    assert owner.tolist() == [0, 1, 2, 2]


def test_long_texts_get_a_run_of_their_own():
    texts = pa.array(["a" * 50, "b" * 500, "c" * 50, "d" * 50])
    runs = [(a, b, len(d)) for a, b, d, _ in text_slices(texts, most_bytes=120)]
    assert runs == [(0, 1, 50), (1, 2, 500), (2, 4, 100)]
    assert list(text_slices(pa.array([], pa.string()))) == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 7), (7, 1), (20, 10), (30, 20), (40, 30), (40, 41)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in found} == {
        1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10, 40: 10, 41: 10,
    }
    assert len(found) == 11
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_long_chain(spark):
    chain = [(k, k + 1) for k in range(200)]
    found = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len(found) == 201 and {r.component for r in found} == {0}


def test_only_keys_that_meet_come_out(spark):
    docs = spark.range(0, 4000, 1, 8).selectExpr("id", "CAST(id % 1000 * (id % 3) AS long) AS k")

    def emit(batch):
        out = np.empty(batch.num_rows, [("key", "<u8"), ("id", "<i8")])
        out["key"] = batch.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out["id"] = batch.column(0).to_numpy()
        yield out

    got = sorted({r.id for r in shared_rows(docs, emit, [("id", "<i8")], 5).collect()})
    rows = [(r.id, r.k) for r in docs.collect()]
    many = {k for _, k in rows if sum(k == x for _, x in rows) > 1}
    assert got == sorted(i for i, k in rows if k in many)
