"""The stages of the pipeline, each against a plain version on its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import mixing, tokens, toxicity
from plumbline.session import stored


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], sf), "stage"))
    return frames


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(parts):
    return {tuple(parts[k : k + 5]) for k in range(len(parts) - 4)} if len(parts) >= 5 else {tuple(parts)} - {()}


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination",
        "mixing sources to target weights", "token-ID / binary output",
    ]
    assert all(f.columns == stages[0].columns for f in stages[1:-1])


def test_toxic_documents_go(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = toxicity.scored(stages[0], toxicity.train(stages[0], labels)).collect()
    kept = {r.doc_id for r in scores if r.predicted == 0}
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(kept)
    assert len(kept) > 0.8 * stages[0].count()


def test_one_of_each_group_stays(stages):
    sets = {r.doc_id: shingles(words(r.text)) for r in stages[1].collect()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({top(i) for i in sets})


def test_documents_with_test_items_go(spark, sf, stages):
    plain = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    items = [shingles(plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = []
    for r in stages[2].collect():
        own = shingles(plain(r.text))
        if not any(i and 100 * len(i & own) >= 75 * len(i) for i in items):
            kept.append(r.doc_id)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(kept)


def test_mix_takes_what_was_decided(stages):
    decided = {r.doc_id: r.copies for r in mixing.mixed(stages[3]).collect() if r.copies}
    assert Counter(r.doc_id for r in stages[4].collect()) == decided
    size, taken = Counter(), Counter()
    for r in stages[3].collect():
        size[r.source] += len(words(r.text))
        taken[r.source] += len(words(r.text)) * decided.get(r.doc_id, 0)
    assert all(taken[s] <= 2 * size[s] for s in size)


def test_token_files_hold_all(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.word_tokenizer())
    at = 0
    got = sorted(stages[5].collect(), key=lambda r: r.start)
    for r, doc in zip(got, sorted(stages[4].collect(), key=lambda r: (r.doc_id, r.text or "")), strict=True):
        ids = np.array([*plain.encode(doc.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (doc.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_stages_on_odd_rows(spark, sf, stages):
    """Nulls, empty and repeated rows pass every stage that has no reason to drop them."""
    schema = stages[0].schema
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3),
         (4, "w " * 5000, "en", None, 10_000), (None, "x y z", None, "s", 5)], schema,
    )
    docs = odd
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stored(stage(spark, docs, sf), "odd")
        assert docs.columns == odd.columns
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, 2, 3, 4, None]
    for name, stage in corpus_pipeline.STAGES[3:]:
        docs = stored(stage(spark, docs, sf), "odd")
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd.limit(0), sf).collect() == []


def test_stages_decide_on_rows(spark, sf, stages):
    """Null and repeated ids: a toxic, leaked or copied row goes alone."""
    schema = stages[0].schema
    rows = lambda some: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in some], schema)
    left = lambda stage, some: sorted(((r.doc_id, r.text) for r in stage(spark, rows(some), sf).collect()), key=str)
    by_key = lambda some: sorted(some, key=str)

    scores = toxicity.scored(stages[0], toxicity.train(stages[0], spark.read.parquet(f"{sf}/labels.parquet")))
    bad = scores.where("predicted = 1").join(stages[0], "doc_id").first().text
    good = [r.text for r in stages[1].where("n_chars > 0").limit(3).collect()]
    clean = [(None, good[0]), (7, good[1]), (None, None), (8, good[2]), (8, good[2])]
    assert left(corpus_pipeline.toxic, [(None, bad), (7, bad), *clean]) == by_key(clean)

    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text)
    clean = [(None, "w " * 30), (7, "x y z"), (None, None), (8, "")]
    assert left(corpus_pipeline.test_items, [(None, item), (7, item), (9, "a b " + item), *clean]) == by_key(clean)

    base = " ".join(f"w{k}" for k in range(60))
    near, other = base + " end", " ".join(f"v{k}" for k in range(60))
    some = [(None, base), (None, near), (None, base), (None, other), (None, "u1 u2"), (None, None), (None, None)]
    want = [(None, other), (None, "u1 u2"), (None, None), (None, None)]
    got = left(corpus_pipeline.near_copies, some)
    assert got in (by_key([*want, (None, base)]), by_key([*want, (None, near)]))
    some = [(5, base), (6, near), (6, other), (7, base), (None, near), (5, "t1 t2 t3"), (5, base), (9, other + " end")]
    assert left(corpus_pipeline.near_copies, some) == by_key([(5, base), (6, other), (5, "t1 t2 t3")])


def test_names_that_stages_use_themselves(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name in ("mark", "_mark", "best_mark", "best_id", "_id", "_own", "leak", "_leak", "size", "item"):
        docs = docs.withColumn(name, docs["doc_id"])
    docs = stored(docs.unionByName(docs.limit(5)), "odd")
    for _, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns and left.count() > 0


def test_stages_bound_their_batches_and_give_training_memory_back(spark, sf, monkeypatch):
    key, given = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(toxicity, "give_back", lambda: given.append(True))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (corpus_pipeline.toxic, corpus_pipeline.token_files):
        spark.conf.unset(key)
        stage(spark, docs, sf)
        assert spark.conf.get(key) == "8m"
    assert len(given) == 1
