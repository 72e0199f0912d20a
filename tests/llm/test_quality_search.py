"""Quality by a quadratic discriminant, and ranked search, against plain versions."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import quality, ranked

DOCS = "doc_id long, text string, score double, rank int, stats string, label int, held_out string, m long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.0, 1, "x", 1, "y", 5) for i, t in rows], DOCS)


# ---- quality


def good(rng):
    return " ".join(rng.choice(["the", "house", "on", "hill", "river", "was", "stone,", "old.", "green"]) for _ in range(60))


def bad(rng):
    return rng.choice([
        " ".join(w + "!!" for w in good(rng).upper().split()),
        " | ".join(good(rng).split()[:20]),
        "spam " * rng.randint(5, 60),
    ])


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(3)
    rows = [(k, good(rng) if k % 4 else bad(rng)) for k in range(1200)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame(
        [(k, 1 if k % 4 else 0) for k, _ in rows] + [(None, 1), (5, None), (7, 9)], "doc_id long, quality int"
    )
    stats = quality.described(docs)
    return rows, stats, labels, quality.train(stats, labels)


def test_held_out_accuracy(marked):
    rows, stats, _, model = marked
    got = {r.doc_id: r for r in quality.scored(stats, model).collect()}
    assert len(got) == len(rows)
    for k, _ in rows:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0.0 <= got[k].score <= 1.0 and got[k].predicted == (got[k].score >= 0.5)
    own = [k for k, _ in rows if got[k].held_out]
    assert sum(got[k].predicted == (1 if k % 4 else 0) for k in own) >= 0.98 * len(own)


def test_scores_are_gaussian_densities(marked):
    rows, stats, labels, model = marked
    vectors = {r.doc_id: np.array(r.stats) / quality.GRID for r in stats.collect()}
    seen = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    pooled, diagonal = model.shrinkage
    classes = [np.array([vectors[k] for k in seen if (1 if k % 4 else 0) == c]) for c in (0, 1)]
    both = sum((len(c) - 1) * np.cov(c.T) for c in classes) / (len(seen) - 2)
    logs = []
    for c in classes:
        own = (1 - pooled) * np.cov(c.T) + pooled * both
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + quality.RIDGE * np.eye(len(own))
        x = np.array([vectors[k] for k, _ in rows]) - c.mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", x, np.linalg.inv(own), x)
        logs.append(np.log(len(c) / len(seen)) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * distance)
    want = 1 / (1 + np.exp(-(model.slope * np.arcsinh(logs[1] - logs[0]) + model.shift)))
    got = {r.doc_id: r.score for r in quality.scored(stats, model).collect()}
    assert np.allclose([got[k] for k, _ in rows], want, atol=1e-6)


def plain_statistics(text):
    data = text.encode()
    words = re.findall(rb"[^ \t-\r]+", data)
    n = max(len(words), 1)
    share = lambda a, b: math.asin(math.sqrt(a / max(b, 1)))
    letters = lambda w, p: len(re.findall(p, w))
    mean = sum(map(len, words)) / n
    runs, last = [0], None
    for w in words:
        runs.append(runs[-1] + 1 if w == last else 1)
        last = w
    grams = [tuple(words[k : k + 4]) for k in range(len(words) - 3)]
    inside = b"".join(words)
    stop = lambda w: w[-1:] in b".,"
    return [
        math.log1p(len(words)), math.log1p(mean), math.log1p(math.sqrt(max(sum(len(w) ** 2 for w in words) / n - mean**2, 0))),
        math.log1p(len(words) / (data.count(b"\n") + 1)), share(len(set(words)), len(words)),
        share(sum(a == b for a, b in zip(words, words[1:])), len(words)), math.log1p(max(runs)),
        share(len(grams) - len(set(grams)), len(grams)),
        share(sum(not re.search(rb"[A-Za-z\x80-\xff]", w) for w in words), len(words)),
        share(sum(letters(w, rb"[A-Z]") > 1 and not re.search(rb"[a-z]", w) for w in words), len(words)),
        share(sum(not re.match(rb"[A-Za-z0-9\x80-\xff]", w[-1:]) and not stop(w) for w in words), len(words)),
        share(sum(stop(w) for w in words), len(words)),
        share(letters(inside, rb"[A-Z]"), letters(inside, rb"[A-Za-z]")),
        share(letters(inside, rb"[^A-Za-z0-9.,;:'\"()?\x80-\xff-]"), len(inside)),
        share(letters(inside, rb"[0-9]"), len(inside)), share(letters(inside, rb"[\x80-\xff]"), len(inside)),
    ]


def test_statistics_by_hand(spark):
    rng = random.Random(9)
    bits = ["a", "The", "GO", "stop.", "x,", "7", "|", "é", "no!", "a", "\n", "a-b", "(see)", "###"]
    texts = ["", " ", "one", "a a", "a b c d a b c d"] + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    got = {r.doc_id: r.stats for r in quality.described(frame(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want = np.rint(np.array(plain_statistics(t)) * quality.GRID)
        assert np.abs(np.array(got[k]) - want).max() <= 1, t


def test_odd_rows_of_quality(spark, marked):
    model = marked[3]
    rows = [(1, None), (2, ""), (None, "the old house"), (None, "the old house"), (3, "word " * 300_000)]
    got = quality.scored(quality.described(frame(spark, rows)), model).collect()
    assert len(got) == 5 and all(r.score is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    empty = quality.described(frame(spark, []))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scored(empty, quality.train(empty, none)).count() == 0
    stats = quality.described(frame(spark, rows))
    assert {r.score for r in quality.scored(stats, quality.train(stats, none)).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.scored(stats, quality.train(stats, one)).collect())


# ---- ranked search


def plain_search(docs, items, depth=50):
    terms = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    own = [(k, terms(t)) for k, t in docs]
    own = [(k, t) for k, t in own if t]
    n_docs, length = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in sorted(set(items), key=str):
        asked = set(terms(text)) & set(df)
        found = []
        for k, t in own:
            m = 50 + 50 * len(t) * n_docs // length
            s = 0
            for w in asked & set(t):
                tf = t.count(w)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if s:
                found.append((-s, k is None, k or 0))
        out += [(item, r + 1, None if null else k, -s) for r, (s, null, k) in enumerate(sorted(found)[:depth])]
    return sorted(out, key=str)


def found(spark, docs, items):
    asked = spark.createDataFrame([(i, t, 1, 2.0) for i, t in items], "item_id long, text string, rank int, score double")
    got = ranked.search(frame(spark, docs), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_search_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)] + ["Été", "ÉTÉ", "x-y", "Über", "A", "a"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 41, 300])))) for k in range(1500)]
    docs += [(5000 + k, " ".join(rng.choices(words, k=7))) for k in range(4000)]  # one long stratum
    docs += [(9000 + k % 30, "w1 w2 w3 w250") for k in range(300)]  # ties and repeated ids
    docs += [(None, "w1 w250"), (None, None), (1, ""), (2, "... --- !"), (3, "w299 " * 50_000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(40)]
    items += [(7, "another text of item 7: w9"), (7, "another text of item 7: w9"), (None, "w250 W250"), (90, None), (91, "?"), (92, "nowhere")]
    assert found(spark, docs, items) == plain_search(docs, items)


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(ranked, "MOST_ITEM_BYTES", 20)
    docs = [(k, f"alpha beta{k % 3} gamma{k % 5}") for k in range(60)]
    items = [(k, f"beta{k % 3} gamma{k % 4}") for k in range(6)]
    assert found(spark, docs, items) == plain_search(docs, items)


def test_search_of_nothing(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == []
    assert found(spark, [(1, None)], [(1, None)]) == []
    assert found(spark, [(1, "a")], [(1, "a")]) == plain_search([(1, "a")], [(1, "a")])


def test_terms_whose_hashes_are_equal_are_told_apart():
    items = ranked.Items([(1, "one two six")])
    items.hashes = np.sort(items.hashes)
    data = np.frombuffer(b"one two six ten", np.uint8)
    starts = np.array([0, 4, 8, 12])
    assert [items.terms[k] if k >= 0 else None for k in items.places(data, starts, starts + 3)] == [b"one", b"two", b"six", None]
    same = np.zeros(3, np.uint64)
    items.hashes = same
    real = ranked.word_hashes
    try:
        ranked.word_hashes = lambda data, starts, ends, lower: np.zeros(len(starts), np.uint64)
        assert [items.terms[k] if k >= 0 else None for k in items.places(data, starts, starts + 3)] == [b"one", b"two", b"six", None]
    finally:
        ranked.word_hashes = real
