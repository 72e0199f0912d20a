"""Operators on pairs against brute force: n-gram join, repeated strings, vectors, leaks."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, near_vectors, ngram_join, repeats

DOCS = "doc_id long, text string, cls string, row long, spans string"


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def reachable(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    line = "one line that stands in very many of the documents here"
    for k in range(30):
        own = texts[k].split()
        for _ in range(rng.randint(0, 3)):
            if own:
                own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
        texts.append(texts[k].upper())
        texts.append(line + " " + " ".join(rng.choice(words) for _ in range(k)))
    texts += [None, "", " \t\n", "a b c d", "A  b c D", "a b c", "x" * 5000, ("y z " * 3000).strip(), line]
    return list(enumerate(texts))


def test_join_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS).repartition(5)
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = reachable(sets, links)
    got = ngram_join.similar_sets(docs).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, len(sets[i]), root[i]) for i in sets)


def test_join_edge_cases(spark):
    rows = [(7, "p q r s t u"), (7, "p q r s t u"), (None, "p q r s t u"), (3, "P Q R S T U"), (9, None)]
    docs = spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_sets(docs).collect()), key=str)
    assert got == [(3, 2, 3), (7, 2, 3), (7, 2, 3), (9, 0, 9), (None, 2, 3)]
    assert ngram_join.similar_sets(docs.limit(0)).collect() == []


def near_group(seed, count, edits, size=120):
    """Copies of one text, each with some words of its own."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(3000)}" for _ in range(size)]
    rows = []
    for k in range(count):
        own = list(base)
        for e in range(edits):
            own[rng.randrange(size)] = f"own{k}x{e}"
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_join_of_many_near_copies(spark, edits):
    rows = near_group(edits, 150, edits)
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS).repartition(5)
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = reachable(sets, links)
    got = ngram_join.similar_sets(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(root.items())


def test_related_texts_below_the_line_are_not_all_paired(spark, monkeypatch):
    made = []
    real = ngram_join._linked

    def counted(docs, table, pairs, percent):
        made.append(pairs.count())
        return real(docs, table, pairs, percent)

    monkeypatch.setattr(ngram_join, "_linked", counted)
    rows = near_group(3, 500, 4)
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS)
    ngram_join.similar_sets(docs).collect()
    assert sum(made) < 10_000  # of 124,750 pairs


def test_only_pairs_with_close_bitmaps_are_counted(spark, monkeypatch):
    counted = []
    real = ngram_join._overlaps

    def overlaps(docs, table, pairs):
        counted.append(pairs.count())
        return real(docs, table, pairs)

    monkeypatch.setattr(ngram_join, "_overlaps", overlaps)
    rows = near_group(3, 500, 4)
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS)
    got = ngram_join.similar_sets(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(reachable(sets, links).items())
    assert sum(counted) < 500  # of more than 6,000 pairs with a common prefix


@pytest.mark.parametrize("size, other", [(1, 1), (1, 3), (31, 34), (300, 390), (2048, 1537), (40, 5000)])
def test_bitmaps_never_differ_more_than_sets(size, other):
    rng = np.random.default_rng(size)
    for shared in (0, min(size, other) // 2, min(size, other)):
        x = rng.integers(0, 1 << 63, size, np.uint64)
        y = np.concatenate((x[:shared], rng.integers(0, 1 << 63, other - shared, np.uint64)))
        a, b = ngram_join.bitmaps(np.concatenate((x, y)), np.array([size, size + other]))
        apart = len(set(x.tolist()) ^ set(y.tolist()))
        assert apart - ngram_join._bits_apart(a, b) >= 0
        assert ngram_join._bits_apart(a, b) == ngram_join._bits_apart(b, a)
        assert (apart - ngram_join._bits_apart(a, b)) % 2 == 0


def test_join_through_rows_without_an_id(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(100)]
    other = words[:88] + [f"v{k}" for k in range(12)]
    far = [f"u{k}" for k in range(12)] + other[12:]
    sets = [shingles(" ".join(w)) for w in (words, other, far)]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.75
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    rows = [(1, " ".join(words)), (None, " ".join(other)), (3, " ".join(far)), (4, " ".join(rng.sample(words, 50)))]
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.similar_sets(docs).collect()), key=str)
    assert got == [(1, 1), (3, 1), (4, 4), (None, 1)]


def removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_match_brute_force(spark, seed):
    rng = random.Random(seed)
    signs = "ab \nñ\0é" if seed == 2 else "abcdefgh ijkl ß\n"
    plain = lambda n: "".join(rng.choice(signs) for _ in range(n))
    shared = [plain(rng.choice([60, 90, 99, 100, 101, 140, 400])) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [plain(rng.randint(0, 150)) + (rng.choice(shared) if rng.random() < 0.7 else "") for _ in range(rng.randint(0, 4))]
        rows.append((i, "".join(parts)))
    rows += [(100, "z" * 700), (101, None), (102, ""), (103, "ab" * 300), (104, rows[3][1]), (3, rows[3][1]), (None, shared[6])]
    docs = spark.createDataFrame([(i, t, "", 5, "") for i, t in rows], DOCS).repartition(4)
    got = repeats.without_repeats(docs, length=100).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(removed(rows, 100), key=str)


def test_repeats_in_long_texts_and_kept_bytes(spark, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghij ") for _ in range(9000))
    rows = [(1, base), (2, base[4000:4500] + "x"), (3, "q" + base[100:350])]
    docs = spark.createDataFrame([(i, t, "", 5, "") for i, t in rows], DOCS)
    got = {r.doc_id: r for r in repeats.without_repeats(docs, keep_text=True).collect()}
    assert got[1].kept.decode() == base[:100] + base[350:4000] + base[4500:]
    assert (got[2].kept, got[3].kept) == (b"x", b"q")
    assert repeats.without_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        repeats.without_repeats(docs, length=64)


def test_anchors_agree_across_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    room = len(data) - np.arange(len(data))
    whole = repeats._Anchors(200).of(data, room)
    part = repeats._Anchors(200).of(data[1000:4000], np.minimum(room[1000:4000], 3000 - np.arange(3000)))
    inner = (whole[1] >= 1400) & (whole[1] < 3600)
    own = (part[1] >= 400) & (part[1] < 2600)
    for a, b in zip(whole, part):
        shift = 1000 if a is whole[1] else 0
        assert (a[inner] == b[own] + np.array(shift, b.dtype)).all()


def vectors(seed=0, n=400, size=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size)) * np.linspace(3, 0.5, size)
    near = base[rng.integers(0, n, 200)] + rng.normal(size=(200, size)) * 0.25
    rows = [*base, *near, *base[:20], base[0] * 1e200, base[1] * 1e-200]
    return [(i, [float(x) for x in v], 3) for i, v in enumerate(rows)]


def test_vectors_match_brute_force(spark):
    rows = vectors()
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [1.0] * 23 + [None], 1), (903, [float("nan")] * 24, 1),
           (904, [1.0] * 23 + [float("inf")], 1), (905, [], 1), (906, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, tile long").repartition(6)
    x = np.array([v for _, v, _ in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    root = reachable(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit))])
    want = [(i, int(hit[i].sum()), root[i], root[i] == i) for i in range(len(x))]
    want += [(i, 0, i, True) for i, _, _ in odd]
    got = near_vectors.near_vectors(table, tile=64).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_vectors_without_any(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    alone = spark.createDataFrame([(4, None), (None, [0.0])], schema)
    got = sorted((tuple(r) for r in near_vectors.near_vectors(alone).collect()), key=str)
    assert got == [(4, 0, 4, True), (None, 0, None, False)]
    same = spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0])], schema)
    got = sorted((tuple(r) for r in near_vectors.near_vectors(same).collect()), key=str)
    assert got == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (None, 0, None, False)]


ITEM = "what is the name of the river that runs through the old town"


def test_leaks_in_long_documents(spark):
    filler = " ".join(f"filler{k}" for k in range(20_000))
    items = [(1, ITEM), (2, "two plus two is four"), (3, None), (4, ""), (5, "short one"), (1, ITEM)]
    docs = [
        (10, filler + " " + ITEM.upper() + "? " + filler),
        (11, ITEM.replace("river", "lake")),  # 5 of 9 shingles are gone
        (12, ITEM.replace("what", "which")),  # 1 of 9 is gone
        (13, "Two plus two, is four!"),
        (14, None),
        (15, ""),
        (16, "short one"),
        (17, "a short one"),
        (None, ITEM),
        (10, "another text with the same id"),
    ]
    df = spark.createDataFrame([(i, t, "", 0, "") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contained_items(df, bench).collect()}
    assert got == {
        (10, 1): (9, 9), (12, 1): (8, 9), (13, 2): (1, 1), (16, 5): (1, 1), (17, 5): (1, 1), (None, 1): (9, 9),
    }
    left = decontaminate.clean_rows(df, bench)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [10, 11, 14, 15]
    named = df.withColumn("leak", F.lit(1)).withColumn("_leak", F.lit(2))
    assert decontaminate.clean_rows(named, bench).columns == named.columns
    assert decontaminate.contained_items(df.limit(0), bench).collect() == []
    assert decontaminate.contained_items(df, bench.limit(0)).collect() == []


def test_items_of_few_words_are_found_inside_documents(spark):
    rng = random.Random(11)
    words = ["p", "q", "r", "s", "t"]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, pick(rng.randint(1, 7))) for k in range(30)]
    docs = [(k, pick(rng.randint(0, 14))) for k in range(60)]
    runs = lambda t, n: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    want = set()
    for i, t in items:
        n = min(len(t.split()), 5)
        for d, x in docs:
            held = runs(t, n) & runs(x, n)
            if 100 * len(held) >= 75 * len(runs(t, n)):
                want.add((d, i, len(held), len(runs(t, n))))
    df = spark.createDataFrame([(i, t, "", 0, "") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(want) > 50


def test_leaks_lose_nothing_at_the_threshold(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(rng.randint(5, 70)))) for k in range(60)]
    docs = []
    for k, t in items:
        words = t.split()
        for cut in (0, 1, 2, 3, 5, 9):
            docs.append((len(docs), " ".join(["pre"] * 6 + words[cut:] + ["post"] * 6)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        for k, u in items:
            a, b = shingles(t), shingles(u)
            if 100 * len(a & b) >= 75 * len(b):
                want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(df, bench).collect()}
    assert got == want


def test_vectors_of_several_lengths_are_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [3.0, 0.0, 0.1]),
            (6, [None] * 5), (7, [0.0] * 4), (8, []), (9, [5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(table).collect()}
    want = {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False)}
    assert got == want | {k: (0, k, True) for k in (6, 7, 8, 9)}


def test_vectors_are_dealt_out_in_few_copies_at_a_time(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1100, 16))
    near = x[rng.integers(0, 1100, 150)] + rng.normal(size=(150, 16)) * 0.2
    x = np.concatenate([x, near, x[0] + rng.normal(size=(80, 16)) * 0.15]).astype(np.float32)
    compared = near_vectors._compared

    def counted(*args):
        run = compared(*args)

        def noted(batches):
            seen = []
            yield from run(seen.append(sum(map(len, b.column("ids").to_pylist()))) or b for b in batches)
            with open(tmp_path / f"{TaskContext.get().stageId()}-{TaskContext.get().partitionId()}", "w") as f:
                f.write(str(sum(seen) // 8))

        return noted

    monkeypatch.setattr(near_vectors, "_compared", counted)
    monkeypatch.setattr(near_vectors, "ROUND_BYTES", 0, raising=False)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(tuple(r) for r in near_vectors.near_vectors(table, tile=16).collect())
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    root = reachable(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit))])
    assert got == [(i, int(hit[i].sum()), root[i], root[i] == i) for i in range(len(x))]
    assert hit.sum() > 1000
    by_stage = {}
    for name in tmp_path.iterdir():
        stage = name.name.split("-")[0]
        by_stage[stage] = by_stage.get(stage, 0) + int(name.read_text())
    assert max(by_stage.values()) <= 2 * len(x)


def test_rounds_bring_every_two_blocks_together_once():
    for count, width, most in ((1, 1.0, 0), (2, 1.0, 25), (7, 9.0, 20), (12, 9.0, 300), (12, 0.2, 20), (9, 0.05, 45)):
        low = [np.array([k / count]) for k in range(count)]
        blocks = [{"n": 10, "low": at, "high": at + 1 / count} for at in low]
        met = []
        for tasks in near_vectors._rounds(blocks, width, most):
            assert sum(10 + 10 * len(past) for _, _, past in tasks) <= max(most, 20)
            met += [(held, held) for held, compared, _ in tasks if compared]
            met += [tuple(sorted((held, p))) for held, _, past in tasks for p in past]
        near = [(a, b) for a in range(count) for b in range(a, count) if (b - a - 1) / count <= width]
        assert sorted(met) == near
