"""Operators on single rows: personal data, toxicity, licences, URLs, token files, mixing."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import licences, mixing, pii, pii_labels, tokens, toxicity, urls

DOCS = "doc_id long, text string, source string, score double, held_out string, size long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 0.0, "x", 1) for i, t, s in rows], DOCS)


# ---- personal data


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        n = int(c) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def by_pattern(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    spans = lambda p: [(m.group(), m.span()) for m in re.finditer(p, text)]
    return {
        "email": [s for _, s in spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [s for g, s in spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in g.split("."))],
        "card": [s for g, s in spans(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(only(g)) <= 19 and luhn(only(g))],
        "phone": [s for g, s in spans(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(only(g)) <= 15],
    }


def test_rules_match_the_patterns():
    rng = random.Random(2)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "x", " ", "é", "+1 (555) 010-4477", "4111111111111111", "-", "+",
            "1", "22", "..", "a.b", "%", "@d-e.f", "\n", "5500 0000 0000 0004", "(", "７"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == by_pattern(text), text


def test_leading_zeros_do_not_matter():
    zeros = "0" * 500
    assert pii.base_spans(f"{zeros}12.1.2.3")["ip"] == [(0, 508)]
    assert pii.base_spans(f"{zeros}.1.2.3 {zeros}256.1.2.3")["ip"] == [(0, 506)]


def test_rules_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii_labels.labelled_table(spark))


def test_field_learns_its_table(field):
    marked = [pii_labels.marked_spans(m) for m in pii_labels.MARKED]
    sentences = [pii.labelled_words(*m) for m in marked]
    paths = field.decode([words for words, _ in sentences])
    right = sum(list(p) == labels for p, (_, labels) in zip(paths, sentences))
    assert right >= 0.95 * len(sentences)


def test_field_on_unseen_sentences(field):
    unseen = ["you may call 555-010-7712 today", "ask at (555) 010-8811 or write", "host 2001:db8::7 is slow"]
    base = [pii.base_spans(t) for t in unseen]
    found = pii.added_spans(field, unseen, base)
    assert [[t[a:b] for v in f.values() for a, b in v] for t, f in zip(unseen, found)] == [
        ["555-010-7712"], ["(555) 010-8811"], ["2001:db8::7"],
    ]
    clean = ["in 2023 there were 77 of them", "version 4.0.2 came out", "chapter 9, page 110.", "a of the 3rd"]
    assert not any(any(f.values()) for f in pii.added_spans(field, clean, [pii.base_spans(t) for t in clean]))


OBFUSCATED = [
    "please mail bob(at)example.org about it",
    "write to carol[at]example.com for the files",
    "we hope that dora(at)mail.example.net reads this",
]


def test_field_reads_words_without_digits(spark, field):
    base = [pii.base_spans(t) for t in OBFUSCATED]
    found = pii.added_spans(field, OBFUSCATED, base)
    assert [[t[a:b] for a, b in f["email"]] for t, f in zip(OBFUSCATED, found)] == [
        ["bob(at)example.org"], ["carol[at]example.com"], ["dora(at)mail.example.net"],
    ]
    rows = [(k, t, "a") for k, t in enumerate(OBFUSCATED)]
    rows.append((3, "plain words (quietly), e.g. here; and a well-known [one] don't\n" * 3000 + OBFUSCATED[0], "a"))
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows), field).collect()}
    assert [got[k].spans for k in range(3)] == ["email:12:30", "email:9:29", "email:13:37"]
    at = len(rows[3][1]) - len(OBFUSCATED[0])
    assert got[3].spans == f"email:{at + 12}:{at + 30}"
    assert all(r.n_email == 0 and r.base_sha256 == got[0].base_sha256 for r in got.values())


def test_whole_texts_are_decoded_as_by_viterbi(field):
    rng = random.Random(5)
    bits = ["a", "word,", "The", "bob(at)x.org", "c[at]d.com", "(555)", "010-4477", "192.0.2.9:80", "e.g.", "(see)", "2019",
            "+1", "555.010.3344", "dead::beef", "don't", "30", "5550", "x" * 70, "^", "$", "é", "3.50", "[x]", "::"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    paths = [np.zeros(len(t.split()), int) for t in texts]
    for i, first, path in pii._Reader(field).labelled(texts):
        paths[i][first : first + len(path)] = path
    want = field.decode([t.split() for t in texts])
    assert [p.tolist() for p in paths] == [p.tolist() for p in want]
    assert sum(p.any() for p in want) > 100


def test_viterbi_finds_the_best_path(field):
    words = "call +1 (555) 010-4477 or 1.2.3.4 now".split()
    ids = [[field.known[f] for f in fs if f in field.known] for fs in pii._features(words)]
    scores = field._padded([ids])[0][0]
    rng = np.random.default_rng(0)

    def value(path):
        moves = sum(field.moves[a, b] for a, b in zip(path[:-1], path[1:]))
        return field.first[path[0]] + moves + sum(scores[t, k] for t, k in enumerate(path))

    best = value(field.decode([words])[0])
    assert all(value(rng.integers(0, len(pii.LABELS), len(words))) <= best for _ in range(3000))


def test_personal_data_rows(spark, field):
    rows = [(1, "mail ann@example.com or +1 (555) 010-4477 é 192.0.2.1", "a"), (2, None, None), (3, "", "a"),
            (None, "x 4111111111111111", "a"), (1, "mail ann@example.com or +1 (555) 010-4477 é 192.0.2.1", "a"),
            (4, "word " * 50_000 + "b@c.de", "a")]
    got = sorted((tuple(r) for r in pii.find_personal_data(frame(spark, rows), field).collect()), key=str)
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    by_id = {r[0]: r for r in got}
    assert len(got) == 6 and got[0] == got[1]
    assert by_id[1][1:5] == (1, 1, 0, 1) and by_id[1][6] == "email:5:20,ip:44:53,phone:24:41"
    assert by_id[2][1:] == by_id[3][1:] == (0, 0, 0, 0, empty, "")
    assert by_id[None][3] == 1 and by_id[4][6] == "email:250000:250006"
    assert pii.find_personal_data(frame(spark, rows).limit(0), field).collect() == []


# ---- toxicity


def sentences(n, seed, insults=("dreckbold", "schuftig", "lumpenzahn")):
    rng = random.Random(seed)
    parts = ["ra", "mo", "ti", "sel", "kun", "bar", "do", "fi", "gan", "wel"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        labels.append(int(k % 5 == 0))
        if labels[-1]:
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append(" ".join(words).capitalize() + ".")
    return texts, labels


@pytest.fixture(scope="module")
def detector():
    return toxicity.fit(*sentences(600, 1), landmarks=64)


def test_toxic_words_with_gaps(detector):
    words = [b"dreckbold", b"Dreckbold,", b"d.r.e.c.k.b.o.l.d", b"dreckxbold", b"dr3ckb0ld", b"dreckboold"]
    chance = detector.probability(detector.words(words))
    assert (chance[:3] > 0.5).all() and (chance >= 0.3).all()
    assert (detector.probability(detector.words([b"", b"ramoti", b"welgan", b"...", b"x" * 4000])) < 0.3).all()


def test_toxicity_held_out(spark, detector):
    texts, labels = sentences(400, 2)
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "ramo", "s"), (7, texts[7], "s"),
             (1002, "ramo " * 30_000 + "d r e c k b o l d", "s")]
    got = toxicity.scored(frame(spark, rows), detector).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    right = sum(by_id[k].predicted == y for k, y in enumerate(labels))
    assert right >= 0.97 * len(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert by_id[1000].score == by_id[1001].score and by_id[1000].predicted == 0
    assert by_id[1002].predicted == 1 and by_id[None].held_out is False
    assert toxicity.scored(frame(spark, rows).limit(0), detector).collect() == []


def test_scores_do_not_depend_on_batches(spark, detector):
    texts, _ = sentences(120, 3)
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    one = {r.doc_id: r.score for r in toxicity.scored(frame(spark, rows).coalesce(1), detector).collect()}
    many = {r.doc_id: r.score for r in toxicity.scored(frame(spark, rows).repartition(7), detector).collect()}
    assert one == many


def test_listed_weights_are_the_landmark_expansion():
    space = toxicity.Landmarks([b"abcde", b"xyzabc", b"hello"], 0.7)
    w = np.array([0.3, -0.2, 0.9], np.float32)
    found = toxicity.Detector(space.expanded(w), 0.0, (1.0, 0.0), 0.7).words([b"abcxde", b"help", b"hello"])
    assert np.allclose(found, space.kernel([b"abcxde", b"help", b"hello"]) @ w, atol=1e-5)
    assert np.allclose(np.diag(space.kernel([b"abcde", b"xyzabc", b"hello"])), 1.0, atol=1e-5)


def test_training_without_both_labels(spark):
    docs = frame(spark, [(1, "a b", "s"), (3, None, "s")])
    labels = spark.createDataFrame([(1, 0, 1), (3, 0, 1), (None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    assert {r.predicted for r in toxicity.scored(docs, model).collect()} == {0}


# ---- licences


def test_licences(spark):
    rng = random.Random(5)
    words = ["ande", "thion", "license", "version", "under", "work", "the", "of", "ing", "4.0", "public"]
    plain = lambda n: " ".join(rng.choice(words[:1] + words[5:9]) for _ in range(n))
    rows = [(k, plain(80) + ".\n" + plain(40), "s") for k in range(40)]
    model = licences.train(licences.notices_table(spark), frame(spark, rows))
    notes = {
        100: ("mit", "Released under the MIT License."),
        101: ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
        102: ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
        103: ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    }
    rows += [(k, plain(90) + "\n" + t + "\n" + plain(9), "s") for k, (_, t) in notes.items()]
    rows += [(200, None, "s"), (201, "", "s"), (202, "the license of the work", "s"), (None, notes[100][1], "s"),
             (203, "ñ " * 9_000 + notes[101][1], "s")]
    got = {r.doc_id: r for r in licences.scan(frame(spark, rows), model).collect()}
    assert len(got) == len(rows)
    for k, (family, text) in notes.items():
        assert got[k].families == family
        _, a, b = got[k].notices.split(":")
        assert dict((i, t) for i, t, _ in rows)[k][int(a) : int(b)] == text
    assert [k for k in got if got[k].families and k not in notes and k is not None] == [203]
    assert got[None].families == "mit" and got[200].n_passages == got[201].n_passages == 0
    assert licences.scan(frame(spark, rows).limit(0), model).collect() == []


# ---- URLs

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PAGES = [
    (1, "http://a.net/x", "<link rel='canonical' href='http://b.com/de/1'>", ("a.net", "/x", None, "block")),
    (2, "http://b.com/de/1", None, ("b.com", "/de/1", "com/de/", "block")),
    (3, "http://c.net/y?q", '<META HTTP-EQUIV="refresh" content="0; url=http://a.net/x#q">', ("c.net", "/y", None, "block")),
    (4, "http://d.net/", '<link href="//E.com/de/2" rel="canonical">', ("d.net", "/", None, "allow")),
    (5, "https://e.com/de/2", "<link rel=canonical href=http://f.org/ok>", ("e.com", "/de/2", "com/de/", "block")),
    (6, "http://f.org/ok", "", ("f.org", "/ok", "org/", "allow")),
    (7, None, "x", ("", "", None, "allow")),
    (8, "nourl", None, ("", "", None, "allow")),
    (9, "http://G.ORG", "", ("g.org", "", None, "allow")),
    (10, "http://w.Example.org/es/1#t", "", ("w.example.org", "/es/1", "example.org/es/", "block")),
    (11, "http://notexample.org/es/1", "", ("notexample.org", "/es/1", "org/", "allow")),
    (12, "http://h.net/p/q", "<link rel=canonical href='../z'><link rel=canonical href='/r'>", ("h.net", "/p/q", None, "allow")),
    (12, "http://h.net/p/q", "<link rel=canonical href='../z'><link rel=canonical href='/r'>", ("h.net", "/p/q", None, "allow")),
    (None, "http://i.com/fr/a", None, ("i.com", "/fr/a", "com/fr/", "allow")),
]


def test_urls(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h, _ in PAGES], "page_id long, url string, html string, host string, rule string")
    got = urls.judged(pages, rules).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *w) for i, _, _, w in PAGES), key=str)
    edges = [("http://h.net/r", "http://z.com/de/"), ("http://d.net/", "http://y.com/de/"), (None, "http://y.com/de/")]
    redirects = spark.createDataFrame(edges, "source string, target string")
    by_id = {r.page_id: r.verdict for r in urls.judged(pages, rules, redirects).collect()}
    assert by_id[12] == "block" and by_id[4] == "allow"  # 4 still reaches an allowed address
    assert urls.judged(pages.limit(0), rules).collect() == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judged(pages, none).collect()} == {"allow"}


# ---- token files


def test_payloads_round_trip():
    rng = np.random.default_rng(1)
    cases = [[], [5], [0, 2**32 - 1], [7] * 1000, rng.integers(0, 50_000, 5000), rng.integers(0, 2**32, 700)]
    skewed = rng.integers(0, 30, 3000)
    skewed[::40] = 2**31
    for values in [*cases, skewed]:
        values = np.array(values, np.uint32)
        for percentile in (0.0, 0.5, 0.9, 1.0):
            payload = tokens.pack(values, percentile)
            assert (tokens.unpack(payload) == values).all()
            for a, b in ((0, 1), (255, 257), (100, 2900), (max(len(values) - 1, 0), len(values) + 9)):
                assert (tokens.unpack(payload, a, b) == values[a:b]).all()
    assert len(tokens.pack(skewed.astype(np.uint32))) < 4 * len(skewed) / 3
    with pytest.raises(ValueError):
        tokens.unpack(b"nothing")


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    bits = ["The", "the.", "a,b", "x_.", "...", "!. ", "İstanbul", "ΑΣ", "é", "é", "<|endoftext|>", "<|ENDOFTEXT|>",
            "don't", "12.", "\n", "\t", " ", "\x1c", "ok, ", "A. B", "日本"]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), "s") for k in range(300, 0, -1)]
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "first", "s"), (5, "again", "s"), (1002, "word " * 60_000, "s")]
    path = str(tmp_path / "tokens")
    tokens.write_tokens(frame(spark, rows).repartition(6), path, tokens.word_tokenizer())
    got = sorted(tokens.read_documents(spark, path).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(tokens.word_tokenizer())
    at = 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes())), t
        at += len(ids)
    chunks = tokens.read_ids(spark, path).collect()
    assert sum(len(c.ids) for c in chunks) == at
    assert all(sum(c.lengths) == len(c.ids) and len(c.doc_ids) == len(c.lengths) for c in chunks)
    none = str(tmp_path / "none")
    tokens.write_tokens(frame(spark, rows).limit(0), none, tokens.word_tokenizer())
    assert tokens.read_documents(spark, none).collect() == []


# ---- mixing


def wanted(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by dealing and dealing again what is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        deal = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if deal[s] > most * sizes[s]]
        if not above:
            return full | deal
        for s in above:
            full[s] = most * sizes[s]
            left -= full[s]


def test_mixing(spark):
    rng = random.Random(8)
    names = ["b", "a", "é", "Z", None, "hot", "none", "c1", "c2"]
    rows = []
    for k in range(4000):
        s = "hot" if k % 3 == 0 else rng.choice(names[:5] + names[7:])
        rows.append((k, " ".join(["w"] * rng.choice([1, 3, 20, 90, 400])), s))
    rows += [(9000, None, "none"), (9001, "", "none"), (None, "a b", "a"), (3, rows[3][1], rows[3][2])]
    docs = frame(spark, rows)
    got = mixing.mixed(docs, group=64).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    target = wanted(size)
    taken = {s: 0 for s in size}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        share = r.target / r.source_size if r.source_size else 0
        assert abs(r.copies - share) < 1
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 800
    again = mixing.mixed(docs.repartition(11), group=64).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, again)) == sorted(map(key, got))
    mix = mixing.mix(docs, group=64)
    assert mix.columns == docs.columns
    counts = {}
    for r in mix.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    decided = {}
    for r in got:
        decided[r.doc_id] = decided.get(r.doc_id, 0) + r.copies
    assert counts == {k: v for k, v in decided.items() if v}
    assert mixing.mixed(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []


def test_rounding_keeps_expected_copies(spark):
    rows = [(k, "w w w", "abc"[k % 3]) for k in range(60)]
    total = {k: 0 for k in range(60)}
    for seed in range(12):
        for r in mixing.mixed(frame(spark, rows), group=8, seed=seed).collect():
            total[r.doc_id] += r.copies
    for s in range(3):
        own = [total[k] / 12 for k in range(60) if k % 3 == s]
        want = wanted({x: 60 for x in "abc"})["abc"[s]] / 60
        assert abs(np.mean(own) - want) < 0.06
    assert pa.array(list(total.values())).null_count == 0


def test_token_words_met_often_are_kept(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MOST_WORDS", 40)
    rng = random.Random(1)
    encoder, plain = tokens._Encoder(tokens.word_tokenizer()), Tokenizer.from_file(tokens.word_tokenizer())
    for _ in range(30):
        texts = [" ".join(rng.choice(["often", "Seen"]) if rng.random() < 0.7 else f"rare{rng.random()}" for _ in range(20))]
        ids, each = encoder.ids(texts)
        assert ids.tolist() == plain.encode(texts[0], add_special_tokens=False).ids and each.tolist() == [len(ids)]
    assert {"often", "seen"} <= set(encoder.known) and len(encoder.known) < 80


def test_long_words_train_by_their_windows():
    long = "xk" * 30 + "jerkface" + "qz" * 40
    texts = [f"you {long} there {k}" for k in range(30)] + [f"a plain text about {k} hills and rivers" for k in range(60)]
    found = toxicity.fit(texts, [1] * 30 + [0] * 60, landmarks=64)
    tops = found.words([b"jerkface", long.encode(), b"rivers"])
    assert tops[1] > tops[2]


def test_words_alike_are_looked_at_once(monkeypatch):
    marked = [pii_labels.marked_spans(m) for m in pii_labels.MARKED]
    model = pii.ChainField().fit([pii.labelled_words(text, spans) for text, spans in marked])
    words = [w for text, _ in marked for w in text.split()]
    words += ["É9aB", "٣4x", "²", "x" * 70 + "9", "a" * 64 + "(", "A1" * 40, "+49(0)", "ǅa", "(at)", "...", "a@b.c"]
    kinds = pii._Kinds(model)
    for w in words:
        own = tuple(model.known[f] for f in pii._features([w])[0][: pii._OWN] if f in model.known)
        assert kinds[w] == kinds._numbered(own, pii.shape(w)), w
    seen, features = [], pii._features
    monkeypatch.setattr(pii, "_features", lambda some: seen.append(some) or features(some))
    for k in range(1000, 2000):
        assert kinds[f"Ab{k}c@d.e"] == kinds["Ab1000c@d.e"]
    assert len(seen) <= 1
