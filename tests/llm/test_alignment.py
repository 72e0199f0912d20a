"""Alignment of two tokenizers against a plain version over whole texts."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import alignment

DOCS = "doc_id long, text string, run long, keys binary, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, b"x", 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(alignment.byte_tokenizer())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_tokenizer())
    table = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    bytes_a = {int(k): base64.b64decode(t) for t, k in map(bytes.split, table)}

    def piece(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    def groups(text):
        data = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [[bytes_a[k] for k in ids_a], [piece(k) for k in ids_b]]
        if any(b"".join(p) != data for p in parts):
            return []
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        out, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
            out.append((ids_a[i:k], ids_b[j:m]))
            i, j = k, m
        return out

    def run(docs):
        found = [(k, groups(t) if t else []) for k, t in docs]
        links = [[(x, y) for a, b in g for x in a for y in b] for _, g in found]
        count = Counter(p for own in links for p in set(own))
        best = {}
        for (x, _), n in count.items():
            best[x] = max(best.get(x, 0), n)
        out = []
        for (k, g), own in zip(found, links):
            said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((
                k, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own),
                sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own),
                hashlib.sha256(said.encode()).hexdigest() if g else "",
            ))
        return sorted(out, key=str)

    return run


def found(spark, docs):
    got = alignment.aligned(frame(spark, docs), alignment.byte_tokenizer(), alignment.piece_tokenizer())
    return sorted(map(tuple, got.collect()), key=str)


def test_alignment_of_the_documents(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(spark, rows) == plain(rows)


def test_alignment_of_odd_texts(spark, plain):
    rng = random.Random(6)
    bits = ["a", "B", " ", "  ", "\n", "\t", " \n ", "\r\n", " ", "　", "​", "᠎", "\x1c", "\x85", "é", "é",
            "ﬁ", "世界", "🙂", "'s", "-----", "=" * 70, "12345", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "▁", " ▁", "\x00",
            "﻿", "the", " and", "Straße", " ", "ا", "…", "?!"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["▁", "a▁b", "▁▁ x", " ", "   ", "\n", " \n", "a ", "a  ", " a", "-" * 3000, "x" * 3000, "no blanks" * 500, "word " * 9000]
    rows = list(enumerate(texts)) + [(None, None), (None, ""), (None, "the same row"), (None, "the same row"), (3, "the same id")]
    got, want = found(spark, rows), plain(rows)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 800 and sum(r[1] == 0 for r in want) > 20


def test_alignment_of_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_branches_and_tree(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "BRANCH_PAIRS", 1)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    rows = [(k, f"some words of the text {k} and others, {k * k}") for k in range(300)]
    assert found(spark, rows) == plain(rows)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        own = alignment.PerfectHash.of(keys)
        assert np.array_equal(np.sort(own(keys)), np.arange(len(keys)))
        again = alignment.PerfectHash.unpacked(own.sizes, own.packed())
        assert np.array_equal(again(keys), own(keys))
    with pytest.raises(ValueError):
        shard = {"sizes": own.sizes, "bits": own.packed(), "keys": keys.astype("<u8").tobytes()}
        alignment._Shard(shard).places(np.array([5], np.uint64))


def test_words_are_cut_alike_by_either_way():
    rng = random.Random(3)
    bits = ["a", "b", " ", " ", "\n", "\t", "\x1c", "\xa0", "​", "é", ".", "\r"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert alignment.cut(text) == [w[1:] for w in alignment._UNIT.findall(" " + text)], repr(text)
        assert "".join(" " + w for w in alignment.cut(text)) == " " + text


def test_frequent_words_are_kept(monkeypatch, plain):
    monkeypatch.setattr(alignment, "MOST_UNITS", 50)
    aligner = alignment.Aligner(alignment.byte_tokenizer(), alignment.piece_tokenizer())
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join(rng.choice(["often", "seen"]) if rng.random() < 0.7 else f"rare{rng.random()}" for _ in range(40))
        units, each = aligner.words([text])
        said = ";".join(aligner.units.digests[u] for u in units)
        assert hashlib.sha256(said.encode()).hexdigest() == plain([(1, text)])[0][-1]
    assert {"often", "seen"} <= set(aligner.known) and len(aligner.known) < 120
