"""Text matching against plain Python."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plumbline.operators import mentions, textmatch

FIELDS = [
    ("harbour", 0, "harbour Bergen Turku"),
    ("load_tons", 1, "load_tons cargo load 40"),
    ("state", 2, "state moored sailing"),
]
TEXTS = [
    "Load tons by harbour, please",
    "how many moored ships in Bergen",
    "nothing fits",
    "",
    "ships by state by harbour",
    "state state state bergen",
]


def words(text):
    return set(re.findall(r"[a-z0-9]+", text.lower()))


@pytest.fixture(scope="module")
def fields(spark):
    return spark.createDataFrame(FIELDS, "field string, position int, description string")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def test_best_field(texts, fields):
    found = textmatch.best_field(texts, "text", ["id"], fields).collect()
    expected = {}
    for i, text in enumerate(TEXTS):
        scores = [len(words(text) & words(d)) for _, _, d in FIELDS]
        expected[i] = (FIELDS[scores.index(max(scores))][0], max(scores))
    assert {r["id"]: (r["field"], r["score"]) for r in found} == expected


def test_best_group_field(texts, fields):
    found = textmatch.best_group_field(texts, "text", ["id"], fields).collect()
    expected = {}
    for i, text in enumerate(TEXTS):
        if " by " not in text.lower():
            continue
        after = words(text.lower().rsplit(" by ", 1)[-1])
        scores = [3 * len(after & words(d)) + len(words(text) & words(d)) for _, _, d in FIELDS]
        if max(scores) > 0:
            expected[i] = (FIELDS[scores.index(max(scores))][0], max(scores))
    assert {r["id"]: (r["field"], r["score"]) for r in found} == expected


def test_null_and_repeated_ids_keep_every_text(spark, fields):
    rows = [(1, "red car"), (None, "red boat"), (1, "blue boat"), (1, "blue boat"), (None, None)]
    texts = spark.createDataFrame(rows, "id long, text string")
    values = spark.createDataFrame(
        [("c", 0, "red"), ("c", 1, "blue"), ("t", 0, "boat"), *(("x", k, f"none{k}") for k in range(600))],
        "field string, place int, value string",
    )
    found = sorted(map(str, map(tuple, textmatch.value_mentions(texts, "text", ["id"], values).collect())))
    assert found == sorted(map(str, [
        (1, "c", "red"), (None, "c", "red"), (None, "t", "boat"),
        (1, "c", "blue"), (1, "t", "boat"), (1, "c", "blue"), (1, "t", "boat"),
    ]))
    assert [r["field"] for r in textmatch.best_field(texts, "text", ["id"], fields).collect()] == ["harbour"] * 5


def test_examples_do_not_name_a_boolean(spark):
    fields = spark.createDataFrame(
        [("is_late", 0, "BOOLEAN", "is_late false true"), ("paid", 1, "BOOLEAN", "paid false true"),
         ("late_fee", 2, "DOUBLE", "late_fee 1.5")],
        "field string, position int, type string, description string",
    )
    texts = spark.createDataFrame([(1, "is this true"), (2, "late: no"), (3, "paid"), (4, None)], "id long, text string")
    found = textmatch.boolean_mentions(texts, "text", ["id"], fields).collect()
    assert sorted(map(tuple, found)) == [(1, "is_late", True), (2, "is_late", False)]


def test_value_mentions(spark, texts):
    listed = [
        ("harbour", 0, "Turku"), ("harbour", 1, "BERGEN"), ("state", 0, "moor"),
        ("state", 1, "state"), ("short", 0, "o"), ("blank", 0, ""), ("pattern", 0, "a.b"),
    ]
    values = spark.createDataFrame(listed, "field string, place int, value string")
    found = textmatch.value_mentions(texts, "text", ["id"], values).collect()
    expected = {}
    for i, text in enumerate(TEXTS):
        for field, _, value in sorted(listed):
            if value and value.lower() in text.lower():
                expected.setdefault((i, field), value)
    assert {(r["id"], r["field"]): r["value"] for r in found} == expected


def test_intents(spark):
    cases = {
        "Average of unique users": "distinct",
        "the MEAN total": "avg",
        "summary": "sum",
        "how many": "count",
        "": "count",
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = df.select("text", textmatch.intent(df["text"]).alias("intent")).collect()
    assert {r["text"]: r["intent"] for r in got} == cases
    counts = {r["intent"]: r["texts"] for r in textmatch.intent_counts(df, "text").collect()}
    assert counts == {"distinct": 1, "avg": 1, "sum": 1, "count": 2}


def plain_mentions(texts, listed):
    out = []
    for i, text in texts:
        firsts = {}
        for field, place, value in sorted(listed):
            if value and text is not None and value.lower() in text.lower():
                firsts.setdefault(field, value)
        out += [(i, field, value) for field, value in firsts.items()]
    return sorted(map(str, out))


def test_value_mentions_of_every_length(spark, monkeypatch):
    rng = random.Random(8)
    bits = ["ab", "a", "B", "é", "É", "#", " ", "0", "世", "Straße"]
    texts = [(k if k % 7 else None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    texts += [(1, None), (2, ""), (3, "ab" * 5000)]
    pick = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
    listed = [(f"f{rng.randint(0, 4)}", rng.randint(0, 99), pick()) for _ in range(400)]
    listed += [("long", k, t[a : a + n]) for k in range(40) for _, t in [texts[k]] for a, n in [(k % 9, 16 + k)] if t[a : a + n]]
    df = spark.createDataFrame(texts, "id long, text string")
    values = spark.createDataFrame(listed, "field string, place int, value string")
    want = plain_mentions(texts, listed)
    found = textmatch.value_mentions(df, "text", ["id"], values)
    assert sorted(map(str, map(tuple, found.collect()))) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mentions, "BLOCK_BYTES", 500)
    blocks = textmatch.value_mentions(df, "text", ["id"], values).collect()
    assert sorted(map(str, map(tuple, blocks))) == want


def test_long_lists_of_values_stay_apart(spark, monkeypatch):
    """No task and not the driver holds a long list; repeated and null ids and fields keep every text."""
    rng = random.Random(3)
    texts = [(k % 3 or None, f"order {rng.randint(0, 4000)} of Customer#{k % 40:09d} äÄ{k % 7} eeee") for k in range(500)]
    texts += [(1, None), (1, ""), (2, "x" * 700_000 + "customer#000003999")]
    listed = [("name", k, f"Customer#{k:09d}") for k in range(4000)] + [(None, -k, str(k)) for k in range(4000)]
    listed += [("name", 3, "customer#000000007"), ("short", 1, "E"), ("short", 0, "q"), ("ä", None, "ää3"), ("ä", 0, "Ä")]
    values = spark.createDataFrame(listed, "field string, place int, value string")
    df = spark.createDataFrame(texts, "id long, text string")
    whole = textmatch.value_mentions(df, "text", ["id"], values).collect()

    def forbidden(*args):
        raise AssertionError("a list went to one place")

    monkeypatch.setattr(mentions, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(mentions, "ValueIndex", forbidden)
    for bits in (26, 8):  # marks that let nearly everything through change nothing
        monkeypatch.setattr(mentions, "_MARK_BITS", bits)
        found = textmatch.value_mentions(df.repartition(5), "text", ["id"], values).collect()
        assert len(found) > 1000 and sorted(map(str, map(tuple, found))) == sorted(map(str, map(tuple, whole)))


def test_searching_texts_takes_little_memory():
    index = mentions.ValueIndex([w.encode() for w in ["a", "or", "the", "harbour", "of", "ship"] + [f"word{k}" for k in range(3000)]])
    texts = pa.array([f"the ship of harbour {k} or word{k % 4000}, a word" * 9 for k in range(10_000)])
    tracemalloc.start()
    for _, _, data, offsets in mentions._slices(texts):
        index.matches(data, offsets, np.zeros(3006, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_values_with_a_common_beginning_meet_no_text_for_nothing():
    index = mentions.ValueIndex([f"customer#{k:09d}".encode() for k in range(2000)])
    texts = [b"the customer asked for a customer", b"customer#", b"see customer#000000077 and customer#00000007"] * 100
    offsets = np.cumsum([0, *map(len, texts)])
    pairs_of, value, looked = index.candidates(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert looked == 100
    assert set(value) == {77} and list(pairs_of) == list(range(2, 300, 3))


def test_no_values(spark, texts):
    values = spark.createDataFrame([("a", 0, ""), ("b", 0, None)], "field string, place int, value string")
    found = textmatch.value_mentions(texts, "text", ["id"], values)
    assert found.columns == ["id", "field", "value"] and found.count() == 0


def test_typed_questions(spark):
    fields = spark.createDataFrame(
        [("price", 0, "DOUBLE", "price 9.5", ["9.5"]), ("weight", 1, "INTEGER", "weight 3", ["3"]),
         ("city", 2, "TEXT", "city Lima Oslo", ["Lima", "Oslo"]), ("is_gift", 3, "BOOLEAN", "is_gift no yes", ["no", "yes"]),
         ("day", 4, "DATE", "day 2024-02-01", ["2024-02-01"])],
        "field string, position int, type string, description string, examples array<string>",
    )
    asked = {
        "Total weight by city": ("sum", "weight", "city", []),
        "average of Oslo and lima by day": ("avg", "price", "day", [("city", "Lima")]),
        "unique city": ("distinct", "city", None, []),
        "how many were a gift: true on 2024-02-01": ("count", None, None, [("is_gift", "true"), ("day", "2024-02-01")]),
        "sum without gift, 0": ("sum", "price", None, [("is_gift", "false")]),
        "is it yes": ("count", None, None, [("is_gift", "true")]),
        "rows by no": ("count", None, "is_gift", [("is_gift", "false")]),
        None: ("count", None, None, []),
    }
    df = spark.createDataFrame([(t,) for t in asked], "text string")
    got = textmatch.typed_questions(df, "text", ["text"], fields).collect()
    assert {r["text"]: (r["agg"], r["field"], r["group_field"], [tuple(f) for f in r["filters"]]) for r in got} == asked
    words = fields.where("type IN ('TEXT', 'DATE')")
    got = textmatch.typed_questions(df, "text", ["text"], words).collect()
    assert {r["text"]: r["agg"] for r in got}["Total weight by city"] == "count"
