"""Files in, typed tables out."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import AggregateSpec
from plumbline.functions.cells import cell_text
from plumbline.functions.names import column_names, slug
from plumbline.operators.exact import exact
from plumbline.operators.method import choose_method
from plumbline.operators.profile import column_profile, column_types, declared_type, text_cells, typed
from plumbline.operators.sketch import distinct_trace, grouped_distinct_trace
from plumbline.plans.ingest import import_file
from plumbline.plans.progressive import progressive
from plumbline.sources import delimited, layout, records, sqlite, xml
from plumbline.sources.files import read_file
from plumbline.sources.rows import register


def kinds(dataset):
    return {r["column"]: r["type"] for r in dataset.profile().collect()}


def test_names():
    assert slug("Order Total (USD)") == "order_total_usd"
    assert slug("2nd place") == "dataset_2nd_place"
    assert slug("***") == "dataset"
    assert column_names(["a", "A", "a_2", "", None, "1x"]) == [
        "a", "a_2", "a_2_2", "column_4", "column_5", "dataset_1x",
    ]


def test_csv(spark, file_in):
    path = file_in("sales.csv", "hull length,paint\n7.25,red\n3.5,red\n9.0,teal\n6.25,white\n")
    boats = delimited.read_csv(spark, path, "Boats 1987")
    assert boats.name == "boats_1987"
    assert kinds(boats) == {"hull_length": "DOUBLE", "paint": "TEXT"}
    assert exact(boats.typed(), AggregateSpec("sum", "hull_length")).first()[0] == 26.0
    register({boats.name: boats.typed()})
    assert spark.sql("select count(*) from boats_1987").first()[0] == 4


def test_csv_rows_are_padded_cut_and_dropped(spark, file_in):
    text = 'a,b,c\n1\n\n , ,\n1,2,3,4\n"x\ny","say ""hi""",\n'
    path = file_in("rows.csv", text)
    assert delimited.has_cells_over_lines(spark, path)
    rows = {tuple(r) for r in delimited.read_csv(spark, path).text.collect()}
    assert rows == {("1", None, None), ("1", "2", "3"), ("x\ny", 'say "hi"', None)}


def test_csv_without_odd_quotes_stays_splittable(spark, file_in):
    path = file_in("quotes.csv", 'a,b\n"1,5","x ""y"""\n')
    assert not delimited.has_cells_over_lines(spark, path)
    assert delimited.read_csv(spark, path).text.first()[0] == "1,5"


@pytest.mark.parametrize("text", ["", " , \n1,2\n"])
def test_csv_needs_a_header(spark, file_in, text):
    with pytest.raises(ValueError):
        delimited.read_csv(spark, file_in("bad.csv", text))


def test_csv_distinct_routes_to_the_sketch(spark, file_in):
    text = "buoy,sea\n31,calm\n57,calm\n31,calm\n31,rough\n88,rough\n90,rough\n57,fog\n"
    buoys = delimited.read_csv(spark, file_in("c.csv", text)).typed()
    spec = AggregateSpec("count", "buoy", distinct=True)
    assert choose_method(buoys, spec).first()["method"] == "hyperloglog"
    assert round(distinct_trace(buoys, spec).first()["estimate"]) == 4
    grouped = AggregateSpec("count", "buoy", distinct=True, group_by="sea")
    lines = grouped_distinct_trace(buoys, grouped).collect()
    assert {r["group_value"]: round(r["estimate"]) for r in lines} == {"calm": 2, "rough": 3, "fog": 1}


def test_tsv(spark, file_in):
    cities = delimited.read_tsv(spark, file_in("cities.tsv", "quay\tcount\nTurku\t12\nOslo\t7\nBergen\t40\n"))
    assert kinds(cities) == {"quay": "TEXT", "count": "INTEGER"}
    assert cities.typed().schema["count"].dataType == T.LongType()


TYPES = {
    "BOOLEAN": [["true", "No", " yes "], ["FALSE"]],
    "INTEGER": [["1", "+2", "-03"], ["20250101", "20251231"], ["99999999999999999999"]],
    "DOUBLE": [["1", "2.5"], ["1e5", ".5", "5."], ["nan", "inf"], ["1_000", "2"], ["1", "-Infinity"]],
    "DATE": [["2025-01-31"], ["2025-01-31", "20250201"], ["2025-W01-1"], ["2024W521", "2025-12-01"]],
    "TEXT": [
        ["yes", "1"], ["1d"], ["2025-02-30"], ["2025-01-01T00:00:00"], ["2025-W54-1"], ["1__0"],
        ["2025-1-1"], [" ", ""], ["0x1F"], ["1,5"],
    ],
}


def test_types_by_full_scan(spark):
    columns, wanted = [], {}
    for kind, cases in TYPES.items():
        for i, case in enumerate(cases):
            wanted[f"{kind.lower()}{i}"] = kind
            columns.append(case)
    longest = max(map(len, columns))
    rows = [tuple(c[i] if i < len(c) else None for c in columns) for i in range(longest)]
    schema = ", ".join(f"{name} string" for name in wanted)
    profile = column_profile(spark.createDataFrame(rows, schema))
    assert {r["column"]: r["type"] for r in profile.collect()} == wanted


def test_long_numbers_keep_their_digits(spark, file_in):
    path = file_in("long.csv", "n\n99999999999999999999\n1\n")
    rows = delimited.read_csv(spark, path).typed().collect()
    assert {int(r["n"]) for r in rows} == {99999999999999999999, 1}


def test_values_of_every_type(spark, file_in):
    path = file_in("v.csv", "b,i,d,t,s\nYES,+7,1_0.5,2025-W01-1, x \nno,,,20250102,\n")
    rows = delimited.read_csv(spark, path).typed().orderBy("b").collect()
    assert [str(v) for v in rows[1]] == ["True", "7", "10.5", "2024-12-30", " x "]
    assert [str(v) for v in rows[0]] == ["False", "None", "None", "2025-01-02", "None"]


def test_declared_types():
    declarations = {
        "BOOLEAN": "BOOLEAN", "BIGINT": "INTEGER", "varchar(10)": "TEXT", "NUMERIC(3,1)": "DOUBLE",
        "REAL": "DOUBLE", "DATETIME": "DATE", "": "TEXT", None: "TEXT",
    }
    assert {d: declared_type(d) for d in declarations} == declarations


def test_examples_are_the_two_smallest(spark):
    df = spark.createDataFrame([(" b ",), ("a",), ("c",), ("a",), ("",)], "v string")
    line = column_profile(df).first()
    assert (line["examples"], line["filled_rows"], line["row_count"]) == (["a", "b"], 4, 5)


def test_listing_of_capabilities(spark, file_in):
    mixed = delimited.read_csv(spark, file_in("m.csv", "n,s\n1,a\n"), "mixed").listing().first()
    assert mixed["capabilities"] == ["count", "count_distinct", "sum", "avg", "group_by"]
    texts = delimited.read_csv(spark, file_in("t.csv", "s\na\n")).listing().first()
    assert texts["capabilities"] == ["count", "count_distinct"]
    numbers = delimited.read_csv(spark, file_in("n.csv", "n\n1\n")).listing().first()
    assert numbers["capabilities"] == ["count", "count_distinct", "sum", "avg"]


def test_json_list(spark, file_in):
    path = file_in("s.json", '[{"quay":"Oslo","depth":4.25},{"quay":"Turku","depth":11.0}]')
    sales = records.read_json(spark, path)
    assert kinds(sales) == {"quay": "TEXT", "depth": "DOUBLE"}
    assert {tuple(r) for r in sales.typed().collect()} == {("Oslo", 4.25), ("Turku", 11.0)}


def test_json_shapes(spark, file_in):
    def cells(text):
        found = records.read_json(spark, file_in("x.json", text))
        return found.text.columns, [tuple(r) for r in found.text.collect()]

    assert cells('{"a":"[","z":[{"k":1},{"m":true}],"b":[5]}') == (
        ["k", "m"],
        [("1", None), (None, "true")],
    )
    assert cells('{"b":{"z":1,"a":[1,null]},"a":12.0}') == (
        ["b", "a"],
        [('{"a":[1,null],"z":1}', "12")],
    )
    assert cells("5") == (["value"], [("5",)])
    assert cells('[1,"x",{"value":2}]') == (["value"], [("1",), ("x",), ("2",)])
    assert cells('[{"Z z":1},{"a":"","Z z":2}]') == (["z_z", "a"], [("1", None), ("2", "")])
    with pytest.raises(ValueError):
        records.read_json(spark, file_in("x.json", "[]"))


def test_json_keys_that_repeat(spark, file_in):
    lines = records.read_json_lines(spark, file_in("k.json", '{"a":1,"b":2,"a":3}\n{"b":5,"a":4}\n')).text
    assert sorted(map(tuple, lines.collect())) == [("3", "2"), ("4", "5")] and lines.columns == ["a", "b"]
    listed = records.read_json(spark, file_in("d.json", '[{"a":1,"b":{"x":1,"x":2},"a":[7]},{"a":null,"a":"z"}]')).text
    assert [tuple(r) for r in listed.collect()] == [("[7]", '{"x":2}'), ("z", None)]


def test_json_lines_are_records(spark, file_in):
    path = file_in("l.json", '{"b":1,"list":[1,2]}\n\n{"a":null,"b":2}\n')
    lines = records.read_json_lines(spark, path)
    assert lines.text.columns == ["b", "list", "a"]
    assert {r["b"] for r in lines.typed().collect()} == {1, 2}


def test_csv_files_with_other_headers_are_an_error(spark, tmp_path):
    for name, text in (("a.csv", "a,b\n1,x\n"), ("b.csv", "b,a\ny,2\n")):
        (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match="header"):
        delimited.read_csv(spark, str(tmp_path)).text.collect()


def test_csv_of_two_bytes_a_sign(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_bytes("a,b\n1,ä\n2,ß\n".encode("utf-16"))
    got = delimited.read_csv(spark, str(path), encoding="UTF-16").text.collect()
    assert [tuple(r) for r in got] == [("1", "ä"), ("2", "ß")]


def test_xml_files_may_name_their_records_differently(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><row><k>1</k></row><row><k>2</k></row></r>")
    (tmp_path / "b.xml").write_text("<r><item><k>3</k></item><item><k>4</k></item></r>")
    got = xml.read_xml(spark, str(tmp_path)).text.collect()
    assert sorted(r["k"] for r in got) == ["1", "2", "3", "4"]


def test_xml(spark, file_in):
    text = (
        "<ships><ship><flag>blue</flag><tons>31.0</tons></ship>"
        "<ship><flag>white</flag><tons>8.75</tons></ship></ships>"
    )
    path = file_in("r.xml", text)
    rows = xml.read_xml(spark, path)
    assert xml.record_tags(spark, path) == ["ship"]
    assert kinds(rows) == {"flag": "TEXT", "tons": "DOUBLE"}
    assert xml.read_xml(spark, path, tags=["ship"]).text.count() == 2


def test_xml_shapes(spark, file_in):
    def cells(text):
        found = xml.read_xml(spark, file_in("x.xml", text)).text
        return {tuple((c, v) for c, v in sorted(r.asDict().items()) if v) for r in found.collect()}

    nested = (
        "<doc><meta><v>1</v></meta><list><item id='1'><tag>a</tag><tag>b</tag></item>"
        "<item id='2'><name lang='en'>N</name></item></list></doc>"
    )
    assert cells(nested) == {
        (("attr_id", "1"), ("tag", '["a","b"]')),
        (("attr_id", "2"), ("name", '{"attr_lang":"en","value":"N"}')),
    }
    assert cells("<one a='1'><x> 5 </x><y/></one>") == {(("attr_a", "1"), ("x", "5"))}
    assert cells("<l><v>1</v><v>2</v><w k='3'>z</w></l>") == {
        (("value", "1"),),
        (("value", "2"),),
        (("attr_k", "3"), ("value", "z")),
    }


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "shop.db")
    connection = sqlite3.connect(path)
    connection.executescript(
        """
        CREATE TABLE orders (amount REAL, status TEXT);
        INSERT INTO orders VALUES (10.5, 'paid'), (4, 'open'), (NULL, 'lost');
        CREATE TABLE customers (customer_id INTEGER, active BOOLEAN, photo BLOB, seen TIMESTAMP);
        INSERT INTO customers VALUES (1, 1, x'0102', NULL), (2, 0, NULL, NULL);
        CREATE TABLE codes (code TEXT PRIMARY KEY, n INT) WITHOUT ROWID;
        INSERT INTO codes VALUES ('a', 1);
        CREATE TABLE empty (a INT, b DATE);
        """
    )
    connection.close()
    found = {d.name: d for d in sqlite.read_sqlite(spark, path, "shop", rows_per_range=1)}
    assert list(found) == ["shop_codes", "shop_customers", "shop_empty", "shop_orders"]
    assert kinds(found["shop_orders"]) == {"amount": "DOUBLE", "status": "TEXT"}
    assert kinds(found["shop_customers"]) == {
        "customer_id": "INTEGER", "active": "INTEGER", "photo": "TEXT", "seen": "DATE",
    }
    assert kinds(found["shop_empty"]) == {"a": "INTEGER", "b": "DATE"}
    assert found["shop_orders"].text.rdd.getNumPartitions() == 3
    assert exact(found["shop_orders"].typed(), AggregateSpec("sum", "amount")).first()[0] == 14.5
    assert found["shop_customers"].typed().where("customer_id = 1").first()["photo"] == "0102"
    with pytest.raises(ValueError):
        sqlite.read_sqlite(spark, str(tmp_path / "none.db"))


def test_cells_of_typed_columns(spark):
    df = spark.sql(
        "select true as a, 12.0D as b, 12.5D as c, date'2025-01-02' as d, "
        "timestamp_ntz'2025-01-02 03:04:05.000006' as e, x'0aff' as f, "
        "named_struct('z', 1, 'a', array('x')) as g, cast(null as string) as h, "
        "cast(1.50 as decimal(5,2)) as i"
    )
    assert tuple(text_cells(df).first()) == (
        "true", "12", "12.5", "2025-01-02", "2025-01-02T03:04:05.000006", "0aff",
        '{"a":["x"],"z":1}', None, "1.50",
    )
    assert df.select(cell_text(F.col("e"), T.TimestampNTZType())).first()[0].endswith(".000006")


def test_doubles_in_full(spark):
    numbers = [0.0, -0.0, 12.0, -1.0, 0.05, 0.00012345678901234567, 0.0009, 9.5e-05, 12345678.5, 1e7, 123456789012345.6, 1e15,
               9007199254740993.0, 1e16, 1.5e300, -2.5e-10, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r["x"] for r in text_cells(df, fractions=True).collect()] == [repr(x) for x in numbers]
    assert text_cells(df.where("x = 12345678.5")).first()["x"] == "12345678.5"
    whole = text_cells(spark.createDataFrame([(0.0, 1.0, 1e15), (-0.0, 2.5, 1.0), (7.0, 3.0, 2.0)], "a double, b double, c double"), fractions=True)
    lines = {r["column"]: r for r in column_profile(whole).collect()}
    assert {name: line["type"] for name, line in lines.items()} == {"a": "INTEGER", "b": "DOUBLE", "c": "DOUBLE"}
    assert lines["a"]["examples"] == ["-0.0", "0.0"]
    assert sorted(r["a"] for r in typed(whole, column_types(column_profile(whole))).collect()) == [0, 0, 7]


def test_conditions_on_cells_do_not_parse_again(spark, file_in):
    path = file_in("k.jsonl", '{"key":1,"status":"a","status":"F"}\n{"key":null,"status":" "}\n{"status":"O","key":2}\n')
    cells = records.read_json_lines(spark, path).text
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert sorted(map(tuple, cells.collect())) == [("1", "F"), ("2", "O")]


def test_import_of_repeated_rows_samples_them_apart(spark, file_in, tmp_path):
    # two kinds of rows only: a sample by content would draw one kind first
    path = file_in("Two Kinds.csv", "kind,amount\n" + "a,1\nb,3\n" * 3000)
    imported = import_file(spark, path, str(tmp_path / "out"))
    assert [d.name for d in imported] == ["two_kinds"]
    assert imported[0].listing.first()["row_count"] == 6000
    opened = layout.open_sample_layout(spark, imported[0].layout_path)
    stored = opened.frame
    assert stored.count() == 6000
    kinds_drawn = layout.up_to(stored, 1).groupBy("kind").count().collect()
    assert sum(r["count"] for r in kinds_drawn) == 512
    assert all(190 < r["count"] < 322 for r in kinds_drawn)
    last = list(progressive(opened, AggregateSpec("avg", "amount"), 0.05))[-1]
    assert last.target_met and abs(last.estimates[0]["estimate"] - 2.0) < 0.2


def test_files_by_suffix(spark, file_in):
    assert [d.name for d in read_file(spark, file_in("My Rows.TSV", "a\tb\n1\t2\n"))] == ["my_rows"]
    assert read_file(spark, file_in("r.json", "[1]"), "n")[0].text.columns == ["value"]
    with pytest.raises(ValueError, match="parquet"):
        read_file(spark, "x.parquet")
