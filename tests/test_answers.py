"""Questions from start to end: method, trace, exact value, comparison, events."""

import pytest
from pyspark.sql import functions as F

from plumbline import AggregateSpec, Comparison
from plumbline.functions import display
from plumbline.functions.order import SampleOrder
from plumbline.operators import adaptive, compare, exact, sampling
from plumbline.operators.method import choose_method
from plumbline.plans.answer import answer, timed
from plumbline.plans.progressive import progressive, progressive_trace
from plumbline.plans.run import record, run
from plumbline.sources import layout, runlog

ORDER = SampleOrder(("o_orderkey",))


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet("/root/testdata/sf0.01/orders.parquet")


def test_spec_checks():
    with pytest.raises(ValueError):
        AggregateSpec("median", "v")
    with pytest.raises(ValueError):
        AggregateSpec("sum")
    with pytest.raises(ValueError):
        AggregateSpec("sum", "v", distinct=True)
    with pytest.raises(ValueError):
        AggregateSpec("sum", "v", order_by="v")
    with pytest.raises(ValueError):
        AggregateSpec("sum", "v", group_by="g", order_by="other")
    with pytest.raises(ValueError):
        Comparison("v", "<>", 1)


def test_default_names():
    assert AggregateSpec("count").name == "row_count"
    assert AggregateSpec("count", "v").name == "count_v"
    assert AggregateSpec("avg", "v").name == "avg_v"
    assert AggregateSpec("sum", "v", alias="total").name == "total"


def test_filtered_count_is_exact(spark, orders):
    spec = AggregateSpec("count", where=(Comparison("o_orderstatus", "=", "F"),))
    found = answer(orders, spec, ORDER)
    truth = orders.where("o_orderstatus = 'F'").count()
    line = found.trace.collect()
    assert found.method == "adaptive_sampling" and len(line) == 1
    assert line[0]["estimate"] == truth and line[0]["relative_error"] == 0.0
    assert line[0]["sample_rows"] == line[0]["total_rows"] == truth
    assert found.comparison.first()["delta"] == 0.0


def test_unfiltered_count_uses_no_rows(orders):
    line = adaptive.adaptive_trace(orders, AggregateSpec("count"), ORDER).first()
    assert (line["sample_rows"], line["total_rows"]) == (0, 15000)
    shown = adaptive.with_progress(
        adaptive.adaptive_trace(orders, AggregateSpec("count"), ORDER), AggregateSpec("count")
    ).first()
    assert (shown["data_scanned_pct"], shown["compute_saved_pct"]) == (0.0, 100.0)


def test_tight_sum_takes_growing_steps(orders):
    spec = AggregateSpec("sum", "o_totalprice", scale=2)
    trace = adaptive.adaptive_trace(orders, spec, ORDER, 0.01).orderBy("iteration").collect()
    sizes = [r["sample_rows"] for r in trace]
    assert len(trace) >= 2 and sizes == sorted(set(sizes))
    assert [r["is_final"] for r in trace] == [False] * (len(trace) - 1) + [True]
    assert trace[-1]["stopped_reason"] == "target_reached" or sizes[-1] == 6000


def test_unreachable_target_stops_at_the_cap(orders):
    spec = AggregateSpec("sum", "o_totalprice", scale=2)
    last = adaptive.final_answer(adaptive.adaptive_trace(orders, spec, ORDER, 0.0001)).first()
    assert (last["sample_rows"], last["stopped_reason"]) == (6000, "sample_cap")


def test_constant_column_stops_at_once(spark):
    df = spark.range(10_000).selectExpr("id as k", "7.0D as v")
    trace = adaptive.adaptive_trace(df, AggregateSpec("avg", "v"), SampleOrder(("k",))).collect()
    assert len(trace) == 1 and trace[0]["sample_rows"] == 512 and trace[0]["estimate"] == 7.0


def test_column_of_nulls(spark):
    df = spark.range(3000).selectExpr("id as k", "cast(null as double) as v")
    total, mean = (
        adaptive.adaptive_trace(df, AggregateSpec(a, "v"), SampleOrder(("k",))).collect()
        for a in ("sum", "avg")
    )
    assert [(r["estimate"], r["relative_error"]) for r in total] == [(0.0, 0.0)]
    assert [r["relative_error"] for r in mean] == [1.0] * 4


def test_target_must_be_sensible(orders):
    with pytest.raises(ValueError):
        adaptive.adaptive_trace(orders, AggregateSpec("sum", "o_totalprice"), ORDER, 0.9)


def test_revenue_by_group(orders):
    spec = AggregateSpec(
        "sum",
        "o_totalprice",
        group_by="o_orderpriority",
        order_by="revenue",
        descending=True,
        alias="revenue",
        scale=2,
    )
    found = answer(orders, spec, ORDER, target_error=0.1)
    assert found.method == "stratified_sampling"
    lines = found.comparison.collect()
    assert len(lines) == 5 and all(r["delta_pct"] < 0.25 for r in lines)
    assert all(r["exact_display_value"].startswith("$") for r in lines)
    ranked = [r["revenue"] for r in found.exact.collect()]
    assert ranked == sorted(ranked, reverse=True)


def test_average_is_not_money(orders):
    spec = AggregateSpec("avg", "o_totalprice", scale=2)
    shown = adaptive.with_progress(adaptive.adaptive_trace(orders, spec, ORDER), spec).first()
    assert not shown["display_value"].startswith("$") and "," in shown["display_value"]


def test_small_groups_are_answered_exactly(spark):
    df = spark.createDataFrame(
        [("north", 10), ("north", 15), ("south", 9), ("south", 21)], "region string, amount long"
    )
    spec = AggregateSpec("sum", "amount", group_by="region")
    found = answer(df, spec, SampleOrder(("region", "amount")))
    assert found.method == "exact" and "5000" in found.reason and found.trace is None
    assert {r[0]: r[1] for r in found.exact.collect()} == {"north": 25.0, "south": 30.0}


def test_seventeen_groups_are_too_many(spark):
    df = spark.range(20_000).selectExpr("id as k", "id % 17 as g", "1.0D as v")
    verdict = choose_method(df, AggregateSpec("sum", "v", group_by="g")).first()
    assert (verdict["method"], verdict["group_count"]) == ("exact", 17)
    sixteen = df.withColumn("g", F.col("k") % 16)
    verdict = choose_method(sixteen, AggregateSpec("sum", "v", group_by="g")).first()
    assert verdict["method"] == "stratified_sampling"


def test_grouped_counts_are_exact(orders):
    found = answer(orders, AggregateSpec("count", group_by="o_orderstatus"), ORDER)
    assert found.method == "exact" and found.exact.count() == 3


def test_distinct_customers(orders):
    spec = AggregateSpec("count", "o_custkey", distinct=True)
    found = answer(orders, spec, ORDER)
    assert found.method == "hyperloglog"
    assert found.comparison.first()["delta_pct"] < 0.1


def test_progress_of_an_empty_answer(orders):
    spec = AggregateSpec("sum", "o_totalprice", (Comparison("o_totalprice", "<", 0.0),))
    line = adaptive.with_progress(adaptive.adaptive_trace(orders, spec, ORDER), spec).first()
    assert (line["sample_fraction"], line["data_scanned_pct"], line["status"]) == (
        0.0,
        0.0,
        "target_met",
    )


def test_display(spark):
    money = AggregateSpec("sum", "amount")
    whole = AggregateSpec("sum", "units")
    count = AggregateSpec("count")
    row = spark.range(1).select(
        display.display(display.rounded(F.lit(1234.5), money, True), money, True).alias("money"),
        display.display(display.rounded(F.lit(1234.5), whole, True), whole, True).alias("whole"),
        display.display(display.rounded(F.lit(1234.567), whole), whole).alias("part"),
        display.display(display.rounded(F.lit(1235.5), count), count).alias("count"),
        display.group_label(F.lit(None)).alias("none"),
        display.group_label(F.to_date(F.lit("2025-01-02"))).alias("day"),
        compare.speedup(F.lit(100), F.lit(40)).alias("faster"),
        compare.speedup(F.lit(100), F.lit(0)).alias("unknown"),
    )
    assert tuple(row.first()) == (
        "$1,234.50", "1,234", "1,234.57", "1,236", "NULL", "2025-01-02", 2.5, 0.0,
    )


def test_group_missing_from_the_sample_compares_as_zero(spark):
    spec = AggregateSpec("sum", "v", group_by="g", alias="v_total")
    approx = spark.createDataFrame([("a", 9.0), ("z", 5.0)], "group_value string, estimate double")
    truth = spark.createDataFrame(
        [("a", 10.0), ("b", 4.0), (None, None)], "g string, v_total double"
    )
    lines = {r["group_value"]: r for r in compare.compare_grouped(approx, truth, spec).collect()}
    assert set(lines) == {"a", "b", "NULL"}
    assert (lines["a"]["delta_pct"], lines["b"]["delta_pct"]) == (0.1, 1.0)
    assert (lines["NULL"]["exact_value"], lines["NULL"]["delta_pct"]) == (0.0, 0.0)
    rolled = compare.delta_roll_up(approx, truth, spec).first()
    assert (rolled["group_count"], rolled["max_delta_pct"]) == (3, 1.0)


def test_layout_reads_only_what_it_needs(spark, orders, tmp_path):
    path = str(tmp_path / "layout")
    layout.write_sample_layout(orders, path, ORDER.for_rows(15000))
    opened = layout.open_sample_layout(spark, path)
    stored = opened.frame
    assert stored.count() == opened.rows == 15000
    assert stored.drop(layout.STEP).exceptAll(orders).count() == 0
    spec = AggregateSpec("avg", "o_totalprice", scale=2)
    last = list(progressive(opened, spec, 0.05))[-1]
    assert last.target_met and last.bytes_read < last.bytes_total / 4
    plan = layout.up_to(stored, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sample_step" in plan
    # the same steps and estimates as the trace that scans the whole table
    trace = adaptive.adaptive_trace(orders, spec, ORDER, 0.01).orderBy("iteration").collect()
    steps = progressive_trace(opened, spec, 0.01).orderBy("iteration").collect()
    assert [r["sample_rows"] for r in steps] == [r["sample_rows"] for r in trace]
    assert [r["estimate"] for r in steps] == pytest.approx([r["estimate"] for r in trace])


def test_runs_report_what_they_open(spark, orders, tmp_path):
    path = str(tmp_path / "layout")
    layout.write_sample_layout(orders, path, ORDER.for_rows(15000))
    bare = layout.open_sample_layout(spark, path)
    layout.write_statistics(spark, path, ("o_orderpriority", "o_custkey", "o_orderstatus"))
    counted = layout.open_sample_layout(spark, path)
    assert counted.counted == {"o_orderpriority", "o_orderstatus"}  # customers are more than a thousand
    assert counted.frame.columns == bare.frame.columns
    plain = AggregateSpec("sum", "o_totalprice", scale=2)
    filtered = AggregateSpec("sum", "o_totalprice", (Comparison("o_orderstatus", "=", "F"),), scale=2)
    grouped = AggregateSpec("sum", "o_totalprice", group_by="o_orderpriority", scale=2)
    first = {s: next(progressive(bare, s, 0.5)) for s in (plain, filtered, grouped)}
    few = {s: next(progressive(counted, s, 0.5)) for s in (plain, filtered, grouped)}
    whole = sum(s["bytes"] for s in bare.steps.values())
    files = sum(s["files"] for s in bare.steps.values())
    assert first[filtered].bytes_read == first[grouped].bytes_read == whole + first[plain].bytes_read
    assert first[filtered].files_read == files + first[plain].files_read
    for spec in first:
        assert (few[spec].files_read, few[spec].bytes_read) == (first[plain].files_read, first[plain].bytes_read)
        assert few[spec].estimates == first[spec].estimates
        assert few[spec].bytes_read < 0.5 * whole and few[spec].elapsed_ms > 0


def test_runs_of_every_method(spark, orders, tmp_path):
    path = str(tmp_path / "layout")
    layout.write_sample_layout(orders, path, ORDER.for_rows(15000))
    stored = layout.open_sample_layout(spark, path)
    specs = {
        "adaptive_sampling": AggregateSpec("avg", "o_totalprice", scale=2),
        "stratified_sampling": AggregateSpec("sum", "o_totalprice", group_by="o_orderpriority", scale=2),
        "hyperloglog": AggregateSpec("count", "o_custkey", distinct=True),
        "exact": AggregateSpec("count", group_by="o_orderpriority"),
    }
    for method, spec in specs.items():
        done = run(stored, spec, 0.05)
        assert done.method == method
        record(done, str(tmp_path / "runs"), f"a/{method}", "what?", "orders", "Orders")
        if method == "exact":
            assert done.trace is None and done.exact.count() == 5
            continue
        lines = done.comparison.collect()
        assert all(r["speedup"] == round(done.exact_ms / done.approx_ms, 2) for r in lines)
        assert all(r["delta_pct"] < 0.2 for r in lines) and done.exact_ms > 0
    told = runlog.read_events(spark, str(tmp_path / "runs" / "events")).groupBy("session_id", "type").count().collect()
    kinds = {(r["session_id"], r["type"]): r["count"] for r in told}
    assert kinds[("a/exact", "exact_result")] == 1 and ("a/exact", "approx_final") not in kinds
    assert kinds[("a/adaptive_sampling", "approx_final")] == 1
    assert runlog.read_history(spark, str(tmp_path / "runs" / "history")).count() == 4


def test_layout_refuses_many_groups(spark, orders, tmp_path):
    path = str(tmp_path / "layout")
    layout.write_sample_layout(orders, path, ORDER)
    spec = AggregateSpec("sum", "o_totalprice", group_by="o_custkey")
    with pytest.raises(ValueError, match="groups"):
        next(progressive(layout.open_sample_layout(spark, path), spec))


def test_one_step_run_has_no_progress_event(spark, orders, tmp_path):
    spec = AggregateSpec("count", where=(Comparison("o_orderstatus", "=", "F"),))
    trace = adaptive.adaptive_trace(orders, spec, ORDER)
    compared = compare.compare_scalar(trace, exact.exact(orders, spec), spec)
    question = spark.createDataFrame([("how many?",)], "prompt string")
    verdict = choose_method(orders, spec)
    events = runlog.event_log(
        "s", question, verdict, adaptive.with_progress(trace, spec), compared
    )
    path = str(tmp_path / "events")
    runlog.write_events(events, path, "s")
    stored = runlog.read_events(spark, path).orderBy("sequence").collect()
    assert [r["type"] for r in stored] == [
        "sql_generated", "plan_ready", "approx_final", "exact_result",
    ]
    assert [r["sequence"] for r in stored] == [1, 2, 3, 4]


def test_history_is_newest_first_and_searchable(spark, tmp_path):
    path = str(tmp_path / "history")
    runlog.append_run(spark, path, "a", "Total revenue", "orders_v1", "Orders", True, 0.1, 0.9)
    runlog.append_run(spark, path, "b", "Delay by carrier", "shipments_v1", "Shipments")
    history = runlog.read_history(spark, path)
    listed = runlog.newest_first(history).collect()
    assert [r["session_id"] for r in listed] == ["b", "a"]
    assert (listed[1]["live_mode"], listed[1]["error_tolerance"]) == (True, 0.1)
    fields = ("prompt", "dataset_label", "dataset_id")
    assert [r[0] for r in runlog.search(history, " REVENUE ", *fields).collect()] == ["a"]
    assert [r[0] for r in runlog.search(history, "ment", *fields).collect()] == ["b"]
    assert runlog.search(history, " ", *fields).count() == 2


def test_replay_and_milestones(spark):
    trace = spark.createDataFrame(
        [
            (1, 0.2, False, "warming_up"),
            (2, 0.08, False, "converging"),
            (3, 0.04, True, "target_met"),
        ],
        "iteration int, relative_error double, is_final boolean, status string",
    )
    again = {
        (r["tolerance"], r["iteration"]): r["status"]
        for r in compare.replay(trace, [0.1, 0.01]).collect()
    }
    assert [again[(0.1, i)] for i in (1, 2, 3)] == ["warming_up", "target_met", "target_met"]
    assert [again[(0.01, i)] for i in (1, 2, 3)] == ["warming_up", "converging", "converging"]
    met = compare.milestones(trace, [0.1, 0.01, 0.1]).orderBy("threshold").collect()
    assert [tuple(r) for r in met] == [(0.01, None), (0.1, 2)]


def test_first_points_keep_the_earliest(spark):
    points = spark.createDataFrame(
        [(1, 2, 0.3), (1, 1, 0.5), (2, 3, 0.1)], "iteration int, sequence int, relative_error double"
    )
    kept = compare.first_points(points).orderBy("iteration").collect()
    assert [(r["sequence"], r["relative_error"]) for r in kept] == [(1, 50.0), (3, 10.0)]


def test_timed(orders):
    assert timed(orders.select("o_orderkey")) > 0


def test_plans_push_filters_and_prune_columns(orders):
    spec = AggregateSpec("sum", "o_totalprice", (Comparison("o_orderstatus", "=", "F"),))
    plan = exact.exact(orders, spec)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan
    sampled = adaptive.adaptive_trace(orders, spec, ORDER)
    sampled.collect()
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # one scan counts the buckets, one folds the rows; they are joined with nothing
    assert final.count("FileScan") == 1 and "ReusedSubquery" in plan and "o_orderpriority" not in plan
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_counts_come_from_footers(spark, sf):
    rows = adaptive.footer_rows(spark, f"{sf}/orders.parquet")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: []" in plan
    assert adaptive.count_trace_of(rows).first()["total_rows"] == spark.read.parquet(f"{sf}/orders.parquet").count()
    # other queries are planned as before
    assert "FileScan" in spark.read.parquet(f"{sf}/orders.parquet")._jdf.queryExecution().executedPlan().toString()


def test_a_quota_per_stratum_keeps_few_rows_before_the_shuffle(orders):
    drawn = sampling.draw_per_stratum(orders, ORDER, "o_orderpriority", 20)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "row_number(), 20, Partial" in plan and "row_number(), 20, Final" in plan


def test_layout_shuffles_sampled_rows_only(spark, orders, tmp_path):
    within, past, cut = sampling.placed_rows(orders, ORDER.for_rows(15000), past_cap=True)
    assert within.count() + cut.count() < 0.6 * 15000 < past.count() + cut.count()
    assert "Exchange" not in past._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    layout.write_sample_layout(orders, str(tmp_path / "l"), ORDER.for_rows(15000))
    steps = layout.open_sample_layout(spark, str(tmp_path / "l"))
    assert [steps.steps[k]["rows"] for k in steps.sampled] == [512, 512, 768, 1344, 2352, 512]
