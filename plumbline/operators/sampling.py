"""Random prefixes of a table, exactly n rows long, without sorting the table.

A row's place in the random order is its rank by hash. Nothing here ranks all rows: rows are
counted per hash range ("bucket", at most a million of them), running counts over the buckets tell
for every bucket whether it lies wholly inside one sample step, and only the few buckets that a
step boundary cuts through are ranked row by row, one bucket per task. What becomes of a bucket is
read from a list, so the rows of a table are joined with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.order import SampleOrder
from plumbline.spec import AggregateSpec

# First batch 512 rows, growth by 1.75, cap at 40 % of the rows but at least 2,048.
FIRST_BATCH = 512
GROWTH_QUARTERS = 7
MIN_CAP = 2048
CAP_FRACTION = 0.4

_LARGEST_TABLE = 1 << 60

SUM_COLUMNS = ("sample_rows", "sum_y", "sum_yy", "sum_x")
#: columns that sampling adds to the rows of a table
STEP, PRIORITY = "sample_step", "sample_priority"
BUCKET, STRATUM = "sample_bucket", "sample_stratum"


def growth_steps() -> list[int]:
    """Cumulative sample sizes before the cap is applied; about 65 for any table size."""
    steps = [FIRST_BATCH]
    while steps[-1] < _LARGEST_TABLE:
        steps.append(max(steps[-1] + FIRST_BATCH, steps[-1] * GROWTH_QUARTERS // 4))
    return steps


@dataclass(frozen=True)
class Steps:
    """Increasing sample sizes as SQL; by default the growth steps up to the cap of the table.

    ``total`` and ``rank`` are the names of columns, or expressions.
    """

    sizes: tuple[int, ...] = ()

    @property
    def _listed(self) -> str:
        return f"array({', '.join(f'{s}L' for s in self.sizes or growth_steps())})"

    @staticmethod
    def _cap(total: str) -> str:
        share = f"cast(floor(cast({total} as double) * {CAP_FRACTION}D) as bigint)"
        return f"greatest(1L, least({total}, greatest({MIN_CAP}L, {share})))"

    def before(self, rank: str, total: str) -> str:
        """Number of steps smaller than ``rank``."""
        smaller = f"size(filter({self._listed}, s -> s < {rank}))"
        if self.sizes:
            return smaller
        return f"case when {rank} > {self._cap(total)} then {self.count(total)} else {smaller} end"

    def count(self, total: str) -> str:
        if self.sizes:
            return str(len(self.sizes))
        return f"size(filter({self._listed}, s -> s < {self._cap(total)})) + 1"

    def array(self, total: str) -> str:
        if self.sizes:
            return self._listed
        return f"array_distinct(transform({self._listed}, s -> least(s, {self._cap(total)})))"


def ladder(population: DataFrame) -> DataFrame:
    """Sample steps for a one-row frame with ``population_rows``."""
    return population.selectExpr(
        "population_rows", f"posexplode({Steps().array('population_rows')}) as (pos, sample_rows)"
    ).selectExpr("pos + 1 as iteration", "sample_rows", "population_rows")


def value_columns(spec: AggregateSpec, column: str | None = None) -> list[str]:
    """y and x of the estimators: NULL counts as 0, and has no weight in a mean.

    With a scale, a value that the scale would change is an error, as are NaN and infinities.
    """
    column = f"`{column or spec.column}`"
    weight = "1L" if spec.agg == "sum" else f"if({column} is null, 0L, 1L)"
    if spec.scale is None:
        return [f"coalesce(cast({column} as double), 0D) as y", f"{weight} as x"]
    kind = f"decimal(18,{spec.scale})"
    exact = f"try_cast({column} as {kind})"
    told = f"concat('not a number of {spec.scale} decimal places: ', {column})"
    value = (
        f"case when {column} is null then cast(0 as {kind}) "
        f"when cast({exact} as double) = cast({column} as double) then {exact} "
        f"else cast(raise_error({told}) as {kind}) end"
    )
    return [f"{value} as y", f"{weight} as x"]


def first_sums() -> list[Column]:
    """Sums over sample rows. x is 0 or 1, and y is 0 where x is 0, so that the sums of x*x and
    x*y are those of x and y."""
    return _exprs(
        "count(1) as sample_rows", "sum(y) as sum_y", "sum(y * y) as sum_yy", "sum(x) as sum_x"
    )


def _merge_sums() -> list[Column]:
    return _exprs(*[f"sum({c}) as {c}" for c in SUM_COLUMNS])


def _exprs(*texts: str) -> list[Column]:
    return [F.expr(t) for t in texts]


def _bucket_table(rows: DataFrame, order: SampleOrder, steps: Steps, past_cap: bool = False) -> Column:
    """What becomes of the rows of each bucket, as a scalar subquery.

    ``codes`` has a number per bucket: the step its rows belong to, minus k for the k-th bucket
    that a step boundary cuts through, 0 for rows past the last step (or, if ``past_cap``, the number
    after it). ``cut_before`` has the rows before each cut bucket; ``last`` is the last step and
    ``total_rows`` all rows.
    ``rows`` has the column ``bucket``. The result is 2**bucket_bits whole numbers, 4 MB at most.
    """
    every = rows.sparkSession.range(0, 1 << order.bucket_bits, 1, 1)
    counted = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("sample_rows"))
        .unionByName(every.selectExpr("cast(id as int) as bucket", "0L as sample_rows"))
        .groupBy("bucket")
        .agg(F.sum("sample_rows").alias("sample_rows"))
        .selectExpr(
            "bucket",
            "sum(sample_rows) over (order by bucket) as rows_through",
            "rows_through - sample_rows as rows_before",
            "sum(sample_rows) over () as total_rows",
        )
    )
    # sizes are whole numbers, so "size <= r" is "size < r + 1"
    begun = steps.before("rows_before + 1", "total_rows")
    ended = steps.before("rows_through", "total_rows")
    placed = counted.selectExpr(
        "*", f"{begun} as begun", f"{ended} as ended", f"{steps.count('total_rows')} as last"
    )
    wanted = "true" if past_cap else "begun < last"
    coded = placed.selectExpr(
        "bucket",
        "rows_before",
        "total_rows",
        "last",
        "begun < ended as cut",
        "case when begun < ended then -cast(sum(if(begun < ended, 1, 0)) over (order by bucket) as int) "
        f"when {wanted} then begun + 1 else 0 end as code",
    )
    listed = coded.selectExpr(
        "transform(array_sort(collect_list(struct(bucket, code))), c -> c.code) as codes",
        "transform(array_sort(collect_list(if(cut, struct(bucket, rows_before), null))), c -> c.rows_before) "
        "as cut_before",
        "max(total_rows) as total_rows",
        "max(last) as last",
    )
    return listed.select(F.struct("*").alias("buckets")).scalar()


def placed_rows(
    df: DataFrame, order: SampleOrder, sizes: list[int] | None = None, past_cap: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``sample_rows`` in three parts.

    Those of buckets that lie in one step, those past the last step (if ``past_cap``), and those of
    buckets that a boundary cuts through. The first two are filters of the table; the last are ranked.
    """
    taken = {PRIORITY, BUCKET, STEP} & set(df.columns)
    if taken:
        raise ValueError(f"rename {sorted(taken)}: the sample needs these names")
    rows = df.withColumn(PRIORITY, order.priority())
    bucket = order.bucket(F.col(PRIORITY))
    steps = Steps(tuple(sorted(set(sizes or ()))))
    table = _bucket_table(rows.select(bucket.alias("bucket")), order, steps, past_cap)
    wanted = [*df.columns, PRIORITY, STEP]
    coded = rows.withColumn(STEP, table["codes"][bucket])
    within = coded.where((F.col(STEP) > 0) & (F.col(STEP) <= table["last"]))
    past = coded.where(F.col(STEP) > table["last"])
    # rows of cut buckets are ranked, each bucket by its own task
    rank, total = f"{STEP}_rank", f"{STEP}_total"
    inside = Window.partitionBy(STEP).orderBy(*order.ranking(PRIORITY))
    cut = (
        coded.where(F.col(STEP) < 0)
        .withColumn(rank, F.row_number().over(inside))
        .withColumn(rank, F.col(rank) + table["cut_before"][-F.col(STEP) - 1])
        .withColumn(total, table["total_rows"])
        .withColumn(STEP, F.expr(f"{steps.before(rank, total)} + 1"))
    )
    if not past_cap:
        cut = cut.where(f"{STEP} <= {steps.count(total)}")
    return within.select(*wanted), past.select(*wanted), cut.select(*wanted)


def sample_rows(
    df: DataFrame, order: SampleOrder, sizes: list[int] | None = None, past_cap: bool = False
) -> DataFrame:
    """Rows of the random prefix, with ``sample_step`` and ``sample_priority``.

    The step is that at which a growing sample draws the row. ``sizes`` are cumulative sample
    sizes; by default the ladder of the table. ``past_cap`` adds all other rows as one more step.
    Reads the key columns once to count buckets, then the wanted rows; only rows of buckets that
    a step boundary cuts through, at most one bucket per boundary, are shuffled.
    """
    within, past, cut = placed_rows(df, order, sizes, past_cap)
    sampled = within.unionByName(cut)
    return sampled.unionByName(past) if past_cap else sampled


def draw(df: DataFrame, order: SampleOrder, size: int) -> DataFrame:
    """A simple random sample of exactly ``size`` rows (all rows if there are fewer)."""
    return sample_rows(df, order, [size]).drop(PRIORITY, STEP)


def draw_per_stratum(df: DataFrame, order: SampleOrder, strata: str, size: int) -> DataFrame:
    """``size`` random rows of every stratum, NULL being a stratum too.

    One scan: each task keeps at most ``size`` rows of a stratum before they are shuffled, so no
    stratum is sorted whole.
    """
    rank = f"{STRATUM}_rank"
    taken = {PRIORITY, rank} & set(df.columns)
    if taken:
        raise ValueError(f"rename {sorted(taken)}: the sample needs these names")
    inside = Window.partitionBy(strata).orderBy(*order.ranking(PRIORITY))
    return (
        df.withColumn(PRIORITY, order.priority())
        .withColumn(rank, F.row_number().over(inside))
        .where(F.col(rank) <= size)
        .drop(PRIORITY, rank)
    )


def step_moments(df: DataFrame, spec: AggregateSpec, order: SampleOrder) -> DataFrame:
    """Sums of the growing sample after every ladder step, per group if the spec has one.

    Columns: ``iteration``, ``scanned_rows`` (sample size over all groups), ``total_rows``,
    ``group_value`` (grouped only), the six sums, ``population_rows`` (of the group). Every group
    has a row at every step.

    Two scans: one of the key columns to count buckets, one that folds the sample. The second
    joins nothing; it shuffles one partial sum per step, group and task, and the rows of the
    cut buckets only.
    """
    if not spec.is_approximable_total:
        raise ValueError("only sum and avg are sampled; counts are answered exactly")
    groups = ["group_value"] if spec.group_by else []
    # from here on no column has a name of the table's own
    keyed = spec.projected(df, *order.keys).select(
        *[F.col(spec.group_by).alias(g) for g in groups],
        F.col(spec.column).alias("value"),
        order.priority().alias("priority"),
    )
    bucket = order.bucket(F.col("priority")).alias("bucket")
    steps = Steps()
    table = _bucket_table(keyed.select(bucket), order, steps, past_cap=bool(groups))
    # values are worked out after the filter, which drops the rows past the cap
    rows = (
        keyed.select(*groups, "value", "priority", table["codes"][bucket].alias("code"))
        .where("code != 0")
        .selectExpr(*groups, "code", "if(code > 0, null, priority) as priority", *value_columns(spec, "value"))
    )

    # Rows of a cut bucket keep their place in the order, all others only their step. Equal rows
    # fold into one line with a count, so a repeated row makes no large group.
    cut = [f"if(code > 0, null, {c}) as cut_{c}" for c in ("y", "x")]
    folded = rows.groupBy(*groups, "code", F.col("priority").alias("cut_priority"), *_exprs(*cut)).agg(*first_sums())
    apart = ", ".join(["code", *[f"if(code > 0, {g}, null)" for g in groups]])
    along = ", ".join(["cut_priority", "cut_y", "cut_x", *groups])
    placed = folded.select("*", table["total_rows"].alias("total_rows"), table["cut_before"].alias("cut_before")).selectExpr(
        "*",
        "if(code > 0, code, null) as step",
        "if(code > 0, null, cut_before[-code - 1] + sum(sample_rows) over (partition by " + apart + " order by " + along
        + " rows between unbounded preceding and current row)) as ends",
    )
    shared = placed.selectExpr("*", f"explode({_shares(steps)}) as share")
    lines = (
        shared.selectExpr(
            *groups,
            "share.step as step",
            "total_rows",
            "share.taken as sample_rows",
            _scaled("sum_y", "cut_y * share.taken", spec),
            _scaled("sum_yy", "cut_y * cut_y * share.taken", spec),
            "coalesce(cut_x * share.taken, sum_x) as sum_x",
        )
        .groupBy(*groups, "step")
        .agg(F.max("total_rows").alias("total_rows"), *_merge_sums())
    )
    if not groups:
        # an empty table still has one step, of no rows
        nothing = df.sparkSession.range(0, 1, 1, 1).selectExpr(
            "1 as step", *[f"0L as {c}" for c in ("total_rows", *SUM_COLUMNS)]
        )
        lines = lines.unionByName(nothing)

    # every line counts towards its own step and all later ones
    at = lines.selectExpr("*", f"explode(sequence(1, {steps.count('total_rows')})) as iteration")
    sums = at.groupBy("iteration", *groups).agg(
        *_exprs(
            "max(total_rows) as total_rows",
            *[
                f"coalesce(sum(if(iteration >= step, {c}, null)), 0) as {c}"
                for c in SUM_COLUMNS
            ],
            "sum(sample_rows) as population_rows",
        )
    )
    size = f"element_at({steps.array('total_rows')}, iteration)"
    return sums.selectExpr(
        "iteration",
        f"least({size}, total_rows) as scanned_rows",
        "total_rows",
        *groups,
        *SUM_COLUMNS,
        "sum_x as sum_xx",
        "sum_y as sum_xy",
        f"{'population_rows' if groups else 'total_rows'} as population_rows",
    )


def _shares(steps: Steps) -> str:
    """Steps that take part of ``sample_rows`` equal rows, the last of them ranked ``ends``.

    Nearly always one step takes them all. Rows past the last step go to one more step after it.
    """
    first = steps.before("(ends - sample_rows + 1)", "total_rows")
    last = steps.before("ends", "total_rows")
    sizes = steps.array("total_rows")
    spans = (
        f"transform(array_append({sizes}, ends), (high, i) -> named_struct('step', i + 1, 'taken', "
        f"least(high, ends) - greatest(element_at(array_insert({sizes}, 1, 0L), i + 1), "
        "ends - sample_rows)))"
    )
    whole = "array(named_struct('step', {step}, 'taken', sample_rows))"
    return (
        f"case when step is not null then {whole.format(step='step')} "
        f"when {first} = {last} then {whole.format(step=f'{last} + 1')} "
        f"else filter({spans}, s -> s.taken > 0) end"
    )


def _scaled(name: str, cut: str, spec: AggregateSpec) -> str:
    if spec.scale is None:
        kind = "double"
    else:
        kind = f"decimal(38,{spec.scale * (2 if name == 'sum_yy' else 1)})"
    return f"coalesce(cast({cut} as {kind}), cast({name} as {kind})) as {name}"
