"""Pieces of the oracle SQL: random order, ladder, sums and estimators, written for any engine."""

from __future__ import annotations

from statistics import NormalDist

#: two-sided 95 % quantile of the normal distribution, with every digit of the double
Z_95 = f"CAST({NormalDist().inv_cdf(0.975)!r} AS DOUBLE)"


def priority(keys: tuple[str, ...]) -> str:
    return f"md5(concat_ws('|', {', '.join(keys)}))"


def ladder(population: str) -> str:
    """CTEs ``cap`` and ``ladder(it, size, c, n)`` over a one-row CTE with column n."""
    return f"""
cap AS (
  SELECT n, CAST(greatest(1, least(n, greatest(2048,
    CAST(floor(n * CAST(0.4 AS DOUBLE)) AS BIGINT)))) AS BIGINT) AS c FROM {population}),
ladder(it, size, c, n) AS (
  SELECT 1, least(c, 512), c, n FROM cap
  UNION ALL
  SELECT it + 1,
         least(c, greatest(size + 512, CAST(floor(size * CAST(1.75 AS DOUBLE)) AS BIGINT))), c, n
  FROM ladder WHERE size < c)"""


def moments(
    table: str,
    keys: tuple[str, ...],
    value: str,
    mean: bool = False,
    group: str | None = None,
    where: str = "TRUE",
    tie: str | None = None,
    scale: int = 2,
) -> str:
    """``WITH RECURSIVE`` up to CTE ``moments``: the six sums of every step (and group)."""
    ordering = ", ".join([priority(keys), *([tie] if tie else [])])
    y = f"CAST(coalesce({value}, 0) AS DECIMAL(18,{scale}))"
    x = f"CASE WHEN {value} IS NULL THEN 0 ELSE 1 END" if mean else "1"
    g = f"{group} AS g" if group else "0 AS g"
    return f"""WITH RECURSIVE base AS (
  SELECT {g}, {y} AS y, {x} AS x, row_number() OVER (ORDER BY {ordering}) AS rk
  FROM {table} WHERE {where}),
pop AS (SELECT count(*) AS n FROM base),
{ladder("pop")},
groups AS (SELECT g, count(*) AS ng FROM base GROUP BY g),
moments AS (
  SELECT l.it, least(l.size, l.n) AS scanned, l.n AS total, s.g, s.ng AS pop_rows,
         count(b.rk) AS n, coalesce(sum(b.y), 0) AS sy,
         coalesce(sum(CAST(b.y AS DECIMAL(38,{2 * scale})) * b.y), 0) AS syy,
         coalesce(sum(b.x), 0) AS sx
  FROM ladder l CROSS JOIN groups s
  LEFT JOIN base b ON b.rk <= l.size AND b.g IS NOT DISTINCT FROM s.g
  GROUP BY ALL)"""


def estimates(mean: bool) -> str:
    """CTEs after ``moments``: ``est`` with estimate, standard error and relative error."""
    if mean:
        value = "CASE WHEN x = 0 THEN 0 ELSE y / x END"
        spread = """CASE WHEN n < 2 OR x = 0 THEN NULL ELSE
          sqrt(greatest(0, (1 - n / p)
            * greatest(0, (yy - 2 * (y / x) * y + (y / x) * (y / x) * x) / (n - 1))
            / (n * (x / n) * (x / n)))) END"""
        blind = "n < 2 OR x = 0"
    else:
        value = "CASE WHEN n = 0 THEN 0 ELSE p * (y / n) END"
        spread = """CASE WHEN n < 2 THEN NULL ELSE
          p * sqrt(greatest(0, (1 - n / p)
            * greatest(0, (yy - n * (y / n) * (y / n)) / (n - 1)) / n)) END"""
        blind = "n < 2"
    return f""",
d AS (
  SELECT it, scanned, total, g, pop_rows, n AS sample_rows,
         CAST(n AS DOUBLE) AS n, CAST(pop_rows AS DOUBLE) AS p, CAST(sy AS DOUBLE) AS y,
         CAST(syy AS DOUBLE) AS yy, CAST(sx AS DOUBLE) AS x
  FROM moments),
e AS (SELECT *, CAST({value} AS DOUBLE) AS estimate, {spread} AS se FROM d),
est AS (
  SELECT *,
    CASE WHEN n = p THEN CAST(0 AS DOUBLE)
         WHEN {blind} THEN CAST(1 AS DOUBLE)
         WHEN {Z_95} * se <= 0 THEN CAST(0 AS DOUBLE)
         WHEN abs(estimate) <= 1e-9 THEN CAST(1 AS DOUBLE)
         ELSE {Z_95} * se / abs(estimate) END AS err,
    CASE WHEN n < 2 THEN NULL WHEN n = p THEN estimate
         ELSE estimate - {Z_95} * se END AS ci_low,
    CASE WHEN n < 2 THEN NULL WHEN n = p THEN estimate
         ELSE estimate + {Z_95} * se END AS ci_high
  FROM e)"""


def stopped(target: float) -> str:
    """CTEs after ``est``: ``tr``, the steps up to the first whose worst error meets the target."""
    return f""",
worst AS (SELECT it, max(err) AS overall FROM est GROUP BY it),
stop AS (
  SELECT coalesce(min(CASE WHEN overall <= {target} THEN it END), max(it)) AS last FROM worst),
tr AS (
  SELECT est.*, worst.overall, worst.overall <= {target} AS target_met,
         est.it = stop.last AS is_final,
         CASE WHEN est.it < stop.last THEN NULL WHEN worst.overall <= {target}
              THEN 'target_reached' ELSE 'sample_cap' END AS stopped_reason
  FROM est JOIN worst USING (it) CROSS JOIN stop WHERE est.it <= stop.last)"""


def scalar_trace(target: float, *args, mean: bool = False, **kwargs) -> str:
    return moments(*args, mean=mean, **kwargs) + estimates(mean) + stopped(target)


SCALAR_COLUMNS = """
SELECT it AS iteration, estimate, err AS relative_error, ci_low, ci_high, sample_rows,
       total AS total_rows, target_met, is_final, stopped_reason FROM tr"""

GROUPED_COLUMNS = """
SELECT it AS iteration, g AS group_value, estimate, err AS relative_error, ci_low, ci_high,
       sample_rows, pop_rows AS population_rows, scanned AS scanned_rows, total AS total_rows,
       overall AS overall_error, target_met, is_final, stopped_reason FROM tr"""


def hll_registers(table: str, column: str, precision: int, by: str = "", where: str = "TRUE") -> str:
    """CTE ``regs`` with the ``by`` columns, idx and rnk."""
    keep = f"{by}, " if by else ""
    width = 64 - precision
    return f"""digests AS (
  SELECT {keep}CAST('0x' || substr(h, 1, 8) AS BIGINT) AS hi,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) AS lo
  FROM (SELECT {keep}md5(CAST({column} AS VARCHAR)) AS h FROM {table}
        WHERE {column} IS NOT NULL AND {where})),
bits AS (
  SELECT {keep}lo & {(1 << precision) - 1} AS idx,
         hi * {1 << (32 - precision)} + (lo >> {precision}) AS rest FROM digests),
regs AS (
  SELECT {keep}CAST(idx AS INTEGER) AS idx,
         CAST(max(CASE WHEN rest = 0 THEN {width + 1}
                       ELSE {width + 1} - length(bin(rest)) END) AS INTEGER) AS rnk
  FROM bits GROUP BY {keep}idx)"""


def hll_estimate(harmonic: str, filled: str, precision: int) -> str:
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    raw = f"(CAST({alpha * m * m!r} AS DOUBLE) / ({harmonic} + ({m} - {filled})))"
    # logarithms of two engines may differ in the last bit
    return (
        f"round(CASE WHEN {raw} <= {2.5 * m} AND {m} - {filled} > 0 "
        f"THEN {float(m)!r}::DOUBLE * ln({float(m)!r}::DOUBLE / nullif({m} - {filled}, 0)) ELSE {raw} END, 6)"
    )
