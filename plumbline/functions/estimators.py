"""Estimators over sample sums, as SQL expressions for ``selectExpr``.

``n`` sample rows out of ``pop``; ``y`` the value (0 for NULL); ``x`` 1 for a value that counts
towards the mean, else 0. Sampling is without replacement, hence the factor 1 - n/pop. Each list
names its steps, and a later step uses the names of the earlier ones.
"""

from __future__ import annotations

from statistics import NormalDist

#: Fixed value: estimates closer to zero than this have no meaningful relative error.
NEAR_ZERO = "1e-9D"

#: the sums of ``operators.sampling.step_moments``, as doubles under short names
SUMS = [
    "cast(sample_rows as double) as n",
    "cast(population_rows as double) as pop",
    "cast(sum_y as double) as y",
    "cast(sum_yy as double) as yy",
    "cast(sum_x as double) as x",
    "cast(sum_xx as double) as xx",
    "cast(sum_xy as double) as xy",
    "1 - n / nullif(pop, 0D) as unsampled",
]

#: population size times sample mean; 0 for an empty sample
TOTAL = [
    "y / nullif(n, 0D) as mean_y",
    "coalesce(pop * mean_y, 0D) as estimate",
    "greatest(0D, (yy - n * mean_y * mean_y) / nullif(n - 1, 0D)) as variance",
    "pop * sqrt(greatest(0D, unsampled * variance / nullif(n, 0D))) as standard_error",
    "n < 2 as blind",
]

#: sum of values over count of values; 0 when no row has a value
MEAN = [
    "y / nullif(x, 0D) as ratio",
    "coalesce(ratio, 0D) as estimate",
    "x / nullif(n, 0D) as mean_x",
    "greatest(0D, (yy - 2 * ratio * xy + ratio * ratio * xx) / nullif(n - 1, 0D)) as variance",
    "sqrt(greatest(0D, unsampled * variance / nullif(n * mean_x * mean_x, 0D))) as standard_error",
    "n < 2 or x = 0 as blind",
]


def normal_quantile(confidence: float) -> float:
    """Two-sided normal quantile, 1.96 for 95 %."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie strictly between 0 and 1")
    return NormalDist().inv_cdf((1 + confidence) / 2)


def interval(confidence: float) -> list[str]:
    """``relative_error``, ``ci_low`` and ``ci_high`` after ``TOTAL`` or ``MEAN``.

    A full sample is exact (error 0). An empty one, a single row and, for a mean, a sample
    without any value know nothing (error 1) and, below two rows, have no interval.
    """
    z = f"{normal_quantile(confidence)!r}D"
    return [
        f"case when n = pop then 0D else {z} * standard_error end as margin",
        "case when n = pop then 0D when blind then 1D when margin <= 0 then 0D "
        f"when abs(estimate) <= {NEAR_ZERO} then 1D "
        "else margin / nullif(abs(estimate), 0D) end as relative_error",
        "case when n >= 2 then estimate - margin end as ci_low",
        "case when n >= 2 then estimate + margin end as ci_high",
    ]
