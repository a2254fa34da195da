"""Closed-form statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided binomial p under 1/2: min(1, 2 * sum_{i<=k} C(n,i) / 2^n); null when n is 0.

    The sum runs downward from i = k on one aggregated row. Terms further than 6 sqrt(n) below k add less than
    1e-30 of the largest one, so the walk stays short for any n.
    """
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n.cast("double") * F.log(F.lit(2.0)))
    steps = F.least(k.cast("bigint"), F.ceil(6 * F.sqrt(n.cast("double"))) + 20)
    walk = F.when(steps >= 1, F.sequence(F.lit(0).cast("bigint"), steps - 1)).otherwise(
        F.array().cast("array<bigint>")
    )

    def step(acc: Column, j: Column) -> Column:
        i = k.cast("double") - j
        term = acc["t"] * i / (n.cast("double") - i + 1)
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    tail = F.aggregate(walk, F.struct(top.alias("t"), top.alias("s")), step, lambda acc: acc["s"])
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * tail))


def hanley_mcneil_se(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """Standard error of an area under the curve; null where the curve is."""
    q1 = auc / (2 - auc)
    q2 = 2 * auc * auc / (1 + auc)
    var = (auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)) / (n_pos * n_neg)
    return F.when(auc.isNotNull() & (n_pos > 0) & (n_neg > 0), F.sqrt(F.greatest(var, F.lit(0.0))))


def safe_round(value: Column, digits: int = 3) -> Column:
    """Rounded value; null for null, NaN and infinities."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(value.isNull() | bad, F.lit(None).cast("double")).otherwise(F.round(value, digits))


def r(value: Column | str, digits: int = 6) -> Column:
    """Round a double for output, with negative zero folded into zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), digits) + F.lit(0.0)
