"""Whether a difference means anything: interval bounds and tests per segment.

Inputs are cut results or their year-over-year comparison: tens of rows, bounded by
the label vocabularies, never household rows. Everything is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: 97.5 % quantile of the normal distribution, and the coefficients of the
# Chebyshev fit of erfc with relative error below 1.2e-7 (Numerical Recipes, "erfcc"),
# from the constant term up.
Z95 = 1.959963984540054
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
# --- end of fixed values -----------------------------------------------------
DIGITS = 9


def wilson_bounds(customers: str, households: str, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of the penetration; NULL without households.

    Stays within 0 and 1 and does not collapse at rates of 0 or 1, unlike the plain normal interval.
    """
    n, c = F.col(households).cast("double"), F.col(customers).cast("double")
    rate = F.try_divide(c, n)
    z2 = z * z
    middle = rate + F.try_divide(F.lit(z2), 2 * n)
    half = z * F.sqrt(F.try_divide(rate * (1 - rate), n) + F.try_divide(F.lit(z2), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z2), n)
    # greatest and least skip NULLs, so a missing rate is kept apart.
    low, high = F.greatest(F.lit(0.0), (middle - half) / scale), F.least(F.lit(1.0), (middle + half) / scale)
    return F.when(rate.isNotNull(), low), F.when(rate.isNotNull(), high)


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal Z."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    fit = F.lit(0.0)
    for a in reversed(ERFC_FIT[1:]):
        fit = t * (F.lit(a) + fit)
    return F.when(z.isNotNull(), F.least(F.lit(1.0), t * F.exp(-x * x + F.lit(ERFC_FIT[0]) + fit)))


def two_proportion_z(customers_a: str, households_a: str, customers_b: str, households_b: str) -> Column:
    """z of the difference a - b with the pooled rate; 0 where all or none are customers, NULL for a missing side."""
    na, nb = F.col(households_a).cast("double"), F.col(households_b).cast("double")
    ca, cb = F.col(customers_a).cast("double"), F.col(customers_b).cast("double")
    pooled = F.try_divide(ca + cb, na + nb)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb)))
    difference = F.try_divide(ca, na) - F.try_divide(cb, nb)
    return F.when(error > 0, difference / error).when(error == 0, F.lit(0.0))


def benjamini_hochberg(df: DataFrame, p: str, q: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``q``, the false discovery rate at which each row's ``p`` is a discovery.

    ``by`` names the columns of a family of tests (all rows by default). Rows with a NULL ``p`` are no
    tests and get NULL. Equal p have equal q.
    """
    family = Window.partitionBy(*by)
    # The default frame of an ordered window holds all rows of equal p.
    rank = F.count(p).over(family.orderBy(F.asc_nulls_last(p)))
    scaled = df.withColumn("_scaled", F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(family) / rank))
    least = F.min("_scaled").over(family.orderBy(F.desc_nulls_last(p)))
    return scaled.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_scaled")


def yoy_significance(change: DataFrame, by: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """The result of ``yoy_change`` with what its differences mean.

    Adds Wilson bounds of both rates (``low_`` / ``high_current`` and ``_prior``),
    ``z`` and ``p_value`` of the two-proportion test, ``q_value`` after Benjamini-Hochberg over the family ``by``,
    and ``significant`` (``q_value <= level``). A segment seen on one date only has the bounds of that
    date and NULLs for the test. Numbers are rounded to 9 decimals after the test is decided.
    """
    out = change
    rounded = {}
    for side in ("current", "prior"):
        low, high = wilson_bounds(f"customers_{side}", f"households_{side}")
        rounded |= {f"low_{side}": low, f"high_{side}": high}
    z = two_proportion_z("customers_current", "households_current", "customers_prior", "households_prior")
    out = out.withColumns({**rounded, "z": z}).withColumn("p_value", two_sided_p(F.col("z")))
    out = benjamini_hochberg(out, "p_value", "q_value", by)
    out = out.withColumn("significant", F.col("q_value") <= level)
    return out.withColumns({c: F.round(c, DIGITS) for c in (*rounded, "z", "p_value", "q_value")})


def rate_bounds(cut: DataFrame, customers: str, households: str, z: float = Z95) -> DataFrame:
    """A cut with Wilson bounds ``low`` and ``high`` of its penetration, rounded to 9 decimals."""
    low, high = wilson_bounds(customers, households, z)
    return cut.withColumns({"low": F.round(low, DIGITS), "high": F.round(high, DIGITS)})
