"""Measures: household count, customer count and their ratio.

Every measure is an additive count, so Spark computes it with a partial
(map-side) aggregate; a hot segment never concentrates rows in one task.
The ratio is derived from the two final counts, never averaged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import CUSTOMER_FLAG, CUSTOMER_KEY


def flag_eq_1() -> Column:
    """Subscriber test of the cuts and cross-tabs: ``CUSTOMER_FLAG = 1``."""
    return F.col(CUSTOMER_FLAG) == 1


def key_gt_0() -> Column:
    """Subscriber test of the two block-group queries: ``CUSTOMER_KEY > 0``."""
    return F.col(CUSTOMER_KEY) > 0


def households() -> Column:
    """Rows in the group (``COUNT(*)``)."""
    return F.count(F.lit(1))


def customers(predicate: Column) -> Column:
    """Rows where ``predicate`` is true; NULL counts as not a customer."""
    return F.count_if(predicate)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """IEEE double ``numerator / denominator``; NULL when the denominator is 0.

    Both sides are cast first: ``count * 1.0 / count`` would type as a
    decimal in Spark, and a decimal-vs-double choice must not depend on
    the engine.
    """
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(num.cast("double"), den.cast("double"))
