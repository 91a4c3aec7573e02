"""Segment penetration: households, customers and their ratio per bucket.

Plan of every cut (``.explain()``): Parquet scan with the snapshot filter as
``PartitionFilters`` and only the label inputs in ``ReadSchema``; one
``Filter`` holding the guards; a ``Project`` with the ``CASE`` labels;
partial ``HashAggregate`` (map-side combine) -> ``Exchange hashpartitioning``
on the labels and date -> final ``HashAggregate``. The shuffle carries at
most one row per (bucket, date, map task), so a segment holding a third of
all households costs the same as any other. The optional global sort runs
on that tiny result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import Dimension, all_of, guard_of
from ..functions.measures import customers, flag_eq_1, households, ratio
from ..sources.household import Snapshot, snapshot_filter
from ..sources.schema import DATE


@dataclass(frozen=True)
class Measures:
    """Output names of the three measures (they vary between queries)."""

    households: str = "household_count"
    customers: str = "customer_count"
    penetration: str = "penetration_rate"


CANONICAL = Measures("households", "customers", "penetration_rate")

_DIMENSION_GUARDS = object()  # sentinel: guard = conjunction of the dimensions' guards


def sort_nulls_last(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Global ascending sort; NULL sorts after every value on each key."""
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys])


def penetration_by(
    df: DataFrame,
    dims: Sequence[Dimension],
    snapshots: Sequence[Snapshot],
    *,
    customer: Column | None = None,
    guard: Column | None | object = _DIMENSION_GUARDS,
    measures: Measures = Measures(),
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Penetration of each bucket combination of ``dims`` on each snapshot.

    ``guard`` replaces the dimensions' own guards when given (``None`` keeps
    every row). ``columns`` is the output order (dimension columns, the date
    and the three measure names); by default dims, date, households,
    customers, penetration. ``order_by`` sorts ascending, NULLs last.
    """
    is_customer = flag_eq_1() if customer is None else customer
    rows = guard_of(dims) if guard is _DIMENSION_GUARDS else guard
    keep = all_of([snapshot_filter(df, snapshots), rows])
    keys = [d.column for d in dims] + [DATE]
    counted = (
        df.where(keep)
        .select(*[d.label() for d in dims], F.col(DATE), is_customer.alias("_is_customer"))
        .groupBy(*keys)
        .agg(
            households().alias(measures.households),
            customers(F.col("_is_customer")).alias(measures.customers),
        )
    )
    out = counted.select(
        *keys,
        measures.households,
        measures.customers,
        ratio(measures.customers, measures.households).alias(measures.penetration),
    )
    if columns is not None:
        out = out.select(*columns)
    return sort_nulls_last(out, order_by) if order_by else out
