"""Block-group operators: bulk presence, block summary, wide demographic pull.

``cut_block_bulk`` is the only query that reads the whole history. Both sides
(the status over the history, the households of the snapshots) are first
reduced to block grain by partial aggregation and then joined on the block
key, in one lazy job and by one plan at every size. No household row is
shuffled, and a hot block is one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import BLOCK_BULK_LABELS, Dimension, all_of
from ..functions.measures import customers, flag_eq_1, households, key_gt_0, ratio
from ..sources.household import Snapshot, snapshot_filter
from ..sources.schema import (
    BLOCK,
    BULK,
    CUSTOMER_KEY,
    DATE,
    DEMOGRAPHIC_PULL_COLUMNS,
    DWELLING,
    HOME_VALUE_COLUMNS,
)
from .penetration import Measures, sort_nulls_last

# --- fixed values: dwelling strings counted by the block-group summary -------
APARTMENT = "APARTMENT"
HOUSE = "HOUSE"
# --- end of fixed values -----------------------------------------------------

def block_bulk_status(history: DataFrame) -> DataFrame:
    """``(CENSUS_BLOCK_GROUP, block_bulk_status)`` over **all** stored days.

    ``has_bulk`` when ``MAX(BULK_FLG) = 1`` for the block, else ``no_bulk``
    (all-NULL flags and a maximum of 2 are ``no_bulk``). The NULL block is
    kept here; an equi-join drops it. No date filter may be applied before
    this aggregate. The result has one row per block group: persist it and
    refresh it daily (``streaming.block_bulk`` keeps it incrementally).
    """
    has_bulk, no_bulk = BLOCK_BULK_LABELS
    return (
        history.groupBy(BLOCK)
        .agg(F.max(BULK).alias("has_bulk_flag"))
        .select(
            BLOCK,
            F.when(F.col("has_bulk_flag") == 1, has_bulk).otherwise(no_bulk).alias("block_bulk_status"),
        )
    )


def cut_block_bulk(
    df: DataFrame,
    snapshots: Sequence[Snapshot],
    status: DataFrame | None = None,
    measures: Measures = Measures("total_households", "customer_count"),
    others: Sequence[Dimension] = (),
    guard: Column | None = None,
) -> DataFrame:
    """Penetration of households in blocks with / without any bulk household.

    ``status`` defaults to ``block_bulk_status(df)`` over the full history of
    ``df``; pass a persisted status table (e.g. the streaming one) to skip
    that scan. ``others`` are further labels of the household, kept beside the
    block in the block-grain aggregate, and ``guard`` the rows they are defined on. Output:
    ``block_bulk_status[, others], DAILY_TIME_KEY, customer_count, total_households, penetration_rate``.
    """
    status = block_bulk_status(df) if status is None else status
    labels = [d.column for d in others]
    rows = df.where(all_of([snapshot_filter(df, snapshots), F.col(BLOCK).isNotNull(), guard]))
    per_block = (
        rows.select(BLOCK, DATE, *[d.label() for d in others], flag_eq_1().alias("_is_customer"))
        .groupBy(BLOCK, DATE, *labels)
        .agg(households().alias("_hh"), customers(F.col("_is_customer")).alias("_cc"))
    )
    return (
        per_block.join(status, BLOCK, "inner")
        .groupBy("block_bulk_status", *labels, DATE)
        .agg(F.sum("_cc").alias(measures.customers), F.sum("_hh").alias(measures.households))
        .select(
            "block_bulk_status",
            *labels,
            DATE,
            measures.customers,
            measures.households,
            ratio(measures.customers, measures.households).alias(measures.penetration),
        )
    )


def block_group_summary(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """One row per (date, block group, children share, six home-value counts).

    Customers here are ``CUSTOMER_KEY > 0``. ``perc_hh_wo_children`` is
    ``1 - PERC_HH_W_CHILDREN``. Sorted by block group then date, NULLs last.
    """
    keys = [DATE, BLOCK, "PERC_HH_W_CHILDREN", *HOME_VALUE_COLUMNS]
    per_block = (
        df.where(snapshot_filter(df, snapshots))
        .groupBy(*keys)
        .agg(
            customers(F.col(DWELLING) == APARTMENT).alias("apartment_count"),
            customers(F.col(DWELLING) == HOUSE).alias("house_count"),
            households().alias("hhs"),
            customers(key_gt_0()).alias("num_customers"),
            customers(F.col(BULK) == 1).alias("bulk_hhs"),
        )
    )
    out = per_block.select(
        DATE,
        BLOCK,
        "hhs",
        "num_customers",
        "PERC_HH_W_CHILDREN",
        (F.lit(1) - F.col("PERC_HH_W_CHILDREN")).alias("perc_hh_wo_children"),
        "bulk_hhs",
        ratio("num_customers", "hhs").alias("penetration"),
        ratio("bulk_hhs", "hhs").alias("bulk_pct"),
        "apartment_count",
        "house_count",
        *HOME_VALUE_COLUMNS,
    )
    return sort_nulls_last(out, [BLOCK, DATE])


def by_block_and_day(rows: DataFrame) -> DataFrame:
    """``rows`` with those of a block group and day beside each other, in partitions of the advisory size.

    A partial aggregate of wide rows by block group holds a group per block that its task
    reads. Where the table is not clustered by block that is nearly every block, however
    large the table; behind this exchange it is what fits one partition. Adaptive execution
    splits the partition of a hot block, as the aggregate has an exchange of its own.
    """
    return rows.hint("rebalance", BLOCK, DATE)


def demographic_pull(df: DataFrame, snapshots: Sequence[Snapshot], clustered: bool = False) -> DataFrame:
    """The 55 block-group columns plus ``hhs, num_customers, penetration``.

    Grouped by all 55 columns over both snapshots **without** the date: a
    block whose demographics are equal on both days yields one row counting
    both days' households; a block whose demographics changed yields one
    undated row per version. Customers are ``CUSTOMER_KEY > 0``.

    The shuffle rows are wide (55 keys). On a fact table clustered by block
    within each date (``write_household_history``) the partial aggregate
    leaves about one row per block per task boundary; say ``clustered`` there, so
    that the rows are not first brought together by block and day.
    """
    rows = df.where(snapshot_filter(df, snapshots)).select(DATE, *DEMOGRAPHIC_PULL_COLUMNS, CUSTOMER_KEY)
    return (
        (rows if clustered else by_block_and_day(rows))
        .groupBy(*DEMOGRAPHIC_PULL_COLUMNS)
        .agg(households().alias("hhs"), customers(key_gt_0()).alias("num_customers"))
        .select(*DEMOGRAPHIC_PULL_COLUMNS, "hhs", "num_customers", ratio("num_customers", "hhs").alias("penetration"))
    )
