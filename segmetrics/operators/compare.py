"""What analysts do with the cuts next: stack, compare years, rank, interact.

All of these run on cut results, which are bounded by the label
vocabularies times the snapshot count (tens of rows), never on household
rows. Window functions here are partitioned by date or by label, i.e. over
a handful of rows each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dimensions import Dimension
from ..functions.measures import ratio
from ..plans.catalog import CUTS, CutSpec
from ..plans.workbench import stacked_cuts
from ..sources.household import Snapshot, snapshot_literals
from ..sources.schema import DATE
from .penetration import CANONICAL, Measures

SINGLE_CUTS: tuple[CutSpec, ...] = tuple(c for c in CUTS if len(c.dims) == 1)
LONG_COLUMNS = ("dimension", "bucket", DATE, "households", "customers", "penetration_rate")


def to_long(cut: DataFrame, spec: CutSpec) -> DataFrame:
    """One cut as ``dimension, bucket, DAILY_TIME_KEY, households, customers, penetration_rate``."""
    (dim,) = spec.dims
    m = spec.measures
    return cut.select(
        F.lit(dim.name).alias("dimension"),
        F.col(dim.column).cast("string").alias("bucket"),
        F.col(DATE),
        F.col(m.households).alias("households"),
        F.col(m.customers).alias("customers"),
        F.col(m.penetration).alias("penetration_rate"),
    )


def all_cuts_long(df: DataFrame, snapshots: Sequence[Snapshot], status: DataFrame | None = None) -> DataFrame:
    """The nine single cuts stacked in long form.

    The eight cuts by household labels come from one scan of the snapshots;
    the block-bulk cut, which needs the history, is added. Lazy: no job runs
    before an action.
    """
    return _long(df, snapshots, SINGLE_CUTS, None, status)


def _long(df, snapshots, specs, customer, status) -> DataFrame:
    stacked = stacked_cuts(df, snapshots, specs, [spec.dims[0].name for spec in specs], customer, status)
    return stacked.select(F.col("tag").alias("dimension"), F.col("bucket_a").alias("bucket"), *LONG_COLUMNS[2:])


def cut_spec(*dims: Dimension, key: str | None = None, guards: Sequence[str] | None = None) -> CutSpec:
    """A cut of any one or two dimensions, custom ones included.

    ``guards`` replaces the dimensions' named guards; a custom dimension's own
    guard always holds.
    """
    layout = (*[d.column for d in dims], DATE, "hh", "cc", "pr")
    return CutSpec(key or "_".join(d.name for d in dims), "", dims, layout, CANONICAL, (), None if guards is None else tuple(guards))


def long_by(
    df: DataFrame,
    snapshots: Sequence[Snapshot],
    dims: Sequence[Dimension],
    customer: Column | None = None,
    status: DataFrame | None = None,
) -> DataFrame:
    """The long form over any dimensions, built-in or the user's own, each under its guards.

    The columns of ``all_cuts_long``, so ``yoy_change`` and ``spread_ranking`` take it as it is.
    ``customer`` replaces the customer test.
    """
    return _long(df, snapshots, [cut_spec(d) for d in dims], customer, status)


def interactions_by(
    df: DataFrame,
    snapshots: Sequence[Snapshot],
    pairs: Sequence[tuple[Dimension, Dimension]],
    customer: Column | None = None,
    status: DataFrame | None = None,
) -> DataFrame:
    """Interaction effects of any pairs of dimensions, with the columns of ``all_interactions``.

    ``cross_tab`` is the two dimensions' names joined by ``_``.
    """
    return all_interactions(df, snapshots, [cut_spec(a, b) for a, b in pairs], customer, status)


def yoy_change(
    cut: DataFrame,
    dims: Sequence[str],
    current: Snapshot,
    prior: Snapshot,
    measures: Measures = CANONICAL,
) -> DataFrame:
    """Current vs prior snapshot per segment, with ``penetration_change``.

    One aggregation pivots the two dates into columns (NULL-safe on the
    segment keys, no self-join). A segment seen on one date only has NULLs
    for the other and a NULL change.
    """
    cur, pri = snapshot_literals(cut, [current, prior])
    is_cur = F.col(DATE) == F.lit(cur)
    is_pri = F.col(DATE) == F.lit(pri)

    def on(day, col: str):
        return F.max(F.when(day, F.col(col)))

    out = cut.groupBy(*dims).agg(
        on(is_cur, measures.households).alias("households_current"),
        on(is_cur, measures.customers).alias("customers_current"),
        on(is_cur, measures.penetration).alias("penetration_current"),
        on(is_pri, measures.households).alias("households_prior"),
        on(is_pri, measures.customers).alias("customers_prior"),
        on(is_pri, measures.penetration).alias("penetration_prior"),
    )
    return out.withColumn("penetration_change", F.col("penetration_current") - F.col("penetration_prior"))


def spread_ranking(long: DataFrame, min_households: int | None = None) -> DataFrame:
    """Per dimension and date: penetration spread across buckets, ranked.

    ``spread = max - min`` of the bucket penetration rates (buckets with
    fewer than ``min_households`` households left out when given);
    ``spread_rank`` is 1 for the widest spread on each date, ties share a
    rank.
    """
    kept = long if min_households is None else long.where(F.col("households") >= min_households)
    spreads = kept.groupBy("dimension", DATE).agg(
        F.count(F.lit(1)).alias("n_buckets"),
        F.max("penetration_rate").alias("max_penetration"),
        F.min("penetration_rate").alias("min_penetration"),
    )
    spreads = spreads.withColumn("spread", F.col("max_penetration") - F.col("min_penetration"))
    w = Window.partitionBy(DATE).orderBy(F.desc("spread"))
    return spreads.withColumn("spread_rank", F.rank().over(w))


def interaction_effect(
    xtab: DataFrame, a: str, b: str, measures: Measures, by: Sequence[str] = ()
) -> DataFrame:
    """``pr_ab - (pr_a + pr_b - pr_all)`` for every cell of a cross-tab.

    The margins are re-derived from the cross-tab's own (identically
    guarded) counts by windowed sums, never by averaging rates. ``by`` names
    columns that separate several stacked cross-tabs.
    """
    hh, cc = F.col(measures.households), F.col(measures.customers)

    def margin(*keys: str):
        w = Window.partitionBy(*by, *keys)
        return ratio(F.sum(cc).over(w), F.sum(hh).over(w))

    return (
        xtab.select(
            *by,
            a,
            b,
            DATE,
            measures.households,
            measures.customers,
            measures.penetration,
            margin(DATE, a).alias("penetration_a"),
            margin(DATE, b).alias("penetration_b"),
            margin(DATE).alias("penetration_all"),
        )
        .withColumn(
            "interaction",
            F.col(measures.penetration)
            - (F.col("penetration_a") + F.col("penetration_b") - F.col("penetration_all")),
        )
    )


CROSS_TABS: tuple[CutSpec, ...] = tuple(c for c in CUTS if len(c.dims) == 2)
XTAB_LONG = Measures("households", "customers", "penetration_rate")


def all_interactions(
    df: DataFrame,
    snapshots: Sequence[Snapshot],
    specs: Sequence[CutSpec] = CROSS_TABS,
    customer: Column | None = None,
    status: DataFrame | None = None,
) -> DataFrame:
    """Interaction effects of all 18 cross-tabs (or of ``specs``), stacked.

    Output ``cross_tab, bucket_a, bucket_b, DAILY_TIME_KEY, households,
    customers, penetration_rate, penetration_a, penetration_b,
    penetration_all, interaction``. One scan of the snapshots serves all 18;
    the history is read only for a pair with the block status.
    """
    tags = [spec.key for spec in specs]
    stacked = stacked_cuts(df, snapshots, specs, tags, customer, status).withColumnRenamed("tag", "cross_tab")
    return interaction_effect(stacked, "bucket_a", "bucket_b", XTAB_LONG, by=["cross_tab"])


def min_sample(cut: DataFrame, households: str, n: int, flag: bool = False) -> DataFrame:
    """Keep segments with at least ``n`` households, or flag the small ones."""
    if flag:
        return cut.withColumn("small_sample", F.col(households) < n)
    return cut.where(F.col(households) >= n)


def as_percent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Penetration columns times 100 (same names)."""
    return df.withColumns({c: F.col(c) * 100 for c in columns})
