"""The follow-up analyses the workbench's usage notes ask for, as queries.

Each entry is ``f(df, snapshots) -> DataFrame`` over the household fact table,
like the 29 statements; ``snapshots[0]`` is the current and ``snapshots[1]``
the prior date.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import BLOCK_BULK, DWELLING_DIM, KIDS, LABOR, OWNERSHIP, TRANSPORT, custom_dimension
from ..functions.measures import key_gt_0
from ..operators.blocks import block_bulk_status, by_block_and_day, demographic_pull
from ..operators.compare import (
    all_cuts_long,
    all_interactions,
    as_percent,
    interaction_effect,
    interactions_by,
    long_by,
    min_sample,
    spread_ranking,
    yoy_change,
)
from ..operators.penetration import Measures, penetration_by
from ..operators.significance import rate_bounds, yoy_significance
from ..operators.stats import demographic_correlation, predictor_ranking, univariate_regression
from ..session import ensure_checkpoint_dir
from ..sources.bucketed import append_households, joined_by_block, write_block_rows
from ..sources.census import enrich_with_census
from ..sources.export import export_csv, read_export
from ..sources.household import Snapshot, snapshot_filter
from ..sources.schema import BLOCK, BULK, CUSTOMER_FLAG, CUSTOMER_KEY, DATE, DEMOGRAPHIC_COLUMNS, DWELLING
from .catalog import BLOCK_BULK_DWELLING, CUTS_BY_KEY, XTAB
from .daily_cube import refresh_days, stored_cuts_long

# Segments under this many households are flagged (or left out) as too small to read.
SOLID_HOUSEHOLDS = 1500
# Share of false discoveries accepted when changes are looked at for a closer reading.
EXPLORATORY_LEVEL = 0.2


def yoy_all_cuts(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return yoy_change(all_cuts_long(df, snapshots), ["dimension", "bucket"], snapshots[0], snapshots[1])


def changes_with_tests(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """The comparison of all cuts with tests; each dimension is a family of its own."""
    return yoy_significance(yoy_all_cuts(df, snapshots), ["dimension"], EXPLORATORY_LEVEL)


def bounded_labor_cut(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    spec = CUTS_BY_KEY["xtab_kids_labor"]
    return rate_bounds(spec.run(df, snapshots), spec.measures.customers, spec.measures.households)


def ranked_spreads(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return spread_ranking(all_cuts_long(df, snapshots))


def _interaction(key: str):
    spec = CUTS_BY_KEY[key]
    a, b = (d.column for d in spec.dims)

    def run(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
        return interaction_effect(spec.run(df, snapshots), a, b, spec.measures)

    return run


def small_segments(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    xtab = CUTS_BY_KEY["xtab_kids_transport"].run(df, snapshots)
    return min_sample(xtab, XTAB.households, SOLID_HOUSEHOLDS, flag=True)


def large_segments(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    xtab = CUTS_BY_KEY["xtab_kids_transport"].run(df, snapshots)
    return min_sample(xtab, XTAB.households, SOLID_HOUSEHOLDS)


def kids_in_percent(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return as_percent(CUTS_BY_KEY["cut_kids"].run(df, snapshots), ["penetration_rate"])


def _pull(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return demographic_pull(df, snapshots)


def correlation_matrix(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return demographic_correlation(_pull(df, snapshots))


def ranked_predictors(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return predictor_ranking(_pull(df, snapshots))


def regressions(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return univariate_regression(_pull(df, snapshots))


def enriched_labor_cut(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """Split the table into households and a block attribute table, re-join, cut.

    The attribute table is the census columns per block group (one row per
    block) on the latest snapshot that has the block, standing in for a
    separately delivered ACS extract: a block seen on the prior date only keeps
    its attributes.
    """
    acs = _attributes(df, snapshots)
    households = df.select(DATE, BLOCK, DWELLING, BULK, CUSTOMER_KEY, CUSTOMER_FLAG)
    return CUTS_BY_KEY["cut_labor"].run(enrich_with_census(households, acs, check_keys=False), snapshots)


def _attributes(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """One row of census columns per block group, from the latest snapshot that has it.

    All columns come from the same row: they see the same dates in the same order. Numbers
    one by one are hashed, a struct of them would sort every household, and
    the columns that nobody reads are left out by the planner.
    """
    latest = [F.max_by(c, DATE).alias(c) for c in DEMOGRAPHIC_COLUMNS]
    known = df.where(snapshot_filter(df, snapshots) & F.col(BLOCK).isNotNull())
    return known.groupBy(BLOCK).agg(*latest)


def bucketed_labor_by_status(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """Labour force beside block status, from tables bucketed by block group.

    Stores the fact table, the census attributes and the block status, then joins
    the three without an exchange.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bucketed-{run}"
    fact, acs, status = (f"{name}_{run}" for name in ("households", "census", "block_status"))
    append_households(df.select(DATE, BLOCK, CUSTOMER_FLAG, BULK), fact, f"{base}/households")
    census_rows = df.where(snapshot_filter(df, snapshots) & F.col(BLOCK).isNotNull()).select(DATE, BLOCK, *DEMOGRAPHIC_COLUMNS)
    write_block_rows(_attributes(by_block_and_day(census_rows), snapshots), acs, f"{base}/census")
    write_block_rows(block_bulk_status(spark.table(fact)), status, f"{base}/status")
    rows = spark.table(fact).where(snapshot_filter(df, snapshots))
    joined = joined_by_block(spark, rows, acs, status)
    return penetration_by(joined, [BLOCK_BULK, LABOR], snapshots, measures=XTAB)


def cuts_from_daily_cube(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """All 27 cuts from the stored daily tables: every day is aggregated once, then two are read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/daily_cube-{uuid.uuid4().hex}"
    days = [r[0] for r in df.select(DATE).distinct().collect()]  # a row per stored day
    refresh_days(df, days, path)
    return stored_cuts_long(spark, path, snapshots)


AGE_DECADE = custom_dimension(
    "age_decade",
    lambda: (F.floor(F.col("MEDIAN_HH_AGE") / 10) * 10).cast("int"),
    guard=lambda: F.col("MEDIAN_HH_AGE").isNotNull(),
)


def custom_age_cut(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """A user-defined dimension and customer test (``CUSTOMER_KEY > 0``)."""
    return penetration_by(
        df, [AGE_DECADE], snapshots, customer=key_gt_0(), measures=Measures(), order_by=["age_decade", DATE]
    )


def _custom_long(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return long_by(df, snapshots, [AGE_DECADE, KIDS, OWNERSHIP, TRANSPORT], customer=key_gt_0())


def custom_yoy(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return yoy_change(_custom_long(df, snapshots), ["dimension", "bucket"], snapshots[0], snapshots[1])


def custom_ranking(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return spread_ranking(_custom_long(df, snapshots))


def custom_interactions(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    return interactions_by(df, snapshots, [(AGE_DECADE, KIDS), (DWELLING_DIM, AGE_DECADE), (BLOCK_BULK, AGE_DECADE)])


def exported_pull(df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """The wide pull, written as CSV with its manifest and read back through the checks."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pull_csv-{uuid.uuid4().hex}"
    export_csv(_pull(df, snapshots), path)
    return read_export(spark, path)


ANALYSES = {
    "all_cuts_long": all_cuts_long,
    "yoy_change": yoy_all_cuts,
    "yoy_significance": changes_with_tests,
    "rate_bounds": bounded_labor_cut,
    "spread_ranking": ranked_spreads,
    "interaction_dwelling_kids": _interaction("xtab_dwelling_kids"),
    "interaction_kids_transport": _interaction("xtab_kids_transport"),
    "all_interactions": all_interactions,
    "min_sample": small_segments,
    "min_sample_filter": large_segments,
    "as_percent": kids_in_percent,
    "demographic_correlation": correlation_matrix,
    "predictor_ranking": ranked_predictors,
    "univariate_regression": regressions,
    "enrich_with_census": enriched_labor_cut,
    "bucketed_labor_by_status": bucketed_labor_by_status,
    "daily_cube_cuts": cuts_from_daily_cube,
    "custom_dimension": custom_age_cut,
    "custom_long": _custom_long,
    "custom_yoy": custom_yoy,
    "custom_ranking": custom_ranking,
    "custom_interactions": custom_interactions,
    "export_csv_round_trip": exported_pull,
    "xtab_block_bulk_dwelling": BLOCK_BULK_DWELLING.run,
}
