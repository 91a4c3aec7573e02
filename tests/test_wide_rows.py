"""Wide aggregates by block group on tables that are not clustered by block."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conftest import CUR, PRI, rows
from segmetrics.operators.blocks import demographic_pull
from segmetrics.sources.schema import BLOCK, CUSTOMER_KEY, DATE

SNAPS = (CUR, PRI)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scattered(spark):
    """Blocks whose rows are far apart, a hot block and rows without a block."""
    records = []
    for i in range(400):
        block = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"{i % 50:012d}"
        records.append({DATE: (CUR, PRI, dt.date(2023, 3, 31))[i % 3 if block != "hot" else i % 2], BLOCK: block, CUSTOMER_KEY: (i, 0, None)[i % 3], "TOTAL_POPULATION": i % 2 or None, "POP_PER_HH": (1.5, None)[i % 2]})
    return rows(spark, records).repartition(7)


def test_rows_of_the_pull_meet_by_block_before_they_are_hashed(spark):
    text = plan(demographic_pull(scattered(spark), SNAPS))
    # The plan is printed from its end: the exchange by block and day stands below both aggregates.
    assert text.rindex("REBALANCE_PARTITIONS_BY_COL") > text.rindex("HashAggregate") and text.count("HashAggregate") == 2
    # The aggregate has its own exchange, so that a hot block's partition may be split.
    assert text.count("Exchange hashpartitioning") == 2
    assert "REBALANCE" not in plan(demographic_pull(scattered(spark), SNAPS, clustered=True))


def test_the_pull_is_the_same_by_either_way(spark):
    df = scattered(spark)
    got, want = (sorted(map(tuple, demographic_pull(df, SNAPS, clustered=c).collect()), key=repr) for c in (False, True))
    assert got == want and sum(r[-3] for r in got) == df.where(F.col(DATE).isin(*SNAPS)).count()
