"""Census attributes of the block groups, from the latest snapshot that has them."""

from __future__ import annotations

import datetime as dt

from conftest import CUR, PRI, rows
from segmetrics.plans.analyses import _attributes, enriched_labor_cut
from segmetrics.sources.schema import BLOCK, DATE, DEMOGRAPHIC_COLUMNS

SNAPS = (CUR, PRI)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attributes_are_hashed_and_pruned(spark):
    df = rows(spark, [{DATE: CUR, BLOCK: "a", "TOTAL_FAMILIES": 1}]).repartition(3)
    assert "SortAggregate" not in plan(_attributes(df, SNAPS))
    text = plan(enriched_labor_cut(df, SNAPS))
    assert "SortAggregate" not in text and "max_by(TOTAL_IN_LABOR_FORCE" in text and "max_by(MEDIAN_HH_AGE" not in text


def test_attributes_of_a_block_are_one_row_of_its_latest_day(spark):
    records = [{DATE: day, BLOCK: "b", **{c: (k + j) if (j + k) % 3 else None for j, c in enumerate(DEMOGRAPHIC_COLUMNS)}} for k, day in enumerate((PRI, CUR, CUR, CUR, PRI))]
    for r in records:
        r.update({c: float(r[c]) for c in DEMOGRAPHIC_COLUMNS if r[c] is not None and (c.startswith("PERC_") or c.endswith("_PER_HH") or c == "MEDIAN_HH_AGE")})
    records += [{DATE: PRI, BLOCK: "old", "TOTAL_FAMILIES": 3}, {DATE: CUR, BLOCK: None, "TOTAL_FAMILIES": 4}, {DATE: dt.date(2023, 3, 31), BLOCK: "gone", "TOTAL_FAMILIES": 5}]
    found = {r[BLOCK]: tuple(r)[1:] for r in _attributes(rows(spark, records).repartition(3), SNAPS).collect()}
    assert set(found) == {"b", "old"} and found["old"][DEMOGRAPHIC_COLUMNS.index("TOTAL_FAMILIES")] == 3
    assert found["b"] in [tuple(r[c] for c in DEMOGRAPHIC_COLUMNS) for r in records[1:4]]
