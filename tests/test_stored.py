"""Bucketed tables and stored daily aggregates."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import CUR, OLD, PRI
from segmetrics.functions.dimensions import LABOR
from segmetrics.operators.blocks import block_bulk_status
from segmetrics.operators.compare import cut_spec
from segmetrics.operators.penetration import penetration_by
from segmetrics.plans.analyses import _attributes
from segmetrics.plans.catalog import BLOCK_BULK_DWELLING, CUTS, CUTS_BY_KEY
from segmetrics.plans.daily_cube import refresh_days, stored_cuts, stored_cuts_long
from segmetrics.sources.bucketed import SALTS, append_households, joined_by_block, write_block_rows
from segmetrics.sources.census import enrich_with_census
from segmetrics.sources.household import read_household_history, write_household_history
from segmetrics.sources.schema import BLOCK, BULK, CUSTOMER_FLAG, DATE

SNAPS = (CUR, PRI)
THIN = [DATE, BLOCK, CUSTOMER_FLAG, BULK]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def bucketed(spark, hh, tmp_path_factory):
    run, base = uuid.uuid4().hex, str(tmp_path_factory.mktemp("bucketed"))
    names = [f"{n}_{run}" for n in ("households", "census", "status")]
    for day in (OLD, PRI, CUR):
        append_households(hh.where(F.col(DATE) == day).select(THIN), names[0], f"{base}/h", buckets=4)
    write_block_rows(_attributes(hh, SNAPS), names[1], f"{base}/c", buckets=4)
    write_block_rows(block_bulk_status(hh), names[2], f"{base}/s", buckets=4)
    return names, base


def test_days_land_one_by_one_and_join_like_the_plain_tables(spark, hh, bucketed):
    (fact, census, status), _ = bucketed
    assert rows_of(spark.table(fact).select(THIN)) == rows_of(hh.select(THIN))
    got = joined_by_block(spark, fact, census, status)
    want = enrich_with_census(hh.select(THIN), _attributes(hh, SNAPS), check_keys=False).join(block_bulk_status(hh).where(F.col(BLOCK).isNotNull()), BLOCK, "left")
    columns = [*THIN, "TOTAL_FAMILIES", "MEDIAN_HH_AGE", "block_bulk_status"]
    assert rows_of(got.select(columns)) == rows_of(want.select(columns))


def test_no_exchange_under_the_joins(spark, bucketed):
    (fact, census, status), _ = bucketed
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        rows = spark.table(fact).where(F.col(DATE).isin(*SNAPS))
        joined = joined_by_block(spark, rows, census, status)
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert text.count("SortMergeJoin") == 2 and "Exchange" not in text and "PartitionFilters: [DATE" not in text
        cut = penetration_by(joined, [LABOR], SNAPS)._jdf.queryExecution().executedPlan().toString()
        # The one exchange is that of the cut's own partial counts, above the joins.
        assert cut.count("Exchange") == 1 and cut.index("Exchange") < cut.index("SortMergeJoin")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_and_missing_blocks_are_spread_over_buckets(spark, tmp_path):
    run = uuid.uuid4().hex
    rows = spark.range(4000).select(
        F.lit(CUR).alias(DATE),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias(BLOCK),
        F.lit(1).alias(CUSTOMER_FLAG),
        F.col("id").cast("int").alias(BULK),
    )
    append_households(rows, f"h_{run}", str(tmp_path / "h"), buckets=32)
    sizes = [r["count"] for r in spark.table(f"h_{run}").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 4000 / 4
    write_block_rows(spark.createDataFrame([("hot", 7), (None, 8)], f"{BLOCK} string, x int"), f"b_{run}", str(tmp_path / "b"), buckets=32)
    assert spark.table(f"b_{run}").count() == SALTS
    got = joined_by_block(spark, f"h_{run}", f"b_{run}")
    assert got.count() == 4000 and got.where("x = 7").count() == rows.where(f"{BLOCK} = 'hot'").count() and got.where("x = 8").count() == 0


def test_block_tables_are_replaced(spark, tmp_path):
    name = f"b_{uuid.uuid4().hex}"
    for x in (1, 2):
        write_block_rows(spark.createDataFrame([("a", x)], f"{BLOCK} string, x int"), name, str(tmp_path / "b"), buckets=2)
    assert {r["x"] for r in spark.table(name).collect()} == {2}


@pytest.fixture(scope="module")
def cube(spark, hh, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube"))
    for day in (OLD, PRI, CUR):
        refresh_days(hh, [day], path)
    return path


def test_stored_cuts_equal_the_direct_ones(spark, hh, cube):
    stored = stored_cuts(spark, cube, SNAPS)
    assert list(stored) == [c.key for c in CUTS]
    long = stored_cuts_long(spark, cube, SNAPS).collect()
    for spec in CUTS:
        direct = spec.run(hh, SNAPS)
        assert stored[spec.key].columns == direct.columns
        want = rows_of(direct)
        assert rows_of(stored[spec.key]) == want, spec.key
        assert sorted(r["households"] for r in long if r["cut"] == spec.key) == sorted(r[spec.measures.households] for r in direct.collect())


def test_cuts_read_no_household_and_two_small_partitions(spark, cube):
    for key, cut in stored_cuts(spark, cube, SNAPS, [CUTS_BY_KEY["cut_kids"], CUTS_BY_KEY["cut_block_bulk"]]).items():
        files = cut.inputFiles()
        assert files and all(cube in f for f in files), key
        if key == "cut_kids":
            plan = cut._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == 1 and ("PartitionFilters: [isnotnull(DAILY_TIME_KEY" in plan or "PartitionFilters: [DAILY_TIME_KEY" in plan)


def test_refreshing_a_day_replaces_that_day_only(spark, hh, tmp_path):
    path, table = str(tmp_path / "cube"), str(tmp_path / "hh")
    write_household_history(hh.drop("HOUSEHOLD_ROW_ID"), table)
    history = read_household_history(spark, table)
    specs = [CUTS_BY_KEY["cut_kids"], CUTS_BY_KEY["cut_block_bulk"]]
    refresh_days(history, [PRI, OLD], path, specs)
    refresh_days(history.where(F.col("CHILDREN_PER_HH") < 1), [CUR], path, specs)  # a day that landed in part
    before = rows_of(stored_cuts(spark, path, [PRI], specs)["cut_kids"])
    assert rows_of(stored_cuts(spark, path, SNAPS, specs)["cut_kids"]) != rows_of(CUTS_BY_KEY["cut_kids"].run(history, SNAPS))
    refresh_days(history, [CUR], path, specs)
    refresh_days(history, [CUR], path, specs)
    assert rows_of(stored_cuts(spark, path, [PRI], specs)["cut_kids"]) == before
    for spec in specs:
        assert rows_of(stored_cuts(spark, path, SNAPS, specs)[spec.key]) == rows_of(spec.run(history, SNAPS))


def test_stored_cubes_take_custom_cuts_and_refuse_block_pairs(spark, hh, tmp_path):
    from segmetrics.plans.analyses import AGE_DECADE

    spec = cut_spec(AGE_DECADE)
    refresh_days(hh, SNAPS, str(tmp_path / "c"), [spec])
    (long,) = [rows_of(stored_cuts_long(spark, str(tmp_path / "c"), SNAPS, [spec]).select("bucket_a", DATE, "households"))]
    want = penetration_by(hh, [AGE_DECADE], SNAPS).select(F.col("age_decade").cast("string"), DATE, "household_count")
    assert long == rows_of(want)
    with pytest.raises(ValueError, match="no household labels"):
        stored_cuts(spark, str(tmp_path / "c"), SNAPS, [BLOCK_BULK_DWELLING])
