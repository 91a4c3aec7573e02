"""Reading the fact table: user column names, user date types, catalog tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import CUR, PRI
from segmetrics.plans.catalog import QUERIES
from segmetrics.sources.schema import HOUSEHOLD_SCHEMA
from segmetrics.sources.household import (
    household_table,
    read_household_history,
    snapshot_literals,
    write_household_history,
)

SNAPS = (CUR, PRI)


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_column_map_renames_user_columns(spark, hh, tmp_path):
    path = str(tmp_path / "user_named")
    user = {"DWELLING_SEGMENT": "unit_type", "CUSTOMER_FLAG": "is_subscriber", "DAILY_TIME_KEY": "snapshot_date"}
    hh.drop("HOUSEHOLD_ROW_ID").withColumnsRenamed(user).write.parquet(path)
    back = read_household_history(spark, path, column_map={v: k for k, v in user.items()})
    assert _sorted(QUERIES["cut_dwelling"](back, SNAPS)) == _sorted(QUERIES["cut_dwelling"](hh, SNAPS))


@pytest.mark.parametrize(
    "kind, convert",
    [
        ("string", lambda c: F.date_format(c, "yyyy-MM-dd")),
        ("int", lambda c: F.date_format(c, "yyyyMMdd").cast("int")),
        ("timestamp", lambda c: F.to_timestamp(c)),
    ],
)
def test_snapshot_literals_follow_the_date_column_type(hh, kind, convert):
    typed = hh.withColumn("DAILY_TIME_KEY", convert(F.col("DAILY_TIME_KEY")))
    assert typed.schema["DAILY_TIME_KEY"].dataType.simpleString().startswith(kind)
    got = QUERIES["cut_kids"](typed, SNAPS).drop("DAILY_TIME_KEY")
    want = QUERIES["cut_kids"](hh, SNAPS).drop("DAILY_TIME_KEY")
    assert _sorted(got) == _sorted(want)
    # The column itself is never cast, so the filter stays prunable.
    assert len(snapshot_literals(typed, SNAPS)) == 2


def test_integer_date_partitions_are_pruned(spark, hh, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    path = str(tmp_path / "int_keyed")
    keyed = hh.drop("HOUSEHOLD_ROW_ID").withColumn(
        "DAILY_TIME_KEY", F.date_format("DAILY_TIME_KEY", "yyyyMMdd").cast("int")
    )
    write_household_history(keyed, path)
    table = spark.read.parquet(path)
    plan = QUERIES["cut_kids"](table, SNAPS)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(DAILY_TIME_KEY" in plan or "PartitionFilters: [DAILY_TIME_KEY" in plan
    assert "20250331" in plan and "cast(DAILY_TIME_KEY" not in plan


def test_catalog_table(spark, hh):
    hh.createOrReplaceTempView("household_daily_history_test")
    df = household_table(spark, "household_daily_history_test")
    assert _sorted(QUERIES["cut_bulk"](df, SNAPS)) == _sorted(QUERIES["cut_bulk"](hh, SNAPS))


def test_writer_spreads_a_hot_block_over_several_files(spark, hh, tmp_path):
    # Nine in ten households sit in one block group.
    hot = hh.withColumn(
        "CENSUS_BLOCK_GROUP",
        F.when(F.col("HOUSEHOLD_ROW_ID") % 10 != 0, F.lit("000000000042")).otherwise(F.col("CENSUS_BLOCK_GROUP")),
    ).drop("HOUSEHOLD_ROW_ID")
    path = str(tmp_path / "hot")
    write_household_history(hot, path, partitions=8)
    day = spark.read.parquet(f"{path}/DAILY_TIME_KEY=2025-03-31")
    files = day.select(F.input_file_name().alias("f"), "CENSUS_BLOCK_GROUP").where(
        F.col("CENSUS_BLOCK_GROUP") == "000000000042"
    )
    assert files.select("f").distinct().count() > 1
    assert spark.read.parquet(path).count() == hot.count()


def test_schema_follows_the_column_map(spark, hh, tmp_path):
    path = str(tmp_path / "mapped")
    user = {"unit_type": "DWELLING_SEGMENT", "day": "DAILY_TIME_KEY"}
    stored = hh.drop("HOUSEHOLD_ROW_ID").withColumnsRenamed({v: k for k, v in user.items()})
    stored.withColumn("day", F.date_format("day", "yyyyMMdd").cast("int")).write.partitionBy("day").parquet(path)
    back = read_household_history(spark, path, column_map=user, date_type=T.IntegerType())
    assert set(back.columns) == set(HOUSEHOLD_SCHEMA.names)
    got = QUERIES["cut_dwelling"](back, SNAPS).drop("DAILY_TIME_KEY")
    assert _sorted(got) == _sorted(QUERIES["cut_dwelling"](hh, SNAPS).drop("DAILY_TIME_KEY"))


def test_text_snapshots_match_a_text_key_as_they_stand(hh):
    typed = hh.withColumn("DAILY_TIME_KEY", F.date_format("DAILY_TIME_KEY", "yyyyMMdd"))
    got = QUERIES["cut_kids"](typed, ("20250331", "20240331")).drop("DAILY_TIME_KEY")
    assert _sorted(got) == _sorted(QUERIES["cut_kids"](hh, SNAPS).drop("DAILY_TIME_KEY"))
