"""Incremental block bulk status: streamed days equal the batch aggregate."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import CUR, OLD, PRI
from segmetrics.operators.blocks import block_bulk_status, cut_block_bulk
from segmetrics.streaming.block_bulk import block_bulk_table, household_stream, refresh_block_bulk


def _land_day(df, root: str, day) -> None:
    df.where(F.col("DAILY_TIME_KEY") == day).drop("HOUSEHOLD_ROW_ID").write.parquet(f"{root}/day={day}")


def _status(df) -> set[tuple]:
    return {tuple(r) for r in df.collect()}


def test_stream_refresh_is_incremental_and_exact(spark, hh, tmp_path):
    landing, table, ckpt = str(tmp_path / "landing"), str(tmp_path / "status"), str(tmp_path / "ckpt")
    for day in (OLD, PRI):
        _land_day(hh, landing, day)
    refresh_block_bulk(household_stream(spark, landing), table, ckpt)
    two_days = hh.where(F.col("DAILY_TIME_KEY").isin(OLD, PRI))
    assert _status(block_bulk_table(spark, table)) == _status(block_bulk_status(two_days))

    # A new day lands; the next run reads only that day's files.
    _land_day(hh, landing, CUR)
    refresh_block_bulk(household_stream(spark, landing), table, ckpt)
    assert _status(block_bulk_table(spark, table)) == _status(block_bulk_status(hh))


def test_streamed_status_feeds_the_block_bulk_cut(spark, hh, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "status")
    for day in (OLD, PRI, CUR):
        _land_day(hh, landing, day)
    refresh_block_bulk(household_stream(spark, landing), table, str(tmp_path / "ckpt"))
    status = block_bulk_table(spark, table)
    with_table = cut_block_bulk(hh, (CUR, PRI), status=status)
    from_history = cut_block_bulk(hh, (CUR, PRI))
    assert sorted(map(tuple, with_table.collect())) == sorted(map(tuple, from_history.collect()))


def test_daily_job_chain(spark, hh, tmp_path):
    """The README's daily job, end to end, on the small fixture."""
    from segmetrics.operators.blocks import demographic_pull
    from segmetrics.operators.stats import demographic_correlation
    from segmetrics.plans.workbench import penetration_workbench
    from segmetrics.session import materialize
    from segmetrics.sources.export import export_csv

    landing, status_path, out = str(tmp_path / "landing"), str(tmp_path / "status"), str(tmp_path / "out")
    for day in (OLD, PRI, CUR):
        _land_day(hh, landing, day)
    df = hh.drop("HOUSEHOLD_ROW_ID")
    snaps = (CUR, PRI)
    refresh_block_bulk(household_stream(spark, landing), status_path)
    status = block_bulk_table(spark, status_path)
    cuts = penetration_workbench(df, snaps, status=status)
    full = penetration_workbench(df, snaps)
    assert _status(cuts["cut_block_bulk"]) == _status(full["cut_block_bulk"])
    pull = materialize(demographic_pull(df, snaps), "pull")
    demographic_correlation(pull).write.parquet(f"{out}/correlation")
    export_csv(pull, f"{out}/pull_csv")
    assert spark.read.parquet(f"{out}/correlation").count() == 55 * 54 // 2
    assert spark.read.option("header", True).csv(f"{out}/pull_csv").count() == pull.count()


def test_rerun_without_new_files_changes_nothing(spark, hh, tmp_path):
    landing, table, ckpt = str(tmp_path / "landing"), str(tmp_path / "status"), str(tmp_path / "ckpt")
    for day in (OLD, PRI, CUR):
        _land_day(hh, landing, day)
    refresh_block_bulk(household_stream(spark, landing), table, ckpt)
    before = _status(block_bulk_table(spark, table))
    versions = spark.read.parquet(table).select("epoch").distinct().count()
    refresh_block_bulk(household_stream(spark, landing), table, ckpt)  # a retried daily run
    assert _status(block_bulk_table(spark, table)) == before
    assert spark.read.parquet(table).select("epoch").distinct().count() == versions


def test_unpublished_versions_are_not_read(spark, hh, tmp_path):
    landing, table, ckpt = str(tmp_path / "landing"), str(tmp_path / "status"), str(tmp_path / "ckpt")
    _land_day(hh, landing, CUR)
    refresh_block_bulk(household_stream(spark, landing), table, ckpt)
    before = _status(block_bulk_table(spark, table))
    # A run that failed after some files of its version: no mark was written.
    half = spark.createDataFrame([("000000000001", 1, 99)], "CENSUS_BLOCK_GROUP string, has_bulk_flag int, epoch long")
    half.write.parquet(f"{table}/epoch=99")
    assert _status(block_bulk_table(spark, table)) == before


def _versions(spark, landing, table, ckpt, hh, days, files=None):
    for day in days:
        _land_day(hh, landing, day)
        refresh_block_bulk(household_stream(spark, landing), table, ckpt, files)


def _rows_in(path):
    import glob

    import pyarrow.parquet as pq

    return sum(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/part-*.parquet"))


def test_old_versions_go_and_a_running_reader_does_not_fail(spark, hh, tmp_path):
    import datetime as dt

    from segmetrics.streaming.block_bulk import retire_versions

    table, landing = str(tmp_path / "status"), str(tmp_path / "landing")
    assert retire_versions(spark, table) == []
    _versions(spark, landing, table, str(tmp_path / "ckpt"), hh, [OLD])
    reader = block_bulk_table(spark, table)  # planned now, read to the end later
    first = _status(reader)
    _versions(spark, landing, table, str(tmp_path / "ckpt"), hh, [PRI, CUR])
    whole = _status(block_bulk_status(hh))

    # Within the readers' time nothing goes, however few versions are kept.
    assert retire_versions(spark, table, keep=1) == []
    assert _status(reader) == first

    later = dt.datetime.now() + dt.timedelta(days=2)
    assert retire_versions(spark, table, keep=3, now=later) == []
    assert retire_versions(spark, table, keep=2, now=later) == [0]
    assert retire_versions(spark, table, keep=2, now=later) == []  # done once
    assert _rows_in(f"{table}/epoch=0") == 0 and _rows_in(f"{table}/epoch=1") > 0
    assert _status(block_bulk_table(spark, table)) == whole

    # The next run of the stream goes on as before.
    more = hh.where(F.col("DAILY_TIME_KEY") == OLD).withColumn("BULK_FLG", F.lit(1)).drop("HOUSEHOLD_ROW_ID")
    more.write.parquet(f"{landing}/day=late")
    refresh_block_bulk(household_stream(spark, landing), table, str(tmp_path / "ckpt"))
    assert retire_versions(spark, table, keep=2, now=later) == [1]
    assert _status(block_bulk_table(spark, table)) == _status(block_bulk_status(hh.drop("HOUSEHOLD_ROW_ID").unionByName(more)))


def test_a_retirement_that_failed_is_taken_up_again(spark, hh, tmp_path):
    import datetime as dt

    from segmetrics.streaming import block_bulk

    table = str(tmp_path / "status")
    _versions(spark, str(tmp_path / "landing"), table, str(tmp_path / "ckpt"), hh, [OLD, PRI])
    block_bulk._mark(spark, [0], f"{table}.retired")  # marked, but the files are still there
    later = dt.datetime.now() + dt.timedelta(days=2)
    assert block_bulk.retire_versions(spark, table, keep=1, now=later) == [0]
    assert _rows_in(f"{table}/epoch=0") == 0
    with pytest.raises(ValueError, match="always kept"):
        block_bulk.retire_versions(spark, table, keep=0)


def test_versions_can_be_compacted(spark, hh, tmp_path):
    import glob

    table = str(tmp_path / "status")
    _versions(spark, str(tmp_path / "landing"), table, str(tmp_path / "ckpt"), hh, [OLD], files=1)
    assert len(glob.glob(f"{table}/epoch=0/part-*.parquet")) == 1
    assert _status(block_bulk_table(spark, table)) == _status(block_bulk_status(hh.where(F.col("DAILY_TIME_KEY") == OLD)))
