"""Stored daily aggregates: all 27 cuts of any two days without reading a household.

Two small tables under one folder, both partitioned by day and written a day at a
time by overwriting that day's partition, so a repeated or late run of a day leaves the others alone:

- ``segments``: the segment cube of the day (labels and guard bits, households and
  customers; bounded by the label vocabularies), for the 26 cuts by household labels;
- ``blocks``: one row per block group with the day's households, customers and largest
  bulk flag. The block status of all days is the largest of these, and the
  block-bulk cut joins it to the two days asked for, at block grain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dimensions import BLOCK_BULK
from ..functions.measures import customers, flag_eq_1, households, ratio
from ..operators.blocks import block_bulk_status
from ..sources.household import Snapshot, snapshot_filter
from ..sources.schema import BLOCK, BULK, DATE
from .catalog import CUTS, CutSpec
from .workbench import grouping_sets, rollup, segment_cube


def _by_labels(specs: Sequence[CutSpec]) -> list[CutSpec]:
    return [spec for spec in specs if BLOCK_BULK not in spec.dims]


def refresh_days(df: DataFrame, days: Sequence[Snapshot], path: str, specs: Sequence[CutSpec] = CUTS) -> None:
    """Aggregate the given days of the household table into the stored tables.

    Reads the days' partitions only. ``specs`` are the cuts that will be asked for.
    """
    per_block = (
        df.where(snapshot_filter(df, days))
        .groupBy(DATE, BLOCK)
        .agg(households().alias("_hh"), customers(flag_eq_1()).alias("_cc"), F.max(BULK).alias(BULK))
    )
    for name, table in (("segments", segment_cube(df, days, specs=_by_labels(specs))), ("blocks", per_block)):
        # A day is a handful of rows (segments) or a row per block: few files per day, and not one per task.
        rows = table.repartitionByRange(DATE, F.xxhash64(*[c for c in table.columns if c != DATE]))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(f"{path}/{name}")


def _stored(spark: SparkSession, path: str, name: str, date_type: T.DataType) -> DataFrame:
    table = spark.read.parquet(f"{path}/{name}")
    return table.withColumn(DATE, F.col(DATE).cast(date_type)) if table.schema[DATE].dataType != date_type else table


def stored_cube(spark: SparkSession, path: str, snapshots: Sequence[Snapshot], date_type: T.DataType = T.DateType()) -> DataFrame:
    """The segment cube of the given days, from their stored partitions."""
    cube = _stored(spark, path, "segments", date_type)
    return cube.where(snapshot_filter(cube, snapshots))


def _block_bulk(spark: SparkSession, path: str, snapshots: Sequence[Snapshot], spec: CutSpec, date_type: T.DataType) -> DataFrame:
    if len(spec.dims) > 1:
        raise ValueError(f"{spec.key}: the stored block table has no household labels")
    blocks, m = _stored(spark, path, "blocks", date_type), spec.measures
    status = block_bulk_status(blocks)
    asked = blocks.where(snapshot_filter(blocks, snapshots) & F.col(BLOCK).isNotNull())
    counts = asked.join(status, BLOCK).groupBy("block_bulk_status", DATE).agg(F.sum("_cc").alias(m.customers), F.sum("_hh").alias(m.households))
    return counts.withColumn(m.penetration, ratio(m.customers, m.households)).select(*spec.columns)


def stored_cuts(
    spark: SparkSession,
    path: str,
    snapshots: Sequence[Snapshot],
    specs: Sequence[CutSpec] = CUTS,
    date_type: T.DataType = T.DateType(),
) -> dict[str, DataFrame]:
    """Every cut of ``specs`` from the stored days, keyed by query name, equal to the direct ones."""
    cube = stored_cube(spark, path, snapshots, date_type)
    return {spec.key: _block_bulk(spark, path, snapshots, spec, date_type) if BLOCK_BULK in spec.dims else rollup(cube, spec) for spec in specs}


def stored_cuts_long(
    spark: SparkSession,
    path: str,
    snapshots: Sequence[Snapshot],
    specs: Sequence[CutSpec] = CUTS,
    date_type: T.DataType = T.DateType(),
) -> DataFrame:
    """All cuts stacked as ``cut, bucket_a, bucket_b, DAILY_TIME_KEY, households, customers, penetration_rate``."""
    labelled = _by_labels(specs)
    long = grouping_sets(stored_cube(spark, path, snapshots, date_type), labelled, [s.key for s in labelled]).withColumnRenamed("tag", "cut")
    for spec in specs:
        if BLOCK_BULK in spec.dims:
            m = spec.measures
            cut = _block_bulk(spark, path, snapshots, spec, date_type)
            long = long.unionByName(
                cut.select(
                    F.lit(spec.key).alias("cut"),
                    F.col(spec.dims[0].column).alias("bucket_a"),
                    F.lit(None).cast("string").alias("bucket_b"),
                    DATE,
                    F.col(m.households).alias("households"),
                    F.col(m.customers).alias("customers"),
                    F.col(m.penetration).alias("penetration_rate"),
                )
            )
    return long
