"""Incremental upkeep of the full-history block bulk status.

``MAX(BULK_FLG)`` per block group over every stored day is the only input
that needs the whole history. As new daily files land, a Structured
Streaming aggregation keeps it current without rescanning the past: the
state store holds one running maximum per block group (bounded by the
number of block groups, so no watermark is needed), and each trigger writes
the complete state as a new table version.

Run it as a daily job with ``availableNow``: it consumes the files that
arrived since the last run, updates the state and stops. The checkpoint
location lives in the session's shared checkpoint folder, so the job
survives driver and executor loss and never reprocesses a file.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dimensions import BLOCK_BULK_LABELS
from ..session import ensure_checkpoint_dir
from ..sources.fixture import household_fixture_stream
from ..sources.schema import BLOCK, BULK, HOUSEHOLD_SCHEMA

EPOCH = "epoch"
PUBLISHED_AT = "published_at"
# Versions that are always kept, and the longest time a reader may take.
KEPT_VERSIONS = 2
READER_TIME = dt.timedelta(days=1)


def running_bulk_max(households: DataFrame) -> DataFrame:
    """Streaming ``(CENSUS_BLOCK_GROUP, has_bulk_flag)`` over a household stream."""
    return households.groupBy(BLOCK).agg(F.max(BULK).alias("has_bulk_flag"))


def _published(spark: SparkSession, table_path: str) -> DataFrame | None:
    """Epochs whose version is complete, with the time of their mark; None before the first."""
    return _marks(spark, f"{table_path}.published")


def _marks(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{EPOCH} long, {PUBLISHED_AT} timestamp").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _mark(spark: SparkSession, epochs: list[int], path: str) -> None:
    rows = spark.createDataFrame([(e,) for e in epochs], f"{EPOCH} long").coalesce(1)
    rows.withColumn(PUBLISHED_AT, F.current_timestamp()).write.mode("append").parquet(path)


def _write_version(table_path: str, files: int | None):
    def write(batch: DataFrame, epoch_id: int) -> None:
        # Complete state of this epoch into its own folder, then its mark. A
        # retried epoch rewrites an unmarked folder, which no reader looks at,
        # and leaves a marked one alone: it holds the same state.
        spark = batch.sparkSession
        marks = _published(spark, table_path)
        if marks is not None and not marks.where(F.col(EPOCH) == epoch_id).isEmpty():
            return
        rows = batch.withColumn(EPOCH, F.lit(epoch_id).cast("long"))
        if files is not None:
            rows = rows.coalesce(files)
        rows.write.mode("overwrite").parquet(f"{table_path}/{EPOCH}={epoch_id}")
        _mark(spark, [epoch_id], f"{table_path}.published")

    return write


def refresh_block_bulk(
    households: DataFrame,
    table_path: str,
    checkpoint_location: str | None = None,
    files: int | None = None,
) -> None:
    """Fold newly arrived household rows into the status table; return when done.

    ``households`` is a streaming DataFrame with ``CENSUS_BLOCK_GROUP`` and
    ``BULK_FLG`` (e.g. ``household_stream``). The default checkpoint location
    is derived from ``table_path`` inside the session's checkpoint folder. The state
    has a partition per shuffle partition; ``files`` compacts a version to so many files.
    """
    spark = households.sparkSession
    if checkpoint_location is None:
        base = ensure_checkpoint_dir(spark).rstrip("/")
        checkpoint_location = f"{base}/block_bulk_stream-{uuid.uuid5(uuid.NAMESPACE_URL, table_path).hex}"
    query = (
        running_bulk_max(households)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint_location)
        .foreachBatch(_write_version(table_path, files))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def household_stream(spark: SparkSession, path: str, schema: T.StructType = HOUSEHOLD_SCHEMA) -> DataFrame:
    """New household files under ``path`` as a stream (explicit schema)."""
    return spark.readStream.schema(schema).parquet(path)


def block_bulk_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The latest published status version as ``(CENSUS_BLOCK_GROUP, block_bulk_status)``.

    Ready to pass as ``status=`` to ``cut_block_bulk`` / ``segment_cube`` so
    a daily run skips the full-history scan. Versions without a mark
    (still being written, or of a failed run) are not looked at.
    """
    marks = _published(spark, table_path)
    if marks is None:
        raise FileNotFoundError(f"no published version of {table_path}")
    latest = marks.agg(F.max(EPOCH)).first()[0]
    has_bulk, no_bulk = BLOCK_BULK_LABELS
    return spark.read.parquet(f"{table_path}/{EPOCH}={latest}").select(
        BLOCK,
        F.when(F.col("has_bulk_flag") == 1, has_bulk).otherwise(no_bulk).alias("block_bulk_status"),
    )


def retire_versions(
    spark: SparkSession,
    table_path: str,
    keep: int = KEPT_VERSIONS,
    reader_time: dt.timedelta = READER_TIME,
    now: dt.datetime | None = None,
) -> list[int]:
    """Remove the rows of old status versions; return the epochs removed.

    A version goes only if ``keep`` newer ones are published and the version right after it was
    published more than ``reader_time`` ago. A reader takes the newest version, so whoever
    still reads this one began before its successor was published: readers that take no
    longer than ``reader_time`` never lose a file. A version is marked as retired before its files go, and one that
    a failed run left marked is emptied by the next run. Unpublished folders are left alone.
    """
    if keep < 1:
        raise ValueError("the newest version is always kept")
    published = _published(spark, table_path)
    if published is None:
        return []
    by_age = Window.orderBy(F.desc(EPOCH))  # one row per version of the table
    ranked = published.groupBy(EPOCH).agg(F.min(PUBLISHED_AT).alias(PUBLISHED_AT)).select(
        EPOCH, F.row_number().over(by_age).alias("age"), F.lag(PUBLISHED_AT).over(by_age).alias("succeeded_at")
    )
    limit = (F.current_timestamp() if now is None else F.lit(now)) - F.lit(reader_time)
    # Marks of earlier releases have no time; their versions are old.
    old = ranked.where((F.col("age") > keep) & (F.col("succeeded_at").isNull() | (F.col("succeeded_at") < limit)))
    retired = f"{table_path}.retired"
    emptied = _marks(spark, f"{retired}.emptied")
    if emptied is not None:
        old = old.join(emptied.select(EPOCH).distinct(), EPOCH, "left_anti")
    epochs = sorted(r[EPOCH] for r in old.select(EPOCH).collect())
    if not epochs:
        return []
    _mark(spark, epochs, retired)
    for epoch in epochs:
        version = f"{table_path}/{EPOCH}={epoch}"
        spark.createDataFrame([], f"{BLOCK} string, has_bulk_flag int, {EPOCH} long").write.mode("overwrite").parquet(version)
    _mark(spark, epochs, f"{retired}.emptied")
    return epochs


def streamed_block_bulk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every block after streaming the test tables' history once.

    The lineitem files are read as a file stream, turned into household rows
    (stream-static join with ``part``), folded into the running maximum and
    written as a status version; the latest version is returned.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    table = f"{base}/block_bulk_status-{uuid.uuid4().hex}"
    households = household_fixture_stream(spark, sf_dir).select(BLOCK, BULK)
    refresh_block_bulk(households, table, checkpoint_location=f"{table}-checkpoint")
    return block_bulk_table(spark, table)
