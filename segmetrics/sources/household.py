"""Reading and writing the household fact table, and typing snapshot dates.

At scale the fact table is Parquet partitioned by ``DAILY_TIME_KEY``: a query
that keeps two snapshots then lists two partition directories
(``PartitionFilters`` in the plan) instead of scanning every stored day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import BLOCK, DATE, HOUSEHOLD_SCHEMA

Snapshot = dt.date | str


def apply_column_map(df: DataFrame, column_map: Mapping[str, str] | None) -> DataFrame:
    """Rename the user's columns to the canonical names (``{user: canonical}``).

    ``withColumnsRenamed`` is a pure projection: it keeps pushdown and pruning.
    """
    if not column_map:
        return df
    return df.withColumnsRenamed(dict(column_map))


def stored_schema(
    column_map: Mapping[str, str] | None = None, date_type: T.DataType | None = None
) -> T.StructType:
    """The canonical schema under the user's column names and date key type."""
    stored_as = {canonical: user for user, canonical in (column_map or {}).items()}
    return T.StructType(
        [
            T.StructField(
                stored_as.get(f.name, f.name),
                date_type if date_type is not None and f.name == DATE else f.dataType,
                f.nullable,
            )
            for f in HOUSEHOLD_SCHEMA.fields
        ]
    )


def read_household_history(
    spark: SparkSession,
    path: str,
    column_map: Mapping[str, str] | None = None,
    schema: T.StructType | None = None,
    date_type: T.DataType | None = None,
) -> DataFrame:
    """Read the fact table with an explicit schema (never inferred).

    ``schema`` describes the files as stored, i.e. in the user's own names
    when ``column_map`` is given; it defaults to the canonical schema under
    those names, with ``date_type`` (e.g. ``IntegerType()`` for ``yyyymmdd``)
    as the type of the date key. Partition discovery keeps ``DAILY_TIME_KEY``
    as a partition column when the files are laid out as
    ``.../DAILY_TIME_KEY=YYYY-MM-DD/``.
    """
    if schema is None:
        schema = stored_schema(column_map, date_type)
    return apply_column_map(spark.read.schema(schema).parquet(path), column_map)


def household_table(
    spark: SparkSession, name: str, column_map: Mapping[str, str] | None = None
) -> DataFrame:
    """The fact table registered in the catalog as ``name`` (canonical names)."""
    return apply_column_map(spark.table(name), column_map)


def write_household_history(
    df: DataFrame, path: str, mode: str = "errorifexists", partitions: int | None = None
) -> None:
    """Land a fact table partitioned by snapshot date, clustered by block group.

    Rows are range-partitioned on (date, block group, row hash): each task
    writes a contiguous block range of one date, so a task writes one or two
    date directories, Parquet row groups carry tight block-group statistics,
    and the wide pull's partial aggregate sees each block in about one task.
    The row hash lets a block holding a large share of a day spread over
    several tasks; it is deterministic, so a retried task rebuilds exactly
    its own rows (a random salt would not).
    """
    tiebreak = F.xxhash64(*[F.col(c) for c in df.columns])
    keys = [F.col(DATE), F.col(BLOCK), tiebreak]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    (
        ranged.sortWithinPartitions(DATE, BLOCK)
        .write.mode(mode)
        .partitionBy(DATE)
        .parquet(path)
    )


def _as_date(value: Snapshot) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def snapshot_literals(df: DataFrame, snapshots: Iterable[Snapshot]) -> list:
    """Convert snapshot dates to the date column's own type.

    Casting the column instead (``to_date(col)``) would hide it from
    partition pruning and Parquet filter pushdown, so the parameters are
    converted here: DATE -> date, TIMESTAMP -> midnight, STRING -> ISO text,
    INT/BIGINT -> ``yyyymmdd``. A STRING key may be in any format: a snapshot
    given as text is then taken as it stands, e.g. ``"20250331"``.
    """
    snapshots = list(snapshots)
    kind = df.schema[DATE].dataType
    if isinstance(kind, T.StringType) and all(isinstance(s, str) for s in snapshots):
        return snapshots
    dates = [_as_date(s) for s in snapshots]
    if isinstance(kind, T.DateType):
        return dates
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return [dt.datetime(d.year, d.month, d.day) for d in dates]
    if isinstance(kind, T.StringType):
        return [d.isoformat() for d in dates]
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return [d.year * 10000 + d.month * 100 + d.day for d in dates]
    raise TypeError(f"unsupported {DATE} type {kind.simpleString()}")


def snapshot_filter(df: DataFrame, snapshots: Sequence[Snapshot]) -> Column:
    """``DAILY_TIME_KEY IN (current, prior, ...)`` with typed literals."""
    return F.col(DATE).isin(snapshot_literals(df, snapshots))
