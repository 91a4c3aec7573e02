"""Tables bucketed by block group: fact, attributes and status join without an exchange.

The household table is clustered once, when a day lands; every later join by
block group then reads matching buckets side by side, however many days
are asked for. Buckets are by (block group, salt): a household's salt is a hash of its
row, so the households of a hot block and those without a block are spread over ``SALTS`` buckets,
and the block-grain side, which is small, is stored once per salt.

Daily use: ``append_households`` writes the new day's partition only,
``write_block_rows`` replaces the block-grain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import BLOCK, DATE

SALT = "BLOCK_SALT"
SALTS = 8
BUCKETS = 32


def _bucketed(df: DataFrame, buckets: int):
    # The partitions of the shuffle are the buckets, so a task writes one file per bucket and day.
    return df.repartition(buckets, BLOCK, SALT).write.bucketBy(buckets, BLOCK, SALT).sortBy(BLOCK, SALT)


def append_households(df: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Append household rows (e.g. a new day) to the fact table ``table`` at ``path``.

    Partitioned by day and bucketed within a day; the first call creates the table. Days
    already there are not rewritten.
    """
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != BLOCK]), F.lit(SALTS)).cast("int")
    rows = df.withColumn(SALT, salt)
    _bucketed(rows, buckets).partitionBy(DATE).mode("append").option("path", path).saveAsTable(table)


def write_block_rows(df: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """(Re)write a table of one row per block group, with its columns, once per salt.

    The number of buckets must be that of the fact table. Rows without a block are left out: they match nothing.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(SALT)
    rows = df.where(F.col(BLOCK).isNotNull()).select("*", salts)
    _bucketed(rows, buckets).mode("overwrite").option("path", path).saveAsTable(table)


def joined_by_block(spark: SparkSession, households: DataFrame | str, *block_tables: str, how: str = "left") -> DataFrame:
    """Households with the columns of each block-grain table; all of them bucketed alike.

    ``households`` is the fact table's name or a selection of its rows that keeps ``BLOCK_SALT``.
    """
    out = spark.table(households) if isinstance(households, str) else households
    for name in block_tables:
        out = out.join(spark.table(name), [BLOCK, SALT], how)
    return out.drop(SALT)
