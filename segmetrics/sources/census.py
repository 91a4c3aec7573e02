"""Attach block-group census attributes (e.g. ACS) to household rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import BLOCK


class DuplicateKeyError(ValueError):
    """The attribute table has more than one row for some block group."""


def duplicate_keys(attributes: DataFrame, on: str = BLOCK) -> DataFrame:
    """Block groups that occur more than once (a distributed aggregate)."""
    return attributes.groupBy(on).count().where(F.col("count") > 1)


def enrich_with_census(
    households: DataFrame, attributes: DataFrame, on: str = BLOCK, check_keys: bool = True
) -> DataFrame:
    """Left join of households to one attribute row per block group.

    Raises ``DuplicateKeyError`` when ``attributes`` repeats a key, since a
    repeated key would silently multiply households. That check is one
    aggregate job over the attribute table; ``check_keys=False`` skips it
    where the keys are known to be unique, and the result is then lazy. The
    join is left to Spark: broadcast if the measured size allows it, else
    shuffled, with AQE splitting a hot block's partition. Households with a
    NULL block group match nothing; a row hash spreads them over the
    partitions, where their common NULL key would send them all to one.
    """
    overlap = (set(households.columns) & set(attributes.columns)) - {on}
    if overlap:
        raise ValueError(f"columns on both sides: {sorted(overlap)}")
    if check_keys and not duplicate_keys(attributes, on).isEmpty():
        raise DuplicateKeyError(f"attribute table repeats {on} values")
    spread = F.when(F.col(on).isNull(), F.xxhash64(*[c for c in households.columns if c != on])).otherwise(F.lit(0))
    left = households.withColumn("_spread", spread.cast("long"))
    right = attributes.withColumn("_spread", F.lit(0).cast("long"))
    return left.join(right, [on, "_spread"], "left").drop("_spread")
