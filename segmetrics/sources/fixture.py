"""Household fact table derived from the TPC-H-style test tables.

There is no household table under the test data, so one is derived: every
``lineitem`` row becomes a household-day (``h``) and the ``part`` it joins
plays the census block group (``b``). All columns are integer arithmetic,
``CASE``, ``lpad`` and one double division, so Spark and DuckDB produce
bit-equal values (see FIXTURES.md §1).

The same expression table feeds the Spark DataFrame (``household_fixture``)
and the DuckDB oracle (``fixture_cte_sql``), so both engines read one input.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import HOUSEHOLD_COLUMNS

CURRENT = dt.date(2025, 3, 31)
PRIOR = dt.date(2024, 3, 31)
HISTORY_ONLY = dt.date(2023, 3, 31)
SNAPSHOTS = (CURRENT, PRIOR)


def _pct(mod: int, den: int) -> str:
    return f"CASE WHEN b % 89 = 0 THEN NULL ELSE CAST(b % {mod} AS DOUBLE) / {den} END"


# (column, SQL type, expression over h and b); order = FIXTURES.md §1.
FIXTURE_COLUMNS: tuple[tuple[str, str, str], ...] = (
    ("HOUSEHOLD_ROW_ID", "BIGINT", "h"),
    ("DAILY_TIME_KEY", "DATE",
     "CASE WHEN h % 5 IN (0, 1) THEN DATE '2025-03-31' "
     "WHEN h % 5 IN (2, 3) THEN DATE '2024-03-31' ELSE DATE '2023-03-31' END"),
    ("CENSUS_BLOCK_GROUP", "STRING",
     "CASE WHEN b % 97 = 0 THEN NULL ELSE lpad(CAST(b AS STRING), 12, '0') END"),
    ("DWELLING_SEGMENT", "STRING",
     "CASE WHEN h % 11 = 0 THEN NULL WHEN h % 17 = 0 THEN 'MOBILE' "
     "WHEN h % 3 = 0 THEN 'APARTMENT' ELSE 'HOUSE' END"),
    ("BULK_FLG", "INT",
     "CASE WHEN h % 13 = 0 THEN NULL WHEN b % 7 = 0 AND h % 2 = 0 THEN 1 "
     "WHEN b % 7 = 1 AND h % 5 = 4 THEN 1 ELSE 0 END"),
    ("CUSTOMER_KEY", "BIGINT",
     "CASE WHEN h % 19 = 0 THEN NULL WHEN h % 23 = 0 THEN -1 "
     "WHEN (h + b) % 4 = 0 THEN 0 ELSE 1000 + h END"),
    ("CUSTOMER_FLAG", "INT",
     "CASE WHEN h % 29 = 0 THEN NULL WHEN (h + b) % 4 = 0 THEN 0 ELSE 1 END"),
    ("TOTAL_HOUSEHOLDS", "INT",
     "CASE WHEN b % 41 = 0 THEN 0 WHEN b % 43 = 0 THEN NULL ELSE 10 * (1 + b % 20) END"),
    ("TOTAL_POPULATION", "INT",
     "25 * (1 + b % 20) + CASE WHEN b % 10 = 0 AND h % 5 IN (0, 1) THEN 5 ELSE 0 END"),
    ("TOTAL_FAMILIES", "INT", "CASE WHEN b % 47 = 0 THEN NULL ELSE (1 + b % 20) * (b % 11) END"),
    ("TOTAL_LABOR_FORCE", "INT", "b % 17 + b % 8"),
    ("TOTAL_IN_LABOR_FORCE", "INT", "CASE WHEN b % 61 = 0 THEN NULL ELSE b % 17 END"),
    ("PERC_IN_LABOR_FORCE", "DOUBLE", _pct(17, 17)),
    ("TOTAL_NOT_IN_LABOR_FORCE", "INT", "CASE WHEN b % 67 = 0 THEN NULL ELSE b % 8 END"),
    ("PERC_NOT_IN_LABOR_FORCE", "DOUBLE", _pct(8, 8)),
    ("TRANSPORTATION_TOTAL", "INT", "b % 10 + b % 6 + b % 7"),
    ("TRANSPORTATION_DRIVE_ALONE", "INT", "CASE WHEN b % 71 = 0 THEN NULL ELSE b % 10 END"),
    ("TRANSPORTATION_CARPOOL", "INT", "CASE WHEN b % 73 = 0 THEN NULL ELSE b % 6 END"),
    ("TRANSPORTATION_WORK_FROM_HOME", "INT", "CASE WHEN b % 79 = 0 THEN NULL ELSE b % 7 END"),
    ("PERC_WORK_FROM_HOME", "DOUBLE", _pct(7, 7)),
    ("TOTAL_HOUSEHOLD_STATUS", "INT", "10 * (1 + b % 20)"),
    ("TOTAL_OCCUPIED_STATUS", "INT", "9 * (1 + b % 20)"),
    ("PERC_HH_OCCUPIED", "DOUBLE", _pct(9, 9)),
    ("TOTAL_VACANT_STATUS", "INT", "1 + b % 20"),
    ("PERC_HH_VACANT", "DOUBLE", _pct(10, 10)),
    ("TOTAL_OWNER_OCCUPIED", "INT", "5 * (b % 21)"),
    ("PERC_OWNER_OCCUPIED", "DOUBLE",
     "CASE WHEN b % 37 = 0 THEN NULL ELSE CAST(b % 21 AS DOUBLE) / 20 END"),
    ("TOTAL_RENTER_OCCUPIED", "INT", "100 - 5 * (b % 21)"),
    ("PERC_RENTER_OCCUPIED", "DOUBLE", _pct(12, 12)),
    ("TOTAL_MOBILE_HOME", "INT", "b % 4"),
    ("PERC_HH_MOBILE_HOME", "DOUBLE", _pct(14, 14)),
    ("TOTAL_HOME_VALUE", "INT", "b % 3 + b % 5 + b % 9 + b % 14 + b % 15 + b % 16"),
    ("HOME_VALUE_0K_50K", "INT", "b % 3"),
    ("PERC_HOME_VALUE_0K_50K", "DOUBLE", _pct(3, 3)),
    ("HOME_VALUE_50K_100K", "INT", "b % 5"),
    ("PERC_HOME_VALUE_50K_100K", "DOUBLE", _pct(5, 5)),
    ("HOME_VALUE_100K_250K", "INT", "b % 9"),
    ("PERC_HOME_VALUE_100K_250K", "DOUBLE", _pct(18, 18)),
    ("HOME_VALUE_250K_500K", "INT", "b % 14"),
    ("PERC_HOME_VALUE_250K_500K", "DOUBLE", _pct(19, 19)),
    ("HOME_VALUE_500K_1M", "INT", "b % 15"),
    ("PERC_HOME_VALUE_500K_1M", "DOUBLE", _pct(15, 15)),
    ("HOME_VALUE_GREATER_1M", "INT", "b % 16"),
    ("PERC_HOME_VALUE_GREATER_1M", "DOUBLE", _pct(16, 16)),
    ("TOTAL_INTERNET_HOUSEHOLD", "INT", "10 * (1 + b % 20)"),
    ("TOTAL_INTERNET_SUBSCRIPTION", "INT", "7 * (1 + b % 20)"),
    ("PERC_HH_INTERNET_SUBSCRIPTION", "DOUBLE", _pct(22, 22)),
    ("TOTAL_INTERNET_NO_SUBSCRIPTION", "INT", "1 + b % 20"),
    ("PERC_HH_NO_INTERNET_SUBSCRIPTION", "DOUBLE", _pct(23, 23)),
    ("TOTAL_INTERNET_NO_ACCESS", "INT", "2 * (1 + b % 20)"),
    ("PERC_HH_NO_INTERNET_ACCESS", "DOUBLE", _pct(24, 24)),
    ("POP_PER_HH", "DOUBLE", "CAST(4 + b % 13 AS DOUBLE) / 4"),
    ("ADULTS_PER_HH", "DOUBLE", "CAST(4 + b % 5 AS DOUBLE) / 4"),
    ("CHILDREN_PER_HH", "DOUBLE", "CASE WHEN b % 31 = 0 THEN NULL ELSE CAST(b % 9 AS DOUBLE) / 2 END"),
    ("TOTAL_FAMILIES_W_CHILDREN", "INT", "CASE WHEN b % 53 = 0 THEN NULL ELSE b % 13 END"),
    ("TOTAL_FAMILIES_WO_CHILDREN", "INT", "CASE WHEN b % 59 = 0 THEN NULL ELSE b % 12 END"),
    ("PERC_HH_W_CHILDREN", "DOUBLE",
     "CASE WHEN b % 83 = 0 THEN NULL ELSE CAST(b % 33 AS DOUBLE) / 32 END"),
    ("MEDIAN_HH_AGE", "DOUBLE", "CAST(50 + b % 91 AS DOUBLE) / 2"),
    ("TOTAL_EDUCATION", "INT", "20 * (1 + b % 20)"),
    ("TOTAL_DEGREE_BACHELORS_ABOVE", "INT", "3 * (1 + b % 20)"),
    ("PERC_DEGREE_BACHELORS_ABOVE", "DOUBLE", _pct(25, 25)),
)

# The fixture carries every schema column, in schema order, after its row id.
assert tuple(c for c, _, _ in FIXTURE_COLUMNS[1:]) == HOUSEHOLD_COLUMNS


def derive_households(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The household columns over ``lineitem`` joined to ``part`` (batch or stream).

    Plain inner equi-join; Spark picks broadcast or shuffle join from the
    part table's size, and AQE splits a skewed part key. Column pruning
    drops every derived column a query does not read, so a cut over two
    columns only reads ``l_orderkey, l_linenumber, l_partkey, p_partkey``.
    """
    x = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"], "inner").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("h"),
        F.col("p_partkey").alias("b"),
    )
    return x.selectExpr(*[f"CAST({e} AS {t}) AS {c}" for c, t, e in FIXTURE_COLUMNS])


def household_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived household fact table over ``{sf_dir}/lineitem`` and ``part``.

    The scan is read as it is split: one plan at every size.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    pt = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return derive_households(li, pt)


def household_fixture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream: lineitem files as they land, part static."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    li = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "lineitem.parquet")
        .parquet(sf_dir)
        .select("l_orderkey", "l_linenumber", "l_partkey")
    )
    pt = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return derive_households(li, pt)


def fixture_cte_sql() -> str:
    """``hh`` as a DuckDB/ANSI SQL CTE body over the pre-registered views."""
    cols = ",\n    ".join(f"CAST({e} AS {t}) AS {c}" for c, t, e in FIXTURE_COLUMNS)
    return (
        "SELECT\n    " + cols + "\nFROM (SELECT l.l_orderkey * 8 + l.l_linenumber AS h, "
        "p.p_partkey AS b FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) x"
    )
