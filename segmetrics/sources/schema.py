"""Schema of the census-enriched household fact table.

One row per household per day. Census attributes belong to the household's
census block group and repeat on every household row of that block.
The source never declares types; the ones below are inferred from how each
column is compared, divided or grouped.
"""

from __future__ import annotations

from pyspark.sql import types as T

DATE = "DAILY_TIME_KEY"
BLOCK = "CENSUS_BLOCK_GROUP"
DWELLING = "DWELLING_SEGMENT"
BULK = "BULK_FLG"
CUSTOMER_KEY = "CUSTOMER_KEY"
CUSTOMER_FLAG = "CUSTOMER_FLAG"

# --- fixed values: column names that must equal the analysed table's -------
# The 55 block-group columns of the wide demographic pull, in output order
# (block group first, then the 54 demographics).
DEMOGRAPHIC_PULL_COLUMNS: tuple[str, ...] = (
    "CENSUS_BLOCK_GROUP",
    "TOTAL_HOUSEHOLDS",
    "TOTAL_POPULATION",
    "TOTAL_FAMILIES",
    "TOTAL_LABOR_FORCE",
    "TOTAL_IN_LABOR_FORCE",
    "PERC_IN_LABOR_FORCE",
    "TOTAL_NOT_IN_LABOR_FORCE",
    "PERC_NOT_IN_LABOR_FORCE",
    "TRANSPORTATION_TOTAL",
    "TRANSPORTATION_DRIVE_ALONE",
    "TRANSPORTATION_CARPOOL",
    "TRANSPORTATION_WORK_FROM_HOME",
    "PERC_WORK_FROM_HOME",
    "TOTAL_HOUSEHOLD_STATUS",
    "TOTAL_OCCUPIED_STATUS",
    "PERC_HH_OCCUPIED",
    "TOTAL_VACANT_STATUS",
    "PERC_HH_VACANT",
    "TOTAL_OWNER_OCCUPIED",
    "PERC_OWNER_OCCUPIED",
    "TOTAL_RENTER_OCCUPIED",
    "PERC_RENTER_OCCUPIED",
    "TOTAL_MOBILE_HOME",
    "PERC_HH_MOBILE_HOME",
    "TOTAL_HOME_VALUE",
    "HOME_VALUE_0K_50K",
    "PERC_HOME_VALUE_0K_50K",
    "HOME_VALUE_50K_100K",
    "PERC_HOME_VALUE_50K_100K",
    "HOME_VALUE_100K_250K",
    "PERC_HOME_VALUE_100K_250K",
    "HOME_VALUE_250K_500K",
    "PERC_HOME_VALUE_250K_500K",
    "HOME_VALUE_500K_1M",
    "PERC_HOME_VALUE_500K_1M",
    "HOME_VALUE_GREATER_1M",
    "PERC_HOME_VALUE_GREATER_1M",
    "TOTAL_INTERNET_HOUSEHOLD",
    "TOTAL_INTERNET_SUBSCRIPTION",
    "PERC_HH_INTERNET_SUBSCRIPTION",
    "TOTAL_INTERNET_NO_SUBSCRIPTION",
    "PERC_HH_NO_INTERNET_SUBSCRIPTION",
    "TOTAL_INTERNET_NO_ACCESS",
    "PERC_HH_NO_INTERNET_ACCESS",
    "POP_PER_HH",
    "ADULTS_PER_HH",
    "CHILDREN_PER_HH",
    "TOTAL_FAMILIES_W_CHILDREN",
    "TOTAL_FAMILIES_WO_CHILDREN",
    "PERC_HH_W_CHILDREN",
    "MEDIAN_HH_AGE",
    "TOTAL_EDUCATION",
    "TOTAL_DEGREE_BACHELORS_ABOVE",
    "PERC_DEGREE_BACHELORS_ABOVE",
)
# The six home-value count columns carried by the block-group summary.
HOME_VALUE_COLUMNS: tuple[str, ...] = (
    "HOME_VALUE_0K_50K",
    "HOME_VALUE_50K_100K",
    "HOME_VALUE_100K_250K",
    "HOME_VALUE_250K_500K",
    "HOME_VALUE_500K_1M",
    "HOME_VALUE_GREATER_1M",
)
# --- end of fixed values -----------------------------------------------------

# The 54 numeric demographics (the pull without the block-group key).
DEMOGRAPHIC_COLUMNS: tuple[str, ...] = DEMOGRAPHIC_PULL_COLUMNS[1:]


def _census_type(name: str) -> T.DataType:
    """Counts are integers; proportions, averages and the median are doubles."""
    if name.startswith("PERC_") or name.endswith("_PER_HH") or name == "MEDIAN_HH_AGE":
        return T.DoubleType()
    return T.IntegerType()


HOUSEHOLD_SCHEMA = T.StructType(
    [
        T.StructField(DATE, T.DateType(), True),
        T.StructField(BLOCK, T.StringType(), True),
        T.StructField(DWELLING, T.StringType(), True),
        T.StructField(BULK, T.IntegerType(), True),
        T.StructField(CUSTOMER_KEY, T.LongType(), True),
        T.StructField(CUSTOMER_FLAG, T.IntegerType(), True),
    ]
    + [T.StructField(c, _census_type(c), True) for c in DEMOGRAPHIC_COLUMNS]
)

HOUSEHOLD_COLUMNS: tuple[str, ...] = tuple(HOUSEHOLD_SCHEMA.fieldNames())
