"""segmetrics: subscriber penetration by household and census-block segment, on Spark.

The household fact table has one row per household per day, enriched with
census block-group demographics. Every query keeps two snapshot dates and
measures households, customers and their ratio per demographic bucket.
"""

from .functions.dimensions import DIMENSIONS, Dimension, custom_dimension
from .operators.blocks import block_bulk_status, block_group_summary, cut_block_bulk, demographic_pull
from .operators.penetration import Measures, penetration_by
from .plans.catalog import CUTS, CUTS_BY_KEY, QUERIES
from .sources.household import household_table, read_household_history, write_household_history

__all__ = [
    "CUTS",
    "CUTS_BY_KEY",
    "DIMENSIONS",
    "Dimension",
    "Measures",
    "QUERIES",
    "block_bulk_status",
    "block_group_summary",
    "custom_dimension",
    "cut_block_bulk",
    "demographic_pull",
    "household_table",
    "penetration_by",
    "read_household_history",
    "write_household_history",
]
