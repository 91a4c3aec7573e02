"""Arrow batches sized for whole texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` texts to a Python worker at once, unless the session says otherwise.

    Spark's default of 10,000 rows is meant for numbers; of documents that is
    tens of megabytes, held several times over in the executor and its workers.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(rows))
