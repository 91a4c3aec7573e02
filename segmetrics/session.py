"""Session settings and lineage cutting.

The library never overrides a cluster's configuration. ``local_session`` is
for tests and the bench only; on a cluster, set the ``RECOMMENDED_CONF``
entries in the job's own configuration.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning: coalesce tiny shuffle outputs (every cut's result is a
# handful of rows), split skewed join partitions, convert joins to broadcast
# only from measured shuffle sizes.
RECOMMENDED_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(
    cpus: int | str = "*",
    app: str = "segmetrics",
    shuffle_partitions: int = 8,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the session names, if any."""
    try:
        found = spark.sparkContext.getCheckpointDir()
    except Exception:  # e.g. Spark Connect: only the configuration is visible
        found = None
    return found or spark.conf.get("spark.checkpoint.dir", None)


def _is_local(spark: SparkSession) -> bool:
    return str(spark.conf.get("spark.master", "")).startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; create one only in local mode.

    A cluster must name a shared folder in ``spark.checkpoint.dir``; a
    machine-local temporary folder would not survive the loss of the node.
    """
    found = checkpoint_dir(spark)
    if found:
        return found
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before materializing results")
    path = tempfile.mkdtemp(prefix="segmetrics-ckpt-")
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()``: a lost executor re-reads the written
    files instead of re-running the scan that produced them. Unlike an RDD
    checkpoint the table is columnar, so each later job reads only the
    columns it needs, with the vectorized reader and real size statistics
    for the planner. Used for small results several jobs read (the segment
    cube, the demographic pull). ``codec`` overrides the session's Parquet
    compression.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.parquet(path)
