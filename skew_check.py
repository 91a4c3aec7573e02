"""Skew check: one block group holds a third of all households.

    python skew_check.py [sf_dir]

Rewrites the derived household table in memory so that every third
household sits in one block group (and, for the census join, another third
has no block group), runs the block-keyed operators, and reads task times
and shuffle reads per stage from Spark's event log (written to a scratch
folder). A stage whose slowest task is far above its median would mean one
task received the hot block's rows. The census join runs with broadcasting
disabled, so the shuffled join and AQE's skew split are what is measured.
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import tempfile

import zstandard
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from segmetrics.plans.catalog import QUERIES
from segmetrics.plans.workbench import penetration_workbench
from segmetrics.session import RECOMMENDED_CONF, ensure_checkpoint_dir
from segmetrics.sources.census import enrich_with_census
from segmetrics.sources.fixture import SNAPSHOTS, household_fixture
from segmetrics.sources.schema import DEMOGRAPHIC_COLUMNS

HOT = "000000000042"


def session(event_dir: str) -> SparkSession:
    b = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", event_dir)
    )
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def worst_stages(event_dir: str) -> dict[str, tuple]:
    path = [p for p in glob.glob(f"{event_dir}/*/*") if "events" in os.path.basename(p)][0]
    raw = open(path, "rb").read()
    text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read().decode() if path.endswith(".zstd") else raw.decode()
    group_of, tasks = {}, {}
    for line in text.splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            for s in e["Stage IDs"]:
                group_of[s] = e.get("Properties", {}).get("spark.jobGroup.id")
        elif e["Event"] == "SparkListenerTaskEnd":
            info = e["Task Info"]
            read = e.get("Task Metrics", {}).get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
            tasks.setdefault(e["Stage ID"], []).append((info["Finish Time"] - info["Launch Time"], read))
    worst: dict[str, tuple] = {}
    for stage, ts in tasks.items():
        group = group_of.get(stage)
        if not group or len(ts) < 4:
            continue
        times = [t for t, _ in ts]
        reads = [r for _, r in ts]
        ratio = max(times) / max(statistics.median(times), 1)
        if ratio > worst.get(group, (0.0,))[0]:
            worst[group] = (round(ratio, 1), len(ts), max(reads), statistics.median(reads))
    return worst


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    event_dir = tempfile.mkdtemp(prefix="segmetrics-events-")
    spark = session(event_dir)
    hh = household_fixture(spark, sf_dir)
    third = F.col("HOUSEHOLD_ROW_ID") % 3
    hot = hh.withColumn("CENSUS_BLOCK_GROUP", F.when(third == 0, F.lit(HOT)).otherwise(F.col("CENSUS_BLOCK_GROUP")))

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def census_join() -> None:
        acs = (
            hh.where((F.col("DAILY_TIME_KEY") == F.lit(SNAPSHOTS[0])) & F.col("CENSUS_BLOCK_GROUP").isNotNull())
            .select("CENSUS_BLOCK_GROUP", *DEMOGRAPHIC_COLUMNS)
            .distinct()
        )
        with_nulls = hot.withColumn(
            "CENSUS_BLOCK_GROUP", F.when(third == 1, F.lit(None)).otherwise(F.col("CENSUS_BLOCK_GROUP"))
        ).select("DAILY_TIME_KEY", "CENSUS_BLOCK_GROUP", "DWELLING_SEGMENT", "CUSTOMER_FLAG")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        run(enrich_with_census(with_nulls, acs).groupBy("TOTAL_HOUSEHOLDS").count())

    jobs = {
        "cut_block_bulk": lambda: run(QUERIES["cut_block_bulk"](hot, SNAPSHOTS)),
        "block_group_summary": lambda: run(QUERIES["block_group_summary"](hot, SNAPSHOTS)),
        "demographic_pull": lambda: run(QUERIES["demographic_pull"](hot, SNAPSHOTS)),
        "workbench": lambda: [run(d) for d in penetration_workbench(hot, SNAPSHOTS).values()],
        "census_join_shuffled": census_join,
    }
    for name, job in jobs.items():
        spark.sparkContext.setJobGroup(name, name)
        job()
    spark.stop()
    print("| operator | worst stage: max / median task time | tasks | max / median shuffle records read |")
    print("| --- | --- | --- | --- |")
    for name, (ratio, n, rmax, rmed) in worst_stages(event_dir).items():
        print(f"| {name} | {ratio} | {n} | {rmax} / {rmed:g} |")


if __name__ == "__main__":
    main(sys.argv[1:])
