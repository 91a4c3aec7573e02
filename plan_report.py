"""Physical-plan facts of every workbench query on the production layout.

    python plan_report.py [sf_dir] > PLANS.md

Lands the derived household table as Parquet partitioned by date (clustered
by block), runs each of the 29 statements plus the workbench cube on it, and
tabulates the final adaptive plan: file scans, partition pruning, pushed
filters, columns read, shuffles, join strategies, Python operators.
"""

from __future__ import annotations

import re
import sys
import tempfile

from segmetrics.plans.analyses import ANALYSES
from segmetrics.plans.catalog import QUERIES
from segmetrics.plans.workbench import segment_cube
from segmetrics.session import local_session
from segmetrics.sources.fixture import SNAPSHOTS, household_fixture
from segmetrics.sources.household import read_household_history, write_household_history


def final_plan(df) -> str:
    """The executed adaptive plan after the query ran (its final form)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def facts(df) -> dict:
    text = final_plan(df)
    final = text.split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan parquet" in line]
    pruned = sum("PartitionFilters: [" in s and "PartitionFilters: []" not in s for s in scans)
    read_cols = [len(re.search(r"ReadSchema: struct<([^>]*)>", s).group(1).split(",")) for s in scans]
    pushed = sum("PushedFilters: [" in s and "PushedFilters: []" not in s for s in scans)
    joins = sorted({j for j in re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", final)})
    return {
        "scans": len(scans),
        "pruned": pruned,
        "pushed": pushed,
        "cols": "/".join(map(str, read_cols)),
        "shuffles": final.count("Exchange hashpartitioning") + final.count("Exchange rangepartitioning"),
        "broadcasts": final.count("BroadcastExchange"),
        "joins": ", ".join(joins) or "-",
        "python": "yes" if re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas", final) else "no",
    }


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    path = tempfile.mkdtemp(prefix="segmetrics-plans-") + "/household_daily_history"
    write_household_history(household_fixture(spark, sf_dir).drop("HOUSEHOLD_ROW_ID"), path, partitions=24)
    table = read_household_history(spark, path)
    rows = {k: facts(q(table, SNAPSHOTS)) for k, q in QUERIES.items()}
    rows["(workbench) segment_cube"] = facts(segment_cube(table, SNAPSHOTS))
    print("# Plans on the production layout\n")
    print(f"Generated by `python plan_report.py {sf_dir}`: the derived household table written as Parquet")
    print("partitioned by `DAILY_TIME_KEY` (three stored days, clustered by block group), each query run")
    print("once, facts read from the final adaptive plan. *scans*: file scans; *pruned*: scans with")
    print("partition filters (two of three days read); *pushed*: scans with pushed Parquet filters;")
    print("*cols*: columns read per scan; *shuffles*: hash/range exchanges; *python*: any Python")
    print("operator in the plan.\n")
    print("| query | scans | pruned | pushed | cols | shuffles | broadcasts | joins | python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for k, f in rows.items():
        print(
            f"| {k} | {f['scans']} | {f['pruned']} | {f['pushed']} | {f['cols']} | {f['shuffles']} "
            f"| {f['broadcasts']} | {f['joins']} | {f['python']} |"
        )
    print("\n## Follow-up analyses\n")
    print("Same facts for the analyses. Several of them first write an intermediate table (block status,")
    print("segment cube, stacked cuts, pull) to the checkpoint folder; the plan below is the final query")
    print("over those tables, so its scans include them. *python* is `yes` where the statistics run numpy")
    print("inside `mapInPandas`.\n")
    print("| analysis | scans | pruned | pushed | cols | shuffles | broadcasts | joins | python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for k, q in ANALYSES.items():
        f = facts(q(table, SNAPSHOTS))
        print(
            f"| {k} | {f['scans']} | {f['pruned']} | {f['pushed']} | {f['cols']} | {f['shuffles']} "
            f"| {f['broadcasts']} | {f['joins']} | {f['python']} |"
        )
    print("\n## Final plans of four representative queries\n")
    print("`*(n)` marks operators compiled into whole-stage-codegen stage n; long lines are cut at 150 characters.")
    samples = {
        "xtab_dwelling_family": QUERIES["xtab_dwelling_family"](table, SNAPSHOTS),
        "cut_block_bulk": QUERIES["cut_block_bulk"](table, SNAPSHOTS),
        "demographic_pull": QUERIES["demographic_pull"](table, SNAPSHOTS),
        "(workbench) segment_cube": segment_cube(table, SNAPSHOTS),
    }
    for name, df in samples.items():
        tree = final_plan(df).split("== Initial Plan ==")[0]
        lines = [ln[:150] for ln in tree.splitlines() if ln.strip() not in ("", "+-")]
        print(f"\n### {name}\n\n```\n" + "\n".join(lines) + "\n```")


if __name__ == "__main__":
    main(sys.argv[1:])
