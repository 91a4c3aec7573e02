"""Follow-up analyses: brute-force checks on the small fixture and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import CUR, PRI, rows
from segmetrics.operators.blocks import demographic_pull
from segmetrics.operators.compare import (
    all_cuts_long,
    all_interactions,
    as_percent,
    to_long,
    interaction_effect,
    min_sample,
    spread_ranking,
    yoy_change,
)
from segmetrics.operators.stats import TARGET, demographic_correlation, predictor_ranking, univariate_regression
from segmetrics.plans.catalog import CUTS_BY_KEY, XTAB
from segmetrics.sources.census import DuplicateKeyError, enrich_with_census
from segmetrics.sources.export import export_csv
from segmetrics.sources.schema import DEMOGRAPHIC_COLUMNS, DEMOGRAPHIC_PULL_COLUMNS

SNAPS = (CUR, PRI)


@pytest.fixture(scope="module")
def pull(hh):
    return demographic_pull(hh, SNAPS).repartition(3).cache()


@pytest.fixture(scope="module")
def pull_pd(pull):
    return pull.toPandas()


def test_long_form_stacks_nine_cuts(hh):
    long = all_cuts_long(hh, SNAPS)
    assert long.columns == ["dimension", "bucket", "DAILY_TIME_KEY", "households", "customers", "penetration_rate"]
    dims = {r[0] for r in long.select("dimension").distinct().collect()}
    assert dims == {"dwelling", "bulk", "block_bulk", "kids", "family_mix", "ownership", "kids_group", "labor",
                    "transport"}
    kids = {(r["bucket"], r["DAILY_TIME_KEY"], r["households"]) for r in long.where("dimension = 'kids'").collect()}
    direct = {(r["kids_bucket"], r["DAILY_TIME_KEY"], r["total_households"])
              for r in CUTS_BY_KEY["cut_kids"].run(hh, SNAPS).collect()}
    assert kids == direct
    as_long = to_long(CUTS_BY_KEY["cut_kids"].run(hh, SNAPS), CUTS_BY_KEY["cut_kids"])
    assert sorted(map(tuple, as_long.collect()), key=repr) == sorted(
        map(tuple, long.where("dimension = 'kids'").collect()), key=repr
    )


def test_yoy_pivots_dates_and_keeps_one_sided_segments(spark):
    cut = spark.createDataFrame(
        [("a", CUR, 10, 5, 0.5), ("a", PRI, 10, 2, 0.2), ("b", CUR, 4, 1, 0.25), (None, PRI, 2, 2, 1.0)],
        "seg string, DAILY_TIME_KEY date, households long, customers long, penetration_rate double",
    )
    got = {r["seg"]: r for r in yoy_change(cut, ["seg"], CUR, PRI).collect()}
    assert math.isclose(got["a"]["penetration_change"], 0.3)
    assert got["b"]["households_prior"] is None and got["b"]["penetration_change"] is None
    assert got[None]["households_current"] is None and got[None]["customers_prior"] == 2


def test_spread_ranking_ties_share_rank(spark):
    long = spark.createDataFrame(
        [("x", CUR, 10, 1, 0.25), ("x", CUR, 10, 5, 0.75), ("y", CUR, 10, 2, 0.0), ("y", CUR, 10, 6, 0.5),
         ("z", CUR, 10, 3, 0.25), ("z", CUR, 2, 2, 1.0)],
        "dimension string, DAILY_TIME_KEY date, households long, customers long, penetration_rate double",
    )
    got = {r["dimension"]: r for r in spread_ranking(long).collect()}
    assert got["z"]["spread_rank"] == 1 and got["x"]["spread_rank"] == got["y"]["spread_rank"] == 2
    kept = {r["dimension"]: r for r in spread_ranking(long, min_households=5).collect()}
    assert kept["z"]["n_buckets"] == 1 and kept["z"]["spread"] == 0.0


def test_interaction_matches_pandas(hh):
    spec = CUTS_BY_KEY["xtab_kids_transport"]
    a, b = (d.column for d in spec.dims)
    got = interaction_effect(spec.run(hh, SNAPS), a, b, spec.measures).toPandas()
    x = got.copy()
    hh_, cc = spec.measures.households, spec.measures.customers
    for name, keys in (("pa", ["DAILY_TIME_KEY", a]), ("pb", ["DAILY_TIME_KEY", b]), ("pall", ["DAILY_TIME_KEY"])):
        g = x.groupby(keys)[[hh_, cc]].transform("sum")
        x[name] = g[cc] / g[hh_]
    expected = x["penetration_rate"] - (x["pa"] + x["pb"] - x["pall"])
    assert np.allclose(got["interaction"], expected, atol=1e-12)


def test_all_interactions_equal_per_cross_tab(hh):
    stacked = all_interactions(hh, SNAPS).cache()
    assert stacked.select("cross_tab").distinct().count() == 18
    for key in ("xtab_dwelling_kids", "xtab_labor_family"):
        spec = CUTS_BY_KEY[key]
        a, b = (d.column for d in spec.dims)
        direct = interaction_effect(spec.run(hh, SNAPS), a, b, spec.measures).collect()
        want = sorted(((r[a], r[b], r["DAILY_TIME_KEY"], r["interaction"]) for r in direct), key=repr)
        got = sorted(
            ((r["bucket_a"], r["bucket_b"], r["DAILY_TIME_KEY"], r["interaction"])
             for r in stacked.where(F.col("cross_tab") == key).collect()),
            key=repr,
        )
        assert got == want


def test_min_sample_filter_and_flag(hh):
    xtab = CUTS_BY_KEY["xtab_kids_transport"].run(hh, SNAPS)
    flagged = min_sample(xtab, XTAB.households, 30, flag=True)
    kept = min_sample(xtab, XTAB.households, 30)
    assert kept.count() == flagged.where(~F.col("small_sample")).count()
    assert flagged.count() == xtab.count()


def test_as_percent(hh):
    cut = CUTS_BY_KEY["cut_kids"].run(hh, SNAPS)
    got = as_percent(cut, ["penetration_rate"]).collect()
    assert [r["penetration_rate"] for r in got] == [r["penetration_rate"] * 100 for r in cut.collect()]


def _pairwise_r(df: pd.DataFrame, a: str, b: str):
    both = df[[a, b]].astype(float).dropna()
    if len(both) < 2 or both[a].nunique() < 2 or both[b].nunique() < 2:
        return len(both), None
    return len(both), float(np.corrcoef(both[a], both[b])[0, 1])


def test_correlation_matches_brute_force(pull, pull_pd):
    got = {(r["col_a"], r["col_b"]): (r["n"], r["r"]) for r in demographic_correlation(pull).collect()}
    cols = [*DEMOGRAPHIC_COLUMNS, TARGET]
    assert len(got) == len(cols) * (len(cols) - 1) // 2
    for (a, b), (n, r) in got.items():
        n_ref, r_ref = _pairwise_r(pull_pd, a, b)
        assert n == n_ref, (a, b)
        if r_ref is None:
            assert r is None, (a, b, r)
        else:
            assert r is not None and abs(r - r_ref) < 2e-9, (a, b, r, r_ref)


def test_correlation_does_not_depend_on_partitioning(pull):
    one = sorted(map(tuple, demographic_correlation(pull.coalesce(1)).collect()), key=repr)
    many = sorted(map(tuple, demographic_correlation(pull.repartition(7)).collect()), key=repr)
    assert one == many


def test_predictor_ranking_order(pull, pull_pd):
    got = predictor_ranking(pull).collect()
    assert [r["rank"] for r in got] == list(range(1, len(DEMOGRAPHIC_COLUMNS) + 1))
    keys = [(r["r_squared"] is None, -(r["r_squared"] or 0.0), r["column"]) for r in got]
    assert keys == sorted(keys)
    top = got[0]
    n, r = _pairwise_r(pull_pd, top["column"], TARGET)
    assert abs(top["r"] - r) < 2e-9 and top["n"] == n


def test_regression_matches_numpy(pull, pull_pd):
    for row in univariate_regression(pull).collect():
        both = pull_pd[[row["column"], TARGET]].astype(float).dropna()
        if both[row["column"]].nunique() < 2:
            assert row["slope"] is None and row["intercept"] is None
            continue
        slope, intercept = np.polyfit(both[row["column"]], both[TARGET], 1)
        assert abs(row["slope"] - slope) < 1e-8 and abs(row["intercept"] - intercept) < 1e-8


def test_zero_variance_gives_null_not_error(spark):
    df = spark.createDataFrame(
        [(1.0, 0.5, 2.0), (1.0, 0.7, None), (1.0, 0.9, 4.0), (float("nan"), 0.3, float("nan"))],
        "c double, penetration double, d double",
    )
    got = {(r["col_a"], r["col_b"]): r for r in demographic_correlation(df, ["c", "d", "penetration"]).collect()}
    assert got[("c", "penetration")]["r"] is None and got[("c", "penetration")]["n"] == 3
    assert got[("d", "penetration")]["n"] == 2 and abs(got[("d", "penetration")]["r"] - 1.0) < 1e-9


def test_export_csv_round_trip(pull, tmp_path):
    path = str(tmp_path / "pull_csv")
    export_csv(pull, path)
    back = pull.sparkSession.read.option("header", True).schema(pull.schema).csv(path)
    assert back.count() == pull.count()
    assert back.columns == list(DEMOGRAPHIC_PULL_COLUMNS) + ["hhs", "num_customers", "penetration"]
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, pull.collect()), key=repr)


def test_enrichment_rejects_duplicate_blocks(spark):
    households = rows(spark, [{"CENSUS_BLOCK_GROUP": "A", "DAILY_TIME_KEY": CUR}]).select(
        "DAILY_TIME_KEY", "CENSUS_BLOCK_GROUP"
    )
    acs = spark.createDataFrame([("A", 1), ("A", 2)], "CENSUS_BLOCK_GROUP string, TOTAL_FAMILIES int")
    with pytest.raises(DuplicateKeyError):
        enrich_with_census(households, acs)


def test_enrichment_keeps_households_without_census(spark):
    households = spark.createDataFrame(
        [("A", CUR), ("B", CUR), (None, CUR)], "CENSUS_BLOCK_GROUP string, DAILY_TIME_KEY date"
    )
    acs = spark.createDataFrame([("A", 7)], "CENSUS_BLOCK_GROUP string, TOTAL_FAMILIES int")
    got = {r["CENSUS_BLOCK_GROUP"]: r["TOTAL_FAMILIES"] for r in enrich_with_census(households, acs).collect()}
    assert got == {"A": 7, "B": None, None: None}


def test_enrichment_broadcast_and_shuffled_paths_agree(spark, hh):
    acs = (
        hh.where(F.col("DAILY_TIME_KEY") == F.lit(CUR))
        .where(F.col("CENSUS_BLOCK_GROUP").isNotNull())
        .select("CENSUS_BLOCK_GROUP", *DEMOGRAPHIC_COLUMNS)
        .distinct()
    )
    households = hh.select("DAILY_TIME_KEY", "CENSUS_BLOCK_GROUP", "CUSTOMER_FLAG")
    broadcast = sorted(map(tuple, enrich_with_census(households, acs).collect()), key=repr)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        shuffled = enrich_with_census(households, acs, check_keys=False)
        assert sorted(map(tuple, shuffled.collect()), key=repr) == broadcast
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(broadcast) == hh.count()


@pytest.mark.parametrize(
    "xs, ys, slope",
    [
        ([1e6 + 0.01 * i for i in range(8)], [0.1 * i for i in range(8)], 10.0),
        ([1e8 + 0.5 * i for i in range(8)], [0.1 * i for i in range(8)], 0.2),
        ([1e9 + i for i in range(8)], [0.1 * i for i in range(8)], 0.1),
        ([1e8 + 0.001 * i for i in range(8)], [0.1 * i for i in range(8)], 100.0),
    ],
)
def test_statistics_on_a_subset_far_from_the_mean(spark, xs, ys, slope):
    """2,000 rows with y unknown must not cost digits of the eight complete ones."""
    from segmetrics.operators.stats import pair_fits

    rows = [(0.0, None)] * 2000 + list(zip(xs, ys))
    df = spark.createDataFrame(rows, "x double, y double").repartition(4)
    got = pair_fits(df, ["x", "y"]).first()
    want = df.where("y is not null").agg(F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("s")).first()
    assert got["n"] == 8 and abs(got["r"]) <= 1
    assert got["r"] == pytest.approx(want["r"], abs=1e-6) and got["slope"] == pytest.approx(slope, rel=1e-3)


def test_cut_spec_keeps_a_custom_guard(spark, hh):
    import dataclasses

    from segmetrics.functions.dimensions import custom_dimension
    from segmetrics.operators.penetration import penetration_by
    from segmetrics.plans.catalog import CUTS_BY_KEY
    from segmetrics.plans.workbench import penetration_workbench

    big = custom_dimension("many_families", lambda: F.col("TOTAL_FAMILIES") > 100, guard=lambda: F.col("TOTAL_FAMILIES") > 50)
    base = CUTS_BY_KEY["cut_kids"]
    spec = dataclasses.replace(base, key="custom", dims=(big,), layout=("many_families", "DAILY_TIME_KEY", "hh", "cc", "pr"), order_by=(), guards=None)
    want = penetration_by(hh, [big], [CUR, PRI], measures=spec.measures, columns=spec.columns)
    want = sorted(map(tuple, want.collect()), key=repr)
    assert sorted(map(tuple, spec.run(hh, [CUR, PRI]).collect()), key=repr) == want
    bench = penetration_workbench(hh, [CUR, PRI], specs=[spec])["custom"]
    assert sorted(map(tuple, bench.collect()), key=repr) == want


def test_yoy_change_on_an_int_date_key(spark, hh):
    from segmetrics.operators.compare import yoy_change
    from segmetrics.plans.catalog import CUTS_BY_KEY

    spec = CUTS_BY_KEY["cut_kids"]
    dims = [spec.dims[0].column]
    want = yoy_change(spec.run(hh, [CUR, PRI]), dims, CUR, PRI, spec.measures).collect()
    as_int = hh.withColumn("DAILY_TIME_KEY", F.date_format("DAILY_TIME_KEY", "yyyyMMdd").cast("int"))
    got = yoy_change(spec.run(as_int, [CUR, PRI]), dims, CUR, PRI, spec.measures).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and got


def test_a_task_sends_one_state_for_all_column_pairs(spark):
    """1,000 rows in three tasks become three rows, each with an entry per column pair."""
    from segmetrics.operators.stats import _reducer

    columns = [f"c{i}" for i in range(5)]
    df = spark.range(0, 1000, 1, 3).select(*[((F.col("id") * (i + 3)) % 17).cast("double").alias(c) for i, c in enumerate(columns)])
    pairs = [(i, list(range(i + 1, 5))) for i in range(4)]
    kind = ", ".join(f"{c} array<double>" for c in ("n", "mx", "my", "sxy", "sxx", "syy", "x_min", "x_max", "y_min", "y_max"))
    states = df.mapInArrow(_reducer(pairs), kind).collect()
    assert len(states) == 3 and all(len(r["n"]) == 10 for r in states) and sum(r["n"][0] for r in states) == 1000


def test_statistics_of_an_empty_pull(spark):
    got = demographic_correlation(spark.createDataFrame([], "c double, penetration double"), ["c", "penetration"]).collect()
    assert [tuple(r) for r in got] == [("c", "penetration", 0, None, None)[:4]]
