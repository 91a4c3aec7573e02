"""Bounds and tests of differences against exact formulas."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import CUR, PRI
from segmetrics.operators.significance import Z95, benjamini_hochberg, rate_bounds, two_sided_p, yoy_significance
from segmetrics.plans.analyses import changes_with_tests

CHANGE = "dimension string, bucket string, households_current long, customers_current long, households_prior long, customers_prior long"


def test_p_value_against_erfc(spark):
    zs = [0.0, 1e-9, 0.5, -1.0, Z95, 3.0, -5.0, 8.0, 20.0, 40.0]
    df = spark.createDataFrame([(z,) for z in [*zs, None]], "z double").select("z", two_sided_p(F.col("z")).alias("p"))
    for r in df.collect():
        if r["z"] is None:
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=2e-7)


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (500, 1000), (0, 0), (None, None)], "c long, n long")
    got = {(r["c"], r["n"]): (r["low"], r["high"]) for r in rate_bounds(df, "c", "n").collect()}
    assert got[0, 0] == got[None, None] == (None, None)
    assert got[0, 10] == pytest.approx((0.0, 0.277532799)) and got[10, 10] == pytest.approx((0.722467201, 1.0))
    for c, n in [(3, 10), (500, 1000)]:
        p, z = c / n, Z95
        for bound in got[c, n]:  # where the normal test of the true rate is at its limit
            assert abs(p - bound) == pytest.approx(z * math.sqrt(bound * (1 - bound) / n), abs=1e-8)


def plain_q(ps):
    m = len(ps)
    return [min(1.0, min(p2 * m / sum(x <= p2 for x in ps) for p2 in ps if p2 >= p)) for p in ps]


def test_benjamini_hochberg_by_family(spark):
    families = {"a": [0.01, 0.04, 0.03, 0.005, 0.5, 0.03], "b": [0.9], "c": [0.2, 0.2, 1.0]}
    rows = [(f, i, p) for f, ps in families.items() for i, p in enumerate(ps)] + [("a", 99, None), ("d", 0, None)]
    df = spark.createDataFrame(rows, "f string, i int, p double")
    got = {(r["f"], r["i"]): r["q"] for r in benjamini_hochberg(df, "p", "q", ["f"]).collect()}
    assert got["a", 99] is None and got["d", 0] is None
    for f, ps in families.items():
        assert [got[f, i] for i in range(len(ps))] == pytest.approx(plain_q(ps))
    every = {(r["f"], r["i"]): r["q"] for r in benjamini_hochberg(df, "p", "q").collect()}
    keys = [(f, i) for f, i, p in rows if p is not None]
    assert [every[k] for k in keys] == pytest.approx(plain_q([p for _, _, p in rows if p is not None]))


def test_tests_of_changes(spark):
    rows = [
        ("d", "up", 1000, 600, 1000, 500),
        ("d", "same", 1000, 500, 1000, 500),
        ("d", "all", 10, 10, 20, 20),
        ("d", "new", 10, 5, None, None),
        ("d", None, 4, 1, 4, 2),
    ]
    got = {r["bucket"]: r for r in yoy_significance(spark.createDataFrame(rows, CHANGE)).collect()}
    pooled = 1100 / 2000
    z = 0.1 / math.sqrt(pooled * (1 - pooled) * (2 / 1000))
    assert got["up"]["z"] == pytest.approx(z) and got["up"]["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-9)
    assert got["up"]["significant"] is True and got["up"]["q_value"] == pytest.approx(4 * got["up"]["p_value"], abs=4e-9)
    assert got["same"]["p_value"] == got["all"]["p_value"] == 1.0 and got["all"]["z"] == 0.0 and got["same"]["significant"] is False
    assert got["new"]["low_current"] is not None and got["new"]["low_prior"] is None
    assert got["new"]["p_value"] is None and got["new"]["q_value"] is None and got["new"]["significant"] is None
    assert yoy_significance(spark.createDataFrame([], CHANGE)).count() == 0


def test_registered_query_has_both_answers(hh):
    rows = changes_with_tests(hh, (CUR, PRI)).collect()
    assert {r["significant"] for r in rows} == {True, False}
    assert all(r["low_current"] <= r["penetration_current"] <= r["high_current"] for r in rows)
