"""Correlation, predictor ranking and univariate regression over the pull.

Inputs are rows of the wide demographic pull (one per block-group version).
Each task reduces its rows to one state: for every column pair the count, means,
centred sums, minima and maxima of its pairwise-complete rows (both
columns known), as arrays over the pairs. A batch is centred per pair, by two passes,
so a subset far from a column's overall mean loses no digits; batches
and tasks are merged by the pairwise update of means and centred sums. What is shuffled
is a task's state, one short row per pair, whatever the number of pull rows.

A statistic is NULL when it is undefined: fewer than two distinct x (or y)
values among the complete rows. The test is ``min < max``, exact unlike a
variance that carries rounding noise; ``try_divide`` covers variances that
underflow. NaN counts as missing, like NULL. Results are rounded to 9 decimals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import DEMOGRAPHIC_COLUMNS

TARGET = "penetration"
DIGITS = 9

# The state of a column pair: rows, means, centred sums, and the range of both columns.
STATE = ("n", "mx", "my", "sxy", "sxx", "syy", "x_min", "x_max", "y_min", "y_max")


def _reducer(pairs: list[tuple[int, list[int]]]):
    """A ``mapInArrow`` function: one row of ``STATE`` arrays per task, over (i, [j, ...]) in order."""

    def of_batch(v: np.ndarray) -> np.ndarray:
        parts = []
        for i, js in pairs:
            x, y = v[:, [i]], v[:, js]
            both = ~(np.isnan(x) | np.isnan(y))
            n = both.sum(axis=0).astype(float)
            state = [n]
            centred = []
            for values in (np.broadcast_to(x, y.shape), y):
                mean = np.where(both, values, 0.0).sum(axis=0) / np.maximum(n, 1)
                off = np.where(both, values - mean, 0.0)
                rest = off.sum(axis=0) / np.maximum(n, 1)
                state.append(mean + rest)
                centred.append(np.where(both, off - rest, 0.0))
            dx, dy = centred
            state += [(dx * dy).sum(axis=0), (dx * dx).sum(axis=0), (dy * dy).sum(axis=0)]
            for values in (np.broadcast_to(x, y.shape), y):
                state += [np.where(both, values, np.inf).min(axis=0), np.where(both, values, -np.inf).max(axis=0)]
            parts.append(np.stack(state))
        return np.concatenate(parts, axis=1)

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        share = b[0] / np.maximum(n, 1)
        dx, dy = b[1] - a[1], b[2] - a[2]
        w = a[0] * share
        sums = [a[3] + b[3] + dx * dy * w, a[4] + b[4] + dx * dx * w, a[5] + b[5] + dy * dy * w]
        ends = [np.minimum(a[6], b[6]), np.maximum(a[7], b[7]), np.minimum(a[8], b[8]), np.maximum(a[9], b[9])]
        return np.stack([n, a[1] + dx * share, a[2] + dy * share, *sums, *ends])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        with np.errstate(all="ignore"):
            for batch in batches:
                if batch.num_rows:
                    found = of_batch(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
                    state = found if state is None else merged(state, found)
        if state is not None:
            yield pa.RecordBatch.from_pydict({name: [row] for name, row in zip(STATE, state)})

    return reduce


def _merge(a: Column, b: Column) -> Column:
    """The pairwise update of two states of one column pair."""
    n = a["n"] + b["n"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    dx, dy, w = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * share
    merged = {
        "n": n,
        "mx": a["mx"] + dx * share,
        "my": a["my"] + dy * share,
        "sxy": a["sxy"] + b["sxy"] + dx * dy * w,
        "sxx": a["sxx"] + b["sxx"] + dx * dx * w,
        "syy": a["syy"] + b["syy"] + dy * dy * w,
        "x_min": F.least(a["x_min"], b["x_min"]),
        "x_max": F.greatest(a["x_max"], b["x_max"]),
        "y_min": F.least(a["y_min"], b["y_min"]),
        "y_max": F.greatest(a["y_max"], b["y_max"]),
    }
    return F.struct(*[merged[c].alias(c) for c in STATE])


def pair_states(pull: DataFrame, columns: Sequence[str], pairs: list[tuple[int, list[int]]]) -> DataFrame:
    """(pos, state): the merged state of every column pair, numbered in the order of ``pairs``."""
    missing = F.lit(None).cast("double")
    values = pull.select(*[F.nanvl(F.col(c).cast("double"), missing).alias(f"c{i}") for i, c in enumerate(columns)])
    states = values.mapInArrow(_reducer(pairs), ", ".join(f"{c} array<double>" for c in STATE))
    each = states.select(F.posexplode(F.arrays_zip(*STATE)).alias("pos", "state"))
    zero = F.struct(*[F.lit({"x_min": float("inf"), "y_min": float("inf"), "x_max": float("-inf"), "y_max": float("-inf")}.get(c, 0.0)).alias(c) for c in STATE])
    # In order of the states' values, so that the result does not depend on which task came first.
    return each.groupBy("pos").agg(F.aggregate(F.array_sort(F.collect_list("state")), zero, _merge).alias("state"))


def pair_fits(pull: DataFrame, columns: Sequence[str], target_only: bool = False) -> DataFrame:
    """``col_a, col_b, n, r, slope, intercept`` of every column pair (b on a).

    All pairs are listed, also those without a complete row (n = 0).
    """
    cols, last = list(columns), len(columns) - 1
    pairs = [(i, [last] if target_only else list(range(i + 1, last + 1))) for i in range(last)]
    s = {c: F.col(f"state.{c}") for c in STATE}
    x_varies, y_varies = s["x_min"] < s["x_max"], s["y_min"] < s["y_max"]
    r = F.try_divide(s["sxy"], F.sqrt(s["sxx"]) * F.sqrt(s["syy"]))
    slope = F.try_divide(s["sxy"], s["sxx"])
    one = F.lit(1.0)
    fits = pair_states(pull, cols, pairs).select(
        "pos",
        s["n"].cast("long").alias("n"),
        F.when(x_varies & y_varies & r.isNotNull(), F.round(F.greatest(-one, F.least(one, r)), DIGITS)).alias("r"),
        F.when(x_varies, F.round(slope, DIGITS)).alias("slope"),
        F.when(x_varies, F.round(s["my"] - slope * s["mx"], DIGITS)).alias("intercept"),
    )
    named = [(cols[i], cols[j]) for i, js in pairs for j in js]
    listed = pull.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(named)], "pos int, col_a string, col_b string")
    return listed.join(fits, "pos", "left").select("col_a", "col_b", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "r", "slope", "intercept")


def demographic_correlation(
    pull: DataFrame, columns: Sequence[str] = (*DEMOGRAPHIC_COLUMNS, TARGET)
) -> DataFrame:
    """Pearson r of every column pair (a before b in ``columns``), long form.

    Output ``col_a, col_b, n, r``.
    """
    return pair_fits(pull, columns).select("col_a", "col_b", "n", "r")


def _against_target(pull: DataFrame, columns: Sequence[str]) -> DataFrame:
    fits = pair_fits(pull, [*columns, TARGET], target_only=True)
    return fits.select(F.col("col_a").alias("column"), "n", "r", "slope", "intercept").withColumn(
        "r_squared", F.round(F.col("r") * F.col("r"), DIGITS)
    )


def predictor_ranking(pull: DataFrame, columns: Sequence[str] = DEMOGRAPHIC_COLUMNS) -> DataFrame:
    """Demographics ranked by r² against penetration (NULL last, then by name).

    Output ``rank, column, n, r, r_squared``; the sign of r is kept. The
    window orders the one-row-per-demographic result only.
    """
    scored = _against_target(pull, columns)
    w = Window.orderBy(F.desc_nulls_last("r_squared"), F.asc("column"))
    return scored.select(F.row_number().over(w).alias("rank"), "column", "n", "r", "r_squared")


def univariate_regression(pull: DataFrame, columns: Sequence[str] = DEMOGRAPHIC_COLUMNS) -> DataFrame:
    """Least-squares fit of penetration (y) on each demographic (x) alone.

    Output ``column, n, slope, intercept, r_squared``. Slope and intercept
    are NULL when x has fewer than two distinct values; r² is NULL also when
    y is constant.
    """
    return _against_target(pull, columns).select("column", "n", "slope", "intercept", "r_squared")
