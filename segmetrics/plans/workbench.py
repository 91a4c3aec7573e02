"""Aggregate once, roll up many: all 27 cuts and cross-tabs from one scan.

Household and customer counts are additive, so the snapshot rows are
grouped once by every label and every named guard bit (the *segment
cube*), and each cut is a ``sum`` over that small table with the cut's
guard bits as a filter. The ratio is recomputed from the summed counts,
never averaged.

Plan at scale:

1. scan the two snapshot partitions once, reading only label and guard
   inputs;
2. scan the full history for ``MAX(BULK_FLG)`` per block (partial aggregate),
   only if the block-bulk cut is among the cuts;
3. reduce the snapshots to block grain by a partial aggregate and join the
   two block-grain tables on the block key (no such join without that cut);
4. the cube has at most one row per combination of labels and bits per date
   that occurs (it still grows with the data until all of them have) and is
   written to the shared checkpoint folder, as two steps read it;
5. one more aggregation sums every cut at once over the cube fanned out to
   the cuts each row qualifies for; each of the 27 results is a filter of
   that (checkpointed) table.

Compared with 27 separate queries this reads the snapshots once instead of
27 times and the history once instead of once per block-bulk query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import BLOCK_BULK, ROW_GUARDS, Dimension, all_of, not_null
from ..functions.measures import customers, flag_eq_1, households, ratio
from ..operators.blocks import block_bulk_status
from ..operators.penetration import sort_nulls_last
from ..session import materialize
from ..sources.household import Snapshot, snapshot_filter
from ..sources.schema import BLOCK, DATE
from .catalog import CUTS, CutSpec



def _bit(name: str) -> str:
    return f"ok_{name}"


def row_tests(specs: Sequence[CutSpec]) -> dict[str, Callable[[], Column]]:
    """Bit name -> row test, for every guard that ``specs`` need (named or a dimension's own)."""
    tests: dict[str, Callable[[], Column]] = {}
    for spec in specs:
        for g in spec.guard_list:
            if g != "block_status_known":
                tests[_bit(g)] = ROW_GUARDS[g]
        for d in spec.dims:
            if d.extra_guard_fn is not None:
                tests[_bit(f"dim_{d.name}")] = d.extra_guard_fn
    return tests


def _spec_bits(spec: CutSpec) -> list[str]:
    return list(row_tests([spec]))


def cube_guard(spec: CutSpec) -> Column | None:
    """The guard of ``spec``, evaluated on the cube instead of on household rows."""
    status = [not_null("block_bulk_status")] if BLOCK_BULK in spec.dims else []
    return all_of([*[F.col(b) for b in _spec_bits(spec)], *status])


def row_labels(specs: Sequence[CutSpec]) -> list[Dimension]:
    """The dimensions of ``specs`` that are labels of a household row, once each."""
    found: list[Dimension] = []
    for spec in specs:
        found.extend(d for d in spec.dims if d != BLOCK_BULK and d not in found)
    return found


def segment_cube(
    df: DataFrame,
    snapshots: Sequence[Snapshot],
    status: DataFrame | None = None,
    specs: Sequence[CutSpec] = CUTS,
    customer: Column | None = None,
) -> DataFrame:
    """Households and customers per (date, labels, guard bits[, block bulk status]).

    Holds the labels and bits that ``specs`` need and no others; the history
    is read for the block status only if one of them is the block-bulk cut.
    Labels are the unguarded bucket expressions; whether a row may enter a
    cut is kept in the ``ok_*`` bits, so one cube serves every guard
    combination (including the two queries with non-standard guards).
    """
    dims, tests = row_labels(specs), row_tests(specs)
    keys = [DATE, *[d.column for d in dims], *tests]
    labelled = [
        F.col(DATE),
        *[d.label() for d in dims],
        *[F.coalesce(test(), F.lit(False)).alias(bit) for bit, test in tests.items()],
    ]
    rows = df.where(snapshot_filter(df, snapshots))
    is_customer = (flag_eq_1() if customer is None else customer).alias("_is_customer")
    if not any(BLOCK_BULK in spec.dims for spec in specs):
        return (
            rows.select(*labelled, is_customer)
            .groupBy(*keys)
            .agg(households().alias("_hh"), customers(F.col("_is_customer")).alias("_cc"))
        )
    # Both sides are reduced to block grain before the join. The left join
    # keeps households of NULL / unknown blocks with a NULL status; only the
    # block-bulk cut drops them (its guard tests the status).
    status = block_bulk_status(df) if status is None else status
    per_block = (
        rows.select(F.col(BLOCK), *labelled, is_customer)
        .groupBy(BLOCK, *keys)
        .agg(households().alias("_hh"), customers(F.col("_is_customer")).alias("_cc"))
    )
    return (
        per_block.join(status, BLOCK, "left")
        .groupBy(*keys, "block_bulk_status")
        .agg(F.sum("_hh").alias("_hh"), F.sum("_cc").alias("_cc"))
    )


def grouping_sets(cube: DataFrame, specs: Sequence[CutSpec], tags: Sequence[str]) -> DataFrame:
    """Several cuts of a segment cube by native grouping sets, stacked as ``tag, bucket_a, bucket_b, date``.

    A cut groups by its labels, its guard bits and the date; groups with a bit
    that does not hold are dropped afterwards. Cuts with equal sets are
    aggregated once. Any number of dimensions up to two and any guards go;
    buckets are cast to string, and ``bucket_b`` is NULL for a single dimension.
    """
    columns, sets = [DATE], {}
    for spec, tag in zip(specs, tags):
        if not 1 <= len(spec.dims) <= 2:
            raise ValueError(f"{tag}: a cut has one or two dimensions")
        parts = [d.column for d in spec.dims] + _spec_bits(spec)
        columns.extend(c for c in parts if c not in columns)
        sets.setdefault(frozenset(parts), []).append((spec, tag))
    # Spark's grouping id: a bit per column, the first one highest, set where the column is left out.
    named = F.lit(None)
    for parts, cuts in sets.items():
        gid = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c != DATE and c not in parts)
        entries = []
        for spec, tag in cuts:
            cols = [F.col(d.column).cast("string") for d in spec.dims] + [F.lit(None).cast("string")]
            entry = F.struct(F.lit(tag).alias("tag"), cols[0].alias("bucket_a"), cols[1].alias("bucket_b"))
            guard = cube_guard(spec)
            entries.append(entry if guard is None else F.when(guard, entry))
        named = F.when(F.col("_set") == gid, F.array(*entries)).otherwise(named)
    listed = [[F.col(DATE), *[F.col(c) for c in columns if c in parts]] for parts in sets]
    summed = cube.groupingSets(listed, *[F.col(c) for c in columns]).agg(
        F.sum("_hh").alias("households"), F.sum("_cc").alias("customers"), F.grouping_id().alias("_set")
    )
    stacked = summed.select(F.explode(named).alias("t"), DATE, "households", "customers").where(F.col("t").isNotNull())
    return stacked.select("t.*", DATE, "households", "customers", ratio("customers", "households").alias("penetration_rate"))


def stacked_cuts(
    df: DataFrame,
    snapshots: Sequence[Snapshot],
    specs: Sequence[CutSpec],
    tags: Sequence[str],
    customer: Column | None = None,
    status: DataFrame | None = None,
) -> DataFrame:
    """Several cuts in one scan, lazily: label combinations first, then grouping sets over these.

    The first aggregate leaves one row per label combination and task, so a
    household row is not copied once per cut. Cuts with the block status have a
    cube of their own at block grain, so that the others are not grouped by block.
    Same columns as ``stacked_rollup``.
    """
    pairs = list(zip(specs, tags))
    out = None
    for chosen in ([p for p in pairs if BLOCK_BULK not in p[0].dims], [p for p in pairs if BLOCK_BULK in p[0].dims]):
        if chosen:
            some = [spec for spec, _ in chosen]
            part = grouping_sets(segment_cube(df, snapshots, status, some, customer), some, [tag for _, tag in chosen])
            out = part if out is None else out.unionByName(part)
    return out


def rollup(cube: DataFrame, spec: CutSpec) -> DataFrame:
    """One cut or cross-tab from the cube (same output as ``spec.run``)."""
    m = spec.measures
    keys = [d.column for d in spec.dims] + [DATE]
    out = (
        cube.where(guard if (guard := cube_guard(spec)) is not None else F.lit(True))
        .groupBy(*keys)
        .agg(F.sum("_hh").alias(m.households), F.sum("_cc").alias(m.customers))
        .select(*keys, m.households, m.customers, ratio(m.customers, m.households).alias(m.penetration))
        .select(*spec.columns)
    )
    return sort_nulls_last(out, spec.order_by) if spec.order_by else out


def stacked_rollup(cube: DataFrame, specs: Sequence[CutSpec], tags: Sequence[str]) -> DataFrame:
    """Several cuts in one aggregation, stacked as ``tag, bucket_a, bucket_b, date``.

    Each cube row is fanned out to the cuts whose guards it passes (at most
    ``len(specs)`` copies of a table bounded by the label vocabularies, never
    household rows) and one ``groupBy`` sums all cuts at once: one shuffle
    instead of one per cut. Buckets are cast to string; ``bucket_b`` is NULL
    for single-dimension cuts. Output ``tag, bucket_a, bucket_b,
    DAILY_TIME_KEY, households, customers, penetration_rate``.
    """
    entries = []
    for spec, tag in zip(specs, tags):
        cols = [F.col(d.column).cast("string") for d in spec.dims] + [F.lit(None).cast("string")]
        entry = F.struct(F.lit(tag).alias("tag"), cols[0].alias("bucket_a"), cols[1].alias("bucket_b"))
        guard = cube_guard(spec)
        entries.append(entry if guard is None else F.when(guard, entry))
    fanned = cube.select(F.explode(F.array(*entries)).alias("t"), DATE, "_hh", "_cc").where(F.col("t").isNotNull())
    return (
        fanned.groupBy(F.col("t.tag").alias("tag"), F.col("t.bucket_a").alias("bucket_a"),
                       F.col("t.bucket_b").alias("bucket_b"), DATE)
        .agg(F.sum("_hh").alias("households"), F.sum("_cc").alias("customers"))
        .withColumn("penetration_rate", ratio("customers", "households"))
    )


def penetration_workbench(
    df: DataFrame,
    snapshots: Sequence[Snapshot],
    status: DataFrame | None = None,
    specs: Sequence[CutSpec] = CUTS,
    checkpoint: bool = True,
) -> dict[str, DataFrame]:
    """All cuts of ``specs`` keyed by query name, from one checkpointed cube.

    With ``checkpoint`` the cube and the stacked sums of all cuts (one
    aggregation, ``stacked_rollup``) are written to the checkpoint folder,
    and each result is a filter and projection of that small table; without
    it each cut is its own rollup of the cube.
    """
    cube = segment_cube(df, snapshots, status, specs)
    if not checkpoint:
        return {spec.key: rollup(cube, spec) for spec in specs}
    cube = materialize(cube, "segment_cube")
    stacked = materialize(stacked_rollup(cube, specs, [s.key for s in specs]), "segment_cuts")
    return {spec.key: _unstack(stacked, spec, cube) for spec in specs}


def _unstack(stacked: DataFrame, spec: CutSpec, cube: DataFrame) -> DataFrame:
    """One cut back out of the stacked table, with its own names and types."""
    m = spec.measures
    buckets = [
        F.col(b).cast(cube.schema[d.column].dataType).alias(d.column)
        for b, d in zip(("bucket_a", "bucket_b"), spec.dims)
    ]
    out = (
        stacked.where(F.col("tag") == spec.key)
        .select(
            *buckets,
            F.col(DATE),
            F.col("households").alias(m.households),
            F.col("customers").alias(m.customers),
            F.col("penetration_rate").alias(m.penetration),
        )
        .select(*spec.columns)
    )
    return sort_nulls_last(out, spec.order_by) if spec.order_by else out
