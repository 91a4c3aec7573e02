"""Dimensions: a bucket label plus the rows it is defined on (its guard).

Every label is a searched ``CASE`` (``F.when`` chain): branches are tried in
order, a NULL condition is not true, and the last branch is the ``ELSE``.
All of it stays inside whole-stage codegen; there is no UDF anywhere.

A cross-tab's guard is the conjunction of its dimensions' guards. Two
queries deviate from that rule and say so explicitly where they are
declared (``plans.catalog``), not through flags here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import BULK, DWELLING

# --- fixed values: bucket labels and cut points of the analysed workbench ---
KIDS_LABELS = ("no_kids", "low_kids", "med_kids", "high_kids")
KIDS_CUTS = (1, 2, 3)  # CHILDREN_PER_HH < 1, < 2, < 3, else
OWNERSHIP_LABELS = ("low_ownership", "mid_low_ownership", "mid_high_ownership", "high_ownership")
OWNERSHIP_CUTS = (0.25, 0.5, 0.75)  # PERC_OWNER_OCCUPIED < 0.25, < 0.5, < 0.75, else
MIX_LABELS = ("family_dominant", "non_family_dominant", "even_split")
MIX_CUTS = (0.6, 0.4)  # families / households >= 0.6, <= 0.4, else
KIDS_GROUP_LABELS = ("Less Kids", "More Kids", "Equal")
LABOR_LABELS = ("Labor Majority", "Labor Minority", "Equal")
TRANSPORT_LABELS = ("Drive Alone Majority", "Carpool Majority", "WFH Majority", "Other")
BLOCK_BULK_LABELS = ("has_bulk", "no_bulk")
# --- end of fixed values -----------------------------------------------------


@dataclass(frozen=True)
class Dimension:
    """A named bucket expression.

    ``column`` is the output column name and ``label_fn`` builds the bucket
    expression (lazily: PySpark columns need an active session). ``guards``
    names the row predicates of ``ROW_GUARDS`` the bucket is defined on;
    ``extra_guard_fn`` adds an arbitrary predicate for custom dimensions.
    """

    name: str
    column: str
    label_fn: Callable[[], Column]
    guards: tuple[str, ...] = ()
    extra_guard_fn: Callable[[], Column | None] | None = None

    def label(self) -> Column:
        return self.label_fn().alias(self.column)

    def guard(self) -> Column | None:
        extra = self.extra_guard_fn() if self.extra_guard_fn is not None else None
        return all_of([row_guard(self.guards), extra])


def all_of(predicates: Sequence[Column | None]) -> Column | None:
    """AND of the non-None predicates (None when there are none)."""
    kept = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, kept) if kept else None


def guard_of(dims: Sequence[Dimension]) -> Column | None:
    return all_of([d.guard() for d in dims])


def guard_names(dims: Sequence[Dimension]) -> tuple[str, ...]:
    """Union of the dimensions' named guards, in first-seen order."""
    seen: list[str] = []
    for d in dims:
        seen.extend(g for g in d.guards if g not in seen)
    return tuple(seen)


def not_null(*names: str) -> Column:
    return all_of([F.col(n).isNotNull() for n in names])


def households_nonzero() -> Column:
    """``TOTAL_HOUSEHOLDS != 0``; NULL is not true, so NULL rows drop too."""
    return F.col("TOTAL_HOUSEHOLDS") != 0


TRANSPORT_COLUMNS = (
    "TRANSPORTATION_DRIVE_ALONE",
    "TRANSPORTATION_CARPOOL",
    "TRANSPORTATION_WORK_FROM_HOME",
)

# Named row predicates. A dimension lists the ones it needs; a query's guard
# is the union of its dimensions' lists unless the query declares its own.
ROW_GUARDS: dict[str, Callable[[], Column]] = {
    "dwelling_known": lambda: not_null(DWELLING),
    "children_known": lambda: not_null("CHILDREN_PER_HH"),
    "owner_known": lambda: not_null("PERC_OWNER_OCCUPIED"),
    "households_nonzero": households_nonzero,
    "families_known": lambda: not_null("TOTAL_FAMILIES"),
    "family_counts_known": lambda: not_null("TOTAL_FAMILIES_WO_CHILDREN", "TOTAL_FAMILIES_W_CHILDREN"),
    "labor_counts_known": lambda: not_null("TOTAL_IN_LABOR_FORCE", "TOTAL_NOT_IN_LABOR_FORCE"),
    "transport_counts_known": lambda: not_null(*TRANSPORT_COLUMNS),
    "block_status_known": lambda: not_null("block_bulk_status"),
}


def row_guard(names: Sequence[str]) -> Column | None:
    return all_of([ROW_GUARDS[n]() for n in names])


def _ladder(value: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """``value < cuts[0] -> labels[0]; < cuts[1] -> labels[1]; ...; else last``."""
    expr = F.when(value < F.lit(cuts[0]), labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        expr = expr.when(value < F.lit(cut), label)
    return expr.otherwise(labels[len(cuts)])


def kids_bucket_expr() -> Column:
    return _ladder(F.col("CHILDREN_PER_HH"), KIDS_CUTS, KIDS_LABELS)


def ownership_bucket_expr() -> Column:
    return _ladder(F.col("PERC_OWNER_OCCUPIED"), OWNERSHIP_CUTS, OWNERSHIP_LABELS)


def family_ratio() -> Column:
    """families / households as a double; NULL (not an error) for 0 households."""
    return F.try_divide(F.col("TOTAL_FAMILIES").cast("double"), F.col("TOTAL_HOUSEHOLDS").cast("double"))


def household_mix_expr() -> Column:
    r = family_ratio()
    hi, lo = MIX_CUTS
    return (
        F.when(r >= F.lit(hi), MIX_LABELS[0])
        .when(r <= F.lit(lo), MIX_LABELS[1])
        .otherwise(MIX_LABELS[2])
    )


def kids_group_expr() -> Column:
    wo, w = F.col("TOTAL_FAMILIES_WO_CHILDREN"), F.col("TOTAL_FAMILIES_W_CHILDREN")
    return (
        F.when(wo > w, KIDS_GROUP_LABELS[0])
        .when(wo <= w, KIDS_GROUP_LABELS[1])
        .otherwise(KIDS_GROUP_LABELS[2])
    )


def labor_group_expr() -> Column:
    inside, outside = F.col("TOTAL_IN_LABOR_FORCE"), F.col("TOTAL_NOT_IN_LABOR_FORCE")
    return (
        F.when(inside > outside, LABOR_LABELS[0])
        .when(inside < outside, LABOR_LABELS[1])
        .otherwise(LABOR_LABELS[2])
    )


def transport_group_expr() -> Column:
    """The one strictly largest of three commute modes; any tie at the top is Other."""
    modes = [F.col(c) for c in TRANSPORT_COLUMNS]
    expr = None
    for i, (mode, label) in enumerate(zip(modes, TRANSPORT_LABELS)):
        rivals = [m for j, m in enumerate(modes) if j != i]
        beats_all = all_of([mode > r for r in rivals])
        expr = F.when(beats_all, label) if expr is None else expr.when(beats_all, label)
    return expr.otherwise(TRANSPORT_LABELS[3])


DWELLING_DIM = Dimension("dwelling", DWELLING, lambda: F.col(DWELLING), ("dwelling_known",))
BULK_DIM = Dimension("bulk", BULK, lambda: F.col(BULK))
KIDS = Dimension("kids", "kids_bucket", kids_bucket_expr, ("children_known",))
OWNERSHIP = Dimension("ownership", "ownership_bucket", ownership_bucket_expr, ("owner_known",))
FAMILY_MIX = Dimension(
    "family_mix", "household_mix", household_mix_expr, ("households_nonzero", "families_known")
)
KIDS_GROUP = Dimension(
    "kids_group", "kids_group", kids_group_expr, ("households_nonzero", "family_counts_known")
)
LABOR = Dimension("labor", "labor_group", labor_group_expr, ("households_nonzero", "labor_counts_known"))
TRANSPORT = Dimension(
    "transport", "transport_group", transport_group_expr, ("households_nonzero", "transport_counts_known")
)
# Block-level bulk presence is not a row expression: it needs MAX(BULK_FLG)
# over the block's whole history (operators.blocks). Once attached as a
# column it behaves like any other dimension.
BLOCK_BULK = Dimension(
    "block_bulk", "block_bulk_status", lambda: F.col("block_bulk_status"), ("block_status_known",)
)

DIMENSIONS: dict[str, Dimension] = {
    d.name: d
    for d in (DWELLING_DIM, BULK_DIM, BLOCK_BULK, KIDS, OWNERSHIP, FAMILY_MIX, KIDS_GROUP, LABOR, TRANSPORT)
}


def custom_dimension(
    name: str,
    label: Callable[[], Column],
    column: str | None = None,
    guard: Callable[[], Column | None] | None = None,
    guards: Sequence[str] = (),
) -> Dimension:
    """A user dimension: any expression as bucket, any predicate as guard."""
    return Dimension(name, column or name, label, tuple(guards), guard)
