"""The 29 workbench queries as declarations.

Each cut or cross-tab is data: its dimensions, output names and order, its
sort keys and -- for the two queries whose row filter is not the union of
their dimensions' guards -- an explicit guard list. Every query is a
function ``f(df, snapshots) -> DataFrame`` over the household fact table.

Short names: 1 = block-group summary; 2a-2i single cuts; 3a-3r cross-tabs;
4 = wide demographic pull.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.dimensions import (
    BLOCK_BULK,
    BULK_DIM,
    DWELLING_DIM,
    FAMILY_MIX,
    KIDS,
    KIDS_GROUP,
    LABOR,
    OWNERSHIP,
    TRANSPORT,
    Dimension,
    all_of,
    guard_names,
    row_guard,
)
from ..operators.blocks import block_group_summary, cut_block_bulk, demographic_pull
from ..operators.penetration import Measures, penetration_by, sort_nulls_last
from ..sources.household import Snapshot
from ..sources.schema import DATE

# Measure names differ between statements; these are the four combinations.
HH_CC = Measures("total_households", "customer_count")
HH_CUSTOMERS = Measures("total_households", "customers")
HHS_CC = Measures("total_hhs", "customer_count")
XTAB = Measures("household_count", "customer_count")


@dataclass(frozen=True)
class CutSpec:
    """One penetration query over one or two dimensions.

    ``layout`` lists the output columns with the roles ``"hh"``, ``"cc"``,
    ``"pr"`` for the measures. ``guards`` overrides the union of the
    dimensions' named guards when not ``None``.
    """

    key: str
    section: str
    dims: tuple[Dimension, ...]
    layout: tuple[str, ...]
    measures: Measures
    order_by: tuple[str, ...] = ()
    guards: tuple[str, ...] | None = None

    @property
    def guard_list(self) -> tuple[str, ...]:
        return guard_names(self.dims) if self.guards is None else self.guards

    @property
    def columns(self) -> tuple[str, ...]:
        role = {"hh": self.measures.households, "cc": self.measures.customers, "pr": self.measures.penetration}
        return tuple(role.get(c, c) for c in self.layout)

    def run(self, df: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
        if BLOCK_BULK in self.dims:
            # Needs the full-history block status: both sides at block grain, then joined.
            others = [d for d in self.dims if d != BLOCK_BULK]
            named = [g for g in self.guard_list if g != "block_status_known"]
            guard = all_of([row_guard(named), *[d.extra_guard_fn() for d in others if d.extra_guard_fn]])
            out = cut_block_bulk(df, snapshots, measures=self.measures, others=others, guard=guard)
            out = out.select(*self.columns)
            return sort_nulls_last(out, self.order_by) if self.order_by else out
        return penetration_by(
            df,
            self.dims,
            snapshots,
            guard=all_of([row_guard(self.guard_list), *[d.extra_guard_fn() for d in self.dims if d.extra_guard_fn]]),
            measures=self.measures,
            columns=self.columns,
            order_by=self.order_by or None,
        )


D = DATE


CC_FIRST = ("cc", "hh", "pr")
HH_FIRST = ("hh", "cc", "pr")


def _single(
    key: str,
    section: str,
    dim: Dimension,
    date_first: bool,
    m: Measures,
    measure_order: tuple[str, ...],
    sort: bool,
    guards: tuple[str, ...] | None = None,
) -> CutSpec:
    keys = (D, dim.column) if date_first else (dim.column, D)
    return CutSpec(key, section, (dim,), keys + measure_order, m, keys if sort else (), guards)


def _xtab(key: str, section: str, a: Dimension, b: Dimension) -> CutSpec:
    cols = (a.column, b.column, D)
    return CutSpec(key, section, (a, b), cols + ("hh", "cc", "pr"), XTAB, cols)


CUTS: tuple[CutSpec, ...] = (
    _single("cut_dwelling", "2a", DWELLING_DIM, False, HH_CC, CC_FIRST, False),
    _single("cut_bulk", "2b", BULK_DIM, True, HH_CC, CC_FIRST, False),
    _single("cut_block_bulk", "2c", BLOCK_BULK, False, HH_CC, CC_FIRST, False),
    _single("cut_kids", "2d", KIDS, True, HH_CC, CC_FIRST, True),
    # 2e keeps rows with unknown family counts (they label even_split).
    _single("cut_family_mix", "2e", FAMILY_MIX, False, HH_CUSTOMERS, HH_FIRST, True, ("households_nonzero",)),
    _single("cut_ownership", "2f", OWNERSHIP, True, HHS_CC, HH_FIRST, True),
    _single("cut_kids_group", "2g", KIDS_GROUP, False, HH_CUSTOMERS, HH_FIRST, True),
    _single("cut_labor", "2h", LABOR, False, HH_CUSTOMERS, HH_FIRST, True),
    _single("cut_transport", "2i", TRANSPORT, False, HH_CUSTOMERS, HH_FIRST, True),
    # 3a keeps the NULL dwelling as its own group: only children is guarded.
    CutSpec(
        "xtab_dwelling_kids",
        "3a",
        (DWELLING_DIM, KIDS),
        (D, DWELLING_DIM.column, KIDS.column, "cc", "hh", "pr"),
        HH_CC,
        (D, DWELLING_DIM.column, KIDS.column),
        guards=("children_known",),
    ),
    _xtab("xtab_dwelling_ownership", "3b", DWELLING_DIM, OWNERSHIP),
    _xtab("xtab_dwelling_family", "3c", DWELLING_DIM, FAMILY_MIX),
    _xtab("xtab_kids_ownership", "3d", KIDS, OWNERSHIP),
    _xtab("xtab_kids_family", "3e", KIDS, FAMILY_MIX),
    _xtab("xtab_ownership_family", "3f", OWNERSHIP, FAMILY_MIX),
    _xtab("xtab_dwelling_kids_group", "3g", DWELLING_DIM, KIDS_GROUP),
    _xtab("xtab_ownership_kids_group", "3h", OWNERSHIP, KIDS_GROUP),
    _xtab("xtab_dwelling_labor", "3i", DWELLING_DIM, LABOR),
    _xtab("xtab_kids_labor", "3j", KIDS, LABOR),
    _xtab("xtab_ownership_labor", "3k", OWNERSHIP, LABOR),
    _xtab("xtab_labor_family", "3l", LABOR, FAMILY_MIX),
    _xtab("xtab_labor_kids_group", "3m", LABOR, KIDS_GROUP),
    _xtab("xtab_dwelling_transport", "3n", DWELLING_DIM, TRANSPORT),
    _xtab("xtab_kids_transport", "3o", KIDS, TRANSPORT),
    _xtab("xtab_ownership_transport", "3p", OWNERSHIP, TRANSPORT),
    _xtab("xtab_family_transport", "3q", FAMILY_MIX, TRANSPORT),
    _xtab("xtab_kids_group_transport", "3r", KIDS_GROUP, TRANSPORT),
)
# A pair that the workbench itself does not have: the block status beside a household label.
BLOCK_BULK_DWELLING = _xtab("xtab_block_bulk_dwelling", "", BLOCK_BULK, DWELLING_DIM)

CUTS_BY_KEY: dict[str, CutSpec] = {c.key: c for c in CUTS}

Query = Callable[[DataFrame, Sequence[Snapshot]], DataFrame]

# All 29 statements, in workbench order.
QUERIES: dict[str, Query] = {
    "block_group_summary": block_group_summary,
    **{c.key: c.run for c in CUTS},
    "demographic_pull": demographic_pull,
}
