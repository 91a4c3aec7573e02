"""Minimax contiguous sharding of atomic groups.

Equal texts form a group that must not be split. Groups are ordered by the
64-bit digest of their text, and cut into ``shards`` contiguous ranges so that
the largest shard is as small as possible: the smallest feasible capacity is
found by binary search, each capacity being checked greedily (fill a shard
until the next group would not fit), and the cuts are those of the greedy pass
at that capacity. The cuts are digests, so they route any text to its shard.

The groups are never brought to one place. A greedy pass only asks "which
group boundary is the last one at or below x?". The driver keeps the first and
last boundary of each cell of a grid over the running size, which
answers exactly unless x falls between the two; such a cell answers with the
lower one (a capacity feasible so is feasible) or the higher (a capacity
infeasible so is infeasible). Where the two searches differ, only the cells
that were asked are refined, by one bounded aggregate, until both agree.

The running size is a two-level prefix sum: within blocks of equal leading
digest bits (``BLOCK_BITS``), and over the block totals. A group is one row
there, so a text that holds a third of all rows is one row too. Slots number
the rows of a shard by the same blocks, each split further by a hash of the
id, so that such a group is not numbered in one task.

Only DataFrame and SQL functions touch rows.

Defined results: a null text has no bytes (size ``OVERHEAD``, crc null) and
null texts are one group; repeated rows get slots of their own; empty tables
give empty results; fewer groups than shards leave shards empty. A digest
collision would only keep two texts together.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmetrics.session import materialize

OVERHEAD = 16
BLOCK_BITS = 12
CELLS = 4096
SLOT_SALT = 32

# Boundary summary of a half-open range (low, high] of running sizes:
# (low, high, first boundary, last boundary); none inside: both None.
Cell = tuple[int, int, int | None, int | None]


def text_digest(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text_digest(text).alias("digest"),
    )


def _block(digest: str) -> Column:
    return F.shiftright(F.col(digest), 64 - BLOCK_BITS)


def running_sizes(rows: DataFrame) -> DataFrame:
    """(digest, size, end): every group and the running size up to its end."""
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size")).withColumn("block", _block("digest"))
    inside = Window.partitionBy("block").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    groups = materialize(groups.withColumn("within", F.sum("size").over(inside)), "shard-groups")
    totals = groups.groupBy("block").agg(F.sum("size").alias("total"))  # 2**BLOCK_BITS rows at most
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    return groups.join(F.broadcast(starts), "block").select("digest", "size", (F.col("start") + F.col("within")).alias("end"))


def _summary(ends: DataFrame, ranges: list[tuple[int, int]], cells: int) -> list[Cell]:
    """First and last boundary in each of up to ``cells`` cells of each range."""
    out: list[Cell] = []
    cases = []
    for k, (low, high) in enumerate(ranges):
        width = -(-(high - low) // cells)
        inside = (F.col("end") > low) & (F.col("end") <= high)
        cases.append(F.when(inside, F.struct(F.lit(k).alias("k"), F.floor((F.col("end") - low - 1) / width).alias("cell"))))
    found = {
        (r["k"], r["cell"]): (r["first"], r["last"])
        for r in ends.select("end", F.coalesce(*cases).alias("at"))
        .where("at IS NOT NULL")
        .groupBy("at.k", "at.cell")
        .agg(F.min("end").alias("first"), F.max("end").alias("last"))
        .collect()  # len(ranges) * cells rows at most
    }
    for k, (low, high) in enumerate(ranges):
        width = -(-(high - low) // cells)
        for c in range(-(-(high - low) // width)):
            out.append((low + c * width, min(high, low + (c + 1) * width), *found.get((k, c), (None, None))))
    return out


class Boundaries:
    """What the driver knows of the group boundaries (a bounded summary)."""

    def __init__(self, cells: list[Cell]):
        self.cells = sorted(cells)
        self.lows = [c[0] for c in self.cells]
        self.last: list[int] = []  # the last boundary before each cell
        seen = 0
        for _, _, _, last in self.cells:
            self.last.append(seen)
            seen = last if last is not None else seen
        self.total = seen

    def at_or_below(self, x: int) -> tuple[int, int, int | None]:
        """(low answer, high answer, index of the cell that leaves them apart)."""
        if x >= self.total:
            return self.total, self.total, None
        k = max(0, bisect_right(self.lows, x - 1) - 1)
        _, _, first, last = self.cells[k]
        if first is None or x < first:
            return self.last[k], self.last[k], None
        if x >= last:
            return last, last, None
        return (first, first, None) if first == last else (first, min(x, last), k)

    def greedy(self, capacity: int, shards: int, high: bool) -> tuple[bool, list[int], set[int]]:
        """Feasible?, the cuts, and the cells whose answer was not exact."""
        cuts, asked, base = [], set(), 0
        for _ in range(shards):
            if base >= self.total:
                break
            low_at, high_at, unsure = self.at_or_below(base + capacity)
            if unsure is not None:
                asked.add(unsure)
            at = high_at if high else low_at
            if at <= base:
                return False, cuts, asked
            cuts.append(at)
            base = at
        return base >= self.total, cuts, asked

    def smallest(self, shards: int, high: bool, least: int) -> int:
        low, top = least, self.total
        while low < top:
            mid = (low + top) // 2
            low, top = (low, mid) if self.greedy(mid, shards, high)[0] else (mid + 1, top)
        return low


def minimax_cuts(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, running sizes at which the shards end)."""
    top = ends.agg(F.max("end").alias("total"), F.max("size").alias("largest")).first()
    if top["total"] is None:
        return 0, []
    least = max(top["largest"], -(-top["total"] // shards))
    known = Boundaries(_summary(ends, [(0, top["total"])], CELLS))
    while True:
        sure, hoped = known.smallest(shards, False, least), known.smallest(shards, True, least)
        feasible, cuts, asked = known.greedy(sure, shards, False)
        if sure == hoped and not asked:
            return sure, cuts
        # Refine what greedy passes ask between the two capacities.
        for capacity in {hoped, (hoped + sure) // 2, sure}:
            for high in (False, True):
                asked |= known.greedy(capacity, shards, high)[2]
        ranges = [known.cells[k][:2] for k in sorted(asked)]
        if not ranges:
            return sure, cuts
        fine = _summary(ends, ranges, max(2, 2 * CELLS // len(ranges)))
        known = Boundaries([c for k, c in enumerate(known.cells) if k not in asked] + fine)


def shard_of(cuts: list[int | None]) -> Column:
    """Shard by the digests at which the shards end (inclusive)."""
    shard = F.lit(max(0, len(cuts) - 1))
    for k in reversed(range(len(cuts) - 1)):
        shard = F.when(F.col("digest") <= cuts[k], F.lit(k)).otherwise(shard)
    return shard


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = materialize(sized_rows(docs), "shard-rows")
    ends = materialize(running_sizes(rows), "shard-ends")
    _, cuts = minimax_cuts(ends, shards)
    at = {r["end"]: r["digest"] for r in ends.where(F.col("end").isin(cuts)).select("end", "digest").collect()} if cuts else {}
    placed = rows.withColumn("shard", shard_of([at[c] for c in cuts]) if cuts else F.lit(0))

    # Slots: number the rows of a shard within sub-blocks, then add what stands before.
    placed = placed.withColumn("part", F.struct(_block("digest").alias("block"), F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_SALT)).alias("salt")))
    counted = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # 2**BLOCK_BITS * SLOT_SALT rows and a few at most
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counted.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "shard-offsets")
    inside = Window.partitionBy("shard", "part").orderBy("digest", "doc_id")
    numbered = placed.withColumn("row", F.row_number().over(inside))
    return numbered.join(offsets, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "digest",
    )
