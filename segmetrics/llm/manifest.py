"""Merkle manifest of a table: a tree of SHA-256 digests per group, and proofs checked by a recursive climb.

1. A leaf is the digest of a row's fields, each with its length in bytes. Within
   a group (``lang``) leaves ascend by ``doc_id``: the table is range-partitioned by
   group and id, numbered inside its partitions, and the partitions' counts per group give
   the offset of each, so no group is gathered in a task.
2. While several nodes remain, every ``FAN`` consecutive ones become the digest of their
   run. Runs are one row each with their children's digests and a link to the parent
   run; every level is one aggregation of the level below (an eighth of its rows) and is
   written. The groups' last nodes, in order of the group, are the leaves of one more tree.
3. A recursive query (``WITH RECURSIVE``) starts from all leaves and joins a node to its parent run once
   per level: the run gives the siblings, the folded digest takes the child's place
   in the run, and the run's links lead on. A leaf's proof is its siblings of all
   levels, from the leaf up; each step adds those of its level, and they are joined after the climb, so
   that no row drags the whole proof through the shuffles.
4. Runs from level ``SPREAD_FROM`` on are kept ``SPREAD`` times, a leaf meeting the copy of its own
   number, as all leaves of a group pass the same top runs; what is left of a hot run is
   split by adaptive execution.

Defined results: null fields are ``-``; a null group is the first one; null ids come first in their
group; rows with the same id are ordered by their leaf, and rows equal in all fields are interchangeable;
a null id is not tampered with; a group with one row has that leaf as its last node; a table with one
group has that group's last node as root; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmetrics.session import materialize

FAN = 8
SPREAD_FROM, SPREAD = 4, 64
ROOT_TREE = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROW_LIMIT, LEVEL_LIMIT = "spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digest_of_all(digests: Column | str) -> Column:
    """Digest of an array of digests, concatenated as texts."""
    return digest_of(F.array_join(F.transform(digests, as_text), ""))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields' UTF-8 lengths and values; ``-`` for a null one."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest_of(F.concat(*parts))


def every_third_lower(docs: DataFrame) -> Column:
    """The text of a row after tampering: A-Z lower-cased where 3 divides the id's CRC-32."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def hashed_rows(docs: DataFrame, tampered: Callable[[DataFrame], Column]) -> DataFrame:
    """(doc_id, lang, leaf, changed, seq): digests of every row as it is and, where it differs, after tampering."""
    kept = [F.col(c) for c in FIELDS[:-1]]
    new = tampered(docs)
    changed = F.when(~new.eqNullSafe(F.col("text")), leaf_digest([*kept, new]))
    digests = docs.select("doc_id", "lang", leaf_digest([*kept, F.col("text")]).alias("leaf"), changed.alias("changed"))
    return digests.withColumn("seq", F.monotonically_increasing_id())


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, gapless from 0 in the order of each group, and ``n``, the group's rows."""
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()), f"{name}-placed")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    # One row per partition and group in it: partitions plus groups, at most.
    parts = placed.groupBy(group, "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("size").over(before), F.lit(0))
    parts = parts.select(F.col(group).alias("in_group"), F.col("part").alias("in_part"), (base - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    placed = placed.join(parts, F.col(group).eqNullSafe(F.col("in_group")) & (F.col("part") == F.col("in_part")))
    return placed.select(*rows.columns, (F.col("place") + F.col("shift")).alias("at"), "n")


def tree_levels(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(run tables from level 1 up, last nodes) of the trees over ``leaves`` (tree, at, n, digest).

    A run: tree, level, at, n (runs of its level in the tree), children, digest.
    """
    runs, nodes, level = [], leaves, 0
    last = leaves.where("n = 1").select("tree", "digest")
    largest = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    while largest > 1:
        level, largest = level + 1, -(-largest // FAN)
        grouped = nodes.where("n > 1").groupBy("tree", F.floor(F.col("at") / FAN).alias("run")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("c")
        )
        grouped = grouped.select("tree", F.lit(level).alias("level"), F.col("run").alias("at"), F.ceil(F.col("n") / FAN).alias("n"), F.col("c.digest").alias("children"))
        nodes = materialize(grouped.withColumn("digest", digest_of_all("children")), f"{name}-level-{level}")
        runs.append(nodes)
        last = last.unionByName(nodes.where("n = 1").select("tree", "digest"))
    return runs, last


def with_links(nodes: DataFrame, level: Column, tops: DataFrame) -> DataFrame:
    """``nodes`` with the run above them (up_tree, up_level, up_at, slot): in the tree, or of the root tree."""
    above = tops.select(F.col("tree"), F.col("root_at"), F.col("root_n"))
    joined = nodes.join(above, "tree", "left")
    inner, outer = F.col("n") > 1, (F.col("n") == 1) & (F.col("root_n") > 1)
    at = F.when(inner, F.col("at")).when(outer, F.col("root_at"))
    linked = joined.withColumns(
        {
            "up_tree": F.when(inner, F.col("tree")).when(outer, F.lit(ROOT_TREE).cast("long")),
            "up_level": F.when(inner, level + 1).when(outer, F.lit(1)),
            "up_at": F.floor(at / FAN),
            "slot": (at % FAN).cast("int"),
        }
    )
    return linked.drop("root_at", "root_n")


def stored_tree(docs: DataFrame, tampered: Callable[[DataFrame], Column] = every_third_lower) -> tuple[DataFrame, DataFrame]:
    """(leaves, runs): the leaf rows and all runs of all levels, each with its link to the run above."""
    rows = materialize(hashed_rows(docs.select(*FIELDS), tampered), "manifest-hashes")
    langs = numbered(rows.select("lang").distinct().withColumn("all", F.lit(0)), "all", ["lang"], "manifest-groups")
    langs = langs.select("lang", F.col("at").alias("tree"), F.col("n").alias("root_n"))
    leaves = numbered(rows, "lang", ["doc_id", "leaf", "seq"], "manifest-leaves")
    named = langs.select(F.col("lang").alias("group"), "tree")
    leaves = leaves.join(named, F.col("lang").eqNullSafe(F.col("group"))).drop("group", "seq")
    leaves = materialize(leaves, "manifest-leaves")

    levels, last = tree_levels(leaves.select("tree", "at", "n", F.col("leaf").alias("digest")), "manifest")
    tops = materialize(last.join(langs, "tree").select("tree", "digest", F.col("tree").alias("root_at"), "root_n"), "manifest-tops")
    upper, _ = tree_levels(tops.select(F.lit(ROOT_TREE).cast("long").alias("tree"), F.col("root_at").alias("at"), F.col("root_n").alias("n"), "digest"), "manifest-root")

    runs = None
    for nodes in [*levels, *upper]:
        runs = nodes if runs is None else runs.unionByName(nodes)
    if runs is None:
        runs = leaves.limit(0).select("tree", F.lit(0).alias("level"), "at", "n", F.array("leaf").alias("children"), F.col("leaf").alias("digest"))
    runs = with_links(runs, F.col("level"), tops).withColumn("last", (F.col("n") == 1) & (F.col("tree") != ROOT_TREE))
    copies = F.when(F.col("level") >= SPREAD_FROM, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    runs = materialize(runs.drop("n").withColumn("copy", F.explode(copies)), "manifest-runs")
    return with_links(leaves, F.lit(0), tops), runs


CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree AS own_tree, at AS own_at, 0 AS steps, leaf AS node, changed AS folded, CAST(NULL AS BINARY) AS siblings, n = 1 AS last,
    up_tree, up_level, up_at, slot, CAST(IF(up_level >= {spread_from}, at % {spread}, 0) AS INT) AS copy
  FROM {leaves}
  UNION ALL
  SELECT c.own_tree, c.own_at, c.steps + 1, r.digest,
    CASE WHEN c.folded = c.node THEN r.digest
      ELSE unhex(sha2(array_join(transform(r.children, (x, i) -> lower(hex(IF(i = c.slot, c.folded, x)))), ''), 256)) END,
    CASE WHEN c.steps = 0 OR c.own_at % {fan} = 0
      THEN aggregate(filter(r.children, (x, i) -> i <> c.slot), X'', (a, x) -> concat(a, x)) END,
    r.last, r.up_tree, r.up_level, r.up_at, r.slot, CAST(IF(r.up_level >= {spread_from}, c.own_at % {spread}, 0) AS INT)
  FROM climb c JOIN {runs} r
    ON c.up_tree = r.tree AND c.up_level = r.level AND c.up_at = r.at AND c.copy = r.copy
)
SELECT own_tree, own_at, steps, node, folded, siblings, last, up_tree IS NULL AS top FROM climb
"""


def climbed(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """Every step of every leaf's way to the root: (own_tree, own_at, steps, node, folded, siblings, last, top).

    Siblings of the second step and above are there for the first leaf of a run only.
    """
    text = CLIMB.format(leaves="{leaves}", runs="{runs}", spread_from=SPREAD_FROM, spread=SPREAD, fan=FAN)
    return leaves.sparkSession.sql(text, leaves=leaves, runs=runs)


def ways_of(steps: DataFrame) -> DataFrame:
    """(own_tree, own_at, leaf, subroot, root, proof_sha256, folded_root) from the climb's steps.

    One group is the eight leaves of a run and the steps they took.
    """
    first, shared = F.col("steps") <= 1, F.col("steps") > 1
    telling = steps.where(first | F.col("siblings").isNotNull() | F.col("last") | F.col("top"))
    by_run = telling.groupBy("own_tree", F.floor(F.col("own_at") / FAN).alias("run")).agg(
        F.array_sort(F.collect_list(F.when(shared & F.col("siblings").isNotNull(), F.struct("steps", "siblings")))).alias("upper"),
        F.collect_list(F.when(F.col("steps") == 0, F.struct("own_at", F.col("node").alias("leaf")))).alias("leaves"),
        F.map_from_entries(F.collect_list(F.when(F.col("steps") == 1, F.struct("own_at", "siblings")))).alias("lowest"),
        F.map_from_entries(F.collect_list(F.when(F.col("top"), F.struct("own_at", "folded")))).alias("folded"),
        F.max(F.when(F.col("last"), F.col("node"))).alias("subroot"),
        F.max(F.when(F.col("top"), F.col("node"))).alias("root"),
    )
    each = by_run.select("own_tree", F.explode("leaves").alias("own"), "upper", "lowest", "folded", "subroot", "root")
    own = F.col("own.own_at")
    proof = F.concat(F.coalesce(F.element_at("lowest", own), F.lit(b"")), F.aggregate("upper.siblings", F.lit(b""), lambda a, x: F.concat(a, x)))
    return each.select(
        "own_tree", own.alias("own_at"), "own.leaf", "subroot", "root", F.sha2(as_text(proof), 256).alias("proof_sha256"), F.element_at("folded", own).alias("folded_root")
    )


def _without_limits(spark: SparkSession, job: Callable[[], DataFrame]) -> DataFrame:
    """Spark stops a recursion at a number of rows and levels; both are lifted while ``job`` runs.

    The rows of the climb are the leaves times the height of the tree.
    """
    before = {key: spark.conf.get(key) for key in (ROW_LIMIT, LEVEL_LIMIT)}
    try:
        for key in before:
            spark.conf.set(key, "-1")
        return job()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def verified_manifest(docs: DataFrame, tampered: Callable[[DataFrame], Column] = every_third_lower) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    leaves, runs = stored_tree(docs, tampered)
    start = leaves.select("tree", "at", "n", "leaf", F.coalesce("changed", "leaf").alias("changed"), "up_tree", "up_level", "up_at", "slot")
    ways = _without_limits(docs.sparkSession, lambda: materialize(ways_of(climbed(start, runs)), "manifest-ways"))
    rows = leaves.select("doc_id", F.col("tree").alias("own_tree"), F.col("at").alias("own_at"))
    joined = rows.join(ways, ["own_tree", "own_at"])
    digests = [as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return joined.select("doc_id", *digests, "proof_sha256", as_text(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))
