"""Benchmark decontamination by SimHash of item-sized windows.

1. Texts become words (lower case, runs of letters and digits) and word
   shingles, each a 64-bit hash whose low bits hold its weight (about the
   base-2 logarithm of its letters, so that long words count more).
2. A window has the size of a benchmark item, in words; a text of fewer words
   is one window as a whole. Only windows that can
   reach the threshold are fingerprinted: those over at least one shingle of an
   item of that size. A window without one has similarity 0, so nothing is lost.
   Fingerprint: 64-bit SimHash of the window's distinct shingles by weight.
3. Multi-index: a fingerprint is cut into ``BLOCKS`` blocks. Of two
   fingerprints within ``RADIUS`` bits, some block pair differs in at most
   ``RADIUS // BLOCKS`` bits (pigeonhole). The item side stores all variants of
   its blocks within that distance, so an equi-join on (size, block, value)
   finds every pair within the radius.
4. Candidates within the radius are verified by the exact weighted similarity,
   weight of the common shingles over weight of all shingles, at least
   ``threshold``.

A window whose similarity is 0.8 differs in 9.7 bits on average (standard
deviation 2.9) and lies within 14 bits with probability 0.95; at 0.9 that is
0.999, and an exact passage differs in none. ``RADIUS`` is a parameter.

Only DataFrame and SQL functions are used. Equal texts are fingerprinted once:
hits carry a fingerprint of the text, and results are joined back to all rows.

Defined results: null and wordless texts and items match nothing; an item of
fewer words than a shingle is one shingle of all its words; repeated rows give
equal results; rows with a null doc_id are reported with a null doc_id; items
with equal text are all reported; null item ids are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.session import materialize

SHINGLE = 5
BLOCKS = 5
RADIUS = 14
WEIGHT_BITS = 5
LANES = 32  # two counters share a long: bits j and j + 32

_WIDTHS = [64 * (b + 1) // BLOCKS - 64 * b // BLOCKS for b in range(BLOCKS)]
_STARTS = [64 * b // BLOCKS for b in range(BLOCKS)]


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` needs it within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for none."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.array_remove(F.split(clean, " "), "")


def shingle_array(words: Column) -> Column:
    """Hash of each shingle in order, its weight in the low bits."""

    def one(text: Column) -> Column:
        weight = F.ceil(F.log2(F.char_length(text) + 1)).cast("long")
        return F.shiftleft(F.shiftright(F.xxhash64(text), WEIGHT_BITS), WEIGHT_BITS).bitwiseOR(F.least(weight, F.lit(2**WEIGHT_BITS - 1)))

    def every(w: Column) -> Column:
        last = F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))
        texts = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
        return F.when(F.size(w) > 0, F.transform(texts, one)).otherwise(F.array().cast("array<long>"))

    return bound(words, every)


def _weight(shingle: Column) -> Column:
    return shingle.bitwiseAND(F.lit(2**WEIGHT_BITS - 1))


def total_weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: acc + _weight(x))


def simhash_blocks(shingles: Column) -> Column:
    """The SimHash of distinct shingles as an array of ``BLOCKS`` integers.

    A bit is set if shingles of more than half of the weight have it.
    """
    mask = F.lit((1 << LANES) + 1)
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(LANES)], F.lit(0).cast("long").alias("total"))

    def add(acc: Column, x: Column) -> Column:
        bits, w = F.xxhash64(x), _weight(x)
        lanes = [(acc[f"c{j}"] + F.shiftrightunsigned(bits, j).bitwiseAND(mask) * w).alias(f"c{j}") for j in range(LANES)]
        return F.struct(*lanes, (acc["total"] + w).alias("total"))

    def blocks(acc: Column) -> Column:
        def bit(j: int) -> Column:
            count = F.shiftrightunsigned(acc[f"c{j % LANES}"], LANES * (j // LANES)).bitwiseAND(F.lit((1 << (LANES - 1)) - 1))
            return (count * 2 > acc["total"]).cast("int")

        def block(b: int) -> Column:
            out = F.lit(0)
            for k in range(_WIDTHS[b]):
                out = out + bit(_STARTS[b] + k) * (1 << k)
            return out

        return F.array(*[block(b) for b in range(BLOCKS)])

    return F.aggregate(shingles, zero, add, blocks)


def _variants(value: Column, width: int, flips: int) -> Column:
    """All values within ``flips`` bits of ``value``."""
    masks = [0]
    for _ in range(flips):
        masks = sorted({m | 1 << k for m in masks for k in range(width)} | set(masks))
    return F.transform(F.array(*map(F.lit, masks)), lambda m: value.bitwiseXOR(m))


def prepared_items(benchmark: DataFrame) -> DataFrame:
    """item_id, size in words, shingles (in order), distinct set, its blocks."""
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("words"))
    rows = rows.where(F.size("words") > 0).select("item_id", F.size("words").alias("size"), F.array_distinct(shingle_array(F.col("words"))).alias("item_set"))
    return rows.select("*", simhash_blocks(F.col("item_set")).alias("item_blocks"))


def item_index(items: DataFrame) -> DataFrame:
    """(size, block, value, item_id): the variants of every block of every item."""
    def tagged(b: int) -> Column:
        return F.transform(_variants(F.get("item_blocks", F.lit(b)), _WIDTHS[b], RADIUS // BLOCKS), lambda v: F.struct(F.lit(b).alias("block"), v.alias("value")))

    each = [tagged(b) for b in range(BLOCKS)]
    return items.select("size", "item_id", F.explode(F.concat(*each)).alias("v")).select("size", "v.block", "v.value", "item_id")


def hit_positions(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(print, check, size, at): shingle positions of distinct texts that an item of ``size`` words has.

    Short items (fewer words than a shingle) are looked up among windows of their own size.
    """
    text = F.col("text")
    prints = (F.xxhash64(text).alias("print"), F.crc32(text.cast("binary")).alias("check"))
    gate = materialize(items.select("size", F.explode("item_set").alias("h")).distinct(), "item-shingles")
    rows = docs.where(text.isNotNull()).select(*prints, F.posexplode(shingle_array(words_of(text))).alias("at", "h"))
    return rows.join(gate, "h").select("print", "check", "size", "at").distinct()


def short_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("size") < SHINGLE)


def _short_positions(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Positions for items shorter than a shingle: each word is a possible window start."""
    text = F.col("text")
    sizes = items.where(F.col("size") < SHINGLE).select("size", F.get("item_set", F.lit(0)).alias("h")).distinct()
    words = F.col("words")
    rows = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("print"), F.crc32(text.cast("binary")).alias("check"), words_of(text).alias("words"))

    def of_size(n: int) -> Column:
        def window(i: Column) -> Column:
            return F.struct(F.lit(n).alias("size"), (i - 1).alias("at"), F.get(shingle_array(F.slice(words, i, n)), F.lit(0)).alias("h"))

        none = F.array().cast("array<struct<size:int,at:int,h:bigint>>")
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), window)).otherwise(none)

    rows = materialize(rows, "short-words")
    each = [of_size(n) for n in range(1, SHINGLE)]
    found = rows.select("print", "check", F.explode(F.concat(*each)).alias("w")).select("print", "check", "w.*")
    return found.join(sizes, ["size", "h"]).select("print", "check", "size", "at").distinct()


def windows(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(print, check, size, start, n_words, shingles): the windows for items of ``size`` over hit positions, for each distinct text.

    A text of fewer words than ``size`` is one window, of all its words.
    """
    starts = hits.groupBy("print", "check").agg(F.collect_set(F.struct("size", "at")).alias("hits"))
    starts = materialize(starts, "window-hits")
    text = F.col("text")
    rows = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("print"), F.crc32(text.cast("binary")).alias("check"), text)
    texts = rows.join(starts.hint("merge"), ["print", "check"]).groupBy("print", "check").agg(F.first("text").alias("text"), F.first("hits").alias("hits"))
    texts = texts.select("print", "check", "hits", words_of(text).alias("words"))
    texts = materialize(texts.select("*", shingle_array(F.col("words")).alias("shingles")), "window-texts")
    n = F.size("words")

    def starts_over(hit: Column) -> Column:
        """Windows over the hit, packed as size * 2^32 + start."""
        # A window of ``size`` words has size - SHINGLE + 1 shingles (one at least).
        high = F.greatest(F.lit(0), F.least(hit["at"], n - hit["size"]))
        low = F.greatest(F.lit(0), high - F.greatest(hit["size"] - SHINGLE, F.lit(0)))
        size = F.shiftleft(hit["size"].cast("long"), 32)
        return F.transform(F.sequence(low, high), lambda at: size + at)

    each = F.array_distinct(F.flatten(F.transform("hits", starts_over)))
    joined = texts.select("print", "check", "words", "shingles", F.explode(each).alias("w"))
    joined = joined.withColumn("w", F.struct(F.shiftright("w", 32).cast("int").alias("size"), F.col("w").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("start")))
    whole = F.slice("shingles", F.col("w.start") + 1, F.greatest(F.col("w.size") - SHINGLE + 1, F.lit(1)))
    short = shingle_array(F.slice("words", F.col("w.start") + 1, F.col("w.size")))
    taken = F.array_distinct(F.when(F.col("w.size") < SHINGLE, short).otherwise(whole))
    return joined.select("print", "check", "w.size", "w.start", F.least(F.col("w.size"), n).alias("n_words"), taken.alias("shingles"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each row for each item found in it.

    Of equal similarities the first window counts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = materialize(prepared_items(benchmark), "benchmark-items")
    hits = hit_positions(rows, items)
    if not short_items(items).isEmpty():
        hits = hits.union(_short_positions(rows, items))
    found = materialize(windows(rows, materialize(hits, "shingle-hits")).withColumn("blocks", simhash_blocks(F.col("shingles"))), "windows")

    keys = found.select("print", "check", "size", "start", F.posexplode("blocks").alias("block", "value"))
    near = keys.join(item_index(items), ["size", "block", "value"]).select("print", "check", "size", "start", "item_id").distinct()
    # ``size`` and ``start`` name the window; fetch both sides and verify.
    sides = near.join(found, ["print", "check", "size", "start"]).join(items.select("item_id", "item_set", "item_blocks"), "item_id")
    differ = sum((F.bit_count(F.get("blocks", F.lit(b)).bitwiseXOR(F.get("item_blocks", F.lit(b)))) for b in range(1, BLOCKS)), F.bit_count(F.get("blocks", F.lit(0)).bitwiseXOR(F.get("item_blocks", F.lit(0)))))
    common = total_weight(F.array_intersect("shingles", "item_set"))
    either = total_weight(F.col("shingles")) + total_weight(F.col("item_set")) - common
    scored = sides.where(differ <= RADIUS).select("print", "check", "item_id", "n_words", "start", (common / either).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("print", "check", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), "n_words")).alias("best"))
    best = materialize(best.select("print", "check", "item_id", "best.similarity", (-F.col("best.back")).alias("start_word"), "best.n_words"), "contaminated-texts")
    ids = rows.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("print"), F.crc32(F.col("text").cast("binary")).alias("check"))
    return ids.join(best, ["print", "check"]).select("doc_id", "item_id", "similarity", "start_word", "n_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id holds no benchmark item; null ids stay."""
    found = materialize(contaminated(docs, benchmark, threshold).where("doc_id IS NOT NULL").select("doc_id").distinct(), "contaminated-ids")
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
