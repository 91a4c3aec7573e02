"""MinHash near-duplicates, with odd sketches to check banded candidates.

1. Every whole text becomes its set of word shingles (64-bit hashes),
   ``BANDS * ROWS`` MinHash samples, and an odd sketch of them: each sample flips one
   bit of a 512-bit map, so that the XOR of two sketches has a bit for each
   position flipped by an odd number of samples that differ. Its population
   count estimates the share of differing samples, most precisely for high
   similarities, from 64 bytes instead of the samples. A second odd sketch folds
   the whole set (1024 bits); its XOR counts at most the symmetric difference,
   so it turns away pairs just below the threshold and never a link.
2. Documents with equal sets are one class; its smallest id represents it.
   ``ROWS`` samples make a band; classes that share a band are candidates. A
   pair of similarity 0.8 shares none of 30 bands of 4 rows with probability
   (1 - 0.8^4)^30 = 2.4e-7; of 0.9, below 1e-13.
3. Bands are never expanded into all pairs. Each member is first paired with
   the smallest id of its band only. Pairs whose sketches allow the threshold
   are confirmed on the full shingle sets, and the confirmed links are
   contracted to components. Only band members that are then still in
   different components are paired with each other. So every candidate pair
   is either inside one component or was compared: no cap, and no link lost
   to a large band.

Sketches never decide that two documents are linked; that of the samples turns
away a pair at the threshold with probability below 1e-8 (``sketch_limit``).

Defined results: a null or wordless text has an empty set and is linked with
nothing; a text with fewer words than a shingle has its whole word sequence
as one; rows with a null doc_id are linked with nothing and have a null
component; rows that share a doc_id are one document; empty tables
give empty results. Words: A-Z lower-cased, cut at the six ASCII spaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.llm.graph import components
from segmetrics.session import materialize

BANDS, ROWS = 30, 4
SAMPLES = BANDS * ROWS
SKETCH_LONGS = 8
SKETCH_BITS = 64 * SKETCH_LONGS
PARITY_LONGS = 16
_WORD_CACHE = 100_000

# Multipliers and offsets of the sample hashes, from a fixed seed.
_RANDOM = np.random.default_rng(20_240_229)
_TIMES = _RANDOM.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, SAMPLES, dtype=np.uint64)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (fixed public constants)."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _WordHashes()


def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower(): A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(words_each, len(words))
    n = len(words) - k + 1
    shingles = np.full(n, k, np.uint64)
    for i in range(k):
        shingles = _mix(shingles * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(shingles)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima over a non-empty set, a block of shingles at a time."""
    low = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        block = shingles[at : at + 1024]
        np.minimum(low, (block * _TIMES[:, None] + _PLUS[:, None]).min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parities of the positions that the samples hash to, as longs."""
    at = (_mix(low ^ _TIMES) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def set_parity(shingles: np.ndarray) -> np.ndarray:
    """Odd sketch of the whole set: parities of the positions that its shingles hash to."""
    at = (_mix(shingles ^ _PLUS[0]) % np.uint64(64 * PARITY_LONGS)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * PARITY_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def sketch_limit(threshold: float, miss: float = 1e-8) -> int:
    """Most differing sketch bits that a pair at ``threshold`` can show, but for a chance of ``miss``.

    The number of differing samples is binomial; each of them flips at most
    two positions, so the limit is twice the bound of that number.
    """
    q, tail, d = 1.0 - threshold, 1.0, 0
    pmf = (1 - q) ** SAMPLES
    while tail - pmf > miss and d < SAMPLES:
        tail -= pmf
        pmf *= (SAMPLES - d) / (d + 1) * q / (1 - q)
        d += 1
    return 2 * d


def signatures(text: str | Column, words_each: int) -> Column:
    """Struct: set size, 128-bit key of the set, band keys and odd sketches (null where the set is empty)."""

    @F.arrow_udf("n long, set_key binary, bands array<long>, sketch array<long>, parity array<long>")
    def sign(texts: pa.Array) -> pa.Array:
        sizes, keys, bands, sketches, parities = [], [], [], [], []
        for t in texts:
            shingles = shingle_set(t.as_py(), words_each)
            sizes.append(len(shingles))
            if not len(shingles):
                keys.append(None), bands.append(None), sketches.append(None), parities.append(None)
                continue
            low = minhashes(shingles)
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            bands.append(band_keys(low))
            sketches.append(odd_sketch(low))
            parities.append(set_parity(shingles))
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs), pa.array(parities, longs)], ["n", "set_key", "bands", "sketch", "parity"])

    return sign(F.col(text) if isinstance(text, str) else text)


def shingle_sets(text: str | Column, words_each: int) -> Column:
    """The full shingle set as an array of longs."""

    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), words_each).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return sets(F.col(text) if isinstance(text, str) else text)


def _differing(name: str, longs: int) -> Column:
    """Population count of the XOR of both sides' bitmaps."""
    each = [F.bit_count(F.get(f"{name}_a", F.lit(i)).bitwiseXOR(F.get(f"{name}_b", F.lit(i)))) for i in range(longs)]
    return sum(each[1:], each[0])


def _may_link(percent: int) -> Column:
    """Whether sizes and odd sketches of both sides allow the threshold.

    Whole-set sketches: with S the sum of the sizes and D the size of the
    symmetric difference, a link is D * (100 + percent) <= S * (100 - percent);
    differing positions never exceed D, so this test turns away no link.
    """
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    samples = _differing("sketch", SKETCH_LONGS) <= sketch_limit(percent / 100)
    whole = _differing("parity", PARITY_LONGS) * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return sizes & samples & whole


def _side_columns(side: str) -> list[Column]:
    return [F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "sketch", "parity")]]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets (node, set)."""
    # Merge joins at every size: the sets grow with the corpus.
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")).hint("merge"), "b")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return sides.where(both * 100 >= (F.size("set_a") + F.size("set_b") - both) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, words_each: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(rows.select("doc_id", signatures("text", words_each).alias("s")).select("doc_id", "s.*"), "signatures")
    with_id = signed.where("doc_id IS NOT NULL AND n > 0")

    # A class of equal sets is represented by its smallest id. A doc_id that
    # stands for several sets (rows that share an id) links those classes.
    classes = materialize(with_id.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    nodes = materialize(
        with_id.withColumnRenamed("doc_id", "node").join(classes, ["set_key", "node"], "left_semi").dropDuplicates(["set_key", "node"]).select("node", "n", "bands", "sketch", "parity"), "class-signatures"
    )
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("band", "first")
    members = materialize(bands.join(shared.hint("merge"), "band"), "band-members")

    # Candidate pairs that the sketches allow: first each member with the first of
    # its band, then, once those links are contracted, the members still apart.
    stars = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(nodes.select(*_side_columns("b")), "b").join(nodes.select(*_side_columns("a")), "a").where(_may_link(percent))
    stars = materialize(stars.select("a", "b").distinct(), "star-pairs")
    texts = rows.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "node")
    banded = members.select("node").distinct()
    sets = materialize(texts.join(banded.hint("merge"), "node", "left_semi").select("node", shingle_sets("text", words_each).alias("set")), "shingle-sets")
    links = materialize(confirmed(stars, sets, percent), "links")

    same_id = with_id.select("doc_id", "set_key").distinct().join(classes, "set_key").where("doc_id <> node").select(F.col("doc_id").alias("b"), F.col("node").alias("a"))
    reached = materialize(components(links), "components")

    # Band members that are still apart after the stars: pair them up.
    labelled = members.select("band", "node").join(reached, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    apart = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    rest = materialize(labelled.join(apart, "band", "left_semi").join(nodes.select("node", "n", "sketch", "parity"), "node"), "members-apart")
    one = rest.select("band", F.col("component").alias("component_a"), *_side_columns("a"))
    two = rest.select("band", F.col("component").alias("component_b"), *_side_columns("b"))
    cross = one.join(two, "band").where((F.col("component_a") != F.col("component_b")) & (F.col("a") < F.col("b")) & _may_link(percent)).select("a", "b").distinct()
    cross = materialize(cross.join(stars, ["a", "b"], "left_anti"), "cross-pairs")
    more = confirmed(cross, sets, percent)

    linked = components(links.select("a", "b").union(more).union(same_id.select("a", "b")))
    whole = signed.join(classes, "set_key", "left").join(linked, signed["doc_id"] == linked["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(linked["component"], F.when(signed["n"] > 0, classes["node"]), F.col("doc_id")))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stays: the smallest id of each group, and all unlinked ones."""
    gone = materialize(near_duplicates(docs, words_each, percent).where("NOT kept").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
