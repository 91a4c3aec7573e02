"""Quality rules with risk-controlled cutoffs.

A rule rejects a document when one of its signals (a share or a mean) exceeds
a cutoff. Cutoffs are not guessed: for every stratum (language by default) the
labelled documents are a holdout, and a cutoff may be used only where the exact
binomial (Clopper-Pearson) upper bound of its false-rejection rate, the share
of good documents that it would reject, is at most the allowed risk.

Multiple testing: what is certified is the joint verdict, that any rule of a
stratum rejects a document, at the whole risk. The labelled documents are cut
in two halves by a hash of the id. On the tuning half cutoffs are picked one by
one, each time the rule and cutoff that separate bad from good best (share of
bad caught less share of good lost) among those with which the joint test still
holds there; ties go to the first rule and the more lenient cutoff. This gives
a sequence of joint cutoffs, each of them stricter than the one before: the
picks in order, each from its most lenient cutoff on. On the other half the sequence is
tested until the first failure (fixed-sequence testing, no correction needed
along it), each test at level ``delta / strata`` (Bonferroni over strata). So
with probability ``1 - delta`` the rules together reject at most ``risk`` of
the good documents of every stratum. The last certified step is in use. A
stratum without enough labels rejects nothing: with no good document lost, it
takes ``log(delta / strata) / log(1 - risk)`` good labels in each half.

Defined results: a null text has no words (base counts 0, ``base_failed``); a
null stratum is a stratum of its own; repeated rows are judged one by one;
several labels of one document count once, as good if any says so; labels
without a document, quality or doc_id are ignored; empty tables give empty results.
Texts are read whole. Columns other than the id, text and stratum are not
touched, so extra columns of any name are safe.

Scale: signals are row-local (no shuffle, no text moves between executors);
the holdout join moves narrow rows only, once; a pass over its rows for each
pick. The driver sees counts by (stratum, rule, grid level) and by (stratum,
step), bounded by ``max_strata``: beyond that number of strata, those with the fewest
labelled documents are pooled to one, and the guarantee holds for the pool.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.session import materialize

POOL = "\0others"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = bytes(range(ord("0"), ord("9") + 1))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
COUNT_TYPE = ", ".join(f"{c} long" for c in COUNTS)

_SHARES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.175, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)

# Rule -> (numerator, denominator, cutoffs from lenient to strict).
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "dup_lines": ("n_dup_lines", "n_lines", _SHARES),
    "symbols": ("n_symbols", "word_chars", _SHARES),
    "repeats": ("n_repeat_words", "n_words", _SHARES),
    "upper": ("n_upper", "word_chars", _SHARES),
    "marks": ("n_marks", "word_chars", _SHARES),
    "digits": ("n_digits", "word_chars", _SHARES),
    "word_length": ("word_chars", "n_words", (60.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0)),
}

NO_STRATUM = "∅"


@dataclass(frozen=True)
class Cutoff:
    """A certified cutoff: reject documents of ``stratum`` whose signal exceeds ``cutoff``.

    The counts and the bound are those of all cutoffs of the stratum together, on the certification half.
    """

    stratum: str
    rule: str
    cutoff: float
    n_good: int
    good_rejected: int
    bad_rejected: int
    upper_bound: float
    besides: tuple[str, ...] | None = None  # of the pool: the strata that stand alone


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    pairs = ids[:-2] * size + ids[1:-1]
    if size > 2_000_000:  # three ids no longer fit one 64-bit key
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, counts = np.unique(pairs * size + ids[2:], return_inverse=True, return_counts=True)
    again = counts[where] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() cuts at exactly the six ASCII spaces
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(data.translate(None, _UPPER)),
        len(data) - len(data.translate(None, _DIGITS)),
        text.count("!") + text.count("?"),
    )


def counts_of(text: str | Column) -> Column:
    """Struct of the text's counts."""

    @F.arrow_udf(COUNT_TYPE)
    def counts(texts: pa.Array) -> pa.Array:
        table = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(column) for column in table.T], list(COUNTS))

    return counts(F.col(text) if isinstance(text, str) else text)


def stratum_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NO_STRATUM))


def base_failed(counts: str) -> Column:
    """Too short, or more than half of the words in repeated 3-word windows."""
    n, again = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < 50) | (again * 100 > n * 50)


def signal(rule: str, counts: str) -> Column:
    above, below, _ = RULES[rule]
    return F.try_divide(F.col(f"{counts}.{above}").cast("double"), F.col(f"{counts}.{below}").cast("double"))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One narrow row per document: id, ``stratum`` and the struct ``counts``."""
    return docs.select(F.col(id_col).alias("doc_id"), stratum_of(stratum_col).alias("stratum"), counts_of(text_col).alias("counts"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def binomial_cdf(k: int, n: int, p: float) -> float:
    """Exact P(Bin(n, p) <= k), by the regularized incomplete beta function."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound at confidence ``1 - level`` for k of n."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > level else (low, mid)
    return high


def holdout(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, counts, good (0 or 1) and half (0 tuning, 1 certification) of the labelled documents.

    Documents that fail the base rule are left out: no cutoff decides on them.
    """
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("good"))
    rows = counted.where(~base_failed("counts")).join(truth, "doc_id")
    return rows.select("stratum", "counts", (F.col("good") > 0).cast("int").alias("good"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))


def rule_histogram(rows: DataFrame) -> dict[str, dict[str, dict[tuple[int, int], int]]]:
    """stratum -> rule -> {(first cutoff exceeded, good): documents}."""
    levels = []
    for rule, (_, _, cutoffs) in RULES.items():
        level = F.lit(len(cutoffs))
        for i in reversed(range(len(cutoffs))):
            level = F.when(signal(rule, "counts") > cutoffs[i], F.lit(i)).otherwise(level)
        levels.append(F.struct(F.lit(rule).alias("rule"), level.alias("level")))
    found = rows.select("stratum", "good", F.explode(F.array(*levels)).alias("at")).groupBy("stratum", "at.rule", "at.level", "good").count()
    table: dict[str, dict[str, dict[tuple[int, int], int]]] = {}
    for r in found.collect():
        table.setdefault(r["stratum"], {}).setdefault(r["rule"], {})[r["level"], r["good"]] = r["count"]
    return table


def tuned_picks(tuning: DataFrame, totals: dict[str, dict[int, int]], risk: float, level: float) -> dict[str, list[tuple[str, int]]]:
    """stratum -> (rule, index of its cutoff) in the order in which they were picked on the tuning half."""
    picks: dict[str, list[tuple[str, int]]] = {s: [] for s in totals}
    gone = {s: {0: 0, 1: 0} for s in totals}
    active = set(totals)
    while active:
        chosen = [Cutoff(s, rule, RULES[rule][2][i], 0, 0, 0, 0.0) for s in sorted(active) for rule, i in picks[s]]
        rest = rule_histogram(tuning.where(F.col("stratum").isin(sorted(active)) & passes(chosen, "counts", "stratum")))
        for stratum in sorted(active):
            good, bad = totals[stratum].get(1, 0), totals[stratum].get(0, 0)
            best, gain, now = None, 0.0, None
            for rule in RULES:
                bins = rest.get(stratum, {}).get(rule, {})
                lost = caught = 0
                for i in range(len(RULES[rule][2])):
                    lost += bins.get((i, 1), 0)
                    caught += bins.get((i, 0), 0)
                    if binomial_cdf(gone[stratum][1] + lost, good, risk) > level:
                        break
                    if bad and (share := caught / bad - lost / good) > gain:
                        best, gain, now = (rule, i), share, (caught, lost)
            if best is None:
                active.discard(stratum)
                continue
            picks[stratum].append(best)
            for g in (0, 1):
                gone[stratum][g] += now[g]
    return picks


def steps_of(picks: list[tuple[str, int]]) -> list[dict[str, int]]:
    """The joint cutoffs in order of strictness: rule -> index of its cutoff."""
    steps: list[dict[str, int]] = []
    for rule, last in picks:
        before = dict(steps[-1]) if steps else {}
        steps += [{**before, rule: i} for i in range(before.get(rule, -1) + 1, last + 1)]
    return steps


def pooled(rows: DataFrame, max_strata: int) -> tuple[DataFrame, tuple[str, ...] | None]:
    """``rows`` with at most ``max_strata`` strata, and the strata that stand alone (None: all do).

    Beyond that number, the strata with the most labelled documents (of equal ones, the first by name) stand alone
    and all others are one, ``POOL``: it is tested and has its guarantee as a whole.
    """
    largest = rows.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(max_strata + 1).collect()
    if len(largest) <= max_strata:
        return rows, None
    alone = tuple(r["stratum"] for r in largest[: max_strata - 1])
    return rows.withColumn("stratum", F.when(F.col("stratum").isin(*alone), F.col("stratum")).otherwise(POOL)), alone


def certified_cutoffs(
    counted: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, max_strata: int = 200
) -> list[Cutoff]:
    """The cutoffs in use: at most one per (stratum, rule), in that order."""
    rows = materialize(holdout(counted, labels), "quality-holdout")
    rows, alone = pooled(rows, max_strata)
    got = rows.groupBy("stratum", "half", "good").count().collect()  # of max_strata strata, four rows each
    strata = sorted({r["stratum"] for r in got})
    level = delta / max(1, len(strata))
    totals = [{s: {r["good"]: r["count"] for r in got if (r["stratum"], r["half"]) == (s, half)} for s in strata} for half in (0, 1)]
    # Where not even a verdict that loses no good document passes, nothing is tuned.
    enough = {s for s in strata if all(binomial_cdf(0, t[s].get(1, 0), risk) <= level for t in totals)}
    picks = tuned_picks(rows.where("half = 0"), {s: totals[0][s] for s in strata if s in enough}, risk, level)
    steps = {s: steps_of(p) for s, p in picks.items() if p}
    if not steps:
        return []
    # The first step that rejects a document; all later ones do so too.
    first = F.lit(None).cast("int")
    for stratum, sequence in steps.items():
        at = F.lit(len(sequence))
        for k in reversed(range(len(sequence))):
            rule, i = next(iter(sequence[k].items() - (sequence[k - 1].items() if k else set())))
            at = F.when(signal(rule, "counts") > RULES[rule][2][i], F.lit(k)).otherwise(at)
        first = F.when(F.col("stratum") == stratum, at).otherwise(first)
    tested = rows.where((F.col("half") == 1) & F.col("stratum").isin(sorted(steps))).groupBy("stratum", first.alias("step"), "good").count().collect()
    bins = {(r["stratum"], r["step"], r["good"]): r["count"] for r in tested}
    found = []
    for stratum, sequence in sorted(steps.items()):
        good, passed, lost, caught = totals[1][stratum].get(1, 0), None, 0, 0
        for k, step in enumerate(sequence):
            lost += bins.get((stratum, k, 1), 0)
            caught += bins.get((stratum, k, 0), 0)
            if binomial_cdf(lost, good, risk) > level:
                break
            passed = (step, lost, caught)
        if passed:
            step, lost_at, caught_at = passed
            bound = upper_bound(lost_at, good, level)
            besides = alone if stratum == POOL else None
            found += [Cutoff(stratum, rule, RULES[rule][2][step[rule]], good, lost_at, caught_at, bound, besides) for rule in RULES if rule in step]
    return found


def passes(cutoffs: list[Cutoff], counts: str, stratum: str) -> Column:
    """Whether a document breaks no cutoff of its stratum (row-local)."""
    verdict = F.lit(True)
    for c in cutoffs:
        mine = F.col(stratum) == c.stratum if c.besides is None else ~F.col(stratum).isin(*c.besides)
        broken = mine & (signal(c.rule, counts) > c.cutoff)
        verdict = verdict & ~F.coalesce(broken, F.lit(False))
    return verdict


def quality_verdicts(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Counts and verdict of every document: doc_id, stratum, counts, base_failed, kept."""
    counted = materialize(document_counts(docs), "quality-counts")
    cutoffs = certified_cutoffs(counted, labels, **limits)
    return counted.withColumn("base_failed", base_failed("counts")).withColumn("kept", ~F.col("base_failed") & passes(cutoffs, "counts", "stratum"))


def keep_good(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    The counts are computed again beside the text instead of joining the
    verdicts back, so that no text is shuffled. Those for the cutoffs are
    stored: a plan that filters and returns them runs the Python function
    twice in a task, each time in a worker of its own.
    """
    counted = materialize(document_counts(docs), "quality-counts")
    cutoffs = certified_cutoffs(counted, labels, **limits)
    counts, stratum = fresh(docs, "counts"), fresh(docs, "stratum")
    rows = docs.withColumn(stratum, stratum_of("lang")).withColumn(counts, counts_of("text"))
    return rows.where(~base_failed(counts) & passes(cutoffs, counts, stratum)).select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
