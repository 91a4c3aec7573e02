"""URL filter: allow and block rules first, a character language-model ratio for the rest.

1. A URL is cut into host and path. The longest rule (host and path prefix) that fits
   decides; rules are a short list given by the caller, one CASE branch each, and no
   row is shuffled for them.
2. URLs that a rule decides are the labelled ones. Four of five, by a hash of
   their text, train two variable-order Markov models over characters, one of
   accepted and one of rejected URLs: counts of every character after its last ``ORDER``
   characters, over all labelled rows; shorter contexts are sums of these. A
   probability mixes its context with the next shorter one by Witten-Bell weights, down
   to the uniform one, so that an unseen context falls back to a shorter one.
3. The score of a URL is the sum over its characters of log p(accepted) - log p(rejected),
   per character. Weights are whole millionths, so that sums are exact in any order.
4. The fifth part calibrates: of all cutoffs on the score (thousandths), the one with the highest
   rate of accepted URLs at or above it less the rate of rejected ones; of equally good ones, whether a
   held-out URL has that score or not, the nearest to zero, then the lower one.
5. URLs without a rule are allowed if their score reaches the cutoff.

Characters are folded to ``SYMBOLS`` (letters a-z, one digit, some marks, one for the rest),
so the weight table that is broadcast has at most ``(SYMBOLS + 1) ** (ORDER + 1)`` rows,
whatever the corpus. Counts, scores and the calibration cover all rows. Only DataFrame
functions are used; a page's html is never read.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and is scored as
an empty text (its end alone); a rule's path must be the start of the URL's path, so a URL without a path
fits no rule; repeated rows give repeated rows; without
labelled URLs of either kind the models are uniform or one-sided and the cutoff is zero; empty tables give
empty results; further columns are ignored; of rules of one length the first by text counts, and block
before allow for one text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmetrics.session import materialize

ALLOW, BLOCK = "allow", "block"
ORDER = 3
HELD_OUT = 5  # one labelled text in so many calibrates
UNIT = 1_000_000  # weights are whole numbers of 1 / UNIT
STEP = 1_000  # scores are compared with cutoffs in 1 / STEP
START, END, DIGIT, OTHER = "^", "$", "0", "~"
MARKS = "/.-_=&"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = len(LETTERS) + len(MARKS) + 3  # with DIGIT, OTHER and END

Rule = tuple[str, str]  # (verdict, host/path)


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path of their URL."""
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.substring(F.col(url_col), at + 3, F.length(url_col))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), LETTERS.upper(), LETTERS)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_branches(rules: Sequence[Rule]) -> Column:
    """The longest of ``rules`` that fits columns host and path, as struct(rule, verdict); null for none."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0] == ALLOW), reverse=True):
        domain, _, start = rule.partition("/")
        fits = (F.col("host") == domain) | F.col("host").endswith("." + domain)
        fits = fits & F.col("path").startswith("/" + start)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def folded(text: Column) -> Column:
    """``text`` over the symbols of the models."""
    lower = F.translate(text, LETTERS.upper() + "123456789", LETTERS + DIGIT * 9)
    return F.regexp_replace(lower, rf"[^{LETTERS}0{MARKS.replace('-', '')}-]", OTHER)


def grams(text: Column, order: int = ORDER) -> Column:
    """Every character of ``text`` and its end, each with the ``order`` characters before it."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def gram_weights(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, weight) of all rows of ``counted`` (gram, good, bad: how often in labelled texts).

    All tables here are bounded by the number of possible grams.
    """
    # Tail k of a gram is its last k + 1 characters: a context of k and what follows.
    sizes = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    tails = counted.select("gram", "good", "bad", sizes).withColumn("tail", F.expr(f"substring(gram, {order + 1} - k, k + 1)"))
    context = F.expr("substring(tail, 1, k)").alias("context")
    after = tails.groupBy("k", "tail").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    seen = after.groupBy("k", context).agg(
        F.sum("good").alias("all_good"),
        F.sum("bad").alias("all_bad"),
        F.count_if(F.col("good") > 0).alias("kinds_good"),
        F.count_if(F.col("bad") > 0).alias("kinds_bad"),
    )
    known = after.select("*", context).join(seen, ["k", "context"])
    facts = F.struct("k", *[known[c] for c in ("good", "bad", "all_good", "all_bad", "kinds_good", "kinds_bad")])
    by_gram = tails.select("gram", "k", "tail").join(known.select("k", "tail", facts.alias("facts")), ["k", "tail"])
    by_gram = by_gram.groupBy("gram").agg(F.array_sort(F.collect_list("facts")).alias("facts"))

    def p(side: str) -> Column:
        def mix(shorter: Column, x: Column) -> Column:
            total, kinds = x[f"all_{side}"], x[f"kinds_{side}"]
            return F.when(total > 0, (x[side] + kinds * shorter) / (total + kinds)).otherwise(shorter)

        return F.aggregate("facts", F.lit(1.0 / SYMBOLS), mix)

    return by_gram.select("gram", F.round((F.log(p("good")) - F.log(p("bad"))) * UNIT).cast("long").alias("weight"))


def scored(rows: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` of ``rows`` with the score of column ``text`` in whole 1 / STEP per character.

    A row is exploded to its characters, joined to the broadcast weights and summed again within
    the same task; ``keys`` must be unique per row.
    """
    spread = rows.select(*keys, F.explode(grams(F.col("text"))).alias("gram"))
    spread = spread.join(F.broadcast(weights), "gram")  # at most (SYMBOLS + 1) ** (ORDER + 1) rows
    total = spread.groupBy(*keys).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    return total.select(*keys, F.floor(F.expr(f"total / (n * {UNIT // STEP})")).cast("long").alias("score"))


def cutoff(held_out: DataFrame) -> int:
    """The calibrated cutoff on ``score`` from rows (score, verdict); 0 unless both verdicts are there.

    The window runs over one row per distinct score, which the range of the weights bounds.
    """
    bins = held_out.groupBy("score").agg(F.count_if(F.col("verdict") == ALLOW).alias("good"), F.count_if(F.col("verdict") == BLOCK).alias("bad"))
    above = Window.orderBy(F.desc("score"))
    every = Window.partitionBy()
    ranked = bins.select(
        "score",
        F.sum("good").over(above).alias("good"),
        F.sum("bad").over(above).alias("bad"),
        F.lead("score").over(above).alias("below"),
        F.sum("good").over(every).alias("all_good"),
        F.sum("bad").over(every).alias("all_bad"),
    ).where("all_good > 0 AND all_bad > 0")
    gain = F.expr("cast(good as decimal(20,0)) * all_bad - cast(bad as decimal(20,0)) * all_good")
    # Whole cutoffs above the next lower score and up to this one part the held-out URLs alike.
    nearest = F.greatest(F.col("below") + 1, F.least("score", F.lit(0).cast("long")))
    best = ranked.withColumn("cutoff", nearest).orderBy(gain.desc(), F.abs("cutoff"), "cutoff").first()
    return 0 if best is None else best["cutoff"]


def filtered_urls(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row (score null where a rule decides)."""
    parts = with_parts(pages.select("page_id", "url")).withColumn("by", rule_branches(rules))
    text = folded(F.concat("host", "path"))
    rows = parts.select("page_id", "host", "path", "by.rule", "by.verdict", text.alias("text"))
    rows = rows.withColumn("held_out", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")

    counted = (
        rows.select("verdict", (F.col("verdict").isNull() | F.col("held_out")).alias("unlabelled"), F.explode(grams(F.col("text"))).alias("gram"))
        .groupBy("gram")
        .agg(
            F.count_if(~F.col("unlabelled") & (F.col("verdict") == ALLOW)).alias("good"),
            F.count_if(~F.col("unlabelled") & (F.col("verdict") == BLOCK)).alias("bad"),
        )
    )
    counted = materialize(counted, "url-grams")
    weights = materialize(gram_weights(counted), "url-weights")

    least = cutoff(scored(rows.where("verdict IS NOT NULL AND held_out"), weights, ["row", "verdict"]))
    judged = scored(rows.where("verdict IS NULL"), weights, ["row", "page_id", "host", "path"])
    judged = judged.select(
        "page_id",
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.when(F.col("score") >= least, ALLOW).otherwise(BLOCK).alias("verdict"),
        "score",
    )
    ruled = rows.where("verdict IS NOT NULL").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("long").alias("score"))
    return ruled.unionByName(judged)
