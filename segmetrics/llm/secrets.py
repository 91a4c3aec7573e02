"""Secret scan with multipart credential linking.

Base kinds stand alone: an assignment to a secret-like name, an access key
identifier, a long hexadecimal run. Weak kinds mean little by themselves: an
account identifier (``client_id = x``), a bare mixed token of 32 or more
characters, an endpoint (a URL or host setting). A weak candidate is reported
only if a complementary part lies within its scope, a gap of at most ``SCOPE``
code points to either side in the same document, whatever the lengths of both: an identifier needs a secret, a secret needs
an identifier or an endpoint, an endpoint needs an identifier or a secret with
it. Parts are joined by running maxima over the sorted starts and ends of a
document, not by pairs, so a document full of parts costs a sort of them.

Only DataFrame and SQL functions are used. Positions come from the lengths of
the pieces between the matches, in code points.

Defined results: a null text is an empty one (no spans); repeated rows get
equal rows; a null doc_id is an id like any other; an empty table gives no rows; further columns are
ignored (and kept by ``masked``). Whole texts are scanned; many matches in one text cost little more than their number.
Parts of a weak candidate that overlap a base span are dropped in its favour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmetrics.llm.quality import fresh
from segmetrics.session import materialize

SCOPE = 200

# Kinds in the order in which they are listed: (kind, pattern, least length of
# a group, that group). Base kinds first.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")
WEAK = {
    "account": r"""(?i)\b(?:client_?id|account_?id|user_?name|login|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "bare": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}",
    "endpoint": r"""(?i)\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!&'*+;=%-]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}""",
}
KINDS = (*BASE_KINDS, *WEAK)
# What a part can stand for, as bits: identifier 1, secret 2, endpoint 4.
ROLES = {"assign": 2, "access": 1, "hex": 2, "account": 1, "bare": 2, "endpoint": 4}
# A weak kind is reported if its scope holds all the roles of one of these masks.
NEEDS = {"account": (2,), "bare": (1, 4), "endpoint": (3,)}

SPAN = "array<struct<start:int,rank:int,finish:int>>"


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """``items`` in consecutive blocks, about as many as each is long."""

    def cut(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1), lambda b: F.slice(x, b * size + 1, size))

    return F.when(F.size(items) > 0, _bound(items, cut)).otherwise(F.array(items))


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches of ``pattern`` as (start, rank of the kind, finish), in code points.

    Match i starts after the first i pieces between matches and the i matches before it. The sums run
    within blocks of matches first and then over the blocks, as an array is copied whenever it grows.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    all_of = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    steps = _bound(found, lambda m: F.arrays_zip(m.alias("m"), F.slice(between, 1, F.size(m)).alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        finish = start + F.char_length(x["m"])
        keep = F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6 if kind == "assign" else F.lit(True)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), finish.alias("finish"))
        return F.struct(finish.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def join(acc: Column, block: Column) -> Column:
        def moved(s: Column) -> Column:
            return F.struct((s["start"] + acc["at"]).alias("start"), s["rank"].alias("rank"), (s["finish"] + acc["at"]).alias("finish"))

        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(block["out"], moved))).alias("out"))

    blocks = F.transform(_blocks(steps), lambda b: F.aggregate(b, first, step))
    spans = F.flatten(F.aggregate(blocks, all_of, join)["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def found_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a text fingerprint, and the array of base and of weak parts of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    # A document without any mark of a part is not scanned for it.
    marks = {"account": r"(?i)(?:id|name|login|user)[\"']?\x20*[:=]", "bare": r"[A-Za-z0-9+/_-]{32}", "endpoint": r"(?i)://|(?:host|endpoint|server)[\"']?\x20*[:=]"}
    empty = F.array().cast(SPAN)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("print"),
        F.concat(*[F.when(text.rlike(p), _spans(text, k, p)).otherwise(empty) for k, p in base.items()]).alias("base"),
        F.concat(*[F.when(text.rlike(marks[k]), _spans(text, k, p)).otherwise(empty) for k, p in WEAK.items()]).alias("weak"),
    )


def linked_weak(parts: DataFrame) -> DataFrame:
    """doc_id, print and the array ``linked`` of weak parts with complementary parts in their scope."""
    both = parts.where("size(weak) > 0 AND size(base) + size(weak) > 1")
    rows = both.select("doc_id", "print", F.explode(F.concat("base", "weak")).alias("p")).distinct()
    # Events in order of position: where a part starts, it counts with its finish
    # from then on; a weak part asks for the farthest finish of each role among the
    # parts that start up to SCOPE behind it, and of base parts that start before its end.
    weak = F.col("p.rank") >= len(BASE_KINDS)
    at = lambda position, ask: F.struct(position.alias("position"), F.lit(ask).alias("ask"))
    start = at(F.col("p.start"), 0)
    asked = F.array(start, at(F.col("p.finish") + SCOPE, 1), at(F.col("p.finish") - 1, 2))
    events = rows.select("doc_id", "print", "p", F.explode(F.when(weak, asked).otherwise(F.array(start))).alias("e"))
    so_far = Window.partitionBy("doc_id", "print").orderBy("e.position").rangeBetween(Window.unboundedPreceding, 0)

    def farthest(ranks: list[int]) -> Column:
        return F.max(F.when((F.col("e.ask") == 0) & F.col("p.rank").isin(ranks), F.col("p.finish"))).over(so_far)

    bits = sorted(set(ROLES.values()))
    ends = [farthest([KINDS.index(k) for k, bit in ROLES.items() if bit == b]).alias(f"end_{b}") for b in bits]
    seen = events.select("doc_id", "print", "p", "e", *ends, farthest(list(range(len(BASE_KINDS)))).alias("base_end")).where("e.ask > 0")
    near = lambda b: F.coalesce((F.col("e.ask") == 1) & (F.col(f"end_{b}") >= F.col("p.start") - SCOPE), F.lit(False))
    covered = F.coalesce((F.col("e.ask") == 2) & (F.col("base_end") > F.col("p.start")), F.lit(False))
    seen = seen.groupBy("doc_id", "print", "p").agg(*[F.max(near(b)).alias(f"near_{b}") for b in bits], F.max(covered).alias("covered"))
    linked = F.lit(False)
    for kind, masks in NEEDS.items():
        for mask in masks:
            held = F.col("p.rank") == KINDS.index(kind)
            for b in bits:
                held = held & F.col(f"near_{b}") if mask & b else held
            linked = linked | held
    return seen.where(linked & ~F.col("covered")).groupBy("doc_id", "print").agg(F.collect_set("p").alias("linked"))


def printed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, print and the sorted spans of every row: ``base`` and ``all`` (with linked weak parts)."""
    parts = materialize(found_parts(docs), "secret-parts")
    links = linked_weak(parts)
    links = links.select(F.col("doc_id").alias("link_id"), F.col("print").alias("link_print"), "linked")
    same = F.col("doc_id").eqNullSafe(F.col("link_id")) & (F.col("print") == F.col("link_print"))
    rows = parts.join(links, same, "left").select("doc_id", "print", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))
    return rows.select("doc_id", "print", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "linked")).alias("all"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted spans of every row: ``base`` and ``all`` (with linked weak parts)."""
    return printed_spans(docs).select("doc_id", "base", "all")


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["finish"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = secret_spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"),
        _written("all").alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every base part in its texts replaced by ``mark``; other columns unchanged."""
    text = F.col("text")
    # Group 2 counts, so an assignment is replaced only if it has 6 or more characters.
    long_assign = ASSIGN.replace("([A-Za-z0-9+/_.=-]+)", "([A-Za-z0-9+/_.=-]{6,}+)")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, long_assign, mark), ACCESS, mark), HEX, mark)
    return docs.withColumn("text", clean)


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with its sorted ``spans`` replaced by ``mark``; spans that overlap are one.

    A piece is found by counting characters from the start of its text, so the text is cut at
    blocks of spans first, and each block at its spans.
    """
    farthest = lambda block: F.array_max(F.transform(block, lambda s: s["finish"]))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def before_blocks(blocks: Column) -> Column:
        """The farthest finish before each block, and after the last one."""

        def step(acc: Column, block: Column) -> Column:
            return F.struct(F.greatest(acc["at"], farthest(block)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(blocks, none, step, lambda acc: F.concat(acc["out"], F.array(acc["at"])))

    def pieces(part: Column, origin: Column, block: Column) -> Column:
        """The text from ``origin`` on, where the blocks before end, to the end of this one."""
        first = F.struct(origin.alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substr(part, acc["at"] - origin + 1, s["start"] - acc["at"])
            out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["finish"]).alias("at"), out.alias("out"))

        return F.array_join(F.aggregate(block, first, step)["out"], "")

    def whole(x: Column) -> Column:
        def one(block: Column, i: Column) -> Column:
            origin = F.get(x["befores"], i)
            return _bound(F.substr(text, origin + 1, F.get(x["befores"], i + 1) - origin), lambda part: pieces(part, origin, block))

        rest = F.element_at(x["befores"], -1)
        return F.concat(F.array_join(F.transform(x["blocks"], one), ""), F.substr(text, rest + 1, F.char_length(text)))

    cut = _bound(_blocks(spans), lambda blocks: F.struct(blocks.alias("blocks"), before_blocks(blocks).alias("befores")))
    return F.when(F.size(spans) > 0, _bound(cut, whole)).otherwise(text)


def masked(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported part, base or linked, in its texts replaced by ``mark``; other columns unchanged.

    Spans go back to their rows by doc_id and text print.
    """
    found = printed_spans(docs.select("doc_id", "text")).where(F.size("all") > 0)
    spans, span_id, span_print = (fresh(docs, c) for c in ("spans", "span_id", "span_print"))
    # Equal rows have equal spans.
    found = found.groupBy(F.col("doc_id").alias(span_id), F.col("print").alias(span_print)).agg(F.first("all").alias(spans))
    found = materialize(found, "secret-spans")
    same = F.col("doc_id").eqNullSafe(F.col(span_id)) & (F.xxhash64("text") == F.col(span_print))
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(_masked(F.col("text"), F.col(spans), mark))
    return docs.join(found, same, "left").withColumn("text", clean).select(*[F.col(f"`{c}`") for c in docs.columns])
