"""URL filter, Merkle manifest and phrase collocations against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from segmetrics.llm import manifest, phrases, registry, urls  # noqa: E402
from segmetrics.verify import compare, duckdb_views  # noqa: E402

SF = "/root/testdata/sf0.001"
CLASH = ("at", "n", "tree", "level", "host", "path", "rule", "verdict", "gram", "weight", "words", "f", "shard", "rank", "score", "digest", "leaf", "seq", "row")


# --- op11 ---------------------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*)[\s\S]*", url.split("://", 1)[1]).groups()
    return brute.ascii_lower(host), path


def plain_rule(host, path, rules):
    fits = []
    for verdict, rule in rules:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else None


def plain_model(texts, order=urls.ORDER):
    """p(character | context) of padded texts, by Witten-Bell mixing over contexts of 0 to ``order``."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        padded = urls.START * order + t + urls.END
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[k][padded[i - k : i]][padded[i]] += 1

    def p(context, c):
        value = 1.0 / urls.SYMBOLS
        for k in range(order + 1):
            after = seen[k].get(context[order - k :])
            if after:
                value = (after[c] + len(after) * value) / (sum(after.values()) + len(after))
        return value

    return p


def plain_score(text, good, bad, order=urls.ORDER):
    padded = urls.START * order + text + urls.END
    total = 0
    for i in range(order, len(padded)):
        context = padded[i - order : i]
        total += math.floor((math.log(good(context, padded[i])) - math.log(bad(context, padded[i]))) * urls.UNIT + 0.5)
    return total // ((len(text) + 1) * (urls.UNIT // urls.STEP))


def plain_fold(text):
    return "".join("0" if c in "0123456789" else c if c in urls.LETTERS or c in urls.MARKS else urls.OTHER for c in brute.ascii_lower(text))


def plain_filter(rows, rules, held_out):
    """(page_id, host, path, rule, verdict) and the scores of rows without a rule."""
    parts = [(page, *plain_parts(url)) for page, url in rows]
    found = [plain_rule(h, p, rules) for _, h, p in parts]
    texts = [plain_fold(h + p) for _, h, p in parts]
    train = {v: [t for t, r in zip(texts, found) if r and r[1] == v and not held_out[t]] for v in ("allow", "block")}
    good, bad = plain_model(train["allow"]), plain_model(train["block"])
    held = [(plain_score(t, good, bad), r[1]) for t, r in zip(texts, found) if r and held_out[t]]
    n_good, n_bad = (sum(v == kind for _, v in held) for kind in ("allow", "block"))
    best = 0
    if n_good and n_bad:

        def gain(s):
            return sum(n_bad if v == "allow" else -n_good for x, v in held if x >= s)

        low, high = min(s for s, _ in held), max(s for s, _ in held)
        best = min(range(min(low, 0), max(high, 0) + 1), key=lambda s: (-gain(s), abs(s), s))
    out = []
    for (page, h, p), r, t in zip(parts, found, texts):
        score = None if r else plain_score(t, good, bad)
        out.append((page, h, p, *(r or (None, "allow" if score >= best else "block")), score))
    return sorted(out, key=repr)


def held_out_texts(spark, texts):
    df = spark.createDataFrame([(t,) for t in set(texts)], "t string")
    return {r["t"]: r["h"] for r in df.select("t", (F.pmod(F.xxhash64("t"), F.lit(urls.HELD_OUT)) == 0).alias("h")).collect()}


def check_urls(spark, rows, rules):
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in CLASH})
    got = sorted((tuple(r) for r in urls.filtered_urls(df, rules).collect()), key=repr)
    held = held_out_texts(spark, [plain_fold("".join(plain_parts(u))) for _, u in rows])
    want = plain_filter(rows, rules, held)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs((g[5] or 0) - (w[5] or 0)) <= 1 for g, w in zip(got, want))
    return got


def test_url_filter_on_a_given_table(spark):
    pages = spark.read.parquet(f"{SF}/../sf0.01/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url").collect()]
    got = check_urls(spark, rows, registry.URL_RULES)
    assert {g[4] for g in got if g[3] is None} == {"allow", "block"}
    out = registry.op11_url_filter(spark, f"{SF}/../sf0.01").select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((g[:5] for g in got), key=repr)


def test_url_filter_parts_and_rules(spark):
    long = "https://Ärger.ORG/" + "a" * 50_000
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "x://ORG/"), (6, "x://org"), (7, "x://a.org?q=/"), (8, "x://example.org/es/1"),
        (9, "x://example.org/es"), (10, "x://www.EXAMPLE.org/en/12#x"), (11, "x://notexample.org/en/1"), (12, "x://forg/"), (13, "x://a.com/de/://b"),
        (14, "x://b.com/fr/"), (None, "x://b.com/fr/"), (14, "x://b.com/fr/"), (15, long), (16, "x://com\n/de/x"), (17, "x://u@h:8/%F0#?"), (18, "x://h?/p"),
    ]
    got = {g[0]: g for g in check_urls(spark, rows, registry.URL_RULES)}
    assert got[1][1:4] == got[3][1:4] == ("", "", None)
    assert got[5][3:5] == ("org/", "allow") and got[6][3] is None and got[7][2:4] == ("", None)
    assert got[8][3:5] == ("example.org/es/", "block") and got[9][3] == "org/" and got[10][3] == "example.org/en/1"
    assert got[11][3] == "org/" and got[12][3] is None and got[13][3] == "com/de/" and got[18][1:3] == ("h", "")
    assert urls.filtered_urls(spark.createDataFrame([], "page_id long, url string"), registry.URL_RULES).count() == 0


def test_url_models_tell_held_out_sites_apart(spark):
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), 7))
    rows = []
    for i in range(600):
        good = i % 2 == 0
        name = word("aeioustrn") if good else word("xzqkwvjy")
        rows.append((i, f"http://{name}.{('org' if good else 'com') if i < 400 else 'net'}/{'fr' if good else 'de'}/{name}"))
    got = urls.filtered_urls(spark.createDataFrame(rows, "page_id long, url string"), registry.URL_RULES).where("rule IS NULL").collect()
    assert len(got) == 200 and sum((r["verdict"] == "allow") == (r["page_id"] % 2 == 0) for r in got) >= 195


def test_url_filter_stays_native(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    plan = urls.filtered_urls(df, registry.URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan


# --- op12 ---------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, lower=False):
    values = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    if lower and values[4] is not None:
        values[4] = brute.ascii_lower(values[4])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_climb(nodes, at):
    """Siblings and positions of node ``at`` on its way up, and the last node."""
    steps = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        steps.append((run, at % 8))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at //= 8
    return steps, nodes[0]


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda x: x[:3])
    subroots = [plain_climb([x[2] for x in groups[g]], 0)[1] for g in langs]
    out = []
    for k, g in enumerate(langs):
        leaves = [x[2] for x in groups[g]]
        for at, (_, _, leaf, r) in enumerate(groups[g]):
            lower, _ = plain_climb(leaves, at)
            upper, root = plain_climb(subroots, k)
            chosen = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            folded, proof = plain_leaf(r, chosen), ""
            for run, slot in lower + upper:
                proof += "".join(run[:slot] + run[slot + 1 :])
                folded = sha("".join([*run[:slot], folded, *run[slot + 1 :]]))
            out.append((r["doc_id"], leaf, subroots[k], root, sha(proof), folded, folded == root))
    return sorted(out, key=repr)


DOC = "doc_id long, source string, lang string, n_chars long, text string"


def check_manifest(spark, rows):
    df = spark.createDataFrame(rows, DOC)
    clash = {c: F.lit("x") for c in CLASH}
    got = sorted((tuple(r) for r in manifest.verified_manifest(df.withColumns(clash)).collect()), key=repr)
    assert got == plain_manifest([r.asDict() for r in df.collect()])
    return got


@pytest.mark.parametrize("n", [1, 9, 65])
def test_manifest_of_one_group(spark, n):
    check_manifest(spark, [(i, "s", "en", i, f"Text {i}") for i in range(n)])


def test_manifest_of_edge_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (3, "s", "zz", 1, "A" * 100_000), (3, "s", "zz", 1, "A" * 100_000), (3, "s", "zz", 2, "b"), (-5, "é", "é", -1, "ÀB\x00c\n")]
    rows += [(i, f"s{i % 3}", f"l{i % 11}", i, None if i % 7 == 0 else f"Mixed Case {i}") for i in range(300)]
    got = check_manifest(spark, rows)
    assert {g[-1] for g in got} == {True, False}
    assert manifest.verified_manifest(spark.createDataFrame([], DOC)).count() == 0


def test_manifest_of_deep_trees(spark):
    """More than SPREAD_FROM levels, so that a climb meets the copies of the upper runs."""
    rows = spark.range(8**4 + 3).select("id", F.lit("s"), F.when(F.col("id") % 50 == 0, "de").otherwise("en"), "id", F.concat(F.lit("T"), "id"))
    check_manifest(spark, [tuple(r) for r in rows.collect()])


# --- op13 ---------------------------------------------------------------------------------------


def plain_phrases(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2 or any(p == q[i : i + len(p)] and 100 * b >= 100 * a for q, b in often.items() if len(q) > len(p) for i in range(len(q) - len(p) + 1)):
                continue
            n = totals[lang]
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]], n))
        for i, (s, a, _, p, l, r, n) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p, -a, l, r, n, -s))
    return sorted(out)


def edge_texts():
    rng = np.random.default_rng(3)
    words = ["the", "The", "of", "new", "york", "new", "é", "a\x0bb", "ß", "日本", "x\u00a0y"]
    rows = [("en" if i % 3 else None, " ".join(rng.choice(words, 40)) + (". " if i % 2 else "\t;") + "one  two three\tfour five six\nseven") for i in range(60)]
    return rows + [("en", None), ("en", ""), ("de", " \t.,"), ("fr", "solo"), ("", "the of the of " * 5000), ("en", "end")]


@pytest.mark.parametrize("cell_bits", [4, 24])
def test_phrases_against_plain_counts(spark, cell_bits):
    """Also with so few cells that all phrases share them: only more is counted."""
    rows = edge_texts()
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in CLASH})
    got = sorted(tuple(r) for r in phrases.collocations(df, least=10, top=25, shards=2, cell_bits=cell_bits).collect())
    assert got == plain_phrases(rows, 10, 25)
    assert any(g[1] == 25 for g in got)


def test_phrase_counts_do_not_depend_on_the_shards(spark):
    df = spark.createDataFrame(edge_texts(), "lang string, text string")
    one, five = (sorted(tuple(r) for r in phrases.phrase_counts(df, 20, shards=s).where("f >= 20").collect()) for s in (1, 3))
    assert one == five and any(r[2] == 5 for r in one)


def test_longer_phrases_start_before_the_words_are_through(spark):
    """Interleaved lengths: with eight shards, bigrams are done long before two whole cycles."""
    docs = spark.createDataFrame([("en", f"alpha beta gamma {i}") for i in range(400)], "lang string, text string")
    steps = []
    counted = phrases.counted_shard

    def watched(shard, reached, step, shards):
        steps.append(step)
        return counted(shard, reached, step, shards)

    phrases.counted_shard = watched
    try:
        found = {r["phrase"]: r["f"] for r in phrases.phrase_counts(docs, 10, shards=8).where("f >= 10").collect()}
    finally:
        phrases.counted_shard = counted
    assert found["alpha beta gamma"] == 400 and len(steps) <= 12


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_mixed", lambda left, right: np.zeros(len(right), np.uint64))
    import pyarrow as pa

    got = phrases.due_phrases(pa.array(["a b a", "b c"]), pa.array(["x", "y"]), np.full(16, phrases.NEVER, np.uint8), 0, 4).to_pydict()
    assert sorted(zip(got["lang"], got["phrase"], got["f"])) == [("x", "a", 2), ("x", "b", 1), ("y", "b", 1), ("y", "c", 1)]


def test_text_hashes_depend_on_the_text_alone():
    import pyarrow as pa

    words = ["", "a", "b", "ab", "ba", "é日", "x" * 5000, "ab"]
    whole = phrases.text_hashes(pa.array(words, pa.large_string()))
    alone = [phrases.text_hashes(pa.array([w], pa.large_string()))[0] for w in words]
    assert list(whole) == alone and len(set(alone)) == len(set(words))
    assert list(phrases.text_hashes(pa.array(["zz", *words], pa.large_string())[1:])) == alone
    assert len(phrases.text_hashes(pa.array([], pa.large_string()))) == 0


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


@pytest.mark.parametrize("key", ["op12_merkle_manifest", "op13_phrase_collocations"])
def test_queries_with_sql(spark, key):
    report = compare(registry.QUERIES[key](spark, SF), registry.ORACLE_SQL[key], duckdb_views(SF))
    assert report["ok"], report
