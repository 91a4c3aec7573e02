"""Results that must not be cut short, against plain versions."""

from __future__ import annotations

import os
import random
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from segmetrics.llm import decontaminate, licenses, quality, secrets  # noqa: E402


def table(spark, sf, name):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def test_licenses_are_inherited_on_a_given_table(spark):
    docs = table(spark, "sf0.01", "documents")
    got = {r["doc_id"]: r for r in licenses.scanned_licenses(*licenses.document_files(docs)).collect()}
    own = {d: r["license"] for d, r in got.items() if r["origin"] == "own"}
    above = {}
    for r in docs.select("doc_id", "source", "lang").collect():
        d, parts = r["doc_id"], [r["source"] or "-", r["lang"] or "-", str(r["doc_id"] // 100), str(r["doc_id"] // 10)]
        above[d] = ["/".join(parts[:n]) for n in (4, 3, 2, 1)]
    first = {}
    for d in sorted(above, reverse=True):
        first.update({a: d for a in above[d]})
    n = 0
    for d, r in got.items():
        near = next((a for a in above[d] if first[a] in own), None)
        if d in own or near is None:
            assert r["origin"] == ("own" if d in own else None) and r["from_directory"] is None
        else:
            n += 1
            assert (r["origin"], r["license"], r["from_directory"]) == ("inherited", own[first[near]], near)
    assert n > 0 and len(got) == 1000


def test_licenses_of_tags_blocks_and_whole_files(spark):
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       {}\n\n Everyone may copy this document.\n"
    mit = "Permission is hereby\ngranted,\n\nfree of charge,\n\nto any person obtaining a copy\n\nof this software and associated\n\ndocumentation files.\n"
    rows = [
        (1, "a/x.py", "# SPDX-License-Identifier: MIT\nimport os", "MIT"),
        (2, "b/x.c", "/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
        (3, "c/x.c", "// SPDX-License-Identifier: (ISC OR GPL-2.0-only WITH Classpath-exception-2.0)", "GPL-2.0"),
        (4, "d/x.c", "// SPDX-License-Identifier: Zlib", None),  # no template has it
        (10, "j/x.c", "// SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
        (5, "e/COPYING", gpl.format("Version 3, 29 June 2007"), "GPL-3.0"),
        (6, "f/COPYING", gpl.format("Version 2, June 1991"), "GPL-2.0"),
        (7, "g/x.c", "#\n# Licensed under the Apache\n# License, Version\n# 2.0.\n#\n\ncode", "Apache-2.0"),
        (8, "h/LICENSE", mit, "MIT"),
        (9, "i/x.txt", mit, None),  # no licence file: not compared as a whole
    ]
    rows += [(100 + i, f"p/{i}.txt", f"the software of this person and files of version {i} are used as a copy", None) for i in range(200)]
    files = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")
    got = licenses.scanned_licenses(files, files.where("path LIKE '%/COPYING' OR path LIKE '%/LICENSE'").select("path")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {r[0]: r[3] for r in rows}


def test_scope_is_measured_between_parts(spark):
    bare, long = "Zq9" + "aB3" * 12, "Zq9" + "aB3" * 140
    url = "https://a.example.org/" + "x" * 300
    rows = [
        (1, f"{long} client_id=someone", ["bare", "account"]),
        (2, f"client_id=someone {long}", ["account", "bare"]),
        (3, f"{url} {bare}", ["bare"]),
        (4, f"{long}{' ' * 200}client_id=someone", ["bare", "account"]),
        (5, f"{long}{' ' * 201}client_id=someone", []),
        (6, f"client_id=x12{' ' * 200}{long}", ["account", "bare"]),
        (7, f"client_id=x12{' ' * 201}{long}", []),
        (8, "password=" + "a." * 150 + long + " client_id=x12", ["assign", "account"]),  # the bare part lies in a base span
    ]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {d: [x.split(":")[0] for x in s.split(",") if x] for d, s in got.items()} == {r[0]: r[2] for r in rows}


def test_linked_parts_equal_a_scan_of_all_pairs(spark):
    rnd = random.Random(3)
    rows = []
    for d in range(60):
        parts = [(a := rnd.randrange(3000), rnd.randrange(6), a + rnd.choice((5, 40, 300, 900))) for _ in range(rnd.randint(2, 25))]
        rows.append((d, 0, [p for p in parts if p[1] < 3], [p for p in parts if p[1] >= 3]))
    table = spark.createDataFrame(rows, f"doc_id long, print long, base {secrets.SPAN}, weak {secrets.SPAN}")
    role = [secrets.ROLES[k] for k in secrets.KINDS]
    want = set()
    for d, _, base, weak in rows:
        for a, k, b in weak:
            held = 0
            for x, other, y in base + weak:
                held |= role[other] if x - b <= secrets.SCOPE and a - y <= secrets.SCOPE else 0
            if any(held & m == m for m in secrets.NEEDS[secrets.KINDS[k]]) and not any(x < b and y > a for x, _, y in base):
                want.add((d, a, k, b))
    got = {(r["doc_id"], *p) for r in secrets.linked_weak(table).collect() for p in r["linked"]}
    assert got == want and want


def test_pipeline_masks_linked_parts(spark):
    bare = "Zq9" + "aB3" * 12
    rows = [(1, f"é😀 client_id=someone, {bare} end"), (2, f"x {bare} y"), (3, "user: bob password: hunter22."), (4, None), (None, f"{bare} client_id=someone"), (None, f"{bare} client_id=someone"), (5, "postgres://db.example.org/x user=bob password=hunter22 end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long")).withColumn("spans", F.lit("mine"))
    out = dict(corpus_pipeline.STAGES)["secret scans"](spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, "é😀 [secret], [secret] end"), (2, rows[1][1]), (3, "[secret] [secret]"), (4, None), (None, "[secret] [secret]"), (None, "[secret] [secret]"), (5, "[secret] [secret] [secret] end")]
    got = [(r["doc_id"], r["text"], r["n_chars"], r["spans"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(d, t, None if t is None else len(t), "mine") for d, t in want], key=str)


def test_texts_shorter_than_an_item_are_compared(spark):
    words = [f"word{i * 37 % 101}x{i}" for i in range(59)]
    items = [(1, " ".join(words)), (2, "one two three four five six seven")]
    docs = [(1, " ".join(words[:55])), (2, " ".join(words[3:])), (3, " ".join(words[:20])), (4, "one two three four five six"), (5, "Two three four five six seven!"), (6, "one two three"), (7, " ".join(words)), (8, None)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for d, text in docs:
        w = brute.decon_words(text)
        for i, item in items:
            v = brute.decon_words(item)
            for at in range(max(1, len(w) - len(v) + 1)):
                a, b = set(brute.decon_shingles(w[at : at + len(v)])), set(brute.decon_shingles(v))
                both, either = sum(map(brute.decon_weight, a & b)), sum(map(brute.decon_weight, a | b))
                if both >= 0.8 * either and both / either > want.get((d, i), (0,))[0]:
                    want[d, i] = (both / either, at, min(len(w), len(v)))
    found = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"], r["n_words"]) for r in got}
    assert found == want and {(1, 1), (2, 1), (7, 1)} <= set(want) and want[1, 1][2] == 55


def test_joint_cutoffs_are_certified_at_the_whole_risk(spark):
    """1,000 good labels of a stratum are enough, and too few for a seventh of the risk each; the other has too few."""
    rnd = random.Random(11)

    def text(good):
        bad = {"#": "ab#def", "!": "ab!def"}[rnd.choice("#!")]
        return " ".join((bad if not good and rnd.random() < 0.7 else "abcdef") + rnd.choice("ghijklmn") * rnd.randint(1, 4) + str(rnd.randrange(10)) * 2 for _ in range(80))

    rows = [(i, text(i % 4 != 0), "en" if i % 6 else "es", int(i % 4 != 0)) for i in range(1600)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    truth = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    counted = quality.document_counts(df)
    found = quality.certified_cutoffs(counted, truth)
    assert {c.stratum for c in found} == {"en"} and {"symbols", "marks"} <= {c.rule for c in found}
    assert all(c.upper_bound <= 0.02 and c.n_good > c.good_rejected for c in found)
    out = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(df, truth).collect()}
    base = {d for d, t, _, _ in rows if not brute.quality_base(t)[-1]}
    en = {d: good for d, _, lang, good in rows if lang == "en" and d in base}
    assert sum(out[d] for d, g in en.items() if g) >= 0.98 * sum(en.values())
    assert sum(not out[d] for d, g in en.items() if not g) >= 0.9 * sum(not g for g in en.values())
    assert all(out[d] == (d in base) for d, _, lang, _ in rows if lang == "es")
