"""Licence scan against a plain TF-IDF cosine and a plain walk up the directories."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
import regex

from segmetrics.llm import licenses

SF = "/root/testdata/sf0.001"
CUE = regex.compile(licenses.CUES)
TAG = r"spdx-license-identifier[\t\n\x0b\f\r :=\"'(]*"
ID = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"


def plain_terms(text):
    tagged = regex.sub(rf"{TAG}({ID})", r" spdx:\1 ", text.lower())
    return regex.findall(r"spdx:[a-z0-9.+-]+|[\p{L}\p{M}]+|[0-9]+(?:\.[0-9]+)*", tagged)


def plain_statements(text):
    out = regex.split(r"\n|(?<=[.!?])[\x20\t]+", text)
    for block in regex.split(r"\n(?:[^\p{L}\p{N}\n]*\n)+", text):
        joined = regex.sub(r"[ \t\n\x0b\f\r]*\n[^\p{L}\p{N}\n]*", " ", block)
        out += [joined, *regex.split(r"(?<=[.!?])[\x20\t]+", joined)]
    for expression in regex.findall(rf"(?i){TAG}({ID}(?:[\x20\t()]+(?:or|and|with)[\x20\t()]+{ID})*)", text):
        for x in regex.split(r"(?i)[\x20\t()]+(?:or|and)[\x20\t()]+", expression):
            out.append("SPDX-License-Identifier: " + regex.sub(r"(?i)[\x20\t()]+with[\x20\t()].*", "", x))
    return {s for s in out if CUE.search(s)}


class Plain:
    def __init__(self, texts):
        self.templates = [(name, Counter(plain_terms(t))) for name, all_of in licenses.NOTICES.items() for t in all_of]
        known = {t for _, c in self.templates for t in c}
        df = Counter(t for text in texts if text is not None for t in set(plain_terms(text)) & known)
        self.idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in known}
        self.outside = math.log((1 + len(texts)) / 2) + 1

    def vector(self, counts):
        return {t: n * self.idf.get(t, self.outside) for t, n in counts.items()}

    def best(self, statements):
        found = []
        for s in statements:
            v = self.vector(Counter(plain_terms(s)))
            norm = math.sqrt(sum(x * x for x in v.values()))
            for name, c in self.templates:
                w = self.vector(c)
                dot = sum(x * w.get(t, 0) for t, x in v.items())
                if dot and dot / norm / math.sqrt(sum(x * x for x in w.values())) >= licenses.THRESHOLD - 1e-12:
                    found.append((-round(dot / norm / math.sqrt(sum(x * x for x in w.values())), 9), name))
        return min(found, default=None)


def plain_scan(rows):
    """doc_id -> (license, cosine, origin, from_directory) for the layout of ``document_files``."""
    path = {d: ["" if x is None else x for x in ((s or "-") if s is not None else "-", lang if lang is not None else "-", str(d // 100), str(d // 10))] for d, _, lang, s in rows}
    first = {}
    for d in sorted(path):
        for k in range(1, 5):
            first.setdefault("/".join(path[d][:k]), d)
    speaks = defaultdict(list)
    for directory, d in first.items():
        speaks[d].append(directory)
    plain = Plain([t for _, t, _, _ in rows])
    own = {}
    for d, text, _, _ in rows:
        if text is not None and CUE.search(text):
            own[d] = plain.best(plain_statements(text) | ({text} if d in speaks else set()))
    given = {directory: own[d][1] for directory, d in first.items() if own.get(d)}
    out = {}
    for d in path:
        if own.get(d):
            out[d] = (own[d][1], -own[d][0], "own", None)
            continue
        up = next((x for x in ("/".join(path[d][:k]) for k in (4, 3, 2, 1)) if x in given), None)
        out[d] = (given.get(up), None, "inherited" if up else None, up)
    return out


def test_scan_of_a_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    got = licenses.scanned_licenses(*licenses.document_files(docs)).collect()
    want = plain_scan(rows)
    assert len(got) == len(want) == len(rows)
    for r in got:
        license, cosine, origin, from_directory = want[r["doc_id"]]
        assert (r["license"], r["origin"], r["from_directory"]) == (license, origin, from_directory), r
        assert (r["cosine"] is None) == (cosine is None) and abs((r["cosine"] or 0) - (cosine or 0)) < 1e-8
    assert {r["origin"] for r in got} >= {"own", None}


HEADERS = {
    "ISC": "// Permission to use, copy, modify, and/or distribute this software for any purpose\n// with or without fee is hereby granted, provided that the above\n// copyright notice and this permission notice appear in all copies.",
    "EPL-2.0": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0.",
    "BSD-2-Clause": "# SPDX-License-Identifier: BSD-2-Clause",
    "0BSD": "SPDX-License-Identifier: 0BSD",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999",
}


@pytest.mark.parametrize("name", sorted(HEADERS))
def test_further_templates(spark, name):
    rows = [(1, "a/x.py", HEADERS[name]), (2, "a/y.py", "plain prose"), (3, "b/z.py", HEADERS[name] + "\n\nother prose follows here")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scanned_licenses(files, files.where("doc_id = 1").select("path")).collect()}
    assert got == {1: name, 2: name, 3: name}


def test_statements_are_scored_where_they_lie(spark):
    """Two exchanges (distinct statements, dealt by print) and no digest in the scoring."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    statements = spark.createDataFrame([("p", "Released under the MIT License.")], "print string, statement string")
    plan = licenses.header_licenses(statements, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and plan.count("RepartitionByExpression") == 1
    physical = licenses.header_licenses(statements, docs)._jdf.queryExecution().executedPlan().toString()
    # The third is that of the template rows.
    assert physical.count("Exchange hashpartitioning") == 3 and "Exchange hashpartitioning(print" in physical
    assert "Python" not in physical and "Window" not in physical
