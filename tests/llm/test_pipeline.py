from __future__ import annotations

import hashlib
import os
import re
import sys
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from segmetrics.llm import bpe, quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run_equals_the_stages_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.certified_cutoffs(quality.document_counts(spark.read.parquet(f"{SF}/documents.parquet")), labels) == []  # too few labels
    rows = [(d, t) for d, t in rows if not brute.quality_base(t)[-1]]
    parts = brute.near_components(rows, 5)
    rows = [(d, t) for d, t in rows if parts[d][1] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute.contaminated(rows, items)}
    rows = [(d, t) for d, t in rows if d not in bad]
    vocab = bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in rows:
        t = brute.ASSIGN.sub(lambda m: "[secret]" if len(m[2]) >= 6 else m[0], t)
        t = re.sub("[0-9a-f]{24,}", "[secret]", re.sub("AKIA[A-Z0-9]{16,}", "[secret]", t))
        ids = vocab.encode(t)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want) and want


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("mine")).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
