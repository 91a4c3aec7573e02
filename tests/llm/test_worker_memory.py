"""What Python workers hold while, and after, they work for a stage of the pipeline."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from segmetrics.llm import bpe, quality

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_quality_rules_count_a_text_once_in_a_task(spark, monkeypatch):
    """Two evaluations in one plan take two Python workers for each running task."""
    rows = [(i, f"word{i % 7} " * (40 + i), "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    plans, whole = [], quality.holdout
    monkeypatch.setattr(quality, "holdout", lambda *args: plans.append(whole(*args)) or plans[-1])
    kept = quality.keep_good(docs, labels)
    plans.append(kept)
    evaluations = [p._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") for p in plans]
    assert evaluations == [0, 1]
    want = [r for r in rows if not quality_failed(r[1])]
    assert sorted(map(tuple, kept.collect())) == want


def quality_failed(text: str) -> bool:
    counts = dict(zip(quality.COUNTS, quality.text_counts(text)))
    return counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]


def held(vocab: bpe.Vocabulary) -> int:
    """Bytes of the keys of a vocabulary's tables."""
    return sum(map(len, vocab._seen)) + sum(map(len, vocab._words_seen))


def test_bpe_tables_are_bounded_by_bytes():
    """Long chunks seldom come again: a worker does not keep them."""
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefghij", k=rnd.choice((5, 700)))) for _ in range(20)) for _ in range(200)]
    vocab, lib = bpe.Vocabulary(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    got = vocab.pieces(texts)
    assert held(vocab) < sum(map(len, texts)) // 10
    for text, (ids, decoded) in zip(texts, got):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, np.int32).tolist() == want and decoded == lib.decode(want, skip_special_tokens=False)


def test_bpe_tables_cleared_often_change_nothing(monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choices("abcdeÉß<|>'7", k=rnd.randint(1, 90))) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    texts[5] = None
    texts[6] = "a<|endoftext|>b <|startoftext|> " + "x" * 500
    whole = bpe.Vocabulary(WORD_BPE).pieces(texts)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1500)
    vocab = bpe.Vocabulary(WORD_BPE)
    assert vocab.pieces(texts) == whole
    # No more than the limit and one block of texts.
    assert vocab._held == sum(bpe.ENTRY_BYTES + len(k) + len(v) for table in (vocab._seen, vocab._words_seen) for k, v in table.items())
