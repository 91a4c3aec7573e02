"""Sorts made by the transforms of repeated strings, and their results on odd shards."""

from __future__ import annotations

import random

import numpy as np

from segmetrics.llm.suffixes import merge, smallest_ids, transform


def sorts_of(monkeypatch, call) -> int:
    calls, plain = [], np.argsort
    with monkeypatch.context() as m:
        m.setattr(np, "argsort", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
        call()
    return len(calls)


def test_a_merge_ends_when_its_rounds_change_nothing(monkeypatch):
    one, two = transform([b"abcdefgh" * 9]), transform([b"ijklmnop" * 9], 1)
    assert sorts_of(monkeypatch, lambda: merge(one, two, 500, whole=False)) < 100


def test_the_first_sort_takes_several_symbols(monkeypatch):
    assert sorts_of(monkeypatch, lambda: transform([b"a" * 60, b"a" * 60])) < 6


def test_smallest_ids_of_odd_shards():
    r = random.Random(3)
    for _ in range(150):
        alphabet = r.choice([b"a", b"ab", b"\0\xff", bytes(range(256))])
        strings = [bytes(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 7, 40]))) for _ in range(r.randint(1, 9))]
        ids = np.array([r.randint(0, 4) for _ in strings])
        for length in (1, 3, 20):
            got = smallest_ids(strings, ids, length, 3)
            for s, found in zip(strings, got):
                windows = [s[i : i + length] for i in range(max(0, len(s) - length + 1))]
                assert found.tolist() == [min(d for d, t in zip(ids, strings) if w in t) for w in windows]
