"""Minimizers with many contexts: what their search sorts, and its results against all windows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from segmetrics.llm import suffixes
from segmetrics.llm.suffixes import GRAM, LENGTH

SIDE = LENGTH - GRAM


def bucket(rows: list[tuple[bytes, int, int]]) -> pa.Table:
    """A bucket of different segments (bytes, place of the gram, smallest id)."""
    kinds = {"key": pa.binary(), "mid": pa.int32(), "bytes": pa.binary(), "doc": pa.int64(), "high": pa.int64()}
    columns = [[str(i).encode() for i in range(len(rows))], [m for _, m, _ in rows], [s for s, _, _ in rows], [d for _, _, d in rows], [10**6] * len(rows)]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def sorted_by(monkeypatch, call) -> int:
    sizes, plain = [], np.argsort
    with monkeypatch.context() as m:
        m.setattr(np, "argsort", lambda a, *b, **k: (sizes.append(len(a)), plain(a, *b, **k))[1])
        call()
    return sum(sizes)


def one_gram(contexts: int) -> pa.Table:
    """Segments of a common line's last gram: the same bytes before it, words behind it."""
    r, words = random.Random(contexts), ["the", "of", "rend", "and", "threlyes", "th", "onnt", "in", "ea", "hation", "a", "er"]
    line = b"Released under the terms of the licence named below.\n"[-SIDE - GRAM :]
    ends = {(" ".join(r.choice(words) for _ in range(16)))[:SIDE].encode() for _ in range(contexts * 2)}
    return bucket([(line + e, SIDE, i) for i, e in enumerate(sorted(ends)[:contexts])])


def test_many_contexts_of_one_gram_are_not_sorted_as_one(monkeypatch):
    few, many = one_gram(5_000), one_gram(20_000)
    assert many.num_rows == 20_000
    a = sorted_by(monkeypatch, lambda: suffixes._windows_of_bucket(few))
    b = sorted_by(monkeypatch, lambda: suffixes._windows_of_bucket(many))
    assert b < 4.5 * a and b < 1_000 * many.num_rows  # 8.5 times and 14,691 each when all contexts were merged as one


def test_windows_of_odd_buckets(monkeypatch):
    r = random.Random(5)
    for _ in range(120):
        monkeypatch.setattr(suffixes, "BUCKET", r.choice([1, 3, 8, 4000]))
        monkeypatch.setattr(suffixes, "DIGIT_BITS", r.choice([1, 2, 6]))
        alphabet = r.choice([b"a", b"ab", b"\0\xff", b"\0a", bytes(range(256))])
        some = lambda n: bytes(r.choices(alphabet, k=n))
        grams, sides, rows = [some(GRAM) for _ in range(r.choice([1, 2, 9]))], [some(SIDE) for _ in range(3)], {}
        for _ in range(r.randint(1, 70)):
            before, behind = r.choice([SIDE, SIDE, r.randint(0, SIDE)]), r.choice([SIDE, SIDE, r.randint(0, SIDE)])
            if before + behind >= SIDE:
                tail = (r.choice(sides)[: r.choice([SIDE, r.randint(0, 20)])] + some(SIDE))[:behind]
                rows[r.choice([*sides, some(SIDE)])[SIDE - before :] + r.choice(grams) + tail, before] = r.randint(0, 50)
        rows = [(s, m, d) for (s, m), d in rows.items()]
        if not rows:
            continue
        windows = [(i, p, (s[p : p + LENGTH], m - p)) for i, (s, m, _) in enumerate(rows) for p in range(len(s) - LENGTH + 1)]
        lowest = {}
        for i, _, w in windows:
            lowest[w] = min(lowest.get(w, 10**6), rows[i][2])
        got = {}
        for x in suffixes._windows_of_bucket(bucket(rows)).to_pylist():
            got |= {(int(x["key"]), p): x["low"] for p in range(x["at"], x["at"] + x["n"])}
        assert got == {(i, p): lowest[w] for i, p, w in windows}


def test_joined_texts_have_the_minimizers_of_each():
    r = random.Random(2)
    texts = [bytes(r.choices(r.choice([b"a", b"ab", bytes(range(256))]), k=r.choice([0, 10, 49, 50, 51, 90, 2000]))) for _ in range(200)]
    texts += [b"", b"xy" * 40_000]
    data, begins, sizes = suffixes._joined(pa.array(texts, pa.binary()))
    text, at, hashes = suffixes.minimizers(data, begins, sizes)
    for i, t in enumerate(texts):
        alone = suffixes.minimizers(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))
        assert (at[text == i] - begins[i]).tolist() == alone[1].tolist()
        assert hashes[text == i].tolist() == alone[2].tolist()
        every = suffixes.gram_hashes(t, GRAM) >> np.uint64(16)
        assert set(alone[1].tolist()) == {p + int(every[p : p + SIDE + 1].argmin()) for p in range(max(0, len(t) - LENGTH + 1))} or len(t) < LENGTH


def pieces_of(batches: int, docs: int) -> pa.Table:
    r = random.Random(batches)
    rows = [(b, b * docs + d, bytes(r.choices(b"abcdefgh ", k=600))) for b in range(batches) for d in range(docs)]
    return pa.table({"batch": pa.array([x[0] for x in rows], pa.int32()), "doc": [x[1] for x in rows], "piece": pa.array([x[2] for x in rows], pa.binary())})


def test_hashes_of_many_batches_are_packed_together():
    ranges, pieces = 16, pieces_of(60, 5)
    rows = pa.Table.from_batches(list(suffixes._pack_hashes(ranges)(iter(pieces.to_batches(max_chunksize=25)))))
    assert rows.num_rows == ranges  # one row for each batch and range before
    found = [len(x) // 4 for x in rows["prints"].to_pylist()]
    assert max(found) < 2 * min(found)  # minimizers are low hashes: the first range had most


def test_batches_get_back_all_that_they_share():
    pieces = pieces_of(12, 3).to_pydict()
    shared = b"one passage that stands in several of these batches, and is long enough"
    holders = [0, 7, 13, 35]
    for i in holders:
        pieces["piece"][i] = pieces["piece"][i][:100] + shared + pieces["piece"][i][100:]
    pieces = pa.table(pieces, pa.schema([("batch", pa.int32()), ("doc", pa.int64()), ("piece", pa.binary())]))
    pieces = pieces.append_column("print", pieces["doc"]).append_column("start", pa.array([0] * pieces.num_rows, pa.int32()))
    for ranges in (1, 4, 1 << 17):
        packed = pa.Table.from_batches(list(suffixes._pack_hashes(ranges)(iter(pieces.to_batches(max_chunksize=8)))))
        back = pa.concat_tables([suffixes._shared_of_range(packed.filter(pa.compute.equal(packed["range"], i))) for i in set(packed["range"].to_pylist())])
        for batch in range(12):
            mine = lambda t: t.filter(pa.compute.equal(t["batch"], batch))
            found = suffixes._segments_of_batch(mine(pieces), mine(back), ranges).to_pylist()
            assert {x["doc"] for x in found} == {i for i in holders if i // 3 == batch}
            for x in found:
                whole = pieces["piece"][x["doc"]].as_py()
                assert whole[x["begin"] : x["begin"] + len(x["bytes"])] == x["bytes"]
                covered = range(100, 100 + len(shared) - GRAM + 1)
                assert x["begin"] + x["mid"] in covered
