"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in
a document with a smaller id.

1. Texts are split where the hash of the next ``CUT_GRAM`` bytes is low, so equal stretches
   are split alike. A chunk is compared with the ``LENGTH - 1`` bytes that follow it, so that it
   holds every window that starts in it. Windows of a chunk that also stands under a
   smaller id go at once; of the other chunks, adjacent ones form pieces. The smallest id that holds a
   window never loses it here, so pieces are enough for the search.
2. Every window of ``LENGTH`` bytes has a minimizer, its leftmost ``GRAM``-byte
   string of lowest hash; equal windows have the same one at the same place.
   Only minimizers that occur under two ids or more lead further, with the bytes around them (a segment:
   all windows that have this minimizer). Pieces lie in batches of about ``BATCH`` bytes; a batch
   sends the first bits of each of its distinct hashes once, packed by hash range, and gets back those that
   another document has too. Equal segments are one, with
   their smallest id. So all equal windows meet in the bucket of their minimizer.
3. Of a bucket's segments only the parts go further that another one can share: as many bytes before and
   behind the gram as are common with some other segment, if they fill a window. Equal parts are one.
   In a part the gram is replaced by its number, written in symbols that are no bytes. Of a gram with more than
   ``BUCKET`` parts the windows with few and with many bytes before it are searched apart, where the bytes that
   all of these have beside the gram belong to it; so halved again, until the parts of each are few.
   The parts are split into shards. The transform of each shard is
   built alone; transforms are merged pairwise by interleave refinement:
   start from "all of the first, then all of the second" and repeat a stable
   counting sort of the interleave by the symbols that it brings together. After h
   rounds the interleave is sorted by the first h symbols, and the blocks
   of rows that it cannot tell apart are exactly the strings with a common
   prefix of h bytes. No suffix is sorted again. The blocks after ``LENGTH``
   rounds (a gram counts as its symbols) are the repeated intervals; each takes the smallest id in it.
4. Every holder of a segment loses the windows whose smallest id is below its
   own; overlapping windows are joined per document.

Documents are never brought together whole: a bucket holds at most about ``BUCKET``
distinct segments of at most ``2 * LENGTH - GRAM`` bytes (those of one gram stay together), a hash range about ``HASHES`` hashes,
beyond 256 ranges up to four times that (a frequent one counts once per batch), a batch about ``BATCH`` bytes or one longer text.

Defined results: a null text is empty; texts below ``LENGTH`` bytes lose
nothing; rows with a null doc_id lose nothing and take nothing from others;
rows that share an id take nothing from each other, whatever their texts; repeated rows give equal
rows. Overlaps count and strings are judged on the input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmetrics.session import materialize

LENGTH = 50
GRAM = 24
BUCKET = 4000
SHARD = 2000
DIGIT_BITS = 6
CUT_GRAM = 8
CUT_ONE_IN = 256  # positions, on average
CUT_APART = 64
BATCH = 4 << 20
HASHES = 1 << 20
PACKED = 1 << 21

_P = np.uint64(0x9E3779B97F4A7C15)  # odd
_S = np.uint64(29)
_BLOCK = 1 << 15  # windows at once
_PLACE = np.uint64(2**16 - 1)


def _joined(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one value behind another, with where the values begin and their sizes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    size = int(edges[-1] - edges[0])
    data = np.frombuffer(column.buffers()[2], np.uint8, size, int(edges[0])) if size else np.zeros(0, np.uint8)
    return data, edges[:-1] - edges[0], np.diff(edges)


def gram_hashes(data: bytes | np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all strings of ``gram`` bytes, a multiple of 8."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    hashes = eights[:n] * _P
    for at in range(8, gram, 8):
        hashes ^= hashes >> _S
        hashes += eights[at : at + n]
        hashes *= _P
    hashes ^= hashes >> _S
    hashes *= np.uint64(0xC4CEB9FE1A85EC53)
    hashes ^= hashes >> np.uint64(33)
    return hashes


def chunk_starts(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the chunks of joined texts begin; ``CUT_APART`` bytes before a cut hold no other candidate."""
    found = [np.zeros(0, np.int64)]
    for begin in range(0, len(data) - CUT_GRAM + 1, _BLOCK):
        found.append(np.flatnonzero(gram_hashes(data[begin : begin + _BLOCK + CUT_GRAM - 1], CUT_GRAM) < np.uint64(2**64 // CUT_ONE_IN)) + begin)
    hit = np.concatenate(found)
    text = np.searchsorted(begins, hit, "right") - 1
    room = begins[text] + sizes[text] - hit
    hit, text, room = (x[room >= CUT_GRAM] for x in (hit, text, room))
    apart = (np.diff(hit, prepend=-CUT_APART) >= CUT_APART) | (np.diff(text, prepend=-1) != 0)
    return np.unique(np.concatenate((begins, hit[apart & (room >= LENGTH)])))


def minimizers(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: text, position and hash of the grams that are the minimizer of some window of a text."""
    width = length - gram + 1
    windows = max(0, len(data) - length + 1)
    across = np.zeros(len(data) + 1, np.int8)
    np.add.at(across, np.maximum(begins, begins + sizes - length + 1), 1)
    np.add.at(across, begins + sizes, -1)
    inside = np.cumsum(across, dtype=np.int8)[:windows] == 0
    places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin in range(0, windows, _BLOCK):
        hashes = gram_hashes(data[begin : begin + _BLOCK + length - 1], gram)
        # The position below the hash: one minimum finds the leftmost lowest of each window.
        low = hashes & ~_PLACE
        low |= np.arange(len(low), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low[step:], low[:-step])
            span += step
        low = low[inside[begin : begin + _BLOCK]]
        # Windows of two texts have no gram in common.
        at = (low[np.diff(low, prepend=~_PLACE) != 0] & _PLACE).astype(np.int64)
        places.append(at + begin)
        values.append(hashes[at])
    at, values = np.concatenate(places), np.concatenate(values)
    new = np.diff(at, prepend=-1) != 0
    at = at[new]
    return np.searchsorted(begins, at, "right") - 1, at, values[new]


def _symbols(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols 1 to 256 of all strings, and the strings' sizes."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1, sizes


def transform(strings: list[bytes], number: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(BWT symbols, string of each row, offset of each row) of a shard.

    Symbol 0 ends a string, bytes are 1 to 256; the ends are ordered by string.
    ``number`` is added to the string numbers.
    """
    return _transform(*_symbols(strings), number)


def _transform(symbols: np.ndarray, sizes: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``transform`` of strings of any symbols above 0."""
    sizes = sizes + 1
    strings = len(sizes)
    ends = np.cumsum(sizes) - 1
    text = np.zeros(int(sizes.sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = symbols
    rank = text + strings
    rank[ends] = np.arange(strings)
    # The first key packs as many symbols as 63 bits hold, later ones the ranks of two halves.
    bits = max(1, int(rank.max()).bit_length())
    step, longest = 63 // bits, int(sizes.max())
    packed = np.zeros(len(text), np.int64)
    for at in range(step):
        packed <<= bits
        packed[: max(0, len(text) - at)] |= rank[at:]
    key = packed
    while True:
        # Ends have ranks of their own, so a suffix is decided before it leaves its string.
        order = np.argsort(key)
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty_like(rank)
        rank[order] = new
        if step >= longest or new[-1] == len(text) - 1:
            break
        key = rank * (len(text) + 1)
        key[:-step] += rank[step:] + 1
        step *= 2
    owner = np.repeat(np.arange(strings), sizes)
    begins = ends - sizes + 1
    before = text[order - 1]
    offset = order - begins[owner[order]]
    return np.where(offset == 0, 0, before), owner[order] + number, offset


def _interleaved(mask: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = np.empty(len(mask), first.dtype)
    out[~mask] = first
    out[mask] = second
    return out


def merge(one: tuple, two: tuple, depth: int, whole: bool = True) -> tuple[tuple, np.ndarray]:
    """Merge two transforms; also the blocks of rows with ``depth`` common symbols.

    Returns the merged transform and block numbers. ``whole`` refines until the
    interleave no longer changes, so that the result can be merged again; without it the
    rows are in the order of their first ``depth`` symbols, which is all that the blocks need.
    """
    ends = np.concatenate([np.zeros(int((one[0] == 0).sum()), bool), np.ones(int((two[0] == 0).sum()), bool)])
    mask = np.concatenate([np.zeros(len(one[0]), bool), np.ones(len(two[0]), bool)])
    block = np.zeros(len(mask), np.int32)
    at_depth = None
    # Symbols by rank among those present: mostly one byte, one pass of the counting sort.
    present = np.unique(np.concatenate([one[0], two[0]]))
    code = np.zeros(max(257, int(present.max(initial=0)) + 1), np.uint8 if len(present) <= 256 else np.uint16)
    code[present] = np.arange(len(present))
    first, second = code[one[0]], code[two[0]]
    ordered = np.sort(np.concatenate([first, second]), kind="stable")  # the symbols of every interleave, sorted
    symbol_edge = ordered[1:] != ordered[:-1]
    symbol_edge[: len(ends)] = True  # string ends are all different
    rounds = 0
    while True:
        symbols = _interleaved(mask, first, second)
        order = np.argsort(symbols, kind="stable")  # a counting sort for these types
        new = mask[order]
        new[: len(ends)] = ends
        sorted_block, blocks = block[order], block[-1]
        edge = sorted_block[1:] != sorted_block[:-1]
        edge |= symbol_edge
        block = np.zeros(len(mask), np.int32)
        np.cumsum(edge, out=block[1:])
        rounds += 1
        same = bool((new == mask).all())
        mask = new
        if rounds <= depth:
            at_depth = block
        if same and block[-1] == blocks:
            break  # the next round would be this one again
        if rounds >= depth and (same or not whole):
            break
    # Rows within a block may still have moved since ``depth``; blocks have not.
    return tuple(_interleaved(mask, a, b) for a, b in zip(one, two)), at_depth


def smallest_ids(strings: list[bytes], ids: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> list[np.ndarray]:
    """For each string, the smallest id among all strings that hold the window at each offset."""
    symbols, sizes = _symbols(strings)
    flat = _smallest_ids(symbols, sizes, ids, length, shard)
    begins = np.cumsum(sizes) - sizes
    return [flat[b : b + max(0, n - length + 1)] for b, n in zip(begins, sizes)]


def _smallest_ids(symbols: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int, shard: int = SHARD) -> np.ndarray:
    """``smallest_ids`` of strings of any symbols above 0: for each symbol, that of the window that begins there."""
    shard = min(shard, max(1, -(-len(sizes) // 2)))  # two shards at least
    begins = np.concatenate(([0], np.cumsum(sizes)))
    shards = [_transform(symbols[begins[i] : begins[min(i + shard, len(sizes))]], sizes[i : i + shard], i) for i in range(0, len(sizes), shard)]
    if len(shards) == 1:
        shards.append((np.zeros(0, np.int64),) * 3)
    while len(shards) > 2:
        shards = [merge(shards[i], shards[i + 1], 1)[0] if i + 1 < len(shards) else shards[i] for i in range(0, len(shards), 2)]
    (_, owner, offset), block = merge(*shards, length, whole=False)
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    lowest = np.minimum.reduceat(ids[owner], starts)[block]
    flat = np.zeros(begins[-1], np.int64)
    inside = offset < sizes[owner]
    flat[(begins[owner] + offset)[inside]] = lowest[inside]
    return flat


def _chunks(text):
    """Chunks of a binary column: key of the bytes of its windows, and where these begin and end."""
    kind = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int32()), ("e", pa.int32())]))

    @F.arrow_udf("array<struct<k1:long,k2:long,s:int,e:int>>")
    def split(texts: pa.Array) -> pa.Array:
        data, begins, sizes = _joined(texts)
        if not len(begins):
            return pa.array([], kind)
        starts = chunk_starts(data, begins, sizes)
        text = np.searchsorted(begins, starts, "right") - 1
        ends = np.where(np.diff(text, append=len(begins)) != 0, (begins + sizes - LENGTH + 1)[text], np.append(starts[1:], 0))
        view = memoryview(data)
        keys = [xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(starts.tolist(), (ends + LENGTH - 1).tolist())]
        key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        place = lambda at: pa.array((at - begins[text]).astype(np.int32))
        rows = pa.StructArray.from_arrays([pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), place(starts), place(ends)], ["k1", "k2", "s", "e"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(begins) + 1)), pa.int32()), rows)

    return split(text)


_PIECES = pa.schema([("batch", pa.int32()), ("doc", pa.int64()), ("print", pa.int64()), ("start", pa.int32()), ("piece", pa.binary())])


def _pieces_of_batch(texts: pa.Table, known: pa.Table) -> pa.Table:
    """What a batch's texts have beside their known chunks."""
    gone = defaultdict(list)
    for row in known.to_pylist():
        gone[row["doc"], row["print"]].append((row["s"], row["e"]))
    rows, seen = [], set()
    for row in texts.to_pylist():
        me = row["doc"], row["print"]
        if me in seen:
            continue
        seen.add(me)
        windows, at = len(row["data"]) - LENGTH + 1, 0
        for s, e in [*sorted(gone[me]), (windows, windows)]:
            if s > at:
                rows.append({"batch": row["batch"], "doc": me[0], "print": me[1], "start": at, "piece": row["data"][at : s + LENGTH - 1]})
            at = max(at, e)
    return pa.Table.from_pylist(rows, _PIECES)


_PACKED = pa.schema([("range", pa.int32()), ("batches", pa.binary()), ("sizes", pa.binary()), ("prints", pa.binary())])
_LOW_BITS = np.uint64(2**31 - 1)


def _prints(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The first bits of hashes, mixed as minimizers are low ones: those of the range (a power of 2), and 31 more."""
    return (hashes * _P) >> np.uint64(34 - ranges.bit_length())


def _pack_hashes(ranges: int):
    """Distinct minimizers of each batch, those of about ``PACKED`` by hash range; the lowest bit tells that two documents have it.

    Of a hash goes what tells it from nearly all others of its range: a few more segments lead further, no fewer.
    """

    def rows_of(batches: list[int], prints: list[np.ndarray], several: list[np.ndarray]) -> pa.RecordBatch:
        owner = np.repeat(np.array(batches, np.int32), [len(x) for x in prints])
        values = np.concatenate(prints)
        ranged = (values >> np.uint64(31)).astype(np.uint16 if ranges <= 1 << 16 else np.int64)
        order = np.argsort(ranged, kind="stable")
        owner, ranged, low = owner[order], ranged[order], ((values & _LOW_BITS) << np.uint64(1) | np.concatenate(several)).astype(np.uint32)[order]
        begins = np.flatnonzero((np.diff(ranged.astype(np.int64), prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        sizes, owner, ranged = np.diff(begins, append=len(low)).astype(np.int32), owner[begins], ranged[begins]
        first = np.flatnonzero(np.diff(ranged.astype(np.int64), prepend=-1)).tolist()
        edges = np.append(begins, len(low))
        rows = [{"range": int(ranged[a]), "batches": owner[a:b].tobytes(), "sizes": sizes[a:b].tobytes(), "prints": low[edges[a] : edges[b]].tobytes()} for a, b in zip(first, [*first[1:], len(begins)])]
        return pa.RecordBatch.from_pylist(rows, _PACKED)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, prints, several = [], [], []
        for part in parts:
            text, _, found = minimizers(*_joined(part["piece"]))
            docs_of, batch_of = part["doc"].to_numpy()[text], part["batch"].to_numpy()[text]
            starts = np.flatnonzero(np.diff(batch_of, prepend=-1)).tolist()
            for begin, end in zip(starts, [*starts[1:], len(found)]):
                mine, docs = _prints(found[begin:end], ranges), docs_of[begin:end]
                order = np.argsort(mine)
                mine, docs = mine[order], docs[order]
                firsts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                batches.append(int(batch_of[begin]))
                several.append((np.minimum.reduceat(docs, firsts) < np.maximum.reduceat(docs, firsts)).astype(np.uint64))
                prints.append(mine[firsts])
            if sum(map(len, prints)) >= PACKED:
                yield rows_of(batches, prints, several)
                batches, prints, several = [], [], []
        if batches:
            yield rows_of(batches, prints, several)

    return pack


def _shared_of_range(packed: pa.Table) -> pa.Table:
    """Of a hash range, what each batch has that two documents have (or two parts of one batch)."""
    values = _joined(packed["prints"])[0].view(np.uint32)
    batches, sizes = (_joined(packed[c])[0].view(np.int32) for c in ("batches", "sizes"))
    low = values >> np.uint32(1)
    order = np.argsort(low)
    ordered = low[order]
    same = ordered[1:] == ordered[:-1]
    shared = (values & np.uint32(1)).astype(bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    # One holder may have the mark alone; then only it needs the hash.
    count = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[shared], minlength=len(sizes))
    ends = np.concatenate(([0], np.cumsum(count[count > 0]) * 8)).astype(np.int32)
    whole = low[shared].astype(np.uint64) | np.uint64(packed["range"][0].as_py() << 31)
    mine = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(whole)])
    return pa.table([pa.array(batches[count > 0]), mine], ["batch", "prints"])


_SEGMENTS = pa.schema([("doc", pa.int64()), ("print", pa.int64()), ("begin", pa.int32()), ("h", pa.int64()), ("mid", pa.int32()), ("key", pa.binary()), ("bytes", pa.binary())])


def _segments_of_batch(pieces: pa.Table, shared: pa.Table, ranges: int) -> pa.Table:
    """The bytes around each shared minimizer of a batch, with where they begin in the text."""
    wanted = np.unique(np.frombuffer(b"".join(shared["prints"].to_pylist()), np.uint64))
    if not len(wanted) or not pieces.num_rows:
        return _SEGMENTS.empty_table()
    data, begins, sizes = _joined(pieces["piece"])
    text, at, hashes = minimizers(data, begins, sizes)
    h = _prints(hashes, ranges)
    # Few are wanted: a table by the first bits leaves out most others.
    some, rest = np.zeros(1 << 20, bool), np.uint64(10 + ranges.bit_length())
    some[wanted >> rest] = True
    have = np.flatnonzero(some[h >> rest])
    have = have[wanted[np.minimum(np.searchsorted(wanted, h[have]), len(wanted) - 1)] == h[have]]
    text, at, h = text[have], at[have], h[have]
    begin = np.maximum(begins[text], at + GRAM - LENGTH)
    mid = at - begin
    whole = data.tobytes()
    cut = [whole[b:e] for b, e in zip(begin.tolist(), np.minimum((begins + sizes)[text], at + LENGTH).tolist())]
    keys = [xxhash.xxh3_128_digest(bytes((m,)) + c) for m, c in zip(mid.tolist(), cut)]
    start = begin - begins[text] + pieces["start"].to_numpy()[text]
    columns = [pieces["doc"].to_numpy()[text], pieces["print"].to_numpy()[text], start, h.view(np.int64), mid, keys, cut]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENTS)], schema=_SEGMENTS)


def _numbers(table: np.ndarray) -> np.ndarray:
    """Equal rows of a byte table have equal numbers, counted from 0."""
    rows = np.ascontiguousarray(table)
    return pd.factorize(np.array(rows.view(f"S{rows.shape[1]}").ravel().tolist() + [None], object)[:-1])[0]


def _reach(core: np.ndarray, side: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many bytes of its side a row can share with another one of the same core; below 0: there is none."""
    table = np.hstack([core.astype(">u4")[:, None].view(np.uint8), side])
    order = np.argsort(table.view(f"S{table.shape[1]}").ravel())
    differ = table[order[1:]] != table[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    most = np.zeros(len(core), np.int64)
    most[order[1:]] = common
    most[order[:-1]] = np.maximum(most[order[:-1]], common)
    return np.minimum(most - 4, own)


def _smallest_around(core: np.ndarray, before: np.ndarray, behind: np.ndarray, n_before: np.ndarray, n_behind: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row and each x, the smallest id that holds the window of x bytes before the row's core and ``width - x`` behind it.

    The sides are tables of ``width`` columns, the bytes nearest to the core first, of which a row has ``n_before`` and ``n_behind``.

    Only what a row can share with another one is transformed: a shared window holds the
    core, so its part before the core is common to both rows, and its part behind it. Equal parts are one.
    A core is written as ``digits`` symbols that are no bytes: a string of ``width + digits`` symbols holds them all.
    With more than ``BUCKET`` parts, the windows of a core are halved by x: those of either half have more bytes in
    common beside the core, which become part of it. At last a core is the whole window, of which there is one part.
    """
    width = before.shape[1]
    low = np.repeat(ids[:, None], width + 1, axis=1)
    r_before, r_behind = _reach(core, before, n_before), _reach(core, behind, n_behind)
    meets = np.flatnonzero((r_before >= 0) & (r_behind >= 0) & (r_before + r_behind >= width))
    if not len(meets):
        return low
    at = np.arange(width)
    core, r_before, r_behind = core[meets], r_before[meets], r_behind[meets]
    before, behind = np.where(at < r_before[:, None], before[meets], np.uint8(0)), np.where(at < r_behind[:, None], behind[meets], np.uint8(0))
    part = _numbers(np.hstack([core.astype(">u4")[:, None].view(np.uint8), r_before[:, None].astype(np.uint8), r_behind[:, None].astype(np.uint8), before, behind]))
    order = np.lexsort((part, core))
    first = order[np.flatnonzero(np.diff(part[order], prepend=-1))]  # one row of each part, by core
    place = np.empty(len(first), np.int64)
    place[part[first]] = np.arange(len(first))
    part = place[part]
    core, before, behind, r_before, r_behind = core[first], before[first], behind[first], r_before[first], r_behind[first]
    part_ids = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(part_ids, part, ids[meets])
    found = np.repeat(part_ids[:, None], width + 1, axis=1)
    edges = np.flatnonzero(np.diff(core, prepend=-1))
    sizes = np.diff(edges, append=len(core))
    large = np.repeat((sizes > BUCKET) & (width > 0), sizes)
    if large.any():
        half = width // 2
        low_x, high_x = (large & (r_behind >= width - half)), (large & (r_before > half))
        inner = lambda rows, side, n: _numbers(np.hstack([core[rows].astype(">u4")[:, None].view(np.uint8), side[rows, :n]]))
        if low_x.any():
            n = width - half
            found[low_x, : half + 1] = _smallest_around(inner(low_x, behind, n), before[low_x, :half], behind[low_x, n:], np.minimum(r_before[low_x], half), r_behind[low_x] - n, part_ids[low_x])
        if high_x.any():
            n = half + 1
            found[high_x, n:] = _smallest_around(inner(high_x, before, n), before[high_x, n:], behind[high_x, : width - n], r_before[high_x] - n, np.minimum(r_behind[high_x], width - n), part_ids[high_x])
    small = np.flatnonzero(~large)
    heads = np.diff(core[small], prepend=-1) != 0
    call = (np.cumsum(np.bincount(np.cumsum(heads) - 1)) - 1) // BUCKET if len(small) else np.zeros(0, np.int64)
    call = call[np.cumsum(heads) - 1]
    for rows in np.split(small, np.flatnonzero(np.diff(call)) + 1) if len(small) else ():
        found[rows] = _transformed(core[rows], before[rows], behind[rows], r_before[rows], r_behind[rows], part_ids[rows], found[rows])
    x = np.arange(width + 1)
    own = (x <= r_before[part][:, None]) & (x >= width - r_behind[part][:, None])
    low[meets] = np.where(own, found[part], low[meets])
    return low


def _transformed(core: np.ndarray, before: np.ndarray, behind: np.ndarray, n_before: np.ndarray, n_behind: np.ndarray, ids: np.ndarray, low: np.ndarray) -> np.ndarray:
    """``low`` with the smallest ids of the windows that the rows have, by merged transforms."""
    width = before.shape[1]
    number = np.cumsum(np.diff(core, prepend=core[0]) != 0)
    digits = max(1, -(-int(number[-1]).bit_length() // DIGIT_BITS))
    signs = np.stack([(number >> (DIGIT_BITS * i)) % 2**DIGIT_BITS for i in range(digits)], axis=1) + 257
    at = np.arange(width)
    table = np.hstack([before[:, ::-1].astype(np.int64) + 1, signs, behind.astype(np.int64) + 1])
    has = np.hstack([at[::-1] < n_before[:, None], np.ones(signs.shape, bool), at < n_behind[:, None]])
    sizes = n_before + digits + n_behind
    flat = _smallest_ids(table[has], sizes, ids, width + digits)
    x = np.arange(width + 1)
    own = (x <= n_before[:, None]) & (x >= width - n_behind[:, None])
    begins = np.cumsum(sizes) - sizes + n_before
    low[own] = flat[(begins[:, None] - x)[own]]
    return low


_WINDOWS = pa.schema([("key", pa.binary()), ("at", pa.int32()), ("n", pa.int32()), ("low", pa.int64())])


def _windows_of_bucket(bucket: pa.Table) -> pa.Table:
    """Runs of windows of a bucket's segments with the smallest id that holds them, if another holder has a larger one.

    A gram stands for itself in the transforms as a core. In windows that no other segment shares the segment's own smallest id is the smallest.
    """
    data, first, size = _joined(bucket["bytes"])
    mids, own, high = (bucket[c].to_numpy().astype(np.int64) for c in ("mid", "doc", "high"))
    gram, n_behind = first + mids, size - mids - GRAM
    at = np.arange(LENGTH - GRAM)
    core = _numbers(data[gram[:, None] + np.arange(GRAM)])
    before = np.where(at < mids[:, None], data[np.maximum(gram[:, None] - 1 - at, 0)], np.uint8(0))
    behind = np.where(at < n_behind[:, None], data[np.minimum(gram[:, None] + GRAM + at, len(data) - 1)], np.uint8(0))
    low = _smallest_around(core, before, behind, mids, n_behind, own)
    windows = size - LENGTH + 1
    ends = np.cumsum(windows)
    begins = ends - windows
    of = np.repeat(np.arange(len(size)), windows)
    lowest = low[of, mids[of] - np.arange(len(of)) + begins[of]]
    change = np.concatenate(([True], lowest[1:] != lowest[:-1]))
    change[begins] = True
    starts = np.flatnonzero(change)
    of, n, lowest = of[starts], np.diff(starts, append=len(lowest)), lowest[starts]
    told = lowest < high[of]
    of = of[told]
    columns = [bucket["key"].combine_chunks().take(pa.array(of)), starts[told] - begins[of], n[told], lowest[told]]
    return pa.Table.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, _WINDOWS)], schema=_WINDOWS)


def _cut_out(text, ranges):
    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def remove(texts: pa.Array, gone: pa.Array) -> pa.Array:
        data, begins, sizes = _joined(texts)
        text = np.repeat(np.arange(len(sizes)), gone.value_lengths().fill_null(0).to_numpy())
        begin, end = (x.to_numpy() + begins[text] for x in gone.flatten().flatten())
        order = np.argsort(begin, kind="stable")  # texts lie one behind another
        begin, end, text = begin[order], end[order] + LENGTH - 1, text[order]
        reach = np.maximum.accumulate(end)
        new = np.ones(len(begin), bool)
        new[1:] = (begin[1:] > reach[:-1]) | (text[1:] != text[:-1])
        begin, end, text = begin[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1:]), text[new]
        removed = np.bincount(text, end - begin, len(sizes)).astype(np.int64)
        spans = np.bincount(text, minlength=len(sizes))
        view = memoryview(data)
        kept = b"".join([view[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)])])
        ends = np.concatenate(([0], np.cumsum(sizes - removed))).astype(np.int32)
        rest = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
        return pa.StructArray.from_arrays([pa.array(sizes), pa.array(removed), pa.array(spans), rest], ["n_bytes", "n_removed", "n_spans", "kept"])

    return remove(text, ranges)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``materialize``; what its shuffles left on disk goes when it is written, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df, name, "zstd")
    finally:
        conf.set(_CLEANUP, before) if before else conf.unset(_CLEANUP)


def copied_chunks(texts: DataFrame) -> DataFrame:
    """(batch, doc, print, s, e): windows that begin from s to before e are in a chunk that a smaller id has too."""
    chunks = texts.select("batch", "doc", "print", F.explode(_chunks(F.col("data"))).alias("c")).select("batch", "doc", "print", "c.*")
    chunks = _stored(chunks, "chunks")
    first = chunks.groupBy("k1", "k2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").drop("high")
    return chunks.join(first, ["k1", "k2"]).where("doc > low").select("batch", "doc", "print", "s", "e")


def repeated_windows(pieces: DataFrame) -> DataFrame:
    """(doc, print, s, e): windows of pieces that begin from s to before e start under a smaller id too."""
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    hashes = size * 2 // (LENGTH - GRAM + 2)
    ranges = 1 << min((hashes // HASHES).bit_length(), max(8, (hashes // (4 * HASHES)).bit_length()))  # each has rows of all batches
    packed = pieces.select("batch", "doc", "piece").mapInArrow(_pack_hashes(ranges), "range int, batches binary, sizes binary, prints binary")
    shared = packed.groupBy("range").applyInArrow(_shared_of_range, "batch int, prints binary")
    of_batch = lambda pieces, shared: _segments_of_batch(pieces, shared, ranges)
    cut = pieces.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(of_batch, "doc long, print long, begin int, h long, mid int, key binary, bytes binary")
    cut = _stored(cut, "segments")
    distinct = cut.groupBy("h", "key", "mid", "bytes").agg(F.min("doc").alias("doc"), F.max("doc").alias("high"))
    buckets = max(1, -(-cut.count() // BUCKET))  # they hold fewer, as far as segments are equal
    lowest = distinct.groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).applyInArrow(_windows_of_bucket, "key binary, at int, n int, low long")
    lowest = _stored(lowest, "window-ids")
    begin = F.col("begin") + F.col("at")
    return cut.select("doc", "print", "begin", "key").join(lowest, "key").where("low < doc").select("doc", "print", begin.alias("s"), (begin + F.col("n")).alias("e"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", data.alias("data"))
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    batch = F.pmod(F.xxhash64("doc", "print"), F.lit(max(1, -(-size // BATCH)))).cast("int")
    texts = rows.where((F.octet_length("data") >= LENGTH) & F.col("doc_id").isNotNull())
    texts = texts.select(F.col("doc_id").alias("doc"), F.xxhash64("data").alias("print"), "data").withColumn("batch", batch)
    known = _stored(copied_chunks(texts), "copied-chunks")
    pieces = texts.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(_pieces_of_batch, "batch int, doc long, print long, start int, piece binary")
    pieces = _stored(pieces, "pieces")
    gone = known.drop("batch").unionByName(repeated_windows(pieces))
    gone = gone.groupBy(F.col("doc").alias("doc_id"), "print").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    marked = rows.withColumn("print", F.xxhash64("data")).join(gone, ["doc_id", "print"], "left")
    done = marked.select("doc_id", _cut_out(F.col("data"), F.col("gone")).alias("r"))
    return done.select("doc_id", "r.n_bytes", "r.n_removed", "r.n_spans", "r.kept")
