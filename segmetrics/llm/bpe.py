"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are leaves; leaf ``i`` holds the merge rank of the pair that
starts at symbol ``i`` (with its position below the rank, so that one
comparison orders both). The root is the leftmost lowest-rank pair. A merge
changes three leaves, each in logarithmic time, until the root holds no pair.
A word of a million characters therefore costs n log n, not n squared. Short
words are merged many at a time, one row of tree nodes for each (a forest of
segment trees in numpy); words over 64 bytes have a tree of their own.

Normalization and word cutting are the vocabulary's own rules (its
``normalizer`` and ``pre_tokenizer`` sections); merges and decoding are done
here. Texts are cut at ASCII spaces first. No rule of the supported files
looks across a space, so every distinct chunk is encoded once per worker and
then looked up. The tables hold ids only (decoded texts are joined from the
tokens, a block of texts at a time) and no chunk or word over ``KEEP_BYTES``, and are
cleared when they pass ``CACHE_BYTES``, which changes the cost only: a worker
is kept for later tasks of any kind, and its tables with it.

Defined results: a null text encodes as an empty text (no ids, empty decoded
text); repeated rows are encoded one by one; whole texts are read. Row-local: no
shuffle, nothing to lose but a task.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_BYTES = 64 << 20
KEEP_BYTES = 64
ENTRY_BYTES = 150  # of a table's entry besides its key and ids
BLOCK_TEXTS, BLOCK_CHARS = 256, 2_000_000
NO_PAIR = (1 << 62) - 1


def merge_symbols(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until none is left.

    ``ranks`` maps a pair of ids to (rank, merged id).
    """
    n = len(ids)
    if n < 2:
        return ids
    if n == 2:
        hit = ranks.get((ids[0], ids[1]))
        return [hit[1]] if hit else ids
    width = 1 << (n - 2).bit_length()
    shift = width.bit_length()
    mask = (1 << shift) - 1
    tree = [NO_PAIR] * (2 * width)
    for i in range(n - 1):
        hit = ranks.get((ids[i], ids[i + 1]))
        if hit:
            tree[width + i] = hit[0] << shift | i
    for k in range(width - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    if tree[1] == NO_PAIR:
        return ids
    ids = list(ids)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            low = left if left < right else right
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while (root := tree[1]) != NO_PAIR:
        i = root & mask
        j = after[i]
        ids[i] = ranks[ids[i], ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NO_PAIR)
        if k < n:
            before[k] = i
            hit = ranks.get((ids[i], ids[k]))
            put(i, hit[0] << shift | i if hit else NO_PAIR)
        else:
            put(i, NO_PAIR)
        p = before[i]
        if p >= 0:
            hit = ranks.get((ids[p], ids[i]))
            put(p, hit[0] << shift | p if hit else NO_PAIR)
    return [x for x in ids if x >= 0]


def id_lists(packed: list[bytes]) -> pa.ListArray:
    """Packed ids of texts as an array of lists."""
    ends = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


class Vocabulary:
    """A BPE vocabulary file with word ends (``end_of_word_suffix``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("supported: plain BPE files without byte fallback, prefix or decoder")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()} | {i: t for t, i in added.items()}
        self.added = added
        self.texts = pa.array([self.tokens.get(i, "") for i in range(max(self.tokens, default=0) + 1)], pa.large_string())
        # The library's text rules only; merges are done here.
        lib = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self._normal, self._words = lib.normalizer, lib.pre_tokenizer
        # Byte b is written as one character in these files: itself where it is
        # printable, else the next free one from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}
        self.byte_ids, self.end_ids = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in self.byte_of.items():
            self.byte_ids[b], self.end_ids[b] = self.ids[c], self.ids[c + self.suffix]
        pairs = sorted((a << 20 | b, rank, new) for (a, b), (rank, new) in self.ranks.items())
        self.pair_keys, self.pair_ranks = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        self.merged = np.zeros(len(model["merges"]), np.int64)
        for _, rank, new in pairs:
            self.merged[rank] = new
        # Chunks of plain Latin letters, digits and signs need neither the file's
        # normalizer nor an added token; all others take the general way.
        self._simple = re.compile(r"[!-;=-~\u00a1-\u00ff]+").fullmatch
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._simple_words = regex.compile(split).findall
        self._words_seen: dict[bytes, bytes] = {}
        self._seen: dict[bytes, bytes] = {}
        self._held = 0  # about the bytes of both tables

    def _cut(self, chunk: str) -> list[bytes | int]:
        """A chunk's words as bytes, and the ids of the added tokens between them."""
        if self._simple(chunk):
            return [w.encode() for w in self._simple_words(chunk.lower())]
        out: list[bytes | int] = []
        while chunk:
            at, token = min(((at, token) for token in self.added if (at := chunk.find(token)) >= 0), default=(len(chunk), ""))
            if at:
                plain = self._normal.normalize_str(chunk[:at])
                out += [bytes([self.byte_of[c] for c in word]) for word, _ in self._words.pre_tokenize_str(plain)]
            if token:
                out.append(self.added[token])
            chunk = chunk[at + len(token) :]
        return out

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; ``NO_PAIR`` where there is none."""
        keys = np.where((a >= 0) & (b >= 0), a << 20 | b, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_PAIR)

    def _merge_forest(self, symbols: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge many words of at most ``width`` symbols, a row of segment-tree nodes for each.

        All trees take one step at a time: read the root, merge, change three
        leaves and their ancestors. Returns the ids of all words and their counts.
        """
        n, shift = len(lengths), width.bit_length()
        ids = np.full((n, width + 1), -1, np.int64)
        ids[np.arange(width + 1) < lengths[:, None]] = symbols
        place = np.arange(width, dtype=np.int64)
        tree = np.full((n, 2 * width), NO_PAIR, np.int64)
        rank = self._ranked(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = np.where(rank == NO_PAIR, NO_PAIR, rank << shift | place)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        rows = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while rows.size:
            root = tree[rows, 1]
            i = root & ((1 << shift) - 1)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = self.merged[root >> shift]
            ids[rows, j] = -1
            after[rows, i] = k
            before[rows, np.minimum(k, width)] = i
            tree[rows, width + j] = NO_PAIR
            p = before[rows, i]
            p = np.where(p < 0, i, p)
            for left, right in ((i, k), (p, after[rows, p])):
                rank = self._ranked(ids[rows, left], ids[rows, right])
                tree[rows, width + left] = np.where(rank == NO_PAIR, NO_PAIR, rank << shift | left)
            for leaf in (j, i, p):
                k = (width + leaf) >> 1
                for _ in range(shift - 1):
                    tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                    k >>= 1
            rows = rows[tree[rows, 1] != NO_PAIR]
        alive = ids >= 0
        return ids[alive], alive.sum(1)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (its bytes), all merges applied."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for width in (2, 4, 8, 16, 32, 64):
            mine = np.flatnonzero((lengths <= width) & (lengths > (width // 2 if width > 2 else 0)))
            for part in np.array_split(mine, -(-len(mine) // 20_000)) if len(mine) else ():
                flat = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
                ends = np.cumsum(lengths[part])
                symbols = self.byte_ids[flat]
                symbols[ends - 1] = self.end_ids[flat[ends - 1]]
                ids, counts = self._merge_forest(symbols, lengths[part], width)
                for i, found in zip(part, np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])):
                    out[i] = found
        for i in np.flatnonzero(lengths > 64):
            word = words[i]
            symbols = [*self.byte_ids[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.end_ids[word[-1]])]
            out[i] = np.array(merge_symbols(symbols, self.ranks), np.int32)
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks that are not in the table; each distinct word of them once."""
        cut = [self._cut(c.decode("utf-8", "surrogatepass")) for c in chunks]
        known = self._words_seen
        new = list({w for words in cut for w in words if type(w) is bytes and w not in known})
        for word, ids in zip(new, self.merge_words(new)):
            known[word] = ids.tobytes()
        for chunk, words in zip(chunks, cut):
            got = [known[w] if type(w) is bytes else array("i", [w]).tobytes() for w in words]
            self._seen[chunk] = got[0] if len(got) == 1 else b"".join(got)
        self._held += sum([ENTRY_BYTES + len(c) + len(self._seen[c]) for c in chunks]) + sum([ENTRY_BYTES + len(w) + len(known[w]) for w in new])
        self._forget(known, new)

    def _forget(self, table: dict[bytes, bytes], keys: list[bytes]) -> None:
        """Take long keys out of a table: they seldom come again, and each may be a whole text."""
        for key in keys:
            if len(key) > KEEP_BYTES:
                self._held -= ENTRY_BYTES + len(key) + len(table.pop(key))

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids (as 32-bit integers) of each whole text."""
        was = gc.isenabled()
        gc.disable()  # the tables hold no cycles, and scanning them costs a third of the time
        try:
            out: list[bytes] = []
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and end - at < BLOCK_TEXTS and (end == at or chars + len(texts[end] or "") <= BLOCK_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                out += self._packed(texts[at:end])
                at = end
            return out
        finally:
            if was:
                gc.enable()

    def _packed(self, texts: list[str | None]) -> list[bytes]:
        seen = self._seen
        cut = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        if self._held > CACHE_BYTES:
            seen.clear()
            self._words_seen.clear()
            self._held = 0
        if new := list({c for chunks in cut for c in chunks if c not in seen}):
            self._learn(new)
        out = [b"".join([seen[c] for c in chunks]) for chunks in cut]
        self._forget(seen, new)
        return out

    def joined(self, packed: list[bytes]) -> pa.Array:
        """The decoded text (as ``decode`` gives it) of each text's ids."""
        lists = id_lists(packed)
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.texts.take(lists.values)), pa.scalar(" ", pa.large_string()))

    def pieces(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as 32-bit integers, decoded text) of each whole text."""
        packed = self.packed(texts)
        return list(zip(packed, self.joined(packed).to_pylist()))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as files without a decoder section say; unknown ids are skipped."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(text: str | Column, path: str) -> Column:
    """Struct (ids array<int>, decoded string) of a text column."""

    @F.arrow_udf("ids array<int>, decoded string")
    def encode(texts: pa.Array) -> pa.Array:
        vocab = vocabulary(path)
        ids, decoded = [], []
        for at in range(0, len(texts), BLOCK_TEXTS):  # few texts as Python objects at a time
            some = vocab.packed(texts.slice(at, BLOCK_TEXTS).to_pylist())
            ids += some
            decoded.append(vocab.joined(some).cast(pa.string()))
        return pa.StructArray.from_arrays([id_lists(ids), pa.concat_arrays(decoded) if decoded else pa.array([], pa.string())], ["ids", "decoded"])

    return encode(F.col(text) if isinstance(text, str) else text)


def decoded_from(ids: str | Column, path: str) -> Column:
    """Text of a column of id arrays (null: null)."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        vocab = vocabulary(path)
        return pa.array([None if x is None else vocab.decode(x) for x in lists.to_pylist()], pa.string())

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded text of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), encoded(text_col, path).alias("bpe"))
    return rows.select("doc_id", "bpe.ids", "bpe.decoded")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids joined by one space) and decoded_sha256."""
    rows = encode_documents(docs, path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
