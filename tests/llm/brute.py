"""Plain versions of the operators for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import regex

SPACE = " \t\n\v\f\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality_base(text):
    w, text = words(text), text or ""
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def spans_sha(spans):
    return hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans).encode()).hexdigest()


def without_repeats(rows, length=50):
    """doc_id, text -> (n_bytes, n_removed, n_spans, sha256) in order."""
    lowest = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                lowest[w] = min(lowest.get(w, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - length + 1):
                if lowest[b[i : i + length]] < d:
                    gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k):
    w = ascii_lower(text)
    w = words(w)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(rows, k, percent=80):
    sets = {d: shingles(t, k) for d, t in rows if d is not None}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        # A linked set shares one of the rarest shingles: more than a fifth cannot be missing.
        rare = sorted(s, key=lambda x: (len(holders[x]), x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for e in {e for x in rare for e in holders[x] if e != d}:
            both = len(s & sets[e])
            if 100 * both >= percent * (len(s) + len(sets[e]) - both) and root(d) != root(e):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def decon_words(text):
    return [w for w in regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", (text or "").lower()).split(" ") if w]


def decon_shingles(w):
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def decon_weight(shingle):
    return min(31, math.ceil(math.log2(len(shingle) + 1)))


def contaminated(docs, items, threshold=0.8):
    """(doc_id, item_id) -> (similarity, first window)."""
    out, index, known = {}, collections.defaultdict(set), {}
    for i, text in items:
        known[i] = decon_words(text)
        if i is not None and len(known[i]) >= 5:
            for s in decon_shingles(known[i]):
                index[s].add(i)
    short = {i for i, w in known.items() if i is not None and 0 < len(w) < 5}
    for d, text in docs:
        w = decon_words(text)
        for i in short | {i for s in decon_shingles(w) for i in index.get(s, ())}:
            size, want = len(known[i]), set(decon_shingles(known[i]))
            for at in range(len(w) - size + 1):
                got = set(decon_shingles(w[at : at + size]))
                common = sum(map(decon_weight, got & want))
                similarity = common / (sum(map(decon_weight, got)) + sum(map(decon_weight, want)) - common)
                if similarity >= threshold and similarity > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (similarity, at)
    return out


def repair_cost(roles, costs):
    """Least cost of a conversation by trying every state at every turn."""
    from segmetrics.llm import chat

    best = {0: 0}
    for r in roles:
        new = {}
        for s, paid in best.items():
            for at, inserted in chat.insertions(s).items():
                for q in chat.LEGAL[at]:
                    c = paid + costs.insert * len(inserted) + (q != r) * costs.relabel
                    new[q + 1] = min(new.get(q + 1, c), c)
            if s:
                c = paid + costs.merge + (s - 1 != r) * costs.relabel
                new[s] = min(new.get(s, c), c)
        best = new
    return min(c + costs.insert * len(chat.insertions(s)[chat.DONE]) for s, c in best.items())
