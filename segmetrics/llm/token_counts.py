"""Token counts of sections, by offset-mapped attribution.

A document is encoded once, whole; its tokens are character spans that tile
the text. Sections (fields, lines, any given spans) are character spans too.
The two sorted lists are joined by interval, and every token is given to
exactly one section by an explicit rule for tokens that cross a boundary:

- ``majority``: the section that covers most of its characters; ties go to the
  earlier section;
- ``first`` / ``last``: the section of its first / last covered character.

A token that touches no section is counted in the row of section -1, so the
counts of a document always add up to its token count. Encoding sections one
by one would not: pieces change at the cuts.

The vocabulary is a byte-level rank file; spans come from the byte lengths of
the tokens. A character whose bytes are split over tokens counts as covered by
each of them, so such a token has a width.

Defined results: a null text counts as empty; a document always has its row -1
(0 tokens if nothing is outside); empty sections take no tokens; sections
of one document must be sorted and must not overlap; repeated rows give repeated
rows; an empty table gives no rows; further columns are ignored. Row-local: no shuffle. Whole texts are
encoded; the work on a text's sections is linear in their number.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("majority", "first", "last")
SECTIONS = "array<struct<name:string,start:int,finish:int>>"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the byte length of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), widths


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Character start and end (exclusive) of each token of a whole text."""
    encoding, widths = _encoding(path, pattern)
    ends = np.cumsum(widths[encoding.encode_ordinary(text)])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    chars = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to each byte
    return chars[starts] - 1, chars[ends - 1]


def attributed(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether the token crosses a boundary.

    Interval join of two sorted lists: the sections that a token touches are a
    run, found by binary search in their bounds.
    """
    full = np.flatnonzero(high > low)
    section = np.full(len(starts), -1, np.int64)
    if not len(full) or not len(starts):
        return section, np.zeros(len(starts), bool)
    lo, hi = low[full], high[full]
    first = np.searchsorted(hi, starts, "right")
    last = np.searchsorted(lo, ends, "left") - 1
    inside = first <= last
    at = np.minimum(first, len(full) - 1)
    whole = inside & (lo[at] <= starts) & (ends <= hi[at])
    section[inside] = first[inside] if rule != "last" else last[inside]
    if rule == "majority":
        for t in np.flatnonzero(inside & (first < last)):
            k = np.arange(first[t], last[t] + 1)
            section[t] = k[np.argmax(np.minimum(hi[k], ends[t]) - np.maximum(lo[k], starts[t]))]
    crossing = inside & ~whole
    return np.where(section >= 0, full[np.maximum(section, 0)], -1), crossing


COUNTED = "array<struct<section:int,name:string,start:int,finish:int,n_tokens:long,n_crossing:long>>"


def section_counts(text: str | Column, sections: str | Column, path: str, pattern: str, rule: str = "majority") -> Column:
    """Array of (section, name, start, finish, n_tokens, n_crossing): -1 first, then every section in order."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    @F.arrow_udf(COUNTED)
    def count(texts: pa.Array, spans: pa.Array) -> pa.Array:
        columns: dict[str, list] = {c: [] for c in ("section", "name", "start", "finish", "n_tokens", "n_crossing")}
        sizes = [0]
        for i, text in enumerate(texts):
            starts, ends = token_spans(text.as_py() or "", path, pattern)
            mine = spans[i].values
            if mine is None:
                mine = pa.array([], spans.type.value_type)
            low, high = (mine.field(c).to_numpy(zero_copy_only=False) for c in ("start", "finish"))
            section, crossing = attributed(starts, ends, low, high, rule)
            n = len(low) + 1
            columns["section"].append(np.arange(-1, n - 1, dtype=np.int32))
            for c in ("name", "start", "finish"):
                columns[c] += [pa.nulls(1, mine.field(c).type), mine.field(c)]
            columns["n_tokens"].append(np.bincount(section + 1, minlength=n).astype(np.int64))
            columns["n_crossing"].append(np.bincount(section + 1, weights=crossing, minlength=n).astype(np.int64))
            sizes.append(n)
        kinds = {"section": pa.int32(), "name": pa.string(), "start": pa.int32(), "finish": pa.int32(), "n_tokens": pa.int64(), "n_crossing": pa.int64()}
        flat = [pa.concat_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns[c]] or [pa.array([], kinds[c])]).cast(kinds[c]) for c in kinds]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(flat, list(kinds)))

    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return count(as_column(text), as_column(sections))


def line_sections(text: Column, shift: Column | int = 0) -> Column:
    """Each line with its line break as a section named ``line``, in code points from ``shift`` on.

    Linear in the text, whatever the number of its lines.
    """

    @F.arrow_udf(SECTIONS)
    def lines(texts: pa.Array, shifts: pa.Array) -> pa.Array:
        starts, finishes, sizes = [], [], [0]
        for text, at in zip(texts, shifts.to_numpy(zero_copy_only=False)):
            points = np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32)
            breaks = np.flatnonzero(points == 10) + 1
            starts.append(at + np.concatenate([[0], breaks]))
            finishes.append(at + np.concatenate([breaks, [len(points)]]))
            sizes.append(len(breaks) + 1)
        low, high = (pa.array(np.concatenate(x) if x else [], pa.int32()) for x in (starts, finishes))
        names = pa.repeat(pa.scalar("line"), len(low))
        flat = pa.StructArray.from_arrays([names, low, high], ["name", "start", "finish"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)

    return lines(text, (F.lit(shift) if isinstance(shift, int) else shift).cast("int"))


def field_document(fields: dict[str, Column], separator: str = "\n") -> tuple[Column, Column]:
    """(document, sections): named fields joined into one text, null fields as empty ones."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in fields.values()]
    at, sections = F.lit(0), []
    for name, text in zip(fields, texts):
        finish = at + F.char_length(text)
        sections.append(F.struct(F.lit(name).alias("name"), at.alias("start"), finish.alias("finish")))
        at = finish + len(separator)
    return F.concat_ws(separator, *texts), F.array(*sections)


def token_counts(rows: DataFrame, path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """One row per document and section from columns doc_id, text and sections.

    Columns: doc_id, section (-1: outside), name, start, finish, n_tokens, n_crossing.
    """
    counted = rows.select("doc_id", F.explode(section_counts("text", "sections", path, pattern, rule)).alias("c"))
    return counted.select("doc_id", "c.*")


def document_token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "majority") -> DataFrame:
    """Counts for the header fields (language, source) and each line of the text of ``docs``.

    The document is "lang\\nsource\\ntext"; the line breaks between fields are outside all sections.
    """
    head, fields = field_document({"lang": F.col("lang"), "source": F.col("source")})
    rows = docs.select("doc_id", head.alias("head"), fields.alias("fields"), F.coalesce("text", F.lit("")).alias("body"))
    lines = line_sections(F.col("body"), F.char_length("head") + 1)
    rows = rows.select("doc_id", F.concat("head", F.lit("\n"), "body").alias("text"), F.concat("fields", lines).alias("sections"))
    return token_counts(rows, path, pattern, rule)
