"""Substring dedup with an enhanced suffix array and its tree of common-prefix intervals.

A shard's texts are the contexts of its anchors (see anchors.py). Their suffixes of WINDOW bytes or
more are sorted; one stack scan over the common-prefix lengths walks the interval tree from the
leaves up. An interval is reported if the bytes left of its suffixes differ (or one starts its
context): such a string is a maximal repeat, and all suffixes of the interval are its occurrences,
not just neighbours in the array. A text that several documents have stands in the array once, with its
number of copies: as a leaf it is an interval of all of them, since each starts its context. Nothing is
removed but by an interval.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import anchors as A
from . import common as C

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
WIDTH = 8 * -(-(A.WINDOW + A.REACH) // 8)  # no context is longer


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, common prefix with the one before) of all suffixes of WINDOW bytes or more, sorted."""
    size = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(size - A.WINDOW + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    start = C.stretches(np.zeros(len(count), np.int64), count)
    flat = np.frombuffer(b"".join(texts) + bytes(WIDTH), np.uint8)
    rest = size[text] - start
    table = np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[(np.cumsum(size) - size)[text] + start]  # a table of places would be eight times as large
    table[np.arange(WIDTH) >= rest[:, None]] = 0
    order = np.argsort(table.view(f"S{WIDTH}").ravel(), kind="stable")
    table, text, start, rest = table[order], text[order], start[order], rest[order]
    common = np.zeros(len(text), np.int64)
    if len(text) > 1:
        differ = table[1:] != table[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), WIDTH)
        common[1:] = np.minimum(common[1:], np.minimum(rest[1:], rest[:-1]))
    return text, start, common


def maximal_repeats(texts: list[bytes], weight: np.ndarray, several: np.ndarray | None = None):
    """(length, first, last, least weight) of the left-diverse intervals, and the array's (text, start).

    `several` marks texts of which there are copies.
    """
    text, start, common = suffix_array(texts)
    several = np.zeros(len(texts), np.uint8) if several is None else several
    size, copied = np.array([len(t) for t in texts], np.int64), several[text] > 0
    found: list[tuple[int, int, int, int]] = []
    left = [-1 - i if p == 0 else texts[t][p - 1] for i, (t, p) in enumerate(zip(text.tolist(), start.tolist(), strict=True))]
    for i in np.flatnonzero(copied & (start == 0)).tolist():
        left[i] = 256  # copies that start their contexts differ among themselves
    least = weight[text].tolist()
    # a leaf of copies, unless a wider interval has the same string
    beside = np.maximum(common, np.append(common[1:], 0))
    for i in np.flatnonzero(copied & (start == 0) & (size[text] > beside)).tolist():
        found.append((int(size[text[i]]), i, i, least[i]))
    stack: list[list[int]] = []  # length, first, least weight, left byte (256: they differ)
    for i, n in enumerate([*common.tolist(), 0]):
        if n < A.WINDOW and not stack:
            continue
        begin, low, side = i - 1, least[i - 1], left[i - 1]
        while stack and stack[-1][0] > n:
            size_, begin, own, mark = stack.pop()
            low, side = min(low, own), mark if mark == side else 256
            if side == 256:
                found.append((size_, begin, i - 1, low))
        if n >= A.WINDOW:
            if stack and stack[-1][0] == n:
                top = stack[-1]
                top[2], top[3] = min(top[2], low), top[3] if top[3] == side else 256
            else:
                stack.append([n, begin, low, side])
        elif stack:
            stack.clear()
    return found, text, start


def intervals(key: np.ndarray, least_id: np.ndarray, several: np.ndarray, texts: list[bytes]):
    """Yields (text, start, length, least id) of all occurrences of the maximal repeats of a shard's texts.

    Suffixes under different anchors have no WINDOW bytes in common, so the array is made anchor by anchor, many
    at a time; an only text under its anchor has no interval but its leaf.
    """
    size = np.array([len(t) for t in texts], np.int64)
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    leaf = np.flatnonzero((n[at] == 1) & (several > 0))
    yield leaf, np.zeros(len(leaf), np.int64), size[leaf], least_id[leaf]
    among = np.flatnonzero(n[at] > 1)
    among = among[np.argsort(at[among], kind="stable")]
    for lo in _parts(at[among], 12_000):
        own = among[lo]
        found, text, start = maximal_repeats([texts[i] for i in own], least_id[own], several[own])
        if found:
            length, first, last, low = np.array(found, np.int64).T
            width = last - first + 1
            pick = C.stretches(first, width)
            yield own[text[pick]], start[pick], np.repeat(length, width), np.repeat(low, width)


def spans(key: np.ndarray, least_id: np.ndarray, several: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the intervals, those that tell something: an earlier document than the text's own, or copies of the text."""
    which, a, length, m = (np.concatenate(x) for x in zip(*intervals(key, least_id, several, texts), strict=True))
    useful = (m < least_id[which]) | (several[which] > 0)
    return which[useful], a[useful], (a + length)[useful], m[useful]


def _parts(group: np.ndarray, size: int) -> list[slice]:
    """Slices of whole groups of about `size` entries; one group may be longer."""
    out, i = [], 0
    while i < len(group):
        j = min(len(group), i + size)
        j = int(np.searchsorted(group, group[j - 1], side="right"))
        out.append(slice(i, j))
        i = j
    return out


def _kept(s: A.Symbols, removed: np.ndarray) -> list[bytes]:
    flat = np.frombuffer(s.raw, np.uint8)
    ends = s.start
    return [flat[a:b][~removed[a:b]].tobytes() if removed[a:b].any() else s.raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def dedup(docs: DataFrame, block_bytes: int = C.BLOCK_BYTES, fan: int | None = None) -> DataFrame:
    """Removes each byte covered by a WINDOW-byte string that also starts in a document with a smaller doc_id.

    Null texts are empty. Rows that share a doc_id are one document's: they don't remove each other's
    bytes. A null doc_id counts as the smallest. No rows give no rows. A text of any length is whole: one
    beyond `block_bytes` is a block by itself. Other columns are left behind, whatever their names.
    """

    def finish(s: A.Symbols, removed: np.ndarray) -> dict:
        gone, parts = A.runs(removed, s.start)
        kept = _kept(s, removed)
        return {"n_bytes": np.diff(s.start), "n_removed": gone, "n_spans": parts, "kept_sha256": A.hexes(kept)}

    return A.remove_repeats(docs, A.as_bytes, spans, finish, SCHEMA, block_bytes, fan=fan)


def trim(docs: DataFrame, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """The documents with such bytes taken out of their texts, and all other columns.

    A character that is cut goes whole; `n_chars`, if there is one, follows the text. A null text becomes empty;
    no rows give no rows.
    """
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]

    def finish(s: A.Symbols, removed: np.ndarray) -> dict:
        return {"text": [x.decode("utf-8", "ignore") for x in _kept(s, removed)]}

    schema = StructType([StructField("doc_id", LongType()), *([StructField("rest", StructType(others))] if others else []), StructField("text", StringType())])
    out = A.remove_repeats(docs, A.as_bytes, spans, finish, schema, block_bytes, carry=True)
    at = {f.name: F.col("rest")[f.name] for f in others}
    if "n_chars" in at:
        at["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[at.get(c, F.col(c)).alias(c) for c in docs.columns])
