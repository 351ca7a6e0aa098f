"""Routing of texts that share a window of `WINDOW` symbols to where they can be compared.

Every window has an anchor: the leftmost of its `GRAM`-grams with the least hash. Equal windows have
equal anchors at equal places, so windows need to be compared only under a common anchor. Symbols are
bytes or words. Three passes over the documents, each in blocks:

1. anchors are asked for: which occur in more than one document, and which in very many places?
2. around each anchor that does, its *context* (all windows that it anchors, joined) goes to the
   shard of the anchor; equal contexts of a block go once, with the least doc_id. The engine of the
   shard finds repeats and answers each context with spans (from, to, least doc_id with that string);
3. spans with a smaller doc_id than the document's own are removed from it.

A passage that a third of all documents share reaches its shard once a block. A short string that very
many documents share, each between other words, would bring as many different contexts to one shard: the
windows of an anchor with HOT such contexts or more go one by one, each to the shard of its own hash.
Hashes only route: strings are held equal by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

WINDOW, GRAM = 50, 24
REACH = WINDOW - GRAM + 1  # grams of a window
#: Symbols that are hashed at once.
CHUNK = 500_000
NULL_ID = -(2**63)  # a null doc_id counts as smaller than every other
#: Contexts of an anchor from which on its windows go one by one: unlike ones, counted in each block by their looks.
HOT = 4_000
#: Distinct contexts, sorted by anchor (anchors, least ids, whether there are several copies, texts), to spans (context, from, to, least id)
Engine = Callable[[np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Symbols:
    """Documents as symbols: a number for each, where each document starts, and the bytes under them."""

    value: np.ndarray
    start: np.ndarray  # n + 1 offsets
    ids: np.ndarray  # doc_id of each document
    raw: bytes
    at: np.ndarray | None  # for words: where each starts in raw; None: symbols are the bytes

    def slice(self, a: int, b: int) -> bytes:
        """Symbols a to b: bytes, or words each followed by a space."""
        lo, size = self.bytes_of(np.array([a]), np.array([b]))
        return self.raw[lo[0] : lo[0] + size[0]]

    def bytes_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, how many) of symbols a to b."""
        return (a, b - a) if self.at is None else (self.at[a], self.at[b] - self.at[a])


def as_bytes(texts: list[bytes], ids: np.ndarray) -> Symbols:
    raw = b"".join(texts)
    return Symbols(np.frombuffer(raw, np.uint8), _offsets([len(t) for t in texts]), ids, raw, None)


def as_words(texts: list[bytes], ids: np.ndarray) -> Symbols:
    from xxhash import xxh64_intdigest

    word, sizes, distinct = C.word_ids(texts)
    value = np.array([xxh64_intdigest(w) for w in distinct] or [0], dtype=C.U64)[word]
    length = np.array([len(w) for w in distinct] or [0], dtype=np.int64)[word]
    raw = b"".join([b" ".join(t.split()) + b" " if n else b"" for t, n in zip(texts, sizes, strict=True)])
    return Symbols(value, _offsets(sizes), ids, raw, _offsets(length + 1))


def _offsets(sizes) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(np.asarray(sizes, dtype=np.int64), dtype=np.int64)))


def _power(e: int) -> np.uint64:
    return C.U64(pow(C.MULTIPLIER, e, 1 << 64))


def grams(value: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` successive symbols, by doubling."""
    run, n, out, done = C.mixed(value), 1, None, 0
    while size:
        if size & 1:
            if out is None:
                out, done = run, n
            else:
                keep = len(value) - done - n + 1
                out, done = out[: max(0, keep)] * _power(n) + run[done : done + max(0, keep)], done + n
        size >>= 1
        if size:
            run, n = run[:-n] * _power(n) + run[n:] if len(run) > n else run[:0], 2 * n
    return C.mixed(out)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values, by doubling."""
    run, n = h, 1
    while 2 * n <= width:
        run, n = np.minimum(run[:-n], run[n:]), 2 * n
    keep = len(h) - width + 1
    return np.minimum(run[:keep], run[width - n : width - n + keep])


def anchors(value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor; windows are named by where they start."""
    if len(value) < WINDOW:
        return np.empty(0, C.U64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = grams(value, GRAM)
    low = least(h, REACH)
    doc = np.repeat(np.arange(len(start) - 1), np.diff(start))
    whole = doc[: len(low)] == doc[WINDOW - 1 :]
    new = np.empty(len(low), bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (doc[1 : len(low)] != doc[: len(low) - 1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    out = []
    while len(first):  # once, and again where a gram repeats within reach
        at = np.empty(len(first), np.int64)
        for i in range(0, len(first), 20_000):
            part = first[i : i + 20_000]
            at[i : i + 20_000] = part + np.argmax(h[part[:, None] + np.arange(REACH)] == low[part][:, None], axis=1)
        out.append((C.mixed(low[first] + C.U64(1)), first, np.minimum(last, at)))  # least hashes are small: spread them again
        again = last > at
        first, last = at[again] + 1, last[again]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else anchors(value[:0], start)


def chunks(s: Symbols) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, offsets) of runs of whole documents of about CHUNK symbols."""
    i, n = 0, len(s.start) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(s.start, s.start[i] + CHUNK, side="right")) - 1)
        yield i, s.start[i : j + 1]
        i = j


def all_anchors(s: Symbols) -> tuple[np.ndarray, ...]:
    """(hash, document, first window, last window) of a block's anchors."""
    parts = []
    for i, start in chunks(s):
        key, a, b = anchors(s.value[start[0] : start[-1]].astype(C.U64) + C.U64(1), start - start[0])
        base = s.start[i]
        parts.append((key, i + np.searchsorted(start - start[0], a, side="right") - 1, a + base, b + base))
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty.astype(C.U64), empty, empty, empty)


def looks(s: Symbols, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each context's length and of some symbols at both its ends: unlike contexts rarely look alike."""
    out = (b - a).astype(C.U64)
    for i in (0, 4, 9):
        out = out * C.U64(C.MULTIPLIER) + s.value[a + i]
        out = out * C.U64(C.MULTIPLIER) + s.value[b - 1 - i]
    return C.mixed(out)


def contents(s: Symbols, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the symbols from each a to b, in order of a."""
    out = np.empty(len(a), C.U64)
    for _, start in chunks(s):
        lo, hi = np.searchsorted(a, start[[0, -1]])
        if lo < hi:
            running, inverse = prefix_hash(s.value[start[0] : start[-1]].astype(C.U64) + C.U64(1))
            x, y = a[lo:hi] - start[0], b[lo:hi] - start[0]
            out[lo:hi] = C.mixed((running[y] - running[x]) * inverse[x] + (y - x).astype(C.U64))
    return out


def prefix_hash(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hashes and inverse powers: any range's hash in two look-ups."""
    n = len(value)
    powers = np.full(n + 1, C.MULTIPLIER, dtype=C.U64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=C.U64)
    inverse = np.full(n + 1, pow(C.MULTIPLIER, -1, 1 << 64), dtype=C.U64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=C.U64)
    return np.concatenate((np.zeros(1, C.U64), np.cumsum(C.mixed(value) * powers[:n], dtype=C.U64))), inverse


@dataclass(frozen=True)
class Contexts:
    """Distinct contexts of a block, sorted by anchor, and to which one each occurrence belongs."""

    key: np.ndarray
    least_id: np.ndarray
    several: np.ndarray  # whether there are copies in the block
    first: np.ndarray  # one occurrence of each: symbols from, to
    last: np.ndarray
    of: np.ndarray  # occurrence -> context
    doc: np.ndarray
    at: np.ndarray  # occurrence -> its first symbol


def same(s: Symbols, a: np.ndarray, b: np.ndarray, other_a: np.ndarray, other_b: np.ndarray) -> np.ndarray:
    """Whether symbols a to b are those from other_a to other_b, byte by byte."""
    flat = np.frombuffer(s.raw, np.uint8)
    (x, size), (y, other) = s.bytes_of(a, b), s.bytes_of(other_a, other_b)
    equal = size == other
    ends = np.cumsum(np.where(equal, size, 0))
    lo = 0
    while lo < len(a):  # a million bytes at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, side="right")))
        part = lo + np.flatnonzero(equal[lo:hi])
        differ = flat[C.stretches(x[part], size[part])] != flat[C.stretches(y[part], size[part])]
        equal[np.repeat(part, size[part])[differ]] = False
        lo = hi
    return equal


def contexts(s: Symbols, flags: np.ndarray) -> Contexts:
    """Those of the block's anchors that occur in several documents: `flags` has 1 for them and 2 more if they are hot."""
    key, doc, a, b = all_anchors(s)
    flag = flags[np.unique(key, return_inverse=True)[1]] if len(key) else np.empty(0, np.uint8)
    cold, hot = np.flatnonzero(flag == 1), np.flatnonzero(flag == 3)
    count = b[hot] - a[hot] + 1
    own = np.concatenate((cold, np.repeat(hot, count)))
    a = np.concatenate((a[cold], C.stretches(a[hot], count)))
    b = np.concatenate((b[cold], a[len(cold) :])) + WINDOW
    order = np.argsort(a, kind="stable")
    is_window, own, a, b = (np.arange(len(own)) >= len(cold))[order], own[order], a[order], b[order]
    doc, content = doc[own], contents(s, a, b)
    key = np.where(is_window, C.mixed(content + C.U64(1)), key[own])
    while True:
        order = np.lexsort((s.ids[doc], content, key))
        key, content, doc, a, b = (x[order] for x in (key, content, doc, a, b))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        of, lead = np.cumsum(new) - 1, np.flatnonzero(new)
        copies = np.flatnonzero(~new)
        unlike = copies[~same(s, a[copies], b[copies], a[lead[of[copies]]], b[lead[of[copies]]])]
        if not len(unlike):
            break
        content[unlike] = C.mixed(content[unlike] + C.U64(1))  # equal hashes of unequal strings
    several = (np.bincount(of, minlength=len(lead)) > 1).astype(np.uint8)
    return Contexts(key[lead], s.ids[doc[lead]], several, a[lead], b[lead], of, doc, a)


def merge_anchors(asked: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries (anchor, whether several documents have it, how many unlike contexts the blocks have)."""
    key, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    several, counts = np.zeros(len(key), np.uint8), np.zeros(len(key), np.int64)
    several[(np.bincount(at, minlength=len(key)) > 1)] = 1
    several[at[np.concatenate([a[1] for a in asked]) > 0]] = 1
    np.add.at(counts, at, np.concatenate([a[2].astype(np.int64) for a in asked]))
    return [key, several, C.small(counts)], np.split(at, np.cumsum([len(a[0]) for a in asked])[:-1])


def merge_contexts(asked: list[list[C.Column_]]) -> tuple[list[C.Column_], list[np.ndarray]]:
    """Entries (anchor, least id, whether there are several copies, text): equal texts under one anchor are one."""
    key, ids, several, texts = (C.joined([a[i] for a in asked]) for i in range(4))
    known: dict[tuple[int, bytes], int] = {}
    of = np.fromiter((known.setdefault(k, len(known)) for k in zip(key.tolist(), texts.texts(), strict=True)), np.int64, len(key))
    first = np.empty(len(known), np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    least_id, more = np.full(len(known), np.iinfo(np.int64).max), (np.bincount(of, minlength=len(known)) > 1).astype(np.uint8)
    np.minimum.at(least_id, of, ids)
    more[of[several > 0]] = 1
    order = np.argsort(key[first], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = first[order]
    return [key[first], least_id[order], more[order], texts.take(first)], np.split(place[of], np.cumsum([len(a[0]) for a in asked])[:-1])


def entries(s: Symbols, c: Contexts) -> list[C.Column_]:
    lo, size = s.bytes_of(c.first, c.last)
    return [c.key, c.least_id, c.several, C.Ragged(size, C.gathered(np.frombuffer(s.raw, np.uint8), lo, size))]


def found(engine: Engine, merged: list[C.Column_]) -> C.Ragged:
    """The spans (from, to, least id) of each entry."""
    which, a, b, m = engine(*merged[:3], merged[3].texts())
    order = np.argsort(which, kind="stable")
    return C.Ragged(np.bincount(which, minlength=len(merged[0])), C.small(a[order]), C.small(b[order]), m[order])


def covered(s: Symbols, c: Contexts, spans: C.Ragged | None) -> np.ndarray:
    """Which symbols lie in spans of documents with smaller ids than their own."""
    edge = np.zeros(len(s.value) + 1, np.int32)
    if spans is not None:
        each = spans.take(c.of)
        occurrence = np.repeat(np.arange(len(c.of)), each.counts)
        a, b, m = (x.astype(np.int64) for x in each.flats)
        earlier = m < s.ids[c.doc[occurrence]]
        start = c.at[occurrence[earlier]]
        np.add.at(edge, start + a[earlier], 1)
        np.add.at(edge, start + b[earlier], -1)
    return np.cumsum(edge, out=edge)[:-1] > 0


def remove_repeats(docs: DataFrame, read: Callable[[list[bytes], np.ndarray], Symbols], engine: Engine, finish: Callable[[Symbols, np.ndarray], dict], schema: str | StructType, block_bytes: int, carry: bool = False, fan: int | None = None) -> DataFrame:
    """`finish` gets a block's symbols and which of them are repeats of documents with smaller ids.

    `carry` keeps the other columns of docs, as a struct `rest` that schema names too.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []
    C.ship(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *([F.struct(*[docs[c] for c in others]).alias("rest")] if others else []))
    blocks = C.block_count(docs, block_bytes)
    ranges = C.levels(blocks, fan or C.FAN)
    rows = C.in_blocks(docs, blocks)

    def symbols(table: pa.Table) -> Symbols:
        return read(C.encoded(table["text"]), table["doc_id"].fill_null(NULL_ID).to_numpy())

    def ask(table: pa.Table) -> pa.Table:
        s = symbols(table)
        key, doc, a, b = all_anchors(s)
        ids = s.ids[doc]
        if not len(key):
            return C.packets([])
        look = looks(s, a, b + WINDOW)
        order = np.lexsort((look, key))
        key, ids, look = key[order], ids[order], look[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        lead = np.flatnonzero(new)
        several = np.minimum.reduceat(ids, lead) < np.maximum.reduceat(ids, lead)
        new[1:] |= look[1:] != look[:-1]
        return C.packets(C.dealt(table["block"][0].as_py(), [key[lead], several.astype(np.uint8), C.small(np.add.reduceat(new, lead, dtype=np.int64))], ranges[0]))

    def tell(merged: list[C.Column_]) -> list[C.Column_]:
        return [merged[1] * (1 + 2 * (merged[2] >= HOT)).astype(np.uint8)]

    def own_contexts(s: Symbols, flags: pa.Table) -> Contexts:
        got = C.columns_of(flags)
        return contexts(s, got[0] if got else np.empty(0, np.uint8))

    def send(table: pa.Table, flags: pa.Table) -> pa.Table:
        s = symbols(table)
        return C.packets(C.dealt(table["block"][0].as_py(), entries(s, own_contexts(s, flags)), ranges[0]))

    def compare(merged: list[C.Column_]) -> list[C.Column_]:
        return [found(engine, merged)]

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        s = symbols(table)
        c = own_contexts(s, answers.filter(pc.equal(answers["answer"], "flags")))
        got = C.columns_of(answers.filter(pc.equal(answers["answer"], "spans")))
        return pa.table({"doc_id": table["doc_id"].combine_chunks()} | ({"rest": table["rest"]} if others else {}) | finish(s, covered(s, c, got[0] if got else None)))

    flags, _ = C.exchange(rows.groupBy("block").applyInArrow(C.tidy(ask), C.PACKET_SCHEMA), blocks, ranges, merge_anchors, tell, fan=fan)
    sent = rows.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(C.tidy(send), C.PACKET_SCHEMA)
    spans, _ = C.exchange(sent, blocks, ranges, merge_contexts, compare, fan=fan)
    answers = flags.withColumn("answer", F.lit("flags")).unionAll(spans.withColumn("answer", F.lit("spans")))
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(C.tidy(remove), schema)


def runs(removed: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(removed symbols, maximal removed runs) of each document."""
    rise = removed.copy()
    rise[1:] &= ~removed[:-1]
    inner = start[:-1][start[:-1] < len(removed)]
    rise[inner] = removed[inner]
    return _sums(removed, start), _sums(rise, start)


def _sums(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start) - 1, np.int64)
    some = np.flatnonzero(np.diff(start))
    if len(some):
        out[some] = np.add.reduceat(flags.view(np.uint8), start[some], dtype=np.int64)
    return out


def hexes(parts: list[bytes]) -> list[str]:
    return [sha256(x).hexdigest() for x in parts]
