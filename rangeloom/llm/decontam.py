"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance over words.

A document is contaminated by an item if some stretch of it is within `edits` = (1 - similarity) * words
of the item, in edits of words. Random walks (Chakraborty, Goldenberg, Koucky, 2016) read items and
documents: a step puts out the word that the walk stands on and moves on or stays by a random bit of step
and word, so walks over strings that differ by few edits soon put out the same again. A key has the outputs at
sampled steps of one walk; windows of documents that share a key with an item are candidates. Windows start
at every word of a document and at every word of an item: with a fifth of the words edited, walks over a
whole item have little in common, and those over STEPS steps from some word of it nearly always have.
WALKS walks reach the target recall (README has measurements). Items of fewer than SHORT words are found
without loss: cut into edits + 1 pieces, one of which every stretch within the distance has whole, they are
read straight on.

Nothing grows on the driver. Keys of items are rows; a *sieve*, a bitmap of at most MOST_BITS bits, holds
the hashes of all keys and of their beginnings, and a window whose reading leaves it is dropped at once. What
passes becomes *regions*, stretches of documents with all that candidates need, which are saved; keys are
joined by Spark, and each pair of a region and an item is verified by the exact edit distance of the item to
the best stretch.

Words are lower-cased (A-Z) and lose ASCII punctuation at both ends; words of punctuation alone go.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common as C
from . import graph

SCHEMA = "doc_id long, item_id long, first_word long, n_words int, distance int, similarity double"
#: Walks, steps of each, and how many of them are sampled for its key.
WALKS, STEPS, SAMPLED = 8, 14, 10
#: Words from which on items are looked for by walks, and below which by pieces.
SHORT = 20
#: The sieve has SIEVE_BITS bits for each key or beginning of a key, and MOST_BITS at most; a part of it has PART_BITS.
SIEVE_BITS, MOST_BITS, PART_BITS = 16, 1 << 28, 1 << 16
#: Rows and bytes of items up to which they are broadcast to be joined; beyond, both sides are shuffled.
MOST_KEYS, MOST_BYTES = 200_000, 16_000_000
#: Cells of the distance table that are worked on at once.
CELLS = 1_000_000
_PUNCTUATION = string.punctuation.encode()
_ONE = 1 << 32  # an edit; the lower half has where the stretch begins


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, words a text, distinct words) after normalisation."""
    ids, sizes, names = C.word_ids([t.lower() for t in texts])
    seen: dict[bytes, int] = {}
    to = np.array([seen.setdefault(w, len(seen)) if (w := n.strip(_PUNCTUATION)) else -1 for n in names] or [0], np.int64)[ids]
    real = to >= 0
    total = np.concatenate(([0], np.cumsum(real)))
    ends = np.cumsum(sizes)
    return to[real], total[ends] - total[ends - sizes], list(seen)


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(hash of each word, words a text, word ids, distinct words)."""
    ids, sizes, names = tokens(texts)
    return np.array([xxh64_intdigest(w) for w in names] or [0], C.U64)[ids], sizes, ids, names


def distances(items: list[np.ndarray], parts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(edits, from, to) of the stretch of each part nearest to its item; the first and shortest of equals."""
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(items)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(parts[i])))
    at = 0
    while at < len(order):
        step = max(1, CELLS // (1 + max(len(parts[i]) for i in order[at : at + 512])))
        some = order[at : at + min(512, step)]
        at += len(some)
        n, m = (np.array([len(x[i]) for i in some]) for x in (items, parts))
        item, part = np.full((len(some), n.max()), -1), np.full((len(some), m.max()), -2)
        for row, i in enumerate(some):
            item[row, : n[row]], part[row, : m[row]] = items[i], parts[i]
        places = np.arange(m.max() + 1)
        cost = np.broadcast_to(places, (len(some), len(places))).copy()
        for i in range(item.shape[1]):
            new = cost + _ONE
            np.minimum(new[:, 1:], cost[:, :-1] + (item[:, i, None] != part) * _ONE, out=new[:, 1:])
            new[:, 0] = (i + 1) * _ONE
            new = np.minimum.accumulate(new - places * _ONE, axis=1) + places * _ONE
            cost = np.where((i < n)[:, None], new, cost)
        cost[places > m[:, None]] = np.iinfo(np.int64).max
        best = cost.argmin(1)
        for row, (i, j) in enumerate(zip(some, best.tolist(), strict=True)):
            edits, begin = divmod(int(cost[row, j]), _ONE)
            out[i] = (edits, begin, j)
    return out


def distance(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    return distances([item], [part])[0]


class Reader:
    """Reads words from a place: a walk that moves on or stays by random bits, or straight on for `steps` words."""

    def __init__(self, steps: int, walk: int | None = None):
        r = np.random.default_rng((20240229, steps if walk is None else 1000 + walk))
        self.steps, self.seed = steps, C.U64(r.integers(1, 1 << 63))
        self.odd = None if walk is None else r.integers(0, 1 << 62, steps).astype(C.U64) * C.U64(2) + C.U64(1)
        sampled = range(steps) if walk is None else [0, *(1 + r.choice(steps - 1, SAMPLED - 1, replace=False))]
        self.sampled = np.isin(np.arange(steps), list(sampled))

    def first(self, word: np.ndarray) -> np.ndarray:
        """The beginning of the key after each word: the first step is always sampled."""
        key = (self.seed ^ word) * C.U64(C.MULTIPLIER)
        return key ^ (key >> C.U64(29))

    def read(self, word: np.ndarray, starts: np.ndarray, ends: np.ndarray, sieve: np.ndarray | None = None, beginnings: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(starts, keys) of the readings that stay before their `ends` and in the sieve; `beginnings` gets the keys of all sampled steps."""
        at, key = starts, np.full(len(starts), self.seed)
        for step in range(self.steps):
            inside = at < ends
            if not inside.all():
                at, starts, ends, key = at[inside], starts[inside], ends[inside], key[inside]
            now = word[at]
            if self.sampled[step]:
                key = (key ^ now) * C.U64(C.MULTIPLIER)
                key ^= key >> C.U64(29)
                if beginnings is not None:
                    beginnings.append(key)
                if sieve is not None:
                    keep = passes(sieve, key)
                    at, starts, ends, key, now = at[keep], starts[keep], ends[keep], key[keep], now[keep]
            if step + 1 < self.steps:
                at = at + 1 if self.odd is None else at + ((now * self.odd[step]) >> C.U64(63)).astype(np.int64)
        return starts, key


def bits_of(key: np.ndarray, size: int) -> np.ndarray:
    """Where a key's bit is in a sieve of `size` bits, a power of two."""
    return (C.mixed(key) >> C.U64(65 - size.bit_length())).astype(np.int64)


def passes(sieve: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = bits_of(key, 8 * len(sieve))
    return np.flatnonzero((sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


def hits(readers: list[Reader], sieve: np.ndarray, word: np.ndarray, sizes: np.ndarray, ids: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the windows that pass the sieve; `distinct` has the hashes of the words that `ids` number."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    found = []
    for r in readers:
        opens = np.zeros(len(distinct), bool)  # words that a key may begin with
        opens[passes(sieve, r.first(distinct))] = True
        starts = np.flatnonzero(opens[ids])
        found.append(r.read(word, starts, ends[starts], sieve))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, C.U64))


def edits_of(words, similarity: float):
    return np.floor((1 - similarity) * words + 1e-9).astype(np.int64)


def item_keys(word: np.ndarray, similarity: float, beginnings: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words a piece or 0, offsets, keys) of one item, by each reader that looks for it."""
    n = len(word)
    if n >= SHORT:
        for walk in range(WALKS):
            starts, key = Reader(STEPS, walk).read(word, np.arange(n), np.full(n, n), beginnings=beginnings)
            yield 0, starts, key
    elif n:
        pieces = int(edits_of(n, similarity)) + 1
        size = n // pieces
        starts, key = Reader(size).read(word, np.arange(pieces) * size, np.full(pieces, n), beginnings=beginnings)
        yield size, starts, key


def _batches(tables, rows: int = 2000):
    for t in C.slices(tables, rows):
        texts = C.encoded(pa.chunked_array([t.column("text")]))
        yield (t, *hashes(texts))


class Index:
    """The keys of all items as rows, their sieve, and what else readers of documents have to know of them."""

    def __init__(self, benchmark: DataFrame, similarity: float):
        C.ship(benchmark.sparkSession)
        items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
        self.items = items.where("item_id IS NOT NULL").distinct().withColumn("item", F.xxhash64("item_id", "text"))
        self.similarity = similarity

        def keys(tables):
            for t, word, sizes, _, _ in _batches(tables):
                out = {"key": [], "item": [], "offset": [], "n": [], "piece": []}
                for item, w in zip(t.column("item").to_pylist(), np.split(word, np.cumsum(sizes)[:-1]), strict=True):
                    for size, starts, key in item_keys(w, similarity):
                        for name, value in (("key", key.view(np.int64)), ("offset", starts), ("item", np.full(len(key), item)), ("n", np.full(len(key), len(w))), ("piece", np.full(len(key), size))):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for k, v in out.items()})

        self.keys = graph.saved(self.items.mapInArrow(keys, "key long, item long, offset long, n long, piece long"))
        found = self.keys.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"), F.collect_set("piece").alias("pieces")).first()
        size = self.items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
        self.few_keys, self.small, self.longest = found["keys"] <= MOST_KEYS, size <= MOST_BYTES, int(found["longest"])
        self.walks, self.pieces = 0 in found.pieces, sorted(set(found.pieces) - {0})  # pieces have less than SHORT words
        self.sieve = self._sieve(found["keys"])

    def _sieve(self, keys: int) -> np.ndarray:
        size = PART_BITS
        while size < min(MOST_BITS, SIEVE_BITS * SAMPLED * keys):
            size *= 2
        similarity = self.similarity

        def bits(tables):
            for t, word, sizes, _, _ in _batches(tables):
                beginnings: list[np.ndarray] = []
                for w in np.split(word, np.cumsum(sizes)[:-1]):
                    for _ in item_keys(w, similarity, beginnings):
                        pass
                at = np.unique(bits_of(np.concatenate(beginnings), size)) if beginnings else np.empty(0, np.int64)
                yield pa.RecordBatch.from_pydict({"part": at // PART_BITS, "bit": at % PART_BITS})

        def join(table: pa.Table) -> pa.Table:
            own = np.zeros(PART_BITS, np.uint8)
            own[table["bit"].to_numpy()] = 1
            return pa.table({"part": [table["part"][0].as_py()], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

        out = np.zeros(size // 8, np.uint8)
        # a row for each part: MOST_BITS at most in all
        for r in self.items.mapInArrow(bits, "part long, bit long").distinct().groupBy("part").applyInArrow(join, "part long, bits binary").collect():
            out[r.part * PART_BITS // 8 : (r.part + 1) * PART_BITS // 8] = np.frombuffer(r.bits, np.uint8)
        return out

    def regions(self, docs: DataFrame) -> DataFrame:
        """(region, doc, doc_id, text_hash, first, words, keys, places): stretches of documents around windows that passed."""
        reach = self.longest + int(edits_of(self.longest, self.similarity))
        sieve, walks, pieces = self.sieve, range(WALKS * self.walks), self.pieces

        def batch(tables):
            readers = [Reader(STEPS, w) for w in walks] + [Reader(size) for size in pieces]
            for t, word, sizes, ids, names in _batches(tables):
                at, key = hits(readers, sieve, word, sizes, ids, np.array([xxh64_intdigest(w) for w in names] or [0], C.U64))
                order = np.lexsort((key, at))
                at, key = at[order], key[order]
                doc = np.repeat(np.arange(len(sizes)), sizes)[at]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 2 * reach) | (np.diff(doc) > 0)))) if len(at) else np.empty(0, np.int64)
                begin, rows, top = np.cumsum(sizes) - sizes, [], len(at)
                for lo, hi in zip(new.tolist(), [*new[1:].tolist(), top], strict=False):
                    d = int(doc[lo])
                    a, b = max(int(begin[d]), int(at[lo]) - reach), min(int(begin[d] + sizes[d]), int(at[hi - 1]) + reach)
                    rows.append((d, a - int(begin[d]), b" ".join([names[i] for i in ids[a:b].tolist()]), key[lo:hi].view(np.int64), at[lo:hi] - a))
                own = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_pydict({
                    **{c: t.column(c).take(own) for c in ("doc", "doc_id", "text_hash")}, "first": pa.array([r[1] for r in rows], pa.int64()), "words": pa.array([r[2] for r in rows], pa.binary()),
                    "keys": pa.array([r[3] for r in rows], pa.list_(pa.int64())), "places": pa.array([r[4] for r in rows], pa.list_(pa.int64())),
                })

        rows = docs.withColumn("doc", F.monotonically_increasing_id()).withColumn("text_hash", F.xxhash64("text"))
        found = rows.mapInArrow(batch, "doc long, doc_id long, text_hash long, first long, words binary, keys array<long>, places array<long>")
        # saved: regions keep their numbers whatever is lost
        return graph.saved(found.withColumn("region", F.monotonically_increasing_id()))

    def matches(self, docs: DataFrame) -> DataFrame:
        """(doc, doc_id, text_hash, item_id, n, first_word, n_words, distance): the best stretch of each document and item within reach."""
        regions, similarity = self.regions(docs), self.similarity
        keys = regions.select("region", F.explode(F.arrays_zip("keys", "places")).alias("e")).select("region", F.col("e.keys").alias("key"), F.col("e.places").alias("place"))
        known = self.keys.select("key", "item", "offset", "n")
        start = F.col("place") - F.col("offset")
        pairs = keys.join(F.broadcast(known) if self.few_keys else known, "key").groupBy("region", "item").agg(F.min(start).alias("low"), F.max(start).alias("high"))
        items = self.items.select("item", "item_id", F.col("text").alias("item_text"))
        rows = pairs.join(regions.select("region", "doc", "doc_id", "text_hash", "first", "words"), "region").join(F.broadcast(items) if self.small else items, "item")

        def verify(tables):
            for t in C.slices(tables, 500):
                texts = C.encoded(pa.chunked_array([t.column("item_text")]))
                of = {x: i for i, x in enumerate(dict.fromkeys(texts))}
                _, item_sizes, item_ids, names = hashes(list(of))
                number = {w: i for i, w in enumerate(names)}
                ends = np.cumsum(item_sizes)
                items, parts, base, rows = [], [], [], []
                for row, (x, words, low, high) in enumerate(zip(texts, t.column("words").to_pylist(), t.column("low").to_pylist(), t.column("high").to_pylist(), strict=True)):
                    i = of[x]
                    n = int(item_sizes[i])
                    k = int(edits_of(n, similarity))
                    # the stretch that a window lies in begins and ends at most k words beside the item's place
                    cut = words.split(b" ")[max(0, low - k) : high + n + k]
                    item, there = item_ids[ends[i] - n : ends[i]], {number[w] for w in set(cut) if w in number}
                    if sum(map(there.__contains__, item.tolist())) < n - k:
                        continue  # each word that isn't there is an edit
                    items.append(item)
                    parts.append(np.array([number.get(w, -1 - len(names)) for w in cut], np.int64))
                    base.append(max(0, low - k))
                    rows.append(row)
                best = distances(items, parts)
                keep = [j for j, (cost, _, _) in enumerate(best) if cost <= edits_of(len(items[j]), similarity)]
                own = pa.array([rows[j] for j in keep], pa.int64())
                first = np.array([base[j] + best[j][1] for j in keep], np.int64) + t.column("first").take(own).to_numpy()
                yield pa.RecordBatch.from_pydict({
                    **{c: t.column(c).take(own) for c in ("doc", "doc_id", "text_hash", "item", "item_id")}, "n": pa.array([len(items[j]) for j in keep], pa.int32()), "first_word": pa.array(first, pa.int64()),
                    "n_words": pa.array([best[j][2] - best[j][1] for j in keep], pa.int32()), "distance": pa.array([best[j][0] for j in keep], pa.int32()),
                })

        found = rows.mapInArrow(verify, "doc long, doc_id long, text_hash long, item long, item_id long, n int, first_word long, n_words int, distance int")
        best = found.groupBy("doc", "item").agg(F.min(F.struct("distance", "first_word", "n_words", "n", "doc_id", "text_hash", "item_id")).alias("b"))
        return best.select("doc", "b.*")


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """A row for each contaminated document and item: where the best stretch is and how near.

    Clean documents give no row; null or empty texts match nothing, and items without words neither. Repeated
    rows each give theirs; an item_id that has several texts counts each. Items without an id are left out.
    Of equally near stretches the first counts, and of those the shortest. Texts of any length are whole. No rows, or no items,
    give no rows. Other columns are left behind, whatever their names.
    """
    found = Index(benchmark, similarity).matches(C.documents(docs))
    return found.select("doc_id", "item_id", "first_word", "n_words", "distance", (1 - F.col("distance") / F.col("n")).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows without a match, with all their columns; the same cases as in find()."""
    found = Index(benchmark, similarity).matches(C.documents(docs)).select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__text_hash"))
    return docs.join(found, same, "left_anti")
