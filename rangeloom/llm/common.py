"""Blocks, packets and text rules shared by the operators of this package.

Corpus-wide questions ("how often does this n-gram occur", "does this anchor occur in another
document") are answered by an exchange of packed numpy columns instead of one Spark row per item:

* documents are hashed into *blocks* of bounded size;
* a block reduces what it asks to entries sorted by a 64-bit key, cut by key range into packets, FAN at
  most and none without entries;
* where there are no more than FAN ranges, a range's packets meet in one task, a *shard*, which merges
  equal entries and answers them. Where there are more, the packets that FAN blocks have for one range are
  merged into a block of its own, which asks on with its range cut into FAN, and hands the answers back.
  So a block never writes more than FAN packets, packets keep their size, and what travels grows with the
  input times the number of levels: one up to FAN blocks, two up to FAN squared;
* an answer has an entry for each entry asked, in their order.

A key of a hot group occurs at most once in a packet, so no task ever reads more than one entry a
block for it, however many documents share it. Everything is a plain shuffle: lost executors are
recomputed from lineage.
"""

from __future__ import annotations

import ctypes
import gc
import inspect
import pickle
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text in one block: what a Python worker holds at once, a tenth of its memory.
BLOCK_BYTES = 8_000_000
U64 = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15
#: The most packets that a block writes, and the most blocks whose packets are merged into one: at 8 MB a block, one level
#: of exchange up to 65 GB of text, with packets of some kB, and two up to 500 TB.
FAN = 8192
PACKET_SCHEMA = "shard long, block long, payload binary"


_shipped: set[str] = set()


def pack(to: Path) -> None:
    """The whole package as a zip file: modules of this one import others of the library."""
    root = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application: they need no installation."""
    if spark.sparkContext.applicationId in _shipped:
        return
    to = Path(tempfile.mkdtemp()) / "rangeloom.zip"
    pack(to)
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(spark.sparkContext.applicationId)


#: What operators keep in a worker from task to task.
_held: dict[tuple[str, str], object] = {}


def held(operator: str, path: str, make: Callable[[str], object]):
    """make(path), kept in this worker until a task of another operator comes (see tidy)."""
    if (operator, path) not in _held:
        _held[operator, path] = make(path)
    return _held[operator, path]


def let_go(operator: str) -> None:
    """Drops what other operators keep."""
    if others := [k for k in _held if k[0] != operator]:
        for k in others:
            del _held[k]
        gc.collect()  # such values refer to themselves


def give_back() -> None:
    """Hands memory that is free back to the system: a worker that is used again would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def tidy(f: Callable, operator: str = "") -> Callable:
    """f for mapInArrow or applyInArrow. A worker serves one operator after the other, so it keeps `operator`'s values alone, and no free memory."""
    if inspect.isgeneratorfunction(f):

        def run(tables):
            let_go(operator)
            try:
                yield from f(tables)
            finally:
                give_back()

    elif len(inspect.signature(f).parameters) == 1:

        def run(table: pa.Table) -> pa.Table:
            let_go(operator)
            try:
                return f(table)
            finally:
                give_back()

    else:

        def run(table: pa.Table, other: pa.Table) -> pa.Table:
            let_go(operator)
            try:
                return f(table, other)
            finally:
                give_back()

    return run


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, by name; extra or clashing columns are left behind."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_size(docs: DataFrame) -> tuple[int, int]:
    """(rows, UTF-8 bytes) of all texts: one JVM-side aggregate."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return int(row.n), int(row.b)


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about `block_bytes` hold these texts (256 bytes a row are added)."""
    rows, size = text_size(docs)
    return max(1, -(-(size + 256 * rows) // block_bytes))


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Adds `block`, a hash of doc_id: rows with one doc_id share a block."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))


def remainder_is(id_col: str | Column, modulus: int, value: int) -> Column:
    """crc32(doc_id as text) mod `modulus` is `value`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % modulus == value, F.lit(False))


class Ragged:
    """A column with several values an entry: how many, and columns of all of them, one entry's after the other."""

    def __init__(self, counts: np.ndarray, *flats: np.ndarray):
        self.counts, self.flats = counts, flats
        self.ends = np.cumsum(counts, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.counts)

    def part(self, a: int, b: int) -> Ragged:
        lo, hi = (int(self.ends[i - 1]) if i else 0 for i in (a, b))
        return Ragged(self.counts[a:b], *(f[lo:hi] for f in self.flats))

    def take(self, at: np.ndarray) -> Ragged:
        counts = self.counts[at].astype(np.int64)
        return Ragged(self.counts[at], *(gathered(f, self.ends[at] - counts, counts) for f in self.flats))

    def texts(self) -> list[bytes]:
        raw, ends = self.flats[0].tobytes(), self.ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


Column_ = np.ndarray | Ragged


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat at stretches(start, size), a million at a time: places take more memory than bytes."""
    ends, lo = np.cumsum(size, dtype=np.int64), 0
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    while lo < len(ends):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + 1_000_000, side="right")))
        out[base : int(ends[hi - 1])] = flat[stretches(start[lo:hi], size[lo:hi])]
        lo = hi
    return out


def part(c: Column_, a: int, b: int) -> Column_:
    return c.part(a, b) if isinstance(c, Ragged) else c[a:b]


def take(c: Column_, at: np.ndarray) -> Column_:
    return c.take(at) if isinstance(c, Ragged) else c[at]


def joined(parts: list[Column_]) -> Column_:
    if isinstance(parts[0], Ragged):
        return Ragged(np.concatenate([p.counts for p in parts]), *(np.concatenate(f) for f in zip(*(p.flats for p in parts), strict=True)))
    return np.concatenate(parts)


def packed(*columns: Column_) -> bytes:
    """Columns as compressed bytes; sorted 64-bit keys become differences, split into byte planes."""
    out = []
    for c in columns:
        ragged = isinstance(c, Ragged)
        out.append(1 + len(c.flats) if ragged else 0)
        for a in (small(c.counts), *c.flats) if ragged else (c,):
            a = np.ascontiguousarray(a)
            if a.dtype == U64 and len(a) and not ragged:
                step = np.diff(a, prepend=U64(0))
                out.append(("k", len(a), np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()))
            else:
                out.append((a.dtype.str, len(a), a.tobytes()))
    raw = pickle.dumps(out, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(payload: bytes) -> list[Column_]:
    size = int.from_bytes(payload[:8], "little")
    items = iter(pickle.loads(pa.decompress(memoryview(payload)[8:], decompressed_size=size, codec="zstd", asbytes=True)))

    def array() -> np.ndarray:
        kind, n, raw = next(items)
        if kind == "k":
            planes = np.frombuffer(raw, np.uint8).reshape(8, n)
            return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)
        return np.frombuffer(raw, np.dtype(kind))

    return [Ragged(*(array() for _ in range(n))) if n else array() for n in items]


def small(counts: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest unsigned type."""
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if top < 256 else np.uint32 if top < 2**32 else np.uint64 if top >= 2**63 else np.int64)


def levels(shards: int, fan: int) -> list[int]:
    """Into how many ranges each level cuts, `fan` at most, so that there are `shards` or more in the end."""
    n = 1
    while fan**n < shards:
        n += 1
    out = []
    for left in range(n, 0, -1):
        f = 1
        while f**left < shards:
            f += 1
        out.append(f)
        shards = -(-shards // f)
    return out


def cuts(keys: np.ndarray, shards: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """Where sorted keys are cut into ranges first, ..., first + count - 1 of `shards` equal ones: count + 1 offsets."""
    edges = [(i << 64) // shards for i in range(first + 1, first + (shards if count is None else count))]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, dtype=U64)), [len(keys)])).astype(np.int64)


def dealt(block: int, columns: list[Column_], shards: int, first: int = 0, count: int | None = None) -> list[tuple[int, int, bytes]]:
    """A block's entries as packets (shard, block, payload); the first column has the keys."""
    edge = cuts(columns[0], shards, first, count)
    return [(first + i, block, packed(*(part(c, a, b) for c in columns))) for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if a < b]


#: Packets' columns to merged columns, sorted by key, and where each packet's entries are in them.
Merge = Callable[[list[list[Column_]]], tuple[list[Column_], list[np.ndarray]]]
#: Merged columns to columns of answers, an entry each.
Answer = Callable[[list[Column_]], list[Column_]]


def exchange(asked: DataFrame, blocks: int, ranges: list[int], merge: Merge, answer: Answer, above: int = 1, fan: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(packets of answers, one for each packet asked; the packets that reach the shards). `ranges` as by levels()."""
    shards, fan = above * ranges[0], fan or FAN
    if len(ranges) == 1:

        def reply(table: pa.Table) -> pa.Table:
            own, shard = payloads(table, "block"), table["shard"][0].as_py()
            merged, at = merge([c for _, c in own])
            found = answer(merged)
            return packets([(shard, block, packed(*(take(c, i) for c in found))) for (block, _), i in zip(own, at, strict=True)])

        return asked.groupBy("shard").applyInArrow(reply, PACKET_SCHEMA), asked
    groups = -(-blocks // fan)  # a range's packets of `fan` blocks are one block of the next level
    several = asked.withColumn("of", F.col("shard") * groups + F.floor(F.col("block") / fan))

    def ask(table: pa.Table) -> pa.Table:
        merged, _ = merge([c for _, c in payloads(table, "block")])
        return packets(dealt(table["of"][0].as_py(), merged, shards * ranges[1], table["shard"][0].as_py() * ranges[1], ranges[1]))

    def hand_back(table: pa.Table, answers: pa.Table) -> pa.Table:
        own, found = payloads(table, "block"), columns_of(answers)
        _, at = merge([c for _, c in own])
        return packets([(table["shard"][0].as_py(), block, packed(*(take(c, i) for c in found))) for (block, _), i in zip(own, at, strict=True)])

    inner = several.groupBy("of").applyInArrow(ask, PACKET_SCHEMA)
    answers, last = exchange(inner, shards * groups, ranges[1:], merge, answer, shards, fan)
    return several.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(hand_back, PACKET_SCHEMA), last


def columns_of(answers: pa.Table) -> list[Column_]:
    """What a block gets back, in the order of what it asked; no columns if it asked nothing."""
    got = [c for _, c in payloads(answers, "shard")]
    return [joined(list(c)) for c in zip(*got, strict=True)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def packets(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def payloads(table: pa.Table, by: str) -> list[tuple[int, list[Column_]]]:
    """(value of `by`, columns) of each packet, in the order of `by`: the same on every attempt."""
    order = np.argsort(table[by].to_numpy(), kind="stable")
    keys, data = table[by].to_pylist(), table["payload"]
    return [(keys[i], unpacked(data[int(i)].as_py())) for i in order]


def encoded(column: pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of at most `rows`: what is made from a part bounds a worker's memory."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def word_ids(texts: list[bytes], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts as ids: (ids, words a text, distinct words).

    `end` is put after each text. bytes.split() cuts at exactly these six characters.
    """
    seen: dict[bytes, int] = {}
    known, parts, sizes = seen.setdefault, [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        if end is not None:
            words.append(end)
        sizes[i] = len(words)
        parts.append(np.fromiter((known(w, len(seen)) for w in words), np.int32, len(words)))
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), sizes, list(seen)


class Kept(dict):
    """Values of `make`, kept while they are in use: keys of at most twice `size` bytes (each counts for 100 more), in two generations."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.room, self.old = make, size, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.room -= len(key) + 100
        if self.room < 0:
            self.old, self.room = dict(self), self.size
            self.clear()
        self[key] = value
        return value
