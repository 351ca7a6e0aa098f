"""SimHash near-dedup with covering locality-sensitive hashing.

For radius r, each of the 64 bits gets a non-zero label of r + 1 bits. Table v (a non-zero value of
r + 1 bits) keeps the bits whose label has an odd number of bits in common with v. At most r bits of a
pair differ; their labels span at most r dimensions, so some v is orthogonal to them all and its table
sees no difference: every pair within the radius collides in some table (Pagh, 2016).

Tables hold distinct fingerprints, not documents. The two of a bucket of two are compared in SQL; larger
buckets are searched breadth-first and give one link for each fingerprint that is reached, never all
pairs. In a bucket of more than MOST_IN_BUCKET, each fingerprint is dealt to all values within r / 2 of it,
and those that meet at a value are linked to the least of them: any two of them differ in r bits or
fewer, and any two that do meet somewhere. No link between components is lost either way.

The pipeline's stage wants all near copies by the Jaccard similarity of their shingles, of which prints
within a few bits find a part. It takes masked prints and bands of least hashes (MinHash) as keys of
candidates, and sets of shingles decide.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from xxhash import xxh64_intdigest

from . import common as C
from . import graph

BITS = 64
#: Fingerprints of a bucket that one task searches, and rows that are searched together.
MOST_IN_BUCKET, GROUP_ROWS = 50_000, 200_000
#: Bands of least shingle hashes, and hashes a band: at similarity 0.8 one pair in 17,000 shares none.
BANDS, BAND_ROWS = 32, 6
ODD = C.mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=C.U64)) | C.U64(1)
#: Shingle hashes of a candidate group that one task holds.
MOST_HASHES = 2_000_000
#: A print that more than one in so many rows have is joined by broadcast: fewer prints than this can be that frequent.
HOT_SHARE = 1000
NO_ID = (1 << 63) - 1


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the text's word shingles, repeats included; of all its words, if there are no more."""
    w = text.lower().split()
    if not w:
        return np.empty(0, C.U64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxh64_intdigest(joined, 42)], C.U64)
    cut = np.cumsum([0, *map(len, w)]) + np.arange(len(w) + 1)
    shingles = [joined[a:b] for a, b in zip(cut[:-words].tolist(), (cut[words:] - 1).tolist(), strict=True)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), C.U64, len(shingles))


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(C.U64)[0])


def fingerprint(text: bytes, words: int) -> int:
    """A bit is set if it is in over half of the hashes of the text's word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, print): print is the fingerprint as a signed long."""

    def batch(tables):
        for t in C.slices(tables):
            found = np.array([fingerprint(x, words) for x in C.encoded(pa.chunked_array([t.column("text")]))], dtype=C.U64)
            yield pa.record_batch({"doc_id": t.column("doc_id"), "print": pa.array(found.view(np.int64))})

    return C.documents(docs).mapInArrow(batch, "doc_id long, print long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks(radius: int) -> list[int]:
    """One mask for each table; labels go round the bits in turn."""
    top = (1 << (radius + 1)) - 1
    label = [1 + i % top for i in range(BITS)]
    return [_signed(sum(1 << i for i in range(BITS) if (label[i] & v).bit_count() & 1)) for v in range(1, top + 1)]


def ball(radius: int) -> list[int]:
    """All values with at most `radius` bits."""
    return [_signed(sum(1 << i for i in c)) for n in range(radius + 1) for c in combinations(range(BITS), n)]


def spanning(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all prints (signed, distinct) whose chains of steps within the radius meet."""
    left, out = prints.astype(np.int64).view(C.U64), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found, left = left[near], left[~near]
                out += [(int(x), int(at)) for x in found.view(np.int64)]
                frontier += list(found)
    return [(a, _signed(b)) for a, b in out]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between `nodes` (node: a struct with a distinct print), enough to join all within the radius (an even number)."""
    if radius % 2:
        raise ValueError("radius has to be even")
    tables = [F.struct(F.lit(i).alias("t"), F.col("node.print").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(radius))]
    dealt = nodes.select("node", F.explode(F.array(*tables)).alias("e")).select("node", "e.t", "e.k")
    size = graph.saved(dealt.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("b"), F.max("node").alias("a")).where("n > 1"))
    two = size.where((F.col("n") == 2) & (F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))) <= radius)).select("a", "b")
    more = size.where("n > 2").select("t", "k", "n")
    rows = more.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not rows:
        return two
    more = graph.saved(dealt.join(more, ["t", "k"]).select("t", "k", "n", "node", "node.print"))
    groups = max(1, rows // GROUP_ROWS)
    kind = nodes.schema["node"].dataType
    edge = StructType([StructField("a", kind), StructField("b", kind)])

    def search(table: pa.Table) -> pa.Table:
        t, k, p = (table[c].to_numpy() for c in ("t", "k", "print"))
        order = np.lexsort((p, k, t))
        t, k, p = t[order], k[order], p[order]
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        at = dict(zip(p.tolist(), order.tolist(), strict=True))
        found = sorted({e for part in np.split(p, cuts) for e in spanning(part, radius)})
        node = table["node"].combine_chunks()
        return pa.table({name: node.take(pa.array([at[e[i]] for e in found], pa.int64())) for i, name in enumerate("ab")})

    few = more.where(F.col("n") <= MOST_IN_BUCKET).select("t", "k", "node", "print", F.pmod(F.xxhash64("t", "k"), F.lit(groups)).alias("g"))
    out = two.unionAll(few.groupBy("g").applyInArrow(search, edge))
    many = more.where(F.col("n") > MOST_IN_BUCKET).select("node").distinct()
    if many.isEmpty():
        return out
    met = many.select("node", F.explode(F.transform(F.lit(ball(radius // 2)), lambda m: m.bitwiseXOR(F.col("node.print")))).alias("z"))
    low = graph.saved(met.groupBy("z").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return out.unionAll(met.join(low, "z").where("node <> b").select(F.col("node").alias("a"), "b"))


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents are linked at `radius` or fewer differing bits.

    component_id is the least doc_id that links reach. A null or empty text has fingerprint zero, linked
    like any other. Each row gives a row; a null doc_id is never a component's id unless it has no other.
    Texts of any length are whole; no rows give no rows; other columns are left behind, whatever their names.

    A print's node has the least doc_id before the print, so the least node of a component, which is its root,
    tells component_id: nothing is joined by root. Prints that more than one in HOT_SHARE rows have are joined by
    broadcast, there being fewer than HOT_SHARE of them.
    """
    prints = graph.saved(fingerprints(docs, words))
    node = F.struct(F.coalesce("least", F.lit(NO_ID)).alias("least"), "print")
    distinct = graph.saved(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).select(node.alias("node"), "n"))
    roots = graph.components(links(distinct.select("node"), radius))
    named = distinct.join(roots, "node", "left").select("node.print", "n", F.coalesce("root", "node")["least"].alias("component_id"))
    rows = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT_SHARE > rows
    few, many = named.where(~hot).select("print", "component_id"), named.where(hot).select("print", "component_id")
    cold = prints.join(F.broadcast(many.select("print")), "print", "left_anti")
    out = cold.join(few, "print").unionByName(prints.join(F.broadcast(many), "print"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"))


def _keys(hashes: np.ndarray, distinct: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key for each table of the masked print and each band of least hashes: what near copies have in common."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(C.U64).max, C.U64)
    for lo in range(0, len(distinct), 256):
        least = np.minimum(least, (distinct[lo : lo + 256, None] * ODD).min(0))
    band = np.zeros(BANDS, C.U64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        band = C.mixed(band ^ column)
    keys = np.concatenate((C.mixed(at & C.U64(majority(hashes))), band))
    return C.mixed(keys + ODD[: len(keys)]).view(np.int64)


def _node(distinct: np.ndarray) -> int:
    """A set of shingles as one signed value."""
    return _signed(xxh64_intdigest(distinct.tobytes(), 7))


def sketches(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """(doc_id, row, node, n, keys): the text's hash, its set of shingles, how many they are, and their keys."""
    at = np.array(masks(radius), np.int64).view(C.U64)

    def batch(tables):
        for t in C.slices(tables):
            rows = []
            for x in C.encoded(pa.chunked_array([t.column("text")])):
                hashes = shingle_hashes(x, words)
                distinct = np.unique(hashes)
                rows.append((_node(distinct), len(distinct), _keys(hashes, distinct, at) if len(distinct) else []))
            yield pa.record_batch({"doc_id": t.column("doc_id"), "row": t.column("row"), "node": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

    return C.documents(docs).withColumn("row", F.xxhash64("text")).mapInArrow(C.tidy(batch), "doc_id long, row long, node long, n long, keys array<long>")


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between places of `sets` (distinct hashes each) that join all with a Jaccard similarity of 0.8 or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    new = np.diff(values[order], prepend=~values[order[:1]]) != 0
    run, owners = np.empty(len(values), np.int64), owner[order]
    run[order] = np.cumsum(new) - 1
    edges, first = np.append(np.flatnonzero(new), len(values)), np.append(0, np.cumsum(sizes))
    left, out = np.ones(len(sets), bool), []
    for start in range(len(sets)):
        if not left[start]:
            continue
        frontier, left[start] = [start], False
        while frontier and left.any():
            at = frontier.pop()
            own = run[first[at] : first[at + 1]]
            lo, count = edges[own], edges[own + 1] - edges[own]
            places = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(owners[places], minlength=len(sets))
            near = np.flatnonzero(left & (5 * common >= 4 * (sizes[at] + sizes - common)))
            left[near] = False
            out += [(int(x), at) for x in near]
            frontier += near.tolist()
    return out


def confirmed(docs: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """Edges (a, b) between nodes of one group of groups(doc_id, node, n, root) that are near copies indeed.

    A group's texts meet in one task. One of more than MOST_HASHES shingles is cut into parts, and each two
    parts meet, so no pair is left out and no task holds more than two parts.
    """
    # saved, so that the join by root has plain shuffles on both sides and a hot root can be split
    parts = graph.saved(groups.groupBy("root").agg(F.ceil(F.sum("n") / MOST_HASHES).cast("int").alias("parts"), F.sum("n").alias("all")))
    total = parts.where("parts = 1").agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    own, other = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    meets = F.transform(other, lambda o: F.struct(F.col("root").alias("g"), F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    single = F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(1 + int(total) // MOST_HASHES)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    where = groups.join(parts, "root").select("doc_id", "node", "root", F.explode(F.when(F.col("parts") == 1, single).otherwise(meets)).alias("e")).select("doc_id", "node", "root", "e.*")

    def search(table: pa.Table) -> pa.Table:
        texts, found, of = table["text"], [], {}
        for i, (root, node) in enumerate(zip(table["root"].to_pylist(), table["node"].to_pylist(), strict=True)):
            of.setdefault(root, []).append((node, i))
        for members in of.values():
            sets = {}
            for node, i in members:
                distinct = np.unique(shingle_hashes((texts[i].as_py() or "").encode(), words))
                if _node(distinct) == node:
                    sets[node] = distinct
            nodes = list(sets)
            if len(nodes) > 1:
                found += [(nodes[a], nodes[b]) for a, b in alike(list(sets.values()))]
        return pa.table({"a": pa.array([e[0] for e in found], pa.int64()), "b": pa.array([e[1] for e in found], pa.int64())})

    return C.documents(docs).join(where, "doc_id").groupBy("g", "i", "j").applyInArrow(C.tidy(search), "a long, b long")


def keep_first(docs: DataFrame, words: int = 5, radius: int = 4) -> DataFrame:
    """The row with the least doc_id (then the least hash of its text) of each group, with all its columns.

    Documents are linked if the Jaccard similarity of their sets of word shingles is 0.8 or more. Those that
    share a masked print or a band of least hashes are candidates; each link is confirmed by the sets. Texts
    without words are near copies of each other. Unlike texts under one doc_id both stay; of equal rows one
    does, of equal texts under one doc_id the least row. Rows without a doc_id can't stand for a group: they
    stay as they are. Texts of any length are whole; no rows give no rows.
    """
    named = docs.where(docs["doc_id"].isNotNull())
    distinct = graph.saved(sketches(named, words, radius).groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    dealt = distinct.select("node", F.explode("keys").alias("k"))
    low = graph.saved(dealt.groupBy("k").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "b"))
    # the links of a hub aren't split: with that the executors of the tool run out of memory (README)
    candidates = graph.components(dealt.join(low, "k").where("node <> b").select(F.col("node").alias("a"), "b"), split_hubs=False)
    groups = graph.saved(distinct.drop("keys").join(candidates, "node").select("least.doc_id", "node", "n", "root"))
    roots = graph.components(confirmed(named, groups, words), split_hubs=False)
    joined = distinct.select("least", "node").join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = joined.groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    rows = docs.select("*", docs["doc_id"].cast("long").alias("__id"), F.xxhash64(docs["text"].cast("string")).alias("__row"))
    out = rows.join(kept.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")), ["__id", "__row"], "left_semi")
    again = graph.saved(rows.where("__id IS NOT NULL").groupBy("__id", "__row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if not again.isEmpty():  # rows with one id and text: one of them
        of = [F.col(c) for c in docs.columns]
        once = out.join(again, ["__id", "__row"], "left_semi").groupBy("__id", "__row").agg(F.min(F.struct(*of)).alias("all")).select("all.*")
        out = out.join(again, ["__id", "__row"], "left_anti").select(*of).unionAll(once)
    return out.select(*docs.columns).unionAll(docs.where(docs["doc_id"].isNull()))
