"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted for a batch of texts at once; trees are grown on the driver from a bounded
sample of labelled documents, level by level from gradient histograms, and flattened into arrays that
numpy walks for all documents of a batch together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: The most labelled rows that trees are grown from: those whose doc_id has the least hash.
MAX_LABELLED = 20_000
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"!", b"*", b"$", b"#", b"%", b"&", b"|", b".", b",", b"<>{}[]()/\\=_+;:@^~`?\"'-"]
_KIND = np.zeros(256, np.int64)
for _i, _c in enumerate(_KINDS, 1):
    _KIND[list(_c)] = _i
_N = len(_KINDS) + 1


def _statistics(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 10
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(words)
    plain = [w for w in distinct if w.isalpha() and w.isascii()]
    return [float(n), len(text) / n, len(distinct) / n, len(lines), len(set(lines)) / len(lines), max(map(len, lines)) / len(text), max(map(len, distinct)), sum(map(bytes.isupper, distinct)) / len(distinct), len(plain) / len(distinct), len(set(zip(words, words[1:]))) / n]


def features(texts: list[bytes]) -> np.ndarray:
    """A row of statistics for each text: shares of byte kinds, then words, lines and repeats."""
    out = np.zeros((len(texts), _N + 11))
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        size = np.array([len(t) for t in part])
        flat = np.frombuffer(b"".join(part), np.uint8)
        counts = np.bincount(np.repeat(np.arange(len(part)) * _N, size) + _KIND[flat], minlength=len(part) * _N).reshape(-1, _N)
        out[lo : lo + len(part), :_N] = counts / np.maximum(size, 1)[:, None]
        out[lo : lo + len(part), _N] = size
    out[:, _N + 1 :] = np.array([_statistics(t) for t in texts]).reshape(len(texts), 10)
    return out


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth as arrays: inner nodes by level, then leaves."""

    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Boosts the logistic loss; the same rows in any order give the same trees."""
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order].astype(float)
    p = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
    base, inner = float(np.log(p / (1 - p))), 2**depth - 1
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    total, out = np.full(len(y), base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-total))
        g, h = q - y, q * (1 - q)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = (node - first) * bins
            best = np.full(n, 1e-6)
            for f, b in enumerate(binned):
                sums = [np.bincount(at + b, weights=w, minlength=n * bins).reshape(n, bins).cumsum(1) for w in (g, h)]
                left_g, left_h = (s[:, :-1] for s in sums)
                all_g, all_h = (s[:, -1:] for s in sums)
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < 1) | (all_h - left_h < 1)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                for i in np.flatnonzero((top > best) & (k < len(edges[f]))):
                    best[i], feature[first + i], threshold[first + i] = top[i], f, edges[f][k[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        sums = [np.bincount(node - inner, weights=w, minlength=inner + 1) for w in (g, h)]
        leaf = -rate * sums[0] / (sums[1] + ridge)
        total += leaf[node - inner]
        out.append((feature, threshold, leaf))
    return Trees(*(np.stack(z) for z in zip(*out, strict=True)), base)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, max_labelled: int = MAX_LABELLED) -> Trees:
    """Trees from the labelled rows whose crc32(doc_id) mod `modulus` is not `held`; a null label or id is none.

    Every label of a doc_id counts. Without labels of both kinds all texts have one score.
    """
    docs = C.documents(docs)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~C.remainder_is("doc_id", modulus, held))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)

    def batch(tables):
        for t in C.slices(tables):
            x = features(C.encoded(pa.chunked_array([t.column("text")])))
            yield pa.record_batch({"x": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64())), "y": t.column("quality")})

    # the sample has max_labelled rows of two numbers at most, so it is broadcast
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "quality").mapInArrow(batch, "x array<double>, y int").toArrow()
    n = _N + 11
    return grow(np.asarray(rows["x"].combine_chunks().flatten()).reshape(-1, n), rows["y"].to_numpy())


def classify(docs: DataFrame, trees: Trees, modulus: int = 3, held: int = 1) -> DataFrame:
    """Scores every text; a null or empty one has the statistics of an empty text.

    Each row gives a row, no rows none. Texts of any length are whole; other columns are left behind, whatever their names.
    """
    rows = C.documents(docs).withColumn("held_out", C.remainder_is("doc_id", modulus, held))

    def batch(tables):
        for t in C.slices(tables):
            score = trees.score(features(C.encoded(pa.chunked_array([t.column("text")]))))
            yield pa.record_batch({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return rows.mapInArrow(batch, SCHEMA)


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows that the trees predict to be good, with all their columns, repeated rows and rows without a doc_id too.

    A null text counts as an empty one; no rows give no rows.
    """
    C.ship(docs.sparkSession)

    def batch(tables):
        for t in C.slices(tables):
            yield t.filter(pa.array(trees.score(features(C.encoded(pa.chunked_array([t.column(text_col)])))) >= 0.5))

    return docs.mapInArrow(C.tidy(batch), docs.schema)
