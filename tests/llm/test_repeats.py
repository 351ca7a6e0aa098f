"""Suffix-array and Lempel-Ziv dedup against brute force."""

from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeloom.llm import anchors, rlz, suffix


def brute(rows, cut, join):
    """Counter-like list of (id, size, removed, runs, hash): windows against smaller ids, null the smallest."""
    order = lambda i: -(2**63) if i is None else i
    first = {}
    seqs = [(i, cut((t or "").encode())) for i, t in rows]
    for i, s in seqs:
        for j in range(len(s) - 49):
            w = bytes(s[j : j + 50]) if isinstance(s, bytes) else tuple(s[j : j + 50])
            first[w] = min(first.get(w, 1 << 63), order(i))
    out = []
    for i, s in seqs:
        gone = [False] * len(s)
        for j in range(len(s) - 49):
            w = bytes(s[j : j + 50]) if isinstance(s, bytes) else tuple(s[j : j + 50])
            if first[w] < order(i):
                gone[j : j + 50] = [True] * 50
        kept = join([x for x, g in zip(s, gone) if not g])
        out.append((i, len(s), sum(gone), sum(a and not b for a, b in zip(gone, [False] + gone)), sha256(kept).hexdigest()))
    return sorted(out, key=str)


EXCHANGES = pytest.mark.parametrize(("block_bytes", "fan", "hot"), [(3_000, None, 4_000), (3_000, 3, 4_000), (20_000, None, 1), (10_000_000, None, 4_000), (10_000_000, None, 8)])


@EXCHANGES
def test_suffix(docs, rows, monkeypatch, block_bytes, fan, hot):
    """One block or several, one level of exchange or more, hot anchors' windows one by one."""
    monkeypatch.setattr(anchors, "HOT", hot)
    got = sorted([tuple(r) for r in suffix.dedup(docs, block_bytes, fan).collect()], key=str)
    assert got == brute([r[:2] for r in rows], bytes, bytes)


@EXCHANGES
def test_rlz(docs, rows, monkeypatch, block_bytes, fan, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    got = sorted([tuple(r) for r in rlz.dedup(docs, block_bytes, fan).collect()], key=str)
    want = brute([r[:2] for r in rows], bytes.split, b" ".join)
    assert got == sorted([(i, n, g, h) for i, n, g, _, h in want], key=str)


def removed(operator, rows):
    """(doc_id, symbols removed) with all documents in one block and one shard, without workers."""
    read = anchors.as_bytes if operator is suffix else anchors.as_words
    s = read([(t or "").encode() for _, t in rows], np.array([anchors.NULL_ID if i is None else i for i, _ in rows]))
    own, n = np.unique(anchors.all_anchors(s)[0], return_counts=True)
    c = anchors.contexts(s, (n > 1).astype(np.uint8))
    merged, (at,) = anchors.merge_contexts([anchors.entries(s, c)])
    gone, _ = anchors.runs(anchors.covered(s, c, anchors.found(operator.spans, merged).take(at)), s.start)
    return sorted(zip([i for i, _ in rows], gone.tolist()), key=str)


@pytest.mark.parametrize("operator", [suffix, rlz])
@pytest.mark.parametrize("collide", [False, True])
def test_equal_hashes_of_unequal_strings(rows, monkeypatch, operator, collide):
    """Hashes of contents and strings that tell little apart: bytes and words decide."""
    if collide:
        monkeypatch.setattr(anchors, "contents", lambda s, a, b: ((b - a) % 2).astype(np.uint64))
        monkeypatch.setattr(rlz.ReferenceBlock, "hashed", lambda self, running, inverse: (self.word[self.at] % 3).astype(np.uint64))
    few = [r[:2] for r in rows if r[0] != 408]
    want = brute(few, *((bytes, bytes) if operator is suffix else (bytes.split, b" ".join)))
    assert removed(operator, few) == sorted([(r[0], r[2]) for r in want], key=str)


@pytest.mark.parametrize("operator", [suffix, rlz])
def test_nothing_goes_but_by_intervals_and_factors(rows, monkeypatch, operator):
    assert sum(n for _, n in removed(operator, [r[:2] for r in rows])) > 500
    none = np.empty(0, np.int64)
    monkeypatch.setattr(suffix, "intervals", lambda *a: iter([(none, none, none, none)]))
    monkeypatch.setattr(rlz.ReferenceBlock, "factors", lambda *a: (none, none, none, none))
    assert sum(n for _, n in removed(operator, [r[:2] for r in rows])) == 0


def test_a_hot_anchor_with_unlike_contexts_is_split(spark, monkeypatch):
    """Many documents share 24 bytes, each between other words: no shard gets them all."""
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 8))
    # of many strings, the one with the least hash: it anchors nearly all windows that have it
    least = lambda t: int(anchors.grams(np.frombuffer(t.encode(), np.uint8).astype(np.uint64) + np.uint64(1), anchors.GRAM)[0])
    line = min((f"the same line {i:010d}" for i in range(3000)), key=least)
    rows = [(i, f"{' '.join(word() for _ in range(6))} {line} {' '.join(word() for _ in range(6))}") for i in range(300)]
    s = anchors.as_bytes([t.encode() for _, t in rows], np.arange(300))
    key, doc, a, b = anchors.all_anchors(s)
    own, at, n = np.unique(key, return_inverse=True, return_counts=True)
    flags = (n > 1).astype(np.uint8)
    assert n.max() > 100  # one anchor of nearly all of them
    whole = anchors.contexts(s, flags)
    split = anchors.contexts(s, flags * (1 + 2 * (n >= 100)).astype(np.uint8))
    largest = lambda c: np.unique(c.key, return_counts=True)[1].max()
    assert largest(whole) > 100 and largest(split) < 100 and len(split.key) <= len(whole.key) * anchors.REACH
    monkeypatch.setattr(anchors, "HOT", 100)
    got = sorted(tuple(x) for x in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows, bytes, bytes))


def test_empty(empty):
    assert suffix.dedup(empty).collect() == [] and rlz.dedup(empty).collect() == [] and suffix.trim(empty).collect() == []


def test_trim(docs):
    out = suffix.trim(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    full, kept = {r.doc_id: r for r in docs.where("doc_id >= 100").collect()}, {r.doc_id: r for r in out.where("doc_id >= 100").collect()}
    assert kept[100].text == "" and kept[405].text == full[405].text and kept[405].block == "mine"
    assert all((r.text is not None and r.n_chars == len(r.text)) for r in kept.values())


def repeats(texts):
    """All maximal repeats of WINDOW bytes or more, by comparing every pair of places."""
    n, places = anchors.WINDOW, [(i, p) for i, t in enumerate(texts) for p in range(len(t))]
    out = {}
    for i, p in places:
        for j, q in places:
            if (i, p) < (j, q):
                if p and q and texts[i][p - 1] == texts[j][q - 1]:
                    continue
                k = 0
                while p + k < len(texts[i]) and q + k < len(texts[j]) and texts[i][p + k] == texts[j][q + k]:
                    k += 1
                if k >= n:
                    out[texts[i][p : p + k]] = None
    return {s: sorted((i, p) for i, p in places if texts[i][p : p + len(s)] == s) for s in out}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(52, 76), st.booleans()), min_size=2, max_size=5))
def test_maximal_repeats(parts):
    """As by comparing all places; texts of which there are copies stand in the array once."""
    source = bytes(b"abcab"[(k * k // 3 + k // 7) % 5] for k in range(120))
    texts = [source[a : a + n] + (b"z" if odd else b"") for a, n, odd in parts]
    texts = [t[: suffix.WIDTH] for t in texts]
    once = list(dict.fromkeys(texts))
    copies = np.array([texts.count(t) > 1 for t in once], np.uint8)
    found, text, start = suffix.maximal_repeats(once, np.array([texts.index(t) for t in once]), copies)
    together = {once[int(text[lo])][int(start[lo]) :][:size]: low for size, lo, _, low in found}
    assert together.keys() == repeats(texts).keys() and all(texts[low].find(x) >= 0 and not any(x in t for t in texts[:low]) for x, low in together.items())
    found, text, start = suffix.maximal_repeats(texts, np.arange(len(texts)))
    got = {}
    for size, lo, hi, low in found:
        at = sorted((int(text[k]), int(start[k])) for k in range(lo, hi + 1))
        assert low == min(i for i, _ in at)
        got[texts[at[0][0]][at[0][1] : at[0][1] + size]] = at
    assert got == repeats(texts)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab", max_size=90), max_size=6), st.integers(0, 3))
def test_anchors_cover_each_window_once(texts, seed):
    texts = [t.encode() * (seed + 1) for t in texts]
    s = anchors.as_bytes(texts, np.arange(len(texts)))
    key, doc, a, b = anchors.all_anchors(s)
    windows = sorted(w for x, y in zip(a.tolist(), b.tolist()) for w in range(x, y + 1))
    assert windows == [p for i, t in enumerate(texts) for p in range(int(s.start[i]), int(s.start[i]) + len(t) - anchors.WINDOW + 1)]
    # equal windows have equal anchors, at equal places
    seen = {}
    for k, x, y in zip(key.tolist(), a.tolist(), b.tolist()):
        for w in range(x, y + 1):
            assert seen.setdefault(s.raw[w : w + anchors.WINDOW], k) == k
