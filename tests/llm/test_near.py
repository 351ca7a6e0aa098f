"""SimHash groups, fingerprints, decontamination."""

from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline as pipeline
from rangeloom.llm import decontam, graph, minhash, simhash


def fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("share", [1000, 3])
def test_groups(docs, rows, empty, monkeypatch, share):
    """With all prints joined by broadcast that more than one in a thousand, or in three, have."""
    monkeypatch.setattr(simhash, "HOT_SHARE", share)
    prints = [fingerprint(t) for _, t, *_ in rows]
    roots = components(prints, 2)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    got = sorted([tuple(r) for r in simhash.near_groups(docs).collect()], key=str)
    assert got == sorted([(rows[i][0], f"{prints[i]:016x}", least[roots[i]]) for i in range(len(rows))], key=str)
    assert simhash.near_groups(empty).collect() == []


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair(radius):
    masks = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
    pairs = combinations(range(64), radius)
    assert all(any(not (m & (1 << p[0] | sum(1 << i for i in p[1:]))) for m in masks) for p in pairs)
    assert len(masks) == 2 ** (radius + 1) - 1


@pytest.mark.parametrize(("radius", "most"), [(2, 50_000), (4, 50_000), (2, 20)])
def test_links_of_a_hot_bucket(spark, monkeypatch, radius, most):
    """Searched in one task, or dealt to the values around: the same components as by brute force."""
    monkeypatch.setattr(simhash, "MOST_IN_BUCKET", most)
    r = np.random.default_rng(4)
    base = int(r.integers(0, 1 << 62))
    prints = sorted({base} | {base ^ sum(1 << int(b) for b in r.choice(24, r.integers(0, 5), replace=False)) for _ in range(400)})
    table = spark.createDataFrame([((i * 7 % 401, simhash._signed(p)),) for i, p in enumerate(prints)], "node struct<least: long, print: long>")
    roots = {r.node.print: r.root.print for r in graph.components(simhash.links(table, radius)).collect()}
    got = [roots.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    want = components(prints, radius)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("share", [1000, 5])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "HUB_SHARE", share)
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[100] == 100 and 300 not in got and {got[500 + i] for i in range(60)} == {500}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_first(docs):
    kept = simhash.keep_first(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    # two unlike texts have id 5, one of them three times
    assert 0 in ids and not any(100 <= i < 112 for i in ids if i is not None) and ids.count(5) == 2 and ids.count(None) == 2
    assert simhash.keep_first(docs.where("false")).collect() == []


def sets(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(r, words, share):
    """Near copies of one text at all distances."""
    w = list(words)
    for _ in range(int(share * len(w))):
        k = int(r.integers(0, len(w)))
        w[k : k + 1] = [[f"x{r.integers(10**6)}"], [], [w[k], f"x{r.integers(10**6)}"]][int(r.integers(0, 3))]
    return " ".join(w)


@pytest.mark.parametrize("most", [2_000_000, 400])
def test_keep_first_of_all_near_copies(spark, monkeypatch, most):
    """As by brute-force Jaccard of five-word shingles, in groups that one task holds and in ones cut into parts."""
    monkeypatch.setattr(simhash, "MOST_HASHES", most)
    r = np.random.default_rng(8)
    texts = []
    for i in range(40):
        base = [f"w{r.integers(3000)}" for _ in range(int(r.integers(3, 300)))]
        texts += [" ".join(base)] + [edited(r, base, float(r.random()) * 0.05) for _ in range(int(r.integers(1, 9)))]
    texts += ["", " ", texts[0].upper(), "one", "one"]
    order = r.permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    of, root = [sets(t) for _, t in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if jaccard(of[a], of[b]) >= 0.8 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    near = sum(0.8 <= jaccard(of[a], of[b]) < 0.85 for a, b in combinations(range(len(rows)), 2))
    assert near > 20
    kept = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(root))


def test_keep_first_of_a_repeated_id(spark):
    """A near copy under an id doesn't take a clean text of that id with it, however the rows come."""
    r = np.random.default_rng(9)
    text = lambda: " ".join(f"w{x}" for x in r.integers(0, 3000, 60))
    first, clean, other = text(), text(), text()
    rows = [(3, first, "a"), (5, first, "b"), (5, clean, "d"), (5, clean, "c"), (5, other, "e"), (6, other, "f")]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_first(spark.createDataFrame(order, "doc_id long, text string, lang string").coalesce(1)).collect()
        assert sorted(map(tuple, kept)) == sorted([(3, first, "a"), (5, clean, "c"), (5, other, "e")])


def test_fingerprints(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BYTES", 20_000)
    got = sorted([tuple(r) for r in minhash.fingerprints(docs).collect()], key=str)
    order = sorted([(-1 if i is None else i, t or "") for i, t, *_ in rows], key=lambda r: (-r[0], r[1]))
    want, exact = [], []
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))} if t.split() else set()
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        want.append((None if i < 0 else i, len(t), sha256(e.encode()).hexdigest()))
        exact.append((like(shingles(t), shingles(e)), like(shingles(t), shingles(nxt))))
    assert [r[:3] for r in got] == sorted(want, key=str)
    by = {(str(w[0]), w[2]): x for w, x in zip(want, exact)}
    errors = [(r[5] - by[str(r[0]), r[2]][0], r[6] - by[str(r[0]), r[2]][1]) for r in got]
    assert np.abs(errors).mean() < 0.05 and np.abs(errors).max() < 0.35
    prints = {}
    for r in minhash.fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> 5").collect():
        assert prints.setdefault(r.text, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 256
    assert minhash.fingerprints(empty).collect() == []
    alone = minhash.fingerprints(docs.where("doc_id = 404")).first()
    assert alone.near_next == 1.0


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_distance():
    r = np.random.default_rng(5)
    items, parts = [r.integers(0, 4, r.integers(1, 8)) for _ in range(60)], [r.integers(0, 4, r.integers(0, 10)) for _ in range(60)]
    for item, part, (cost, a, b) in zip(items, parts, decontam.distances(items, parts)):
        every = [(plain(item.tolist(), part[x:y].tolist()), x, y) for x in range(len(part) + 1) for y in range(x, len(part) + 1)]
        assert (cost, a, b) == min(every)
        assert decontam.distance(item, part) == (cost, a, b)


def normal(text):
    return [x for w in (text or "").lower().split() if (x := w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))]


def brute(docs, items, similarity=0.8):
    """(place of the document, place of the item, first word, words, edits), by every stretch of every document: a row
    of the table of distances to stretches that end at each word, and all that begin where the least does."""
    out = []
    for d, text in enumerate(docs):
        words = normal(text)
        for i, item in enumerate(items):
            item = normal(item)
            k = int((1 - similarity) * len(item) + 1e-9)
            row = [(0, j) for j in range(len(words) + 1)]  # (edits, where the stretch begins)
            for n, x in enumerate(item, 1):
                old, row = row, [(n, 0)]
                for j, y in enumerate(words, 1):
                    row.append(min((old[j][0] + 1, old[j][1]), (row[-1][0] + 1, row[-1][1]), (old[j - 1][0] + (x != y), old[j - 1][1])))
            if item and (best := min((*x, j) for j, x in enumerate(row)))[0] <= k:
                out.append((d, i, best[1], best[2] - best[1], best[0]))
    return out


def letters(r):
    return "".join(r.choice(list("abcdefgh"), r.integers(2, 8)))


def changed(r, words, k):
    w = list(words)
    for _ in range(k):
        i = int(r.integers(0, len(w)))
        w[i : i + 1] = [[letters(r)], [], [w[i], letters(r)]][int(r.integers(0, 3))]
    return w


def contaminated(r):
    """Items of one word and more, and documents with stretches at all distances, most of them near the limit."""
    items = [" ".join(letters(r) for _ in range(n)) for n in (1, 2, 4, 5, 9, 12, 19, 20, 27, 40, 60, 130)]
    docs = []
    for i in range(150):
        w = items[int(r.integers(0, len(items)))].split()
        around = [letters(r) for _ in range(25)]
        stretch = changed(r, w, int(r.integers(0, len(w) // 5 + 2)))
        docs.append(" ".join(around[: int(r.integers(0, 25))] + [x.upper() if i % 2 else x + "," for x in stretch] + around[: int(r.integers(0, 25))]))
    return items, docs + [" ".join(letters(r) for _ in range(200)) for _ in range(40)] + ["", " , ", " ".join([*docs[:8], *docs[3:40]])]


@pytest.mark.parametrize("few", [200_000, 0])
def test_decontamination(spark, monkeypatch, few):
    """Against every stretch of every document: nothing but what is there, and nearly all of it; short items without loss."""
    monkeypatch.setattr(decontam, "MOST_KEYS", few)
    monkeypatch.setattr(decontam, "MOST_BYTES", few)
    items, docs = contaminated(np.random.default_rng(6))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "a b c d e f"), (0, items[0]), (90, None), (91, ""), (92, " .. ")], "item_id long, text string")
    rows = [(i, t) for i, t in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "doc_id AS item_id", "'x' AS key", "1 AS region", "text AS words")
    got = {tuple(x)[:5]: x.similarity for x in decontam.find(table, bench).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want) and all(s == 1 - d / len(items[i].split()) for (_, i, _, _, d), s in got.items())
    short = {i for i, t in enumerate(items) if len(t.split()) < decontam.SHORT}
    assert {w for w in want if w[1] in short} <= set(got)
    long_ = [w for w in want if w[1] not in short]
    assert len(long_) > 60 and len(set(long_) & set(got)) >= 0.9 * len(long_)
    kept = decontam.keep_clean(table, bench)
    assert kept.columns == table.columns and {x.doc_id for x in kept.collect()} == set(range(len(docs))) - {w[0] for w in got}


def test_recall_of_the_walks():
    """With as many edits as there may be, at random places; evenly spread ones are the hardest."""
    r, readers = np.random.default_rng(12), [decontam.Reader(decontam.STEPS, w) for w in range(decontam.WALKS)]

    def met(a, b):
        keys = [[x.read(w, np.arange(len(w)), np.full(len(w), len(w)))[1] for x in readers] for w in (a, b)]
        return any(np.isin(x, y).any() for x, y in zip(*keys))

    for n in (20, 38, 58, 200):
        random = even = unlike = 0
        for _ in range(100):
            item = r.integers(1, 1 << 62, n).astype(np.uint64)
            edited_ = np.array(changed_ids(r, item, n // 5), np.uint64)
            spread = item.copy()
            spread[np.linspace(0, n - 1, n // 5 + 2)[1:-1].astype(int)] = r.integers(1, 1 << 62, n // 5)
            random, even = random + met(item, edited_), even + met(item, spread)
            unlike += met(item, r.integers(1, 1 << 62, n).astype(np.uint64))
        assert random >= 97 and even >= 90 and unlike == 0


def changed_ids(r, words, k):
    w = words.tolist()
    for _ in range(k):
        i = int(r.integers(0, len(w)))
        w[i : i + 1] = [[int(r.integers(1, 1 << 62))], [], [w[i], int(r.integers(1, 1 << 62))]][int(r.integers(0, 3))]
    return w


def test_decontamination_of_odd_rows(spark, docs, rows, empty):
    """Nulls, repeats, one id with several texts, a very long text, no rows, no items."""
    item = " ".join(rows[8][1].split()[:25])
    bench = spark.createDataFrame([(1, item), (1, "one"), (2, rows[40][1])], "item_id long, text string")
    found = sorted([(x.doc_id, x.item_id, x.distance) for x in decontam.find(docs, bench).collect()], key=str)
    want = [(rows[d][0], (1, 1, 2)[i], cost) for d, i, _, _, cost in brute([t for _, t, *_ in rows], [item, "one", rows[40][1]])]
    assert found == sorted(want, key=str) and len(found) > 5
    hit = {(rows[d][0], rows[d][1]) for d, *_ in brute([t for _, t, *_ in rows], [item, "one", rows[40][1]])}
    kept = sorted([(x.doc_id, x.text) for x in decontam.keep_clean(docs, bench).collect()], key=str)
    assert kept == sorted([r[:2] for r in rows if tuple(r[:2]) not in hit], key=str)
    long_ = spark.createDataFrame([(1, f"{'x ' * 200_000}{item}{' y' * 200_000}"), (2, "z" * 1_000_000)], "doc_id long, text string")
    assert [(x.doc_id, x.first_word, x.distance) for x in decontam.find(long_, bench).collect()] == [(1, 200_000, 0)]
    nothing = bench.where("false")
    assert decontam.find(empty, bench).collect() == [] and decontam.find(docs, nothing).collect() == [] and decontam.keep_clean(empty, bench).collect() == [] and decontam.keep_clean(docs, nothing).count() == len(rows)
