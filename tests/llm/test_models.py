"""Language model, quality classifier, language identification."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from rangeloom.llm import langid, lm, quality
from rangeloom.llm.queries import tokenizer_path


def remainder(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


def probabilities(order, strength, training):
    """(N, V, p of a token after a history): the closed form, by counting."""
    grams, histories = Counter(), Counter()
    for w in training:
        for i in range(len(w)):
            for n in range(1, order + 1):
                if n <= i + 2:
                    g = (None, *w[: i + 1])[i + 2 - n :]
                    grams[tuple(g)] += 1
                    histories[tuple(g[:-1])] += 1
    tokens, types = sum(map(len, training)), len({x for w in training for x in w})

    def p(history, w):
        if not history:
            return (grams[w,] + 1) / (tokens + types + 1)
        return (grams[*history, w] + strength * p(history[1:], w)) / (count(history) + strength)

    def count(history):  # how often training was there: a last token is a history too, that nothing follows
        return len(training) if history == (None,) else grams[history]

    return tokens, types, p


def split(t):
    return (t or "").encode().lower().split() + [lm.END]


@pytest.mark.parametrize(("order", "block_bytes", "fan"), [(1, 10_000_000, None), (2, 10_000_000, None), (2, 3_000, None), (2, 3_000, 3), (3, 20_000, 4), (4, 10_000_000, None)])
def test_lm_against_counts(docs, rows, order, block_bytes, fan):
    """As the closed form says, in one block and in several, through one level of exchange and through more."""
    tokens, types, p = probabilities(order, 500.0, [split(t) for i, t, *_ in rows if remainder(i, 7) != 2])
    got = lm.score(docs, order=order, block_bytes=block_bytes, fan=fan).collect()
    want = []
    for i, t, *_ in rows:
        w = split(t)
        score = sum(log10(p((None, *w[:k])[max(0, k + 2 - order) :] if order > 1 else (), x)) for k, x in enumerate(w))
        base = [p((), x) for x in w]
        want.append((i, remainder(i, 7) == 2, len(w), sum(x * (tokens + types + 1) > 1.5 for x in base), tokens, round(sum(map(log10, base)), 6), round(score, 6)))
    assert sorted([(*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6)) for r in got], key=str) == sorted(want, key=str)


def automaton(training, text, order, strength=7.0):
    """The part of it that all words of `text` can reach."""
    grams = lm.Ngrams.of([t.encode() for t in [*training, text]], order)
    learned = np.repeat([True] * len(training) + [False], grams.sizes)
    words = [split(t) for t in training]
    return lm.Automaton(grams, grams.counts(learned), sum(map(len, words)), len({x for w in words for x in w}), len(training), strength), grams


def test_lm_states_sum_to_one():
    """Over all words, the end and an unseen word, from every state: by arcs and failure arcs."""
    training = ["a b a c", "b a a", "c", "a b"]
    machine, grams = automaton(training, "a b c zz", 3)
    tokens = {w: int(machine.grams.at[0][np.flatnonzero(np.concatenate([split(t) for t in [*training, "a b c zz"]]) == w)[0]]) for w in (b"a", b"b", b"c", lm.END, b"zz")}
    # nothing follows the end
    states = sorted(set(machine.target[machine.key % machine.words != tokens[lm.END]].tolist()) | {lm.ROOT, lm.START})
    assert len(states) > 6
    for s in states:
        _, weight = machine.step(np.full(5, s), np.array(list(tokens.values())))
        assert (10**weight).sum() == pytest.approx(1)
    # an unseen word leads to the root by failure arcs alone
    after, _ = machine.step(np.array([s for s in states]), np.full(len(states), tokens[b"zz"]))
    assert set(after.tolist()) == {lm.ROOT}


def test_lm_lanes(monkeypatch):
    """A long text read in lanes has the score that it has when it is read in one."""
    r = np.random.default_rng(2)
    training = [" ".join(f"w{x}" for x in r.integers(0, 30, 400)) for _ in range(4)]
    for order in (1, 2, 3):
        whole = automaton(training, "x", order)[0].score()
        monkeypatch.setattr(lm, "LANE", 7)
        assert automaton(training, "x", order)[0].score() == pytest.approx(whole)
        monkeypatch.undo()


def test_lm_order_three_beats_two_on_copies(docs):
    two, three = (lm.score(docs, order=o).where("doc_id = 105").first().score for o in (2, 3))
    assert three > two


@pytest.mark.parametrize(("blocks", "fan"), [(10, 10), (100, 10), (90, 10), (1000, 10)])
def test_packets_grow_with_blocks(spark, blocks, fan):
    """A block writes `fan` packets at most, none of them empty, and each level has about as many blocks as the last."""
    from rangeloom.llm import common as C

    r = np.random.default_rng(blocks)
    ranges = C.levels(blocks, fan)
    assert np.prod(ranges) >= blocks and max(ranges) <= fan
    keys = [np.sort(r.integers(0, 1 << 63, 30, dtype=np.uint64) * C.U64(2)) for _ in range(blocks)]
    first = [p for b, k in enumerate(keys) for p in C.dealt(b, [k, np.ones(30, np.uint8), np.ones(30, np.uint8)], ranges[0])]
    assert len(first) <= fan * blocks and all(len(C.unpacked(p[2])[0]) for p in first)
    if blocks <= 100:
        answers, last = C.exchange(spark.createDataFrame(first, C.PACKET_SCHEMA), blocks, ranges, lm.merge, lambda m: [m[0]], fan=fan)
        assert last.count() <= fan * blocks * 1.5
        rows = answers.toArrow()
        for b in (0, blocks - 1):  # the answers have the order of the keys that were asked
            own = rows.filter(pa.compute.equal(rows["block"], b))
            assert (C.columns_of(own)[0] == keys[b]).all() and own.num_rows <= fan


def test_lm_empty(empty):
    assert lm.score(empty).collect() == []


def test_trees_learn_and_walk():
    r = np.random.default_rng(1)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    trees = quality.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    again = quality.grow(x[:2000][::-1], y[:2000][::-1])
    assert np.array_equal(again.score(x), trees.score(x))
    one = trees.score(x[:50])
    assert all(np.isclose(trees.score(x[i : i + 1])[0], one[i]) for i in range(50))  # the same alone as in a batch


def exhaustive(x, y, trees, depth, rate, ridge):
    """Boosted trees by trying every split of every feature at each node; predictions of the rows themselves."""
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    total = np.full(len(y), np.log(p / (1 - p)))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-total))
        g, h, add = q - y, q * (1 - q), np.zeros(len(y))
        rows = [np.arange(len(y))]
        for _ in range(depth):
            below = []
            for own in rows:
                value = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)  # noqa: E731, B023
                best, halves = 1e-6, (own, own[:0])
                for f in range(x.shape[1]):
                    for t in np.unique(x[own, f])[:-1]:
                        left, right = own[x[own, f] <= t], own[x[own, f] > t]
                        gain = value(left) + value(right) - value(own)
                        if h[left].sum() >= 1 and h[right].sum() >= 1 and gain > best + 1e-12:
                            best, halves = gain, (left, right)
                below += halves
            rows = below
        for own in rows:
            if len(own):
                add[own] = -rate * g[own].sum() / (h[own].sum() + ridge)
        total += add
    return 1 / (1 + np.exp(-total))


@pytest.mark.parametrize("seed", range(6))
def test_trees_by_exhaustive_splits(seed):
    """With no more distinct values than bins, histograms lose nothing: the trees are those that all splits give."""
    r = np.random.default_rng(seed)
    x = np.round(r.random((60, 3)) * [9, 5, 40])
    y = (x[:, 0] + 3 * x[:, 1] + r.normal(0, 3, 60) > 14).astype(int)
    got = quality.grow(x, y, trees=5, depth=3, rate=0.3).score(x)
    assert np.allclose(got, exhaustive(x, y, 5, 3, 0.3, 1.0))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_quality_with_little_to_learn(spark, docs, rows, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.train(docs, known)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_quality(spark, docs, rows, empty):
    junk = docs.withColumn("text", docs["text"]).where("doc_id < 30").selectExpr("doc_id + 1000 AS doc_id", "upper(replace(text, ' ', '!! ')) AS text", "lang", "source", "n_chars", "block", "shard", "payload")
    everything = docs.where("doc_id < 30").unionByName(junk)
    labels = everything.selectExpr("doc_id", "CAST(doc_id < 1000 AS int) AS quality", "0 AS toxic").unionAll(spark.createDataFrame([(None, 1, 0), (3, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    trees = quality.train(everything, labels)
    held = [r for r in quality.classify(everything, trees).collect() if r.held_out]
    assert held and all(r.predicted == (r.doc_id < 1000) for r in held)
    kept = quality.keep_good(everything, trees)
    assert kept.columns == everything.columns and {r.doc_id < 1000 for r in kept.collect()} == {True}
    assert quality.classify(empty, trees).collect() == []


def segmentations(v, p, word):
    """(sum over every way to cut a word, expected uses of each piece), place by place in plain Python."""
    n = len(word)
    pieces = [(a, b, v.piece.get(word[a:b], v.other if b == a + 1 else None)) for a in range(n) for b in range(a + 1, min(n, a + v.longest) + 1)]
    pieces = [e for e in pieces if e[2] is not None]
    ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for a, b, k in sorted(pieces, key=lambda e: e[1]):
        ahead[b] += ahead[a] * p[k]
    for a, b, k in sorted(pieces, key=lambda e: -e[0]):
        behind[a] += behind[b] * p[k]
    use = Counter()
    for a, b, k in pieces:
        use[k] += ahead[a] * p[k] * behind[b] / ahead[n]
    return ahead[n], use


def ways(v, p, s):
    """The sum by enumeration."""
    if not s:
        return 1.0
    return sum(p[v.piece[s[:k]] if s[:k] in v.piece else v.other] * ways(v, p, s[k:]) for k in range(1, len(s) + 1) if s[:k] in v.piece or k == 1)


def test_segmentations_are_summed():
    v = langid.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    r = np.random.default_rng(2)
    p = r.random(v.other + 1)
    short = ["▁the", "▁x", "ab", "▁hello", "☃a", "▁naïve", "中文"]
    assert np.exp(v.lattice(short).log_total(p)) == pytest.approx([ways(v, p, s) for s in short])
    p = p / p.sum()
    # runs of more than 32 letters, and of letters so rare that the plain sum would vanish
    names = [*short, "▁" + "donaudampfschifffahrtsgesellschaft" * 3, "▁" + "the" * 40, "☃" * 33]
    want = [segmentations(v, p, s) for s in names]
    lattice = v.lattice(names)
    assert lattice.log_total(p) == pytest.approx([np.log(x) for x, _ in want])
    use, all_ = lattice.expected(p, np.ones(len(names))), sum((u for _, u in want), Counter())
    assert np.allclose(use, [all_[i] for i in range(len(p))])
    far = "▁" + "zq☃xé" * 2000
    logs = v.lattice([far, "▁a"]).log_total(p)
    half = v.lattice([far[: len(far) // 2]]).log_total(p)[0]
    assert logs[0] < 1.9 * half < -700 and np.isfinite(logs).all() and logs[1] == pytest.approx(v.lattice(["▁a"]).log_total(p)[0])


def test_more_words_than_twenty_bits():
    v = langid.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    p = np.full(v.other + 1, 0.01)
    names = ["ab"] * 1_048_581 + ["abc"]
    got = v.lattice(names).log_total(p)
    assert np.ptp(got[:-1]) == 0 and got[0] == pytest.approx(np.log(ways(v, p, "ab"))) and got[-1] == pytest.approx(np.log(ways(v, p, "abc")))


def test_language_by_brute_force(spark, monkeypatch):
    """Learned probabilities, predictions and scores as plain sums give them, whole texts of held-out and learned rows."""
    path = tokenizer_path("piece_bpe_32k.model")
    v = langid.vocabulary(path)
    monkeypatch.setattr(langid, "PART", 40)
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat, the hat", "en"), ("le chat noir", "fr"), ("a b-c 12", "en"), ("ÉTÉ étés", "fr"), ("zzz", "de"), ("der hut der katze", "de"), ("the " * 9, "en"), ("chat chat hat", None), ("antidisestablishmentarianismus" * 2, "en"), ("x", "fr")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, path)
    counts = {}
    for i, t, lang in rows:
        if lang and remainder(i, 4) != 2:
            counts.setdefault(lang, Counter()).update(langid.words(t))
    uses = []
    for lang in sorted(counts):
        use = Counter()
        for w, n in counts[lang].items():
            for a in range(len(w)):
                for b in range(a + 1, min(len(w), a + v.longest) + 1):
                    if w[a:b] in v.piece or b == a + 1:
                        use[v.piece.get(w[a:b], v.other)] += n
        for _ in range(langid.ROUNDS):
            p = (np.array([use[k] for k in range(v.other + 1)], float) + 1e-3) / (sum(use.values()) + 1e-3 * (v.other + 1))
            use = Counter()
            for w, n in counts[lang].items():
                for k, x in segmentations(v, p, w)[1].items():
                    use[k] += n * x
        uses.append(np.array([use[k] for k in range(v.other + 1)], float))
    base = (sum(uses) + langid.PRIOR) / (sum(u.sum() for u in uses) + langid.PRIOR * (v.other + 1))
    weight = langid.PRIOR * (v.other + 1) / 10
    ps = [(u + weight * base) / (u.sum() + weight) for u in uses]
    for r in langid.predict(docs, model).collect():
        logs = np.array([sum(np.log(segmentations(v, p, w)[0]) for w in langid.words(rows[r.doc_id][1])) for p in ps])
        odds = np.exp(logs - logs.max())
        assert r.lang_pred == sorted(counts)[int(odds.argmax())] and r.score == pytest.approx(odds.max() / odds.sum()) and r.held_out == (remainder(r.doc_id, 4) == 2)


def test_language(spark, rows, docs, empty):
    en, fr = "the cat sat on the mat and then it went home with them".split(), "le chat est sur la table et puis il rentre chez lui avec eux".split()
    r = np.random.default_rng(3)
    made = [(i, " ".join(r.choice(en if i % 2 else fr, 30)), "en" if i % 2 else "fr") for i in range(80)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 ½ !!", "fr"), (1003, "Zug", None), (None, "the cat", "en"), (7, made[7][1], "en")]
    table = spark.createDataFrame(made + odd, "doc_id long, text string, lang string")
    model = langid.train(table, tokenizer_path("piece_bpe_32k.model"))
    got = langid.predict(table, model).collect()
    assert len(got) == len(made + odd) and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x for x in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred in ("en", "fr")
    assert all(by[i].lang_pred == lang for i, _, lang in made if by[i].held_out)
    nothing = langid.train(empty, tokenizer_path("piece_bpe_32k.model"))
    assert {x.lang_pred for x in langid.predict(table, nothing).collect()} == {"und"} and langid.predict(empty, model).collect() == []
    # extra columns with clashing names, a very long run of letters, a lone surrogate-free odd letter
    odd = spark.createDataFrame([(1, "the cat sat " * 3000, "en", 1.0, True, "x"), (2, "ab" * 60_000, None, 2.0, None, "y"), (3, "𝔘𝔫", None, None, None, None)], "doc_id long, text string, lang string, score double, held_out boolean, lang_pred string")
    got = {x.doc_id: x for x in langid.predict(odd, model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred in ("en", "fr") and got[3].lang_pred in ("en", "fr") and len(got) == 3
