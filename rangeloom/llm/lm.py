"""Language-model scoring by a weighted backoff automaton.

The automaton's states are the histories seen in training, from the empty one (the root) up to order - 1
tokens, and the start of a text. A state has an arc for each continuation seen after it and one failure
arc to the state of its longest proper suffix. Weights come from Dirichlet-smoothed n-grams, which sum to
one in every state:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(hw) + k * p(w | h')) / (c(h) + k)

so an arc weighs log10 p(w | h) and a failure arc log10 k / (c(h) + k); the root takes an unseen word with
log10 1 / (N + V + 1) and stays. One traversal from left to right carries the state: it takes the arc of
the next token, or failure arcs until a state has one, and adds up the weights.

The counts of a corpus have no size bound, so they are never broadcast. They stay cut by n-gram hash
over the shards; a block of documents gets the counts of the n-grams in its own texts and compiles them
into the part of the automaton that its texts can reach. N-grams are identified by 64-bit hashes: at a
billion distinct ones, less than one in ten billion shares its hash with another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END = b""  # no word is empty
ROOT, START, FIRST = 0, 1, 2  # states; n-gram i of the block is state FIRST + i
#: Tokens that a lane of the traversal reads at most: a longer text is read in several at once.
LANE = 4096


NOTHING = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()


@dataclass(frozen=True)
class Ngrams:
    """The n-grams of a block: the texts' lengths in tokens, where each token stands in its text, and for each order
    which n-gram of `keys` ends at each token. An n-gram may begin with the start of the text, but not before."""

    sizes: np.ndarray
    place: np.ndarray
    keys: np.ndarray  # sorted
    at: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[bytes], order: int) -> Ngrams:
        ids, sizes, words = C.word_ids([t.lower() for t in texts], END)
        token = np.array([xxhash.xxh64_intdigest(w) for w in words] or [0], dtype=C.U64)[ids]
        place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own, history = [token], token
        for n in range(2, order + 1):
            before = np.concatenate((np.zeros(1, C.U64), history[:-1]))
            before[place == 0] = C.U64(n)  # the start of a text
            history = C.mixed(before * C.U64(C.MULTIPLIER) + token + C.U64(n))
            own.append(np.where(place + 2 >= n, history, own[-1]))
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        return cls(sizes, place, keys, np.split(at, order))

    def counts(self, learned: np.ndarray) -> np.ndarray:
        """How often each n-gram ends at one of the `learned` tokens."""
        out = np.zeros(len(self.keys), np.int64)
        for n, at in enumerate(self.at, 1):
            out += np.bincount(at[learned & (self.place + 2 >= n)], minlength=len(self.keys))
        return out


class Automaton:
    """States, arcs and failure arcs over the n-grams of a block."""

    def __init__(self, grams: Ngrams, counts: np.ndarray, tokens: int, types: int, starts: int, strength: float):
        self.grams, self.words = grams, len(grams.keys)
        self.unseen = float(np.log10(1.0 / (tokens + types + 1.0)))
        order, states = len(grams.at), FIRST + len(grams.keys)
        seen = np.concatenate(([tokens, starts], counts))  # how often training was in each state
        self.fail = np.full(states, ROOT)
        self.fail_weight = np.log10(strength / (seen + strength))
        p = np.zeros(states)
        source, token, target = [], [], []
        for n, at in enumerate(grams.at, 1):
            # one occurrence of each n-gram of this order tells its history, its last token and its suffix
            some = np.full(len(grams.keys), -1)
            whole = np.flatnonzero(grams.place + 2 >= n)
            some[at[whole]] = whole
            gram = np.flatnonzero((some >= 0) & (counts > 0))
            i = some[gram]
            if n == 1:
                history = np.full(len(gram), ROOT)
                p[FIRST + gram] = (counts[gram] + 1.0) / (tokens + types + 1.0)
            else:
                suffix = FIRST + grams.at[n - 2][i]
                # a text's first token follows START; later ones follow the n-gram that ends before them
                history = np.where(grams.place[i] == 0, START, FIRST + grams.at[n - 2][i - 1])
                p[FIRST + gram] = (counts[gram] + strength * p[suffix]) / (seen[history] + strength)
                self.fail[FIRST + gram] = suffix
            source.append(history)
            token.append(grams.at[0][i])
            # the longest suffix that is a state: at the highest order the n-gram without its first token
            target.append(FIRST + gram if n < order else self.fail[FIRST + gram] if order > 1 else np.full(len(gram), ROOT))
            self.weight = np.log10(p[FIRST + gram]) if n == 1 else np.concatenate((self.weight, np.log10(p[FIRST + gram])))
        key = np.concatenate(source) * self.words + np.concatenate(token)
        by = np.argsort(key)
        self.key, self.weight, self.target = key[by], self.weight[by], np.concatenate(target)[by]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after reading a token each, weights of the arcs taken)."""
        state, weight, left = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(left):
            want = state[left] * self.words + token[left]
            arc = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
            there = self.key[arc] == want if len(self.key) else np.zeros(len(left), bool)
            weight[left[there]] += self.weight[arc[there]]
            state[left[there]] = self.target[arc[there]]
            left = left[~there]
            at_root = state[left] == ROOT
            weight[left[at_root]] += self.unseen
            left = left[~at_root]
            weight[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return state, weight

    def score(self) -> np.ndarray:
        """log10 probability of each text: all texts are read side by side, a token each at a time.

        A text of more than LANE tokens is read in lanes. A state depends on the last order - 1 tokens alone,
        so a later lane reads those first, from the root, without counting their weights.
        """
        sizes, order = self.grams.sizes, len(self.grams.at)
        lanes = np.maximum(1, -(-sizes // LANE))
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = C.stretches(np.zeros(len(lanes), np.int64), lanes)
        warm = np.where(nth > 0, order - 1, 0)
        begin = (np.cumsum(sizes) - sizes)[text] + nth * LANE - warm
        length = warm + np.minimum(LANE, sizes[text] - nth * LANE)
        by = np.argsort(-length, kind="stable")
        text, warm, begin, length = text[by], warm[by], begin[by], length[by]
        first = nth[by] == 0
        state, total = np.where(first & (order > 1), START, ROOT), np.zeros(len(text))
        running = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for t, n in enumerate(running.tolist()):
            state[:n], weight = self.step(state[:n], self.grams.at[0][begin[:n] + t])
            total[:n] += np.where(warm[:n] > t, 0.0, weight)
        return np.bincount(text, weights=total, minlength=len(sizes))


def merge(asked: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries (key, training count, is a word): counts of equal keys are summed."""
    keys, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    counts, word = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint8)
    np.add.at(counts, at, np.concatenate([a[1].astype(np.int64) for a in asked]))
    word[at[np.concatenate([a[2] for a in asked]) > 0]] = 1
    return [keys, C.small(counts), word], np.split(at, np.cumsum([len(a[0]) for a in asked])[:-1])


def score(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = 2, strength: float = 500.0, block_bytes: int = C.BLOCK_BYTES, fan: int | None = None) -> DataFrame:
    """Scores every text by a model of the texts whose crc32(doc_id) mod `modulus` is not `held`.

    A null or empty text is the end token alone. Rows with a null doc_id train and get a score.
    Repeated rows each count and each get a row; no rows give no rows. A text of any length is whole: one
    beyond `block_bytes` is a block by itself. Other columns are left behind, whatever their names.
    """
    docs = C.documents(docs)
    blocks = C.block_count(docs, block_bytes)
    ranges = C.levels(blocks, fan or C.FAN)
    rows = C.in_blocks(docs, blocks).withColumn("held_out", C.remainder_is("doc_id", modulus, held))

    def ask(table: pa.Table) -> pa.Table:
        grams = Ngrams.of(C.encoded(table["text"]), order)
        counts = grams.counts(np.repeat(~table["held_out"].to_numpy(), grams.sizes))
        word = np.zeros(len(counts), np.uint8)
        word[grams.at[0]] = 1
        return C.packets(C.dealt(table["block"][0].as_py(), [grams.keys, C.small(counts), word], ranges[0]))

    def total(table: pa.Table) -> pa.Table:
        _, counts, word = merge([c for _, c in C.payloads(table, "block")])[0]
        known = counts[word > 0].astype(np.int64)
        return pa.table({"tokens": [int(known.sum())], "types": [int((known > 0).sum())]})

    def walk(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return NOTHING
        totals = answers.filter(pc.is_valid(answers["tokens"]))
        tokens, types, starts = (totals[c][0].as_py() for c in ("tokens", "types", "starts"))
        grams = Ngrams.of(C.encoded(table["text"]), order)
        counts = C.columns_of(answers.filter(pc.is_valid(answers["payload"])))[0].astype(np.int64)
        ends, own = np.cumsum(grams.sizes), counts[grams.at[0]]
        each = lambda x: np.add.reduceat(x, ends - grams.sizes)  # noqa: E731  each text has its end token at least
        return pa.table({
            "doc_id": table["doc_id"].combine_chunks(), "held_out": table["held_out"].combine_chunks(), "n_tokens": grams.sizes, "n_known": each((own > 0).astype(np.int64)), "train_tokens": np.full(len(grams.sizes), tokens),
            "base_score": each(np.log10((own + 1.0) / (tokens + types + 1.0))), "score": Automaton(grams, counts, tokens, types, starts, strength).score(),
        })

    asked = rows.groupBy("block").applyInArrow(ask, C.PACKET_SCHEMA)
    answered, last = C.exchange(asked, blocks, ranges, merge, lambda merged: [merged[1]], fan=fan)
    # totals of the corpus, a row, which every block gets
    zero = F.lit(0).cast("long")
    starts = rows.select(zero.alias("tokens"), zero.alias("types"), (~F.col("held_out")).cast("long").alias("starts"))
    words = last.groupBy("shard").applyInArrow(total, "tokens long, types long").withColumn("starts", zero)
    totals = words.unionByName(starts).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("tokens", "types", "starts")])
    every = totals.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("payload"), "tokens", "types", "starts")
    answers = every.unionByName(answered, allowMissingColumns=True)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, SCHEMA)
