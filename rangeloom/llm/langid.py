"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary. A word's probability in a language is
the sum over all ways to cut it into pieces of the product of their probabilities: a forward pass over
its characters, made for all distinct words of a batch at once, whatever their length. Sums are scaled up as
they get small, so that long runs of letters keep theirs. Pieces are learned by expectation-maximisation
from the forward and backward sums; the vocabulary itself is never trained.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: The most documents that probabilities are learned from: those whose doc_id has the least hash.
MAX_LEARNED = 3_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
ROUNDS, PRIOR = 2, 0.5
#: Characters of words that a worker keeps scores of (each word counts for eight more), and of those worked on at once.
MOST_CHARACTERS, PART = 10_000_000, 200_000
SMALL = 1e-100


def words(text: str) -> list[str]:
    """Runs of letters in lower case, each with the vocabulary's mark of a word's start."""
    return ["▁" + w for w in _WORD.findall(text.lower())]


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.piece = {p: i for i, p in enumerate(pieces)}
        self.other = len(pieces)  # any single character that is no piece
        self.longest = max(map(len, pieces))
        # for each length: hashes of all beginnings of pieces, sorted; the piece that is one, or -1; and its characters
        self.beginnings = []
        for n in range(1, self.longest + 1):
            own = sorted({p[:n] for p in pieces if len(p) >= n})
            characters = np.array([[ord(c) for c in x] for x in own], np.uint32).reshape(-1, n)
            h = np.zeros(len(own), C.U64)
            for column in characters.T:
                h = _grown(h, column)
            by = np.argsort(h)
            self.beginnings.append((h[by], np.array([self.piece.get(own[i], -1) for i in by], np.int64), characters[by]))

    def lattice(self, names: list[str]) -> Lattice:
        """All pieces at all places of the words."""
        size = np.array([len(x) for x in names], np.int64)
        text = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
        word, end = np.repeat(np.arange(len(names)), size), np.repeat(np.cumsum(size), size)
        at, h, parts = np.arange(len(text)), np.zeros(len(text), C.U64), []
        for n, (known, piece, characters) in enumerate(self.beginnings, 1):
            inside = at + n <= end[at]
            at, h = at[inside], _grown(h[inside], text[at[inside] + n - 1])
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            there = known[place] == h
            there[there] = (characters[place[there]] == text[at[there][:, None] + np.arange(n)]).all(1)
            if n == 1:
                alone = ~there | (piece[place] < 0)
                parts.append((at[alone], np.full(alone.sum(), 1), np.full(alone.sum(), self.other)))
            at, h, found = at[there], h[there], piece[place[there]]
            parts.append((at[found >= 0], np.full((found >= 0).sum(), n), found[found >= 0]))
        start, n, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.cumsum(size) - size
        a = start - first[word[start]]
        order = np.lexsort((word[start], a + n))
        return Lattice(size, word[start][order], a[order], (a + n)[order], piece[order], self.longest)


def _grown(h: np.ndarray, character: np.ndarray) -> np.ndarray:
    return C.mixed(h * C.U64(C.MULTIPLIER) + character.astype(C.U64) + C.U64(1))


@dataclass(frozen=True)
class Lattice:
    """Edges from place a to place b of a word, in order of b and of the word; every place but the first has one."""

    size: np.ndarray
    word: np.ndarray
    a: np.ndarray
    b: np.ndarray
    piece: np.ndarray
    longest: int

    @property
    def first(self) -> np.ndarray:
        """Where each word's places 0 to its size begin in an array of all words' places."""
        return np.cumsum(self.size + 1) - self.size - 1

    def mirrored(self) -> Lattice:
        a, b = self.size[self.word] - self.b, self.size[self.word] - self.a
        order = np.lexsort((self.word, b))
        return Lattice(self.size, self.word[order], a[order], b[order], self.piece[order], self.longest)

    def sums(self, p: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations of the first i characters, for all words and i."""
        first, places = self.first, int((self.size + 1).sum())
        source, target, weight = first[self.word] + self.a, first[self.word] + self.b, p[self.piece]
        value, out, scale = np.zeros(places), np.full(places, -np.inf), np.zeros(len(self.size))
        value[first], out[first] = 1, 0
        stops = np.searchsorted(self.b, np.arange(1, int(self.size.max(initial=0)) + 2))
        lead = np.flatnonzero(np.diff(target, prepend=-1) != 0)
        leads = np.searchsorted(lead, stops)
        for i, (lo, hi) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)):
            own = lead[leads[i] : leads[i + 1]]
            new, at, w = np.add.reduceat(value[source[lo:hi]] * weight[lo:hi], own - lo), target[own], self.word[own]
            value[at] = new
            out[at] = np.log(new) - scale[w]
            tiny = np.flatnonzero(new < SMALL)
            if len(tiny):  # the last places of these words are scaled up
                back = at[tiny][:, None] - np.arange(min(self.longest, i + 1) + 1)
                factor = 1 / new[tiny]
                value[back] *= factor[:, None]
                scale[w[tiny]] += np.log(factor)
        return out

    def log_total(self, p: np.ndarray) -> np.ndarray:
        return self.sums(p)[self.first + self.size]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words seen `counts` times."""
        forward, backward = self.sums(p), self.mirrored().sums(p)
        first, size = self.first[self.word], self.size[self.word]
        use = np.exp(forward[first + self.a] + np.log(p[self.piece]) + backward[first + size - self.b] - forward[first + size]) * counts[self.word]
        return np.bincount(self.piece, weights=use, minlength=len(p))


def in_parts(names: list[str]) -> list[list[int]]:
    """Places of words, of like length together, in parts of about PART characters."""
    out, room = [], 0
    for i in sorted(range(len(names)), key=lambda i: (len(names[i]), names[i])):
        if room <= 0:
            out.append([])
            room = PART
        out[-1].append(i)
        room -= len(names[i])
    return out


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class WordScores:
    """log-probabilities of words in each language, kept from batch to batch."""

    def __init__(self, model: Model):
        self.model, self.names, self.each, self.room = model, {}, np.zeros((len(model.langs), 0)), MOST_CHARACTERS

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Word numbers of each text; `each` has a column for every number."""
        if self.room < 0:
            self.names, self.each, self.room = {}, np.zeros((len(self.model.langs), 0)), MOST_CHARACTERS
        names, known = self.names, len(self.names)
        out = [np.fromiter([names.setdefault(w, len(names)) for w in words(t)] if t else [], np.int64) for t in texts]
        fresh, v = list(islice(names, known, None)), vocabulary(self.model.path)
        self.room -= sum(map(len, fresh)) + 8 * len(fresh)
        new = np.zeros((len(self.model.langs), len(fresh)))
        for part in in_parts(fresh):
            lattice = v.lattice([fresh[i] for i in part])
            for k, log_p in enumerate(self.model.log_p):
                new[k, part] = lattice.log_total(np.exp(log_p))
        self.each = np.concatenate((self.each, new), axis=1)
        return out


_scores: dict[str, WordScores] = {}


@dataclass(frozen=True)
class Model:
    path: str
    langs: list[str]
    log_p: np.ndarray  # (languages, pieces + 1)
    name: str  # of this fit: what a worker has scored for one model is no use for another

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior under equal priors; UNKNOWN, 0 without letters."""
        best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return best, score
        if self.name not in _scores:
            _scores.clear()
            _scores[self.name] = WordScores(self)
        own = _scores[self.name]
        for i, w in enumerate(own.ids(texts)):
            if len(w) and (any(c.isalpha() for c in texts[i])):
                total = own.each[:, w].sum(1)
                odds = np.exp(total - total.max())
                k = int(odds.argmax())
                best[i], score[i] = self.langs[k], odds[k] / odds.sum()
        return best, score


def fit(path: str, counts: dict[str, Counter]) -> Model:
    """Word counts of each language to a model."""
    v = vocabulary(path)
    langs = sorted(k for k, c in counts.items() if c)
    tables = []
    for lang in langs:
        c = counts[lang]
        names = sorted(c)
        n = np.array([c[x] for x in names], float)
        parts = [(v.lattice([names[i] for i in part]), n[part]) for part in in_parts(names)]
        use = sum(np.bincount(x.piece, weights=m[x.word], minlength=v.other + 1) for x, m in parts)
        for _ in range(ROUNDS):
            p = (use + 1e-3) / (use.sum() + 1e-3 * len(use))
            use = sum(x.expected(p, m) for x, m in parts)
        tables.append(use)
    if not langs:
        return Model(path, [], np.zeros((0, v.other + 1)), uuid.uuid4().hex)
    base = (sum(tables) + PRIOR) / (sum(t.sum() for t in tables) + PRIOR * (v.other + 1))  # what a language lacks, it takes from all
    weight = PRIOR * (v.other + 1) / 10
    return Model(path, langs, np.stack([np.log((t + weight * base) / (t.sum() + weight)) for t in tables]), uuid.uuid4().hex)


def train(docs: DataFrame, path: str, modulus: int = 4, held: int = 2, max_learned: int = MAX_LEARNED) -> Model:
    """A model from documents whose crc32(doc_id) mod `modulus` is not `held`; null ids, texts and langs teach nothing.

    Every row of a chosen doc_id teaches. Without such rows the model knows no language.
    """
    C.ship(docs.sparkSession)
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~C.remainder_is("doc_id", modulus, held))
    sample = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_learned)

    def batch(tables):
        for t in tables:
            count: Counter = Counter()
            for text, lang in zip(t.column("text").to_pylist(), t.column("lang").to_pylist(), strict=True):
                count.update(zip(repeat(lang), words(text)))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in count], pa.string()), "word": pa.array([k[1] for k in count], pa.string()), "n": pa.array(count.values(), pa.int64())})

    # at most max_learned ids are broadcast, and the words of as many documents come back
    rows = known.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id").select("text", "lang").mapInArrow(batch, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    return _from_counts(path, rows)


def _from_counts(path: str, rows: pa.Table) -> Model:
    counts: dict[str, Counter] = {}
    for lang, word, n in zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True):
        counts.setdefault(lang, Counter())[word] += n
    return fit(path, counts)


def predict(docs: DataFrame, model: Model, modulus: int = 4, held: int = 2) -> DataFrame:
    """The language of every text; `und` with score 0 if it is null or has no letter, or nothing was learned.

    The likeliest language counts, of equally likely ones the first by name. Repeated rows each get a row; no rows
    give no rows. Texts and runs of letters of any length are whole, at some two hundred bytes of memory a character of the
    longest run. Other columns are left behind, whatever their names.
    """
    rows = C.documents(docs).withColumn("held_out", C.remainder_is("doc_id", modulus, held))

    def batch(tables):
        for t in tables:
            for lo in range(0, t.num_rows, 4000):
                part = t.slice(lo, 4000)
                best, score = model.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(best, pa.string()), "score": score})

    return rows.mapInArrow(batch, SCHEMA)
