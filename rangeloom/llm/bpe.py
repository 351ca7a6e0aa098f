"""BPE encoding and decoding with a tokenization automaton compiled from the merges.

The automaton reads tokens and accepts exactly the token sequences that BPE produces. It starts as one
state with a loop for each base symbol; then each merge (u, v) -> uv in turn applies a gadget: wherever
u leads to a state with an arc v, u now leads to a copy of that state without v, and uv is added beside
u, leading to where v leads. All arcs of one token lead to one state throughout, so a copy is recorded
as (state before, arc cut, time), and "may t follow s" is answered from the records:

* a state knows the tokens older than itself except those cut from it or from what it was copied from;
* a younger token uv has an arc wherever u had one.

Copies share what they have in common with what they were copied from, as the full table would have an arc
for nearly each pair of tokens.

Prefixes of an accepted sequence are accepted, and a string has one accepted sequence. So a word is read once
from left to right, without a step back: a second table of states and transitions over symbols tells after each
symbol which tokens end there, and of those the one that the state before it has an arc for is the last token of
the sequence so far. Decoding puts out the arcs' labels.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space of the tokenizer's patterns; Python's \s has four control characters more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed values of the public tokenizer: its pattern for words.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Bytes of pieces of text that are kept encoded.
CACHE = 16_000_000
MOST_ARCS = 400_000
#: Texts that are encoded at once: with ids and decoded texts they take a multiple of their size.
SLICE_ROWS = 250


@dataclass
class Automaton:
    """Tokens are numbers; `born` is the merge that made one (-1: a base symbol)."""

    vocab: dict[str, int]
    cut: dict[tuple[int, int], int]  # arc v cut from the target of u, and when
    left: list[int]
    right: list[int]
    born: list[int]
    step: list[dict[str, int]]  # state over symbols -> symbol -> state; 0 is the first
    fail: list[int]  # the state of the longest proper suffix
    ends: list[tuple[tuple[int, int], ...]]  # (token, symbols) of the tokens that end in a state, the longest first
    arcs: dict[int, bool] = field(default_factory=dict)

    @classmethod
    def compile(cls, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> Automaton:
        size = max(vocab.values()) + 1
        self = cls(vocab, {}, [-1] * size, [-1] * size, [-1] * size, [{}], [0], [()])
        for time, (a, b) in enumerate(merges):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        for token, i in vocab.items():
            body, suffix = (token[: -len(end)], end) if end and token.endswith(end) and token != end else (token, "")
            if len(body) == 1 or self._made(i):
                at = 0
                for symbol in [*body[:-1], body[-1] + suffix]:
                    known = self.step[at].setdefault(symbol, len(self.step))
                    if known == len(self.step):
                        self.step.append({})
                        self.fail.append(0)
                        self.ends.append(())
                    at = known
                self.ends[at] = ((i, len(body)),)
        row = list(self.step[0].values())
        while row:  # the states of one symbol, of two, ...
            below = []
            for at in row:
                for symbol, to in self.step[at].items():
                    self.fail[to] = self._next(self.fail[at], symbol)
                    below.append(to)
            for at in below:
                self.ends[at] += self.ends[self.fail[at]]
            row = below
        return self

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        """u leads to a copy of its state without the arc v; uv stands beside u and leads to where v leads."""
        self.cut[u, v] = time
        if self.born[uv] < 0:
            self.left[uv], self.right[uv], self.born[uv] = u, v, time

    def _next(self, at: int, symbol: str) -> int:
        """The state after a symbol: that of the longest suffix that some token begins with."""
        while at and symbol not in self.step[at]:
            at = self.fail[at]
        return self.step[at].get(symbol, 0)

    def follows(self, s: int, t: int) -> bool:
        """Whether the state after token s has an arc for token t."""
        key = s << 32 | t
        known = self.arcs.get(key)
        if known is None:
            known = self._follows(s, t)
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def _follows(self, s: int, t: int) -> bool:
        newer = 1 << 60  # when the copy of the state that s inherits from was taken
        while s >= 0:
            a, younger = t, 1 << 60  # t as it stood before `younger`: its left parts
            while a >= 0:
                time = self.cut.get((s, a))
                if time is not None and time < newer and time <= younger:
                    return False
                younger, a = self.born[a], self.left[a]
            newer, s = self.born[s], self.right[s]
        return True

    def encode(self, word: str, suffix: str = "") -> list[int]:
        """The accepted sequence of a word; `suffix` belongs to the last symbol."""
        n, arcs, step, ends = len(word), self.arcs, self.step, self.ends
        last, sizes, at = [-1] * (n + 1), [0] * (n + 1), 0
        for i, symbol in enumerate(word, 1):
            if i == n:
                symbol += suffix
            to = step[at].get(symbol)
            at = self._next(at, symbol) if to is None else to
            for token, size in ends[at]:
                before = last[i - size]
                if before < 0:
                    ok = i == size
                else:
                    ok = arcs.get(before << 32 | token)
                    if ok is None:
                        ok = self.follows(before, token)
                if ok:
                    last[i], sizes[i] = token, size
                    break
            else:
                raise ValueError(f"no token sequence for {word!r}")
        out = []
        while n:
            out.append(last[n])
            n -= sizes[n]
        return out[::-1]

    def _made(self, token: int) -> bool:
        """Whether BPE makes this token from its own symbols: its two parts may not have merged otherwise."""
        key = -1 - token
        known = self.arcs.get(key)
        if known is None:
            time, u, v = self.born[token], self.left[token], self.right[token]
            known = time >= 0 and self._made_part(u) and self._made_part(v) and self._meet(u, v, time)
            self.arcs[key] = known
        return known

    def _made_part(self, token: int) -> bool:
        return self.born[token] < 0 or self._made(token)

    def _meet(self, s: int, t: int, now: int) -> bool:
        """Whether u and v stand side by side until merge `now`: follows(), with later cuts ignored."""
        newer = now
        while s >= 0:
            a, younger = t, now - 1
            while a >= 0:
                time = self.cut.get((s, a))
                if time is not None and time < newer and time <= younger:
                    return False
                younger, a = min(younger, self.born[a]), self.left[a]
            newer, s = min(newer, self.born[s]), self.right[s]
        return True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or for the others 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class WordCoder:
    """Encodes and decodes whole texts; words between white space are kept once encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.automaton = Automaton.compile(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], self.suffix)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.labels = [""] * (max(*model["vocab"].values(), *self.special.values()) + 1)
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            self.labels[i] = token
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.word = regex.compile(WORD)
        self.symbol = dict(enumerate(byte_symbols()))
        self.kept = C.Kept(self._chunk, CACHE)
        self.words = C.Kept(self._word, CACHE)

    def _word(self, w: str) -> bytes:
        return _ids(self.automaton.encode(w.encode().decode("latin-1").translate(self.symbol), self.suffix))

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        out: list[bytes] = []
        for part in self.split.split(text) if "<" in text else (text,):
            if part in self.special:
                out.append(_ids([self.special[part]]))
                continue
            part = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if part.isalpha():
                out.append(self.words[part])
            elif part[:-1].isalpha() and part[-1] in ".,!?;:|":  # letters and one other sign: two words
                out += (self.words[part[:-1]], self.words[part[-1]])
            else:
                out += [self.words[w] for w in self.word.findall(part)]
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.kept.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        return " ".join([self.labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


def coder(path: str) -> WordCoder:
    """One a worker, while it encodes; the file is part of the installed tokenizers, on every machine."""
    return C.held("bpe", path, WordCoder)


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text as the tokenizers library does, without special tokens added.

    A null or empty text has no tokens and decodes to nothing. Each row gives a row, no rows none. Texts and words
    of any length are whole; other columns are left behind, whatever their names. `with_ids` adds the ids and the
    decoded text.
    """

    def batch(tables):
        c = coder(path)
        for t in C.slices(tables, SLICE_ROWS):
            ids = [c.encode(x) for x in C.encoded(pa.chunked_array([t.column("text")]))]
            texts = [c.decode(x) for x in ids]
            out = {"doc_id": t.column("doc_id"), "n_tokens": np.array([len(x) // 4 for x in ids], np.int64), "ids_sha256": [sha256(x).hexdigest() for x in ids], "decoded_sha256": [sha256(x.encode()).hexdigest() for x in texts]}
            if with_ids:
                out |= {"ids": pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), "decoded": texts}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) if k in ("ids_sha256", "decoded_sha256", "decoded") else v for k, v in out.items()})

    return C.documents(docs).mapInArrow(C.tidy(batch, "bpe"), SCHEMA + ", ids array<int>, decoded string" * with_ids)
