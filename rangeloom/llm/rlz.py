"""Substring dedup by relative Lempel-Ziv parsing over words.

The contexts that reach a shard (see anchors.py) are its reference block, in order of doc_id. An
index holds, for each string of WINDOW words of the block, its earliest place; strings are held equal by
their words, not by their hashes. A context is parsed greedily against the block: from each place on, the
words that follow the string's earliest place are one factor as long as they are the earliest of theirs.
Parsing goes on WINDOW - 1 words before a factor's end, so a string that straddles two factors is found
too. A context that several documents have is parsed for all but the first of them, so its factors cover
it; else only strings of earlier documents count. Every document meets every reference block that can
hold a match, since its anchors choose the shards. Nothing is removed but by a factor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import anchors as A
from . import common as C

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class ReferenceBlock:
    """Texts as one array of word ids with an index of their WINDOW-word strings."""

    def __init__(self, texts: list[bytes], least_id: np.ndarray):
        self.word, sizes, _ = C.word_ids(texts)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        count = np.maximum(sizes - A.WINDOW + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), count)
        self.first = np.cumsum(count) - count
        self.at = C.stretches(self.start[:-1], count)
        #: for each string, where the earliest document has it, and which that is
        self.source = self.at.copy()
        running, inverse = A.prefix_hash(self.word.astype(C.U64) + C.U64(1))
        seed = self.hashed(running, inverse)
        left = np.arange(len(self.at))
        while len(left):  # once, and again for unequal strings with equal hashes
            left = left[np.lexsort((self.at[left], least_id[self.text[left]], seed[left]))]
            new = np.concatenate(([True], seed[left[1:]] != seed[left[:-1]]))
            lead = left[np.flatnonzero(new)[np.cumsum(new) - 1]]
            equal = lead == left
            others = np.flatnonzero(~equal)
            for lo in range(0, len(others), 20_000):
                part = others[lo : lo + 20_000]
                equal[part] = (self._words(left[part]) == self._words(lead[part])).all(1)
            self.source[left[equal]] = self.at[lead[equal]]
            left = left[~equal]
        self.owner = least_id[np.searchsorted(self.start, self.source, side="right") - 1]

    def hashed(self, running: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return C.mixed((running[self.at + A.WINDOW] - running[self.at]) * inverse[self.at])

    def _words(self, strings: np.ndarray) -> np.ndarray:
        return self.word[self.at[strings][:, None] + np.arange(A.WINDOW)]

    def factors(self, parse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, from, to, doc_id of the source) of all texts' factors, greedily from left to right over the strings that `parse` marks."""
        goes_on = np.zeros(len(parse), bool)
        goes_on[1:] = parse[1:] & parse[:-1] & (self.text[1:] == self.text[:-1]) & (self.source[1:] == self.source[:-1] + 1)
        begin = np.flatnonzero(parse & ~goes_on)
        ends = parse.copy()  # a factor's last string
        ends[:-1] &= ~goes_on[1:]
        last = np.flatnonzero(ends)
        text = self.text[begin]
        return text, begin - self.first[text], last - self.first[text] + A.WINDOW, self.owner[begin]


def spans(key: np.ndarray, least_id: np.ndarray, several: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    block = ReferenceBlock(texts, least_id)
    return block.factors((block.owner < least_id[block.text]) | (several[block.text] > 0))


def dedup(docs: DataFrame, block_bytes: int = C.BLOCK_BYTES, fan: int | None = None) -> DataFrame:
    """Removes each word covered by WINDOW words whose sequence also starts in a document with a smaller doc_id.

    Null texts have no words. Rows that share a doc_id don't remove each other's words; a null doc_id
    counts as the smallest. No rows give no rows. A text of any length is whole: one beyond `block_bytes` is a
    block by itself. Other columns are left behind, whatever their names.
    """

    def finish(s: A.Symbols, removed: np.ndarray) -> dict:
        gone, _ = A.runs(removed, s.start)
        kept = []
        for i, (a, b) in enumerate(zip(s.start[:-1], s.start[1:], strict=True)):
            text = s.raw[s.at[a] : s.at[b]][:-1]
            kept.append(b" ".join([w for w, r in zip(text.split(b" "), removed[a:b].tolist(), strict=True) if not r]) if gone[i] else text)
        return {"n_words": np.diff(s.start), "n_removed": gone, "kept_sha256": A.hexes(kept)}

    return A.remove_repeats(docs, A.as_words, spans, finish, SCHEMA, block_bytes, fan=fan)
