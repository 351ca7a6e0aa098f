"""What a Python worker holds on to, and what a shard's suffix array takes: both count against an executor's memory."""

import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from rangeloom.llm import bpe, quality, simhash, suffix
from rangeloom.llm.queries import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")
BLOCK = {"doc_id": pa.array([1, 2]), "text": ["one text " * 20, None], "block": pa.array([0, 0])}


def first_task(monkeypatch, docs, make):
    """What the first of an operator's Python functions gets to do, here instead of in a worker."""
    caught = []
    for kind, name in ((type(docs), "mapInArrow"), (PandasGroupedOpsMixin, "applyInArrow")):
        monkeypatch.setattr(kind, name, lambda self, f, *a, real=getattr(kind, name), **b: caught.append((f, real)) or real(self, f, *a, **b))
    make()
    f, real = caught[0]
    return (lambda: list(f(iter(())))) if real.__name__ == "mapInArrow" else (lambda: f(pa.table(BLOCK)))


@pytest.mark.parametrize("stage", ["quality", "near", "suffix"])
def test_a_task_lets_go_of_another_operators_coder(docs, monkeypatch, stage):
    make = {"quality": lambda: quality.keep_good(docs, None), "near": lambda: simhash.sketches(docs, 5, 4), "suffix": lambda: suffix.trim(docs)}[stage]
    task, coder = first_task(monkeypatch, docs, make), weakref.ref(bpe.coder(WORDS))
    task()
    assert coder() is None


def test_the_coder_stays_for_its_own_tasks(docs, monkeypatch):
    task, coder = first_task(monkeypatch, docs, lambda: bpe.encode(docs, WORDS)), bpe.coder(WORDS)
    task()
    assert bpe.coder(WORDS) is coder


def test_suffix_array_takes_a_few_times_its_table():
    r = random.Random(3)
    texts = [bytes(r.choices(b"abc ", k=76)) for _ in range(2_000)]
    tracemalloc.start()
    text, _, _ = suffix.suffix_array(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) == 2_000 * 27 and peak < 5 * len(text) * suffix.WIDTH
    assert np.bincount(text).tolist() == [27] * 2_000
