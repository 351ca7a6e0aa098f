"""BPE automaton and token files against the tokenizers library."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rangeloom.llm import bpe, graph, tokenfile
from rangeloom.llm.queries import tokenizer_path

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


def sequences(merges, word):
    """BPE by its definition: merges in turn, each from left to right."""
    s = list(word)
    for a, b in merges:
        i = 0
        while i < len(s) - 1:
            if (s[i], s[i + 1]) == (a, b):
                s[i : i + 2] = [a + b]
            i += 1
    return s


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.text("abc", min_size=1, max_size=14))
def test_automaton_is_bpe(seed, word):
    r, symbols, merges = random.Random(seed), ["a", "b", "c"], []
    for _ in range(12):
        a, b = r.choice(symbols), r.choice(symbols)
        if a + b not in symbols:
            merges.append((a, b))
            symbols.append(a + b)
    vocab = {s: i for i, s in enumerate(symbols)}
    automaton = bpe.Automaton.compile(vocab, merges)
    want = [vocab[s] for s in sequences(merges, word)]
    assert automaton.encode(word) == want
    assert all(automaton.follows(a, b) for a, b in zip(want, want[1:]))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'cdeth sTLL  \n\t\xa0é́ñÑΣς中文😀123½٣<|>.!\x1c\x85​ "), max_size=60))
def test_encoders(word_library, byte_library, text):
    c = bpe.coder(WORDS)
    ids = c.encode(text.encode())
    e = word_library.encode(text, add_special_tokens=False)
    assert np.frombuffer(ids, "<u4").tolist() == e.ids
    assert c.decode(ids) == word_library.decode(e.ids, skip_special_tokens=False)
    b = tokenfile.coder(BYTES)
    assert np.frombuffer(b.encode([text.encode()])[0], b.dtype).tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_special_tokens(word_library, byte_library):
    text = "a<|endoftext|>B <|startoftext|><|endoftext|>"
    assert np.frombuffer(bpe.coder(WORDS).encode(text.encode()), "<u4").tolist() == word_library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenfile.coder(BYTES).encode([text.encode()])[0], "<u2").tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_encode_documents(docs, rows, empty, word_library):
    got = sorted([tuple(r) for r in bpe.encode(docs, WORDS).collect()], key=str)
    want = []
    for i, t, *_ in rows:
        e = word_library.encode(t or "", add_special_tokens=False)
        want.append((i, len(e.ids), sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), sha256(word_library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = bpe.encode(docs, WORDS, with_ids=True).where("doc_id = 404").first()
    assert len(full.ids) == full.n_tokens and full.decoded.startswith("Ã©")
    assert bpe.encode(empty, WORDS).collect() == []


def test_token_files(spark, docs, rows, empty, byte_library, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = tokenfile.write(docs, BYTES, folder, length=64, block_bytes=20_000)
    assert manifest.count() > 2
    got = [tuple(r) for r in tokenfile.read(manifest).collect()]
    want, start = [], 0
    for i, t in sorted([(-1 if r[0] is None else r[0], r[1] or "") for r in rows]):
        ids = byte_library.encode(t, add_special_tokens=False).ids + [2]
        want.append((None if i < 0 else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    path = manifest.first().path.removeprefix("file://")
    with pa.memory_map(f"{path}.arrow") as f:  # any row without reading those before it
        reader = pa.ipc.open_file(f)
        batch = reader.get_batch(0)
        assert batch.schema.field("ids").type == pa.list_(pa.uint16(), 64) and batch.schema.field("mask").type == pa.list_(pa.bool_(), 64)
        before = pa.total_allocated_bytes()
        row = batch.column(0).flatten().to_numpy(zero_copy_only=True)[64:128]
        assert len(row) == 64 and pa.total_allocated_bytes() == before
        last = reader.get_batch(reader.num_record_batches - 1).column(1).to_pylist()[-1]
        assert last == sorted(last, reverse=True)  # padding only at the end
    assert tokenfile.read(tokenfile.write(empty, BYTES, f"{folder}2")).collect() == []
    assert graph.shared_folder(spark)
