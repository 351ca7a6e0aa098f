"""Every stage against what it says, each on what the one before it kept."""

from itertools import combinations

import pytest

import corpus_pipeline as pipeline
from rangeloom.llm import decontam

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, DATA).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return [*out, docs]


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def firsts(rows):
    """The least id of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if (x == y or len(x & y) >= 0.8 * len(x | y)) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    return set(least.values())


def test_stages(spark, kept):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "BPE encoding"]
    assert all(df.columns == kept[0].columns for df in kept[:5])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = ids(kept[0]) - ids(kept[1])
    assert gone and all(labels.get(i, 0) == 0 for i in gone) and not any(labels.get(i) == 0 for i in ids(kept[1]))
    assert ids(kept[2]) == firsts([tuple(r) for r in kept[1].select("doc_id", "text").collect()])
    assert ids(kept[3]) == ids(kept[2])
    leaks = {r.doc_id for r in decontam.find(kept[3], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert ids(kept[4]) == ids(kept[3]) - leaks
    assert ids(kept[5]) == ids(kept[4]) and kept[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_run(spark, kept):
    assert sorted(map(tuple, pipeline.run(spark, DATA).drop("ids").collect())) == sorted(map(tuple, kept[5].drop("ids").collect()))


def test_stages_on_odd_rows(spark, docs, rows, empty):
    """Nulls, repeats, long and odd texts and clashing columns go through every stage; no rows give no rows."""
    for table in (docs, empty):
        out = table
        for i, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, out, DATA)
            assert i == 4 or out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), out.schema)
        assert (out.count() > 10) == (table is docs)
