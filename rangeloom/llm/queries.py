"""The queries of this package: one `opN_<name>` for each operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete_at_exit
from . import bpe, decontam, graph, langid, lm, minhash, quality, rlz, simhash, suffix, tokenfile


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is installed; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sums of logarithms are alike to many digits in any order, not to the last
    sums = {c: F.round(c, 6) for c in ("base_score", "score")}
    return lm.score(_table(spark, sf_dir, "documents")).withColumns(sums)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), words=3, radius=2)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.dedup(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{graph.shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    return tokenfile.read(tokenfile.write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, tokenizer_path("piece_bpe_32k.model")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


# Windows of 50 words or bytes that start in an earlier document too; bytes go as pairs of hex digits.
_REPEATS = """, t AS (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS j FROM d),
w AS (SELECT doc_id, i, {window} AS s FROM (SELECT {source}, unnest(range(1, len(u) - 48)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM w JOIN f USING (s) WHERE m < doc_id),
k AS (SELECT t.*, g.j IS NOT NULL AS gone, coalesce(lag(g.j IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY t.j), false) AS before FROM t LEFT JOIN g USING (doc_id, j)),
r AS (SELECT doc_id, count(CASE WHEN gone THEN 1 END) AS n_removed, count(CASE WHEN gone AND NOT before THEN 1 END) AS n_spans, string_agg(x, '{between}' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
"""

_OP2 = (
    "WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), d AS (SELECT doc_id, h, regexp_extract_all(h, '..') AS u FROM h)"
    + _REPEATS.format(window="substr(h, 2 * i - 1, 100)", between="", source="doc_id, h")
    + "SELECT doc_id, len(u) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"
)
_OP7 = (
    r"WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS u FROM documents)"
    + _REPEATS.format(window="array_to_string(u[i:i + 49], ' ')", between=" ", source="doc_id, u")
    + "SELECT doc_id, len(u) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"
)


# crc32 of the id's digits, byte by byte and bit by bit; then counts of words and pairs, and the closed form of order 2.
# A text's words end with '', and NULL is before its first.
_OP1 = r"""WITH c AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, y: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384::BIGINT) ELSE b // 2 END)), 4294967295::BIGINT) AS crc FROM documents),
d AS (SELECT doc_id, coalesce(crc % 7 = 2, false) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), '') AS u FROM documents JOIN c USING (doc_id)),
t AS (SELECT doc_id, held_out, unnest(u) AS w, unnest(list_prepend(NULL, u[:-2])) AS h FROM d),
a AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w), b AS (SELECT h, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY h, w),
s AS (SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, (SELECT count(*) FROM d WHERE NOT held_out) AS texts FROM a),
p AS (SELECT t.*, a.n AS known, (coalesce(a.n, 0) + 1.0::DOUBLE) / (tokens + types + 1) AS one, coalesce(b.n, 0) AS two, CASE WHEN t.h IS NULL THEN texts ELSE coalesce(g.n, 0) END AS before, tokens
FROM t JOIN s ON true LEFT JOIN a ON a.w = t.w LEFT JOIN a g ON g.w = t.h LEFT JOIN b ON b.w = t.w AND b.h IS NOT DISTINCT FROM t.h)
SELECT doc_id, held_out, count(*) AS n_tokens, count(known) AS n_known, tokens AS train_tokens, round(sum(log10(one)), 6) AS base_score, round(sum(log10((two + 500.0::DOUBLE * one) / (before + 500))), 6) AS score FROM p GROUP BY doc_id, held_out, tokens"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests hold the others against brute force."""
    return {"op1_lm_scoring": _OP1, "op2_suffix_dedup": _OP2, "op7_substring_dedup": _OP7}
