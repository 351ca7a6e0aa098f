import random

import pytest

LETTERS = "abcdefgh"


def sentence(r, n, words=400):
    return " ".join("".join(r.choices(LETTERS, k=2 + r.randrange(w := 6))) if r.random() < 0.7 else f"w{r.randrange(words)}" for _ in range(n))


def corpus():
    """(doc_id, text, lang, source): copies, shared passages, nulls, empties, repeats of a row, long and odd texts."""
    r = random.Random(7)
    shared, passage = sentence(r, 30), sentence(r, 70)
    rows = [(i, sentence(r, 20 + 9 * (i % 7)), "en" if i % 3 else "fr", f"s{i % 2}") for i in range(30)]
    rows += [(100 + i, rows[0][1], "en", "copies") for i in range(12)]
    rows += [(200 + i, " ".join([sentence(r, 8), shared, sentence(r, 5), passage, sentence(r, 3)]), None, "passages") for i in range(9)]
    rows += [(300 + i, (passage + " " + sentence(r, 60)).replace(" ", "  \n" if i else " "), "fr", None) for i in range(3)]
    rows += [(400, None, None, None), (401, "", "en", "x"), (402, " \t\n ", "en", "x"), (403, "one", "en", "x"), (404, "Éé ñ x!", "fr", "x"), (405, "12 34 !!", None, "x"), (406, "a" * 400, "en", "x"), (407, "ha " * 300, "en", "x"), (408, sentence(r, 20_000, 50), "en", "long")]
    rows += [rows[5], rows[5], (5, sentence(r, 60), "en", "same id"), (None, passage, "en", "no id"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return base.withColumn("n_chars", F.length("text").cast("long")).withColumn("block", F.lit("mine")).withColumn("shard", F.lit(1)).withColumn("payload", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
