"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL functions alone.

Each five-word shingle is hashed once. The hash's top bits choose one of BINS bins and a bin keeps its
least hash. An empty bin copies from a full bin that a hash of both bins' numbers picks: the same for
all texts with the same full bins, and independent from one empty bin to the next (Shrivastava, 2017).
Eight low-order bits of each bin are stored as two hex digits. Of two unlike bins one in 256 agrees by
chance, so a share s of equal bins estimates the similarity (s - 1/256) / (1 - 1/256).

No step gathers shingles across documents: arrays stay in their rows, and the only shuffle brings each
document to the one that follows it in order of doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BINS, WORDS = 128, 5
#: Text of a range of ids, and the most ranges: beyond some 0.8 TB ranges get longer, 1.5 GB at 100 TB. They are
#: sorted by Spark, which spills; nothing else of a range is held.
BUCKET_BYTES, MOST_BUCKETS = 12_000_000, 65_536
EMPTY = "00" * BINS


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def shingle_hashes(text: Column) -> Column:
    """A 64-bit hash of each run of WORDS words; of the whole sequence, if there are fewer; none without words."""
    hashed = F.transform(F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]))
        few = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= WORDS, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, runs)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (BINS - 1).bit_length()).cast("int")


def low_bits(text: Column) -> Column:
    """One byte a bin as array<tinyint>; an empty array for a text without words."""

    def firsts(h: Column) -> Column:  # sorted hashes: a bin's are neighbours, and its least comes first
        return F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1))))

    def fill(least: Column) -> Column:
        def each(full: Column) -> Column:
            def one(b: Column) -> Column:
                own = F.array_position(full, b).cast("int")
                picked = F.array_min(F.transform(least, lambda x: F.xxhash64(b, _bin(x)).bitwiseAND(F.lit(-256).cast("long")).bitwiseOR(x.bitwiseAND(F.lit(255).cast("long")))))
                return (F.when(own > 0, F.get(least, own - 1)).otherwise(picked).bitwiseAND(F.lit(255).cast("long")) - 128).cast("tinyint")

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), one)

        return F.when(F.size(least) > 0, let(F.transform(least, _bin), each)).otherwise(F.array().cast("array<tinyint>"))

    return let(let(F.sort_array(shingle_hashes(text)), firsts), fill)


def packed(bits: Column) -> Column:
    """The bytes as hex digits."""
    digits = F.array_join(F.transform(bits, lambda x: F.lower(F.lpad(F.hex((x.cast("int") + 128).cast("long")), 2, "0"))), "")
    return F.when(F.size(bits) > 0, digits).otherwise(F.lit(EMPTY))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two texts' shingles, 0 to 1; two texts without words are alike."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 1 / 256
    estimate = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(estimate)


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<column> of the row that follows in descending doc_id (after the last: the first).

    Rows are dealt by ranges of doc_id. Each range also gets the first row of the range below, so no
    range waits for another; a null doc_id comes last, and rows of one doc_id follow by text.
    """
    lowest = F.lit(-(2**63)).cast("long")
    rows = rows.withColumn("o", F.coalesce("doc_id", lowest))
    count, size = C.text_size(rows)
    ranges = max(1, min(MOST_BUCKETS, count, -(-(size + 256 * count) // BUCKET_BYTES)))
    cuts = rows.agg(F.percentile_approx("o", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first().c if ranges > 1 else None
    cuts = sorted(set(cuts or []))
    bucket = F.lit(0)
    if cuts:
        steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
        found = F.aggregate(F.lit(steps), F.lit(0), lambda a, s: F.when(F.coalesce(F.get(F.lit(cuts), a + s - 1) < F.col("o"), F.lit(False)), a + s).otherwise(a))
        bucket = found
    rows = rows.withColumn("bucket", bucket)
    by, whole = Window.orderBy("bucket"), Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # at most MOST_BUCKETS rows
    heads = rows.groupBy("bucket").agg(F.max("o").alias("o")).select("o", F.coalesce(F.lead("bucket").over(by), F.min("bucket").over(whole)).alias("above"))
    both = rows.join(F.broadcast(heads), "o", "left")
    places = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("tail")), F.when(F.col("above").isNotNull(), F.struct(F.col("above").alias("bucket"), F.lit(1).alias("tail")))))
    dealt = both.withColumn("p", F.explode(places)).select("doc_id", "o", *carried, "p.bucket", "p.tail")
    order = Window.partitionBy("bucket").orderBy("tail", F.col("o").desc(), "text")
    return dealt.select("doc_id", *carried, "tail", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("tail = 0").drop("tail")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints every text, and the text with its last third replaced by the next document's beginning.

    Null texts are empty; texts without words have a fingerprint of zeros. Each row gives a row; a single
    row is its own next document. Rows of one doc_id follow each other by text, a null doc_id comes last. No rows give
    no rows; texts of any length are whole; other columns are left behind, whatever their names.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("bits", low_bits(F.col("text"))), ["text", "bits"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    edited = edited.withColumn("edited_bits", low_bits(F.col("edited")))
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("bits")).alias("fingerprint"), packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )
