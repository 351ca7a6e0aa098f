"""What the statements promise, checked on the data: bounds, uniqueness, references, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import KeyType


def literal(key: KeyType, value) -> Column:
    return F.lit(value).cast("long" if key is KeyType.INT else "timestamp_ntz")


def outside(column: str, key: KeyType, lower, upper) -> Column:
    """True for a null key or one outside [lower, upper): rows that an adopted table must not have."""
    k = F.col(column)
    return k.isNull() | (k < literal(key, lower)) | (k >= literal(key, upper))


def range_violations(data: DataFrame, column: str, key: KeyType, lower, upper) -> DataFrame:
    """One row: how many keys are null, below and above, and rows in all."""
    k = F.col(column)
    low, high = k < literal(key, lower), k >= literal(key, upper)
    return data.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(k.isNull(), 1)).alias("null_keys"), F.count(F.when(low, 1)).alias("below"), F.count(F.when(high, 1)).alias("above"))


def unique_violations(data: DataFrame, columns: list[str]) -> DataFrame:
    """Each value of the columns that several rows have; nulls are never equal."""
    known = data.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of the child whose columns are all set and are no row of the parent."""
    keys = parent.select(*[F.col(p).alias(f"__{i}") for i, p in enumerate(parent_columns)])
    match = [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)]
    return child.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).join(keys, match, "left_anti")


def layout_faults(registry: DataFrame) -> DataFrame:
    """(schema_name, parent_name, range_id, before, partition_name, fault): gaps and overlaps of attached native partitions.

    What follows an adopted first partition is detached first, so a gap there is none.
    """
    by = Window.partitionBy("schema_name", "parent_name", "range_id").orderBy("lower_int", "lower_ts")
    own = registry.where("state = 'attached' AND strategy = 'native' AND (lower_int IS NOT NULL OR lower_ts IS NOT NULL)")
    seen = own.withColumn("before", F.lag("partition_name").over(by)).withColumn("bi", F.lag("upper_int").over(by)).withColumn("bt", F.lag("upper_ts").over(by)).withColumn("bk", F.lag("kind").over(by))
    gap, over = (F.col("bk") != "mammoth") & ((F.col("bi") < F.col("lower_int")) | (F.col("bt") < F.col("lower_ts"))), (F.col("bi") > F.col("lower_int")) | (F.col("bt") > F.col("lower_ts"))
    return seen.where(gap | over).select("schema_name", "parent_name", "range_id", "before", "partition_name", F.when(F.coalesce(gap, F.lit(False)), "gap").otherwise("overlap").alias("fault"))
