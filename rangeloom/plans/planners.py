"""What to do next, as DataFrames over registry, configuration, journal and data. Nothing is changed here."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.intervals import Interval, plus
from ..functions.ranges import listed, range_index
from ..types import KeyType, NotPartitioned, Partition, PartitionError, fold

HEADROOM = 2  # partitions kept beyond the configured number
LEAST_FREE = 3
LEAST_COOL_DOWN = Interval(days=4)
PARENT = ["schema_name", "parent_name"]


def lower_text() -> Column:
    return _text("lower_int", "lower_ts")


def upper_text() -> Column:
    return _text("upper_int", "upper_ts")


def _text(number: str, time: str) -> Column:
    at = F.date_format(F.col(time), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.col("key_type") == "int", F.col(number).cast("string")).when(F.col("key_type") == "date", F.substring(at, 1, 10)).otherwise(at)


def _order(descending: bool) -> list[Column]:
    keys = [F.col("lower_int"), F.col("lower_ts")]
    return [k.desc() if descending else k.asc() for k in keys]


def _first_of(registry: DataFrame, descending: bool) -> DataFrame:
    own = registry.where((F.col("state") == "attached") & F.col("kind").isin("regular"))
    by = Window.partitionBy(*PARENT, "range_id").orderBy(*_order(descending))
    return own.withColumn("n", F.row_number().over(by)).where("n = 1").select(*PARENT, "range_id", "partition_name", lower_text().alias("lower_bound"), upper_text().alias("upper_bound"))


def last_partitions(registry: DataFrame) -> DataFrame:
    """The attached partition with the highest bounds of each table and range; mammoth and default don't count."""
    return _first_of(registry, descending=True)


def oldest_partitions(registry: DataFrame) -> DataFrame:
    """The one with the lowest: what may be detached next."""
    return _first_of(registry, descending=False)


def key_maxima(data: DataFrame, partitions: list[Partition]) -> DataFrame:
    """(range_id, max_key): the greatest key below the last bound of each range; one pass for all ranges."""
    key = partitions[0].key_column
    tops: dict[str | None, int] = {}
    for p in partitions:
        if p.upper is not None:
            tops[p.range_id] = max(tops.get(p.range_id, p.upper), p.upper)
    names = sorted(tops, key=lambda r: (r is not None, r or ""))
    found = data.select(F.col(key).cast("long").alias("k")).agg(*[F.max(F.when(F.col("k") < tops[r], F.col("k"))).alias(f"m{i}") for i, r in enumerate(names)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(r).cast("string").alias("range_id"), F.col(f"m{i}").alias("max_key")) for i, r in enumerate(names)])).alias("e")).select("e.*")


def free_partitions(registry: DataFrame, maxima: DataFrame | None, as_of: date) -> DataFrame:
    """(schema_name, parent_name, range_id, free) of one table: partitions that begin above all keys, or after today.

    `maxima` is needed for integer keys; a range without rows counts from 0.
    """
    bounded = registry.where((F.col("state") == "attached") & ~F.col("kind").isin("default", "overflow"))
    if maxima is not None:
        top = F.broadcast(maxima.select(F.coalesce("range_id", F.lit("")).alias("r"), F.coalesce("max_key", F.lit(0)).alias("top")))  # a row for each range of the table
        bounded = bounded.withColumn("r", F.coalesce("range_id", F.lit(""))).join(top, "r", "left")
        ahead = F.col("lower_int") > F.coalesce("top", F.lit(0))
    else:
        ahead = F.col("lower_ts").cast("date") > F.lit(as_of)
    return bounded.groupBy(*PARENT, "range_id").agg(F.count(F.when(ahead, 1)).alias("free"))


def partition_statistics(data: DataFrame, partitions: list[Partition], column: str | None = None) -> DataFrame:
    """(partition, rows, max_key, low, high): one grouped pass over the data for all partitions.

    Rows of no partition are left out. `low` and `high` are of `column`, nulls apart.
    """
    ps = sorted(p for p in partitions if p.lower is not None)
    if not ps:
        raise NotPartitioned("there are no bounds")
    kind = "long" if ps[0].type is KeyType.INT else "timestamp_ntz"
    key = F.col(ps[0].key_column).cast(kind)
    at = range_index(key, [p.lower for p in ps], [p.upper for p in ps], kind)
    values = [F.min("value").alias("low"), F.max("value").alias("high")] if column else []
    stats = data.select(at.alias("at"), key.alias("key"), *([F.col(column).alias("value")] if column else [])).where("at is not null").groupBy("at").agg(F.count(F.lit(1)).alias("rows"), F.max("key").alias("max_key"), *values)
    return stats.select(F.get(listed([p.partition_name for p in ps], "string"), F.col("at")).alias("partition_name"), "rows", "max_key", *(["low", "high"] if column else []), "at")


def date_constraints(data: DataFrame, partitions: list[Partition], column: str) -> DataFrame:
    """(partition_name, lower_bound, upper_bound, rows, min_value, max_value) of integer partitions with rows.

    max_value is null unless the partition's last key is there: only then no more can follow.
    """
    ps = sorted(p for p in partitions if p.lower is not None)
    stats = partition_statistics(data, ps, column)
    lower, upper = (F.get(listed(bounds, "long"), F.col("at")) for bounds in ([p.lower for p in ps], [p.upper for p in ps]))
    return stats.select("partition_name", lower.alias("lower_bound"), upper.alias("upper_bound"), "rows", F.col("low").alias("min_value"), F.when(F.col("max_key") == upper - 1, F.col("high")).alias("max_value"))


def expand_configuration(configuration: DataFrame) -> DataFrame:
    """(schema_name, table_name, key, value): a row for each entry of a table's JSON configuration."""
    entries = F.explode(F.from_json("configuration", "map<string,string>"))
    return configuration.select(F.lower("schema_name").alias("schema_name"), F.lower("table_name").alias("table_name"), entries)


def add_requests(configuration: DataFrame, registry: DataFrame) -> DataFrame:
    """(schema_name, parent_name, wanted): natively partitioned tables under automatic maintenance."""
    tables = registry.where("strategy = 'native'").select(*PARENT).distinct()
    wanted = configuration.select(F.lower("schema_name").alias("schema_name"), F.lower("table_name").alias("parent_name"), F.get_json_object("configuration", "$.auto-maintenance").cast("boolean").alias("auto"), F.get_json_object("configuration", "$.nr").cast("int").alias("nr"))
    return wanted.where("auto").join(tables, PARENT, "left_semi").select(*PARENT, F.greatest(F.lit(LEAST_FREE), F.col("nr") + HEADROOM).alias("wanted"))


def _entries(configuration: DataFrame, key: str, strict_auto: bool = False) -> list[tuple[str, str, str]]:
    """(schema, table, value) of one key; the configuration is small and its intervals are parsed here."""
    out = []
    for r in configuration.collect():
        entry = json.loads(r.configuration)
        if entry.get(key) is not None and (entry.get("auto-maintenance") is True or not strict_auto):
            out.append((fold(r.schema_name), fold(r.table_name), entry[key] if isinstance(entry[key], str) else json.dumps(entry[key])))
    return sorted(out)


def _limits(spark: SparkSession, rows: list[tuple[str, str, str]], as_of: date, least: Interval | None = None) -> DataFrame:
    """(schema_name, parent_name, limit): as_of less each interval, as a date."""
    today = KeyType.DATE.parse(as_of)
    found = []
    for schema, table, text in rows:
        step = Interval.parse(text)
        if least and step.length < least.length:
            step = least
        found.append((schema, table, plus(today, -step).date()))
    return spark.createDataFrame(found, "schema_name string, parent_name string, limit date")


def constraint_requests(configuration: DataFrame, strict_auto: bool = False) -> list[tuple[str, str, str, str]]:
    """(schema, table, marker, column) to constrain."""
    out = []
    for schema, table, value in _entries(configuration, "date_constraint", strict_auto):
        v = json.loads(value)
        if "marker" not in v or "constraint_column" not in v:
            raise PartitionError(f"date_constraint of {schema}.{table} needs marker and constraint_column")
        out.append((schema, table, v["marker"], v["constraint_column"]))
    return out


def detach_candidates(registry: DataFrame, configuration: DataFrame, as_of: date, strict_auto: bool = False) -> DataFrame:
    """(schema_name, parent_name, partition_name, lower_bound, upper_bound): past their retention, oldest first in each table."""
    spark = registry.sparkSession
    limits = _limits(spark, _entries(configuration, "detach", strict_auto), as_of)
    own = registry.where((F.col("state") == "attached") & (F.col("kind") == "regular") & F.col("key_type").isin("date", "timestamp"))
    return own.join(F.broadcast(limits), PARENT).where(F.col("upper_ts").cast("date") < F.col("limit")).select(*PARENT, "partition_name", lower_text().alias("lower_bound"), upper_text().alias("upper_bound")).orderBy(*PARENT, "lower_bound")


def drop_candidates(journal: DataFrame, configuration: DataFrame, as_of: date, strict_auto: bool = False) -> DataFrame:
    """(schema_name, parent_name, partition_name, detached_date): detached at least the cool-down ago."""
    limits = _limits(journal.sparkSession, _entries(configuration, "drop_detached", strict_auto), as_of, LEAST_COOL_DOWN)
    return journal.join(F.broadcast(limits), PARENT).where(F.col("detached_date") <= F.col("limit")).select(*PARENT, "partition_name", "detached_date").orderBy(*PARENT, "partition_name")
