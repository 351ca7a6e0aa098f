"""Rows to partitions, and the constraints that partitions carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import listed, range_index
from ..types import KeyType, NotPartitioned, Partition

PARTITION = "__partition"


def partition_of(partitions: list[Partition]) -> Column:
    """The name of the partition that holds a row's key; the default's for any other; null without one."""
    ps = sorted(p for p in partitions if p.lower is not None)
    spare = [p.partition_name for p in partitions if p.kind == "default"] or [p.partition_name for p in partitions if p.kind == "overflow"]
    if not ps:
        raise NotPartitioned("there are no bounds to route by")
    kind = "long" if ps[0].type is KeyType.INT else "timestamp_ntz"
    at = range_index(F.col(ps[0].key_column).cast(kind), [p.lower for p in ps], [p.upper for p in ps], kind)
    name = F.get(listed([p.partition_name for p in ps], "string"), at)
    return F.coalesce(name, F.lit(spare[0])) if spare else name


def route(data: DataFrame, partitions: list[Partition]) -> DataFrame:
    """Adds the partition's name; a projection, without join or shuffle."""
    return data.withColumn(PARTITION, partition_of(partitions))


def constraint(c: dict) -> Column:
    """A recorded bound as a predicate; null passes."""
    value = F.lit(c["value"])
    column = F.col(c["column"])
    return F.coalesce(column >= value if c["op"] == ">=" else column <= value, F.lit(True))


def broken(partitions: list[Partition]) -> Column | None:
    """True for a routed row that its partition's recorded constraints forbid."""
    found = [(F.col(PARTITION) == p.partition_name) & ~constraint(c) for p in partitions for c in p.constraints]
    return reduce(lambda a, b: a | b, found) if found else None
