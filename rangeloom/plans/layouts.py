"""Bounds and names of new partitions: conversions and growth. Pure functions over a small registry."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..functions.intervals import Interval, age, plus
from ..types import REGISTRY_SCHEMA, KeyType, Partition, PartitionError, fold, named, replace, suffix

_MIDNIGHT = time(0)


def frame(spark: SparkSession, partitions: Iterable[Partition], version: int = 0) -> DataFrame:
    """The registry as a DataFrame."""
    return spark.createDataFrame([p.row(version) for p in partitions], REGISTRY_SCHEMA)


def plan_native(schema: str, table: str, column: str, key: KeyType, start, end, step: str, path: str = "", folder: str = "") -> list[Partition]:
    """The adopted table as first partition [start, end) and one new partition after it.

    For timestamps `end` is a day that still belongs to the first partition; for other keys it is the
    first that doesn't.
    """
    schema, table = fold(schema), fold(table)
    lower, upper = key.parse(start), key.parse(end)
    if key is KeyType.TIMESTAMP:
        lower, upper = datetime.combine(lower.date(), _MIDNIGHT), datetime.combine(upper.date() + timedelta(days=1), _MIDNIGHT)
    top = _advance(key, upper, step)
    if not lower < upper < top:
        raise PartitionError(f"bounds {start}, {end} and step {step} don't ascend")
    own = {"schema_name": schema, "parent_name": table, "key_column": column, "key_type": key.value}
    name = named(table, suffix(key, upper, top))
    return [Partition(partition_name=named(table, "mammoth"), lower=lower, upper=upper, path=path, kind="mammoth", **own), Partition(partition_name=name, lower=upper, upper=top, path=f"{folder}/{name}", **own)]


def plan_inheritance(schema: str, table: str, column: str, key: KeyType, start, end, step: str, path: str = "", folder: str = "") -> list[Partition]:
    """The adopted table with inclusive bounds, a new partition after it, and one for the overflow."""
    schema, table = fold(schema), fold(table)
    lower, last = key.parse(start), key.parse(end)
    if key is KeyType.INT:
        first = last + 1
        new_last = first + int(step) - 1
    elif key is KeyType.DATE:
        first = last + timedelta(days=1)
        new_last = plus(first, Interval.parse(step)) - timedelta(days=1)
    else:
        whole_days = isinstance(end, str) and len(end.strip()) == 10
        if whole_days:
            last = datetime.combine(last.date(), time.max)
        first = last + timedelta(microseconds=1)
        new_last = plus(datetime.combine(first.date(), time.max), Interval.parse(step)) - timedelta(days=1)
    if not lower <= last < first <= new_last:
        raise PartitionError(f"bounds {start}, {end} and step {step} don't ascend")
    own = {"schema_name": schema, "parent_name": table, "key_column": column, "key_type": key.value, "strategy": "inheritance"}
    name = named(table, suffix(key, first, new_last))
    return [
        Partition(partition_name=named(table, "mammoth"), lower=lower, upper=last + key.step, path=path, kind="mammoth", **own),
        Partition(partition_name=name, lower=first, upper=new_last + key.step, path=f"{folder}/{name}", **own),
        Partition(partition_name=named(table, "overflow"), lower=None, upper=None, path=f"{folder}/{named(table, 'overflow')}", kind="overflow", **own),
    ]


def _advance(key: KeyType, at, step: str):
    return at + int(step) if key is KeyType.INT else plus(at, Interval.parse(step))


def successor(last: Partition) -> tuple:
    """Bounds of the partition after this one: as long as this one, by the calendar."""
    if last.type is KeyType.INT:
        return last.upper, 2 * last.upper - last.lower
    step = age(last.upper.date(), last.lower.date())
    top = plus(last.upper, step)
    if top <= last.upper:
        raise PartitionError(f"{last.partition_name} spans less than a day: what follows it would be empty")
    return last.upper, top


def plan_growth(last: Partition, free: int, wanted: int, is_free, folder: str = "") -> list[Partition]:
    """New partitions after `last` until `wanted` are free, with its options; is_free tells which new ones count."""
    out = []
    while free < wanted:
        lower, upper = successor(last)
        name = named(last.parent_name, last.range_id, suffix(last.type, lower, upper))
        last = replace(last, partition_name=name, lower=lower, upper=upper, path=f"{folder}/{name}", kind="regular", constraints=(), loads=())  # options go on
        out.append(last)
        free += bool(is_free(lower))
    return out


def audit(partitions: Iterable[Partition]) -> list[str]:
    """Gaps and overlaps between the attached native partitions of each range.

    Detaching takes what follows the adopted first partition, so a gap there is none.
    """
    ranges: dict[tuple, list[Partition]] = {}
    for p in partitions:
        if p.state == "attached" and p.lower is not None and p.strategy == "native":
            ranges.setdefault((p.schema_name, p.parent_name, p.range_id), []).append(p)
    found = []
    for ps in ranges.values():
        ps.sort()
        found += [f"{'gap' if a.upper < b.lower else 'overlap'} between {a.partition_name} and {b.partition_name}" for a, b in zip(ps, ps[1:]) if a.upper > b.lower or (a.upper < b.lower and a.kind != "mammoth")]
    return found
