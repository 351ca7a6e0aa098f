"""Partition-aware reads: only the folders that can hold a wanted row are opened."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..types import Partition

Bounds = tuple[object | None, object | None]


def survivors(partitions: Iterable[Partition], key: Bounds = (None, None), where: dict[str, Bounds] | None = None) -> list[Partition]:
    """Partitions that may hold keys in [low, high) and, by their recorded constraints, values in [low, high)."""
    out = []
    for p in partitions:
        low, high = key
        if p.lower is not None and ((low is not None and p.upper <= p.type.parse(low)) or (high is not None and p.lower >= p.type.parse(high))):
            continue
        if any(_excluded(c, (where or {}).get(c["column"])) for c in p.constraints):
            continue
        out.append(p)
    return out


def _excluded(c: dict, bounds: Bounds | None) -> bool:
    """Whether no value under the constraint lies in the bounds; ISO text sorts as dates do."""
    if not bounds:
        return False
    low, high = (None if b is None else _iso(b) for b in bounds)
    value = _iso(c["value"])
    if isinstance(value, str) != isinstance(low if low is not None else high, str):
        return False
    return (c["op"] == ">=" and high is not None and value >= high) or (c["op"] == "<=" and low is not None and value < low)


def _iso(value):
    """Dates as timestamps' text, so that both compare; numbers as they are."""
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return f"{value.isoformat()} 00:00:00"
    if isinstance(value, str):
        try:
            return datetime.fromisoformat(value).isoformat(sep=" ")
        except ValueError:
            return value
    return value


def scan(spark: SparkSession, partitions: Iterable[Partition], key_column: str, schema: StructType | None = None, key: Bounds = (None, None), where: dict[str, Bounds] | None = None) -> DataFrame:
    """Rows with keys in [low, high) and values in the given bounds; Parquet filters go on from the survivors' `loads`."""
    paths = [f for p in survivors(partitions, key, where) for f in p.loads]
    if paths:
        reader = spark.read.schema(schema) if schema else spark.read
        out = reader.parquet(*paths)
    elif schema:
        out = spark.createDataFrame([], schema)
    else:
        raise ValueError("no partition is left to take the schema from")
    for column, (low, high) in {key_column: key, **(where or {})}.items():
        if low is not None:
            out = out.where(F.col(column) >= F.lit(low))
        if high is not None:
            out = out.where(F.col(column) < F.lit(high))
    return out
