"""Key types, bounds, errors and the schema of the partition registry."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timedelta
from enum import Enum

from pyspark.sql import types as T

LOGGER = "rangeloom"


class PartitionError(Exception):
    """A request that can't be carried out; nothing has been changed."""


class NotPartitioned(PartitionError):
    pass


class UnsupportedKey(PartitionError):
    pass


class OutOfRange(PartitionError):
    """Rows for which there is no partition, or that a recorded constraint forbids."""


class Conflict(PartitionError):
    """Another writer has published this version of the registry first."""


class KeyType(str, Enum):
    INT, DATE, TIMESTAMP = "int", "date", "timestamp"

    @classmethod
    def of(cls, kind: T.DataType) -> KeyType:
        if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType)):
            return cls.INT
        if isinstance(kind, T.DateType):
            return cls.DATE
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return cls.TIMESTAMP
        raise UnsupportedKey(f"a key of type {kind.simpleString()} is not supported: int, date or timestamp")

    def parse(self, value) -> int | datetime:
        """A bound from text or a Python value; dates are midnights."""
        if self is KeyType.INT:
            return int(value)
        if isinstance(value, datetime):
            return value
        if isinstance(value, date):
            return datetime(value.year, value.month, value.day)
        return datetime.fromisoformat(str(value).strip())

    def text(self, value: int | datetime) -> str:
        if self is KeyType.INT:
            return str(value)
        return value.strftime("%Y-%m-%d") if self is KeyType.DATE else value.strftime("%Y-%m-%d %H:%M:%S") + (f".{value.microsecond:06d}" if value.microsecond else "")

    @property
    def step(self) -> int | timedelta:
        """From an inclusive last key to the exclusive bound above it."""
        return {KeyType.INT: 1, KeyType.DATE: timedelta(days=1), KeyType.TIMESTAMP: timedelta(microseconds=1)}[self]


REGISTRY_SCHEMA = (
    "schema_name string, parent_name string, partition_name string, range_id string, strategy string, kind string, state string, key_column string, key_type string, "
    "lower_int long, upper_int long, lower_ts timestamp_ntz, upper_ts timestamp_ntz, path string, detached_date date, constraints array<struct<name: string, column: string, op: string, value: string>>, version long, "
    "loads array<string>, options map<string,string>"
)


@dataclass(frozen=True)
class Partition:
    """A child with its half-open bounds; an overflow or default partition has none.

    Its rows are in `path`, if that is there, and in the folders `loads`, one for each insert that reached it.
    """

    schema_name: str
    parent_name: str
    partition_name: str
    key_column: str
    key_type: str
    lower: int | datetime | None
    upper: int | datetime | None
    path: str = ""
    range_id: str | None = None
    strategy: str = "native"
    kind: str = "regular"  # or mammoth, overflow, default
    state: str = "attached"
    detached_date: date | None = None
    constraints: tuple[dict, ...] = ()
    loads: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    @property
    def type(self) -> KeyType:
        return KeyType(self.key_type)

    def row(self, version: int = 0) -> dict:
        number = self.key_type == KeyType.INT.value
        return {
            "schema_name": self.schema_name, "parent_name": self.parent_name, "partition_name": self.partition_name, "range_id": self.range_id, "strategy": self.strategy, "kind": self.kind, "state": self.state, "key_column": self.key_column, "key_type": self.key_type,
            "lower_int": self.lower if number else None, "upper_int": self.upper if number else None, "lower_ts": None if number else self.lower, "upper_ts": None if number else self.upper, "path": self.path, "detached_date": self.detached_date, "constraints": [dict(c) for c in self.constraints], "version": version, "loads": list(self.loads), "options": self.options,
        }

    @classmethod
    def from_row(cls, r: dict) -> Partition:
        number = r["key_type"] == KeyType.INT.value
        lower, upper = (r["lower_int"], r["upper_int"]) if number else (r["lower_ts"], r["upper_ts"])
        own = {k: r[k] for k in ("schema_name", "parent_name", "partition_name", "key_column", "key_type", "path", "range_id", "strategy", "kind", "state", "detached_date")}
        return cls(**own, lower=lower, upper=upper, constraints=tuple(c if isinstance(c, dict) else c.asDict() for c in r["constraints"] or ()), loads=tuple(r["loads"] or ()), options=dict(r["options"] or {}))

    def bounds(self) -> list[str]:
        """Bounds as text: half-open for a native partition, inclusive for an inherited one."""
        if self.lower is None:
            return []
        upper = self.upper - self.type.step if self.strategy == "inheritance" else self.upper
        return [self.type.text(self.lower), self.type.text(upper)]

    def __lt__(self, other: Partition) -> bool:
        return self.lower < other.lower


@dataclass(frozen=True)
class Table:
    """A table the manager knows; strategy is None until it is partitioned. `columns` is its schema as JSON, kept here
    since no folder of the table lasts for ever."""

    schema_name: str
    table_name: str
    path: str
    key_column: str | None = None
    key_type: str | None = None
    strategy: str | None = None
    template: bool = False
    primary_key: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    columns: str = ""


@dataclass(frozen=True)
class Index:
    schema_name: str
    table_name: str
    index_name: str
    columns: tuple[str, ...]
    method: str = "btree"
    unique: bool = False
    primary: bool = False


@dataclass(frozen=True)
class ForeignKey:
    schema_name: str
    table_name: str
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    valid: bool = True
    parent_schema: str | None = None  # None: the schema of the key's own table

    def refers_to(self, schema: str, table: str) -> bool:
        return (self.parent_schema or self.schema_name, self.parent) == (schema, table)


def fold(name: str) -> str:
    """Identifiers are compared in lower case everywhere."""
    return name.strip().lower()


#: Fixed value: the longest identifier.
LONGEST = 63


def named(table: str, *parts: str | None) -> str:
    """`<table>_<part>_...`; the table's name is cut where the whole would be too long, so that names stay apart."""
    tail = "_".join(p for p in parts if p)
    return f"{table[: LONGEST - len(tail) - 1]}_{tail}"


class Names:
    """Names of LONGEST characters at most that differ from all taken ones, and then are taken themselves."""

    def __init__(self, taken):
        self.taken, self.tried = set(taken), {}

    def unused(self, name: str, ending: str = "_idx") -> str:
        """The name, or the first one with a number before its ending that isn't taken."""
        stem = name.removesuffix(ending)[: LONGEST - len(ending)]
        n = self.tried.get((stem, ending), 0)
        while (out := f"{stem[: LONGEST - len(ending) - len(str(n or ''))]}{n or ''}{ending}") in self.taken:
            n += 1
        self.tried[stem, ending] = n
        self.taken.add(out)
        return out


def suffix(key: KeyType, lower, upper) -> str:
    """`<lower>_<upper>` without time of day and dashes; a negative number keeps its sign as m."""
    if key is KeyType.INT:
        return "_".join(f"m{-x}" if x < 0 else str(x) for x in (lower, upper))
    return "_".join(x.strftime("%Y%m%d") for x in (lower, upper))


_RANGE = re.compile(r"_(r\d+)_")


def range_of(partition_name: str, parent_name: str) -> str | None:
    """The range in a child's name `<parent>_r<digits>_...`, for layouts that are imported by name."""
    m = _RANGE.match(partition_name[len(parent_name) :]) if partition_name.startswith(parent_name) else None
    return m[1] if m else None


__all__ = ["Conflict", "ForeignKey", "Index", "KeyType", "LONGEST", "Names", "NotPartitioned", "OutOfRange", "Partition", "PartitionError", "REGISTRY_SCHEMA", "Table", "UnsupportedKey", "asdict", "fold", "named", "range_of", "replace", "suffix"]
