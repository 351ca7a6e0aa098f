"""The registry on storage: one JSON object a version, published by a rename that never overwrites.

State is a handful of records for each partition, so the driver holds it, and reads and writes it without
a Spark job; data is never read for it. Writers read a version, work out the next and publish it. The
rename fails if that version is there already, and the writer starts again from it. Rows become visible
the same way: an insert writes a folder that no version names, and a version then names it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from ..types import Conflict, ForeignKey, Index, NotPartitioned, Partition, PartitionError, Table, fold, replace

JOURNAL_SCHEMA = "schema_name string, parent_name string, partition_name string, range array<string>, detached_date date"
CONFIGURATION_SCHEMA = "schema_name string, table_name string, configuration string"


@dataclass
class State:
    version: int = 0
    tables: list[Table] = field(default_factory=list)
    partitions: list[Partition] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    configuration: dict[tuple[str, str], dict] = field(default_factory=dict)
    journal: list[dict] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)  # the last batch that each stream has published

    def table(self, schema: str, name: str) -> Table:
        for t in self.tables:
            if (t.schema_name, t.table_name) == (fold(schema), fold(name)):
                return t
        raise PartitionError(f"there is no table {schema}.{name}")

    def partitioned(self, schema: str, name: str) -> Table:
        t = self.table(schema, name)
        if t.strategy != "native":
            raise NotPartitioned(f"{schema}.{name} is not a natively partitioned table")
        return t

    def children(self, schema: str, name: str, state: str = "attached") -> list[Partition]:
        own = [p for p in self.partitions if (p.schema_name, p.parent_name) == (fold(schema), fold(name)) and p.state == state]
        return sorted((p for p in own if p.lower is not None), key=lambda p: p.lower) + [p for p in own if p.lower is None]

    def replace_table(self, table: Table) -> None:
        self.tables = [t for t in self.tables if (t.schema_name, t.table_name) != (table.schema_name, table.table_name)] + [table]

    def replace_partition(self, p: Partition) -> None:
        self.partitions = [p if (x.schema_name, x.partition_name) == (p.schema_name, p.partition_name) else x for x in self.partitions]


_KINDS = {"tables": Table, "indexes": Index, "foreign_keys": ForeignKey}


def _plain(x):
    return x.isoformat() if isinstance(x, (date, datetime)) else list(x)


class Registry:
    """Loads and publishes versions under `root`."""

    def __init__(self, spark: SparkSession, root: str, attempts: int = 3, back_off: float = 10.0):
        self.spark, self.root, self.attempts, self.back_off = spark, root.rstrip("/"), attempts, back_off
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _file(self, version: int) -> str:
        return f"{self.root}/registry/v={version:09d}.json"

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/registry")
        if not self._fs.exists(at):
            return []
        jvm = self.spark._jvm  # all paths in one text: a call for each would take longer than the listing
        paths = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(self._fs.listStatus(at)))
        return sorted(int(n) for n in re.findall(r"/v=(\d{9,})\.json(?=[,}])", paths))

    def load(self) -> State:
        versions = self.versions()
        if not versions:
            return State()
        state = State(version=versions[-1])
        found = self._fs.open(self._path(self._file(versions[-1])))
        try:
            saved = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8"))
        finally:
            found.close()
        for body in saved["partitions"]:
            for k in ("lower_ts", "upper_ts"):
                body[k] = body[k] and datetime.fromisoformat(body[k])
            body["detached_date"] = body["detached_date"] and date.fromisoformat(body["detached_date"])
            state.partitions.append(Partition.from_row(body))
        state.configuration = {(c["schema_name"], c["table_name"]): c["configuration"] for c in saved["configuration"]}
        state.journal = [j | {"detached_date": date.fromisoformat(j["detached_date"])} for j in saved["journal"]]
        state.streams = saved["streams"]
        for name, kind in _KINDS.items():
            setattr(state, name, [kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in body.items()}) for body in saved[name]])
        return state

    def commit(self, state: State) -> int:
        """Publishes state as the version after the one it was loaded as."""
        new, draft = state.version + 1, f"{self.root}/drafts/{uuid.uuid4().hex}.json"
        body = {name: [asdict(x) for x in getattr(state, name)] for name in _KINDS} | {"partitions": [p.row(new) for p in state.partitions], "journal": state.journal, "streams": state.streams}
        body["configuration"] = [{"schema_name": s, "table_name": t, "configuration": c} for (s, t), c in state.configuration.items()]
        out = self._fs.create(self._path(draft))
        try:
            out.write(bytearray(json.dumps(body, default=_plain).encode()))
        finally:
            out.close()
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.root}/registry"))
        try:
            self._context.rename(self._path(draft), self._path(self._file(new)), options)
        except Exception as e:
            self._fs.delete(self._path(draft), True)
            if self._fs.exists(self._path(self._file(new))):
                raise Conflict(f"version {new} of the registry is there already") from e
            raise
        return new

    def update(self, change: Callable[[State], object]):
        """Applies `change` to the newest state and publishes it; again from the start after a conflict."""
        for attempt in range(1, self.attempts + 1):
            state = self.load()
            result = change(state)
            try:
                self.commit(state)
                return result
            except Conflict:
                if attempt == self.attempts:
                    raise
                time.sleep(self.back_off)

    def partitions(self) -> DataFrame:
        from ..plans.layouts import frame

        state = self.load()
        return frame(self.spark, state.partitions, state.version)

    def journal(self) -> DataFrame:
        return self.spark.createDataFrame([(j["schema_name"], j["parent_name"], j["partition_name"], j["range"], j["detached_date"]) for j in self.load().journal], JOURNAL_SCHEMA)

    def configuration(self) -> DataFrame:
        return self.spark.createDataFrame([(s, t, json.dumps(c)) for (s, t), c in self.load().configuration.items()], CONFIGURATION_SCHEMA)

    def delete_data(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        at = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def existing(self, partitions: list[Partition]) -> list[Partition]:
        """Partitions with a folder to read, each with all of them in `loads`: one listing for each parent folder."""
        listed: dict[str, set[str]] = {}
        out = []
        for p in partitions:
            parent, _, name = p.path.rpartition("/")
            if parent not in listed:
                listed[parent] = set(self.names(parent))
            folders = (p.path,) * (name in listed[parent]) + p.loads
            if folders:
                out.append(replace(p, loads=folders))
        return out
