"""The public operators on a registry: what planners propose is applied and published here."""

from __future__ import annotations

import json
import logging
import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import checks, ddl, routing
from .plans import layouts, planners
from .sources import scan as scans
from .sources.registry import Registry, State
from .types import LOGGER, Conflict, ForeignKey, Index, KeyType, Names, NotPartitioned, OutOfRange, Partition, PartitionError, Table, UnsupportedKey, fold, named, range_of, replace

log = logging.getLogger(LOGGER)


def today() -> date:
    return datetime.now(timezone.utc).date()


class PartitionManager:
    """Range-partitioned tables under one root folder. Every operator leaves a new version of the registry."""

    def __init__(self, spark: SparkSession, root: str, attempts: int = 3, back_off: float = 10.0):
        self.spark, self.root = spark, root.rstrip("/")
        self.registry = Registry(spark, root, attempts, back_off)

    # -- set-up

    def install(self) -> None:
        """Makes an empty registry, unless there is one."""
        if not self.registry.versions():
            self.registry.commit(State())

    def register(self, schema: str, table: str, path: str, primary_key: list[str] = (), options: dict | None = None) -> None:
        """Makes an existing Parquet dataset known as a plain table."""

        def change(state: State):
            if any((t.schema_name, t.table_name) == (fold(schema), fold(table)) for t in state.tables):
                raise PartitionError(f"{schema}.{table} is known already")
            state.tables.append(Table(fold(schema), fold(table), path, primary_key=tuple(primary_key), options=options or {}, columns=columns))
            if primary_key:
                state.indexes.append(Index(fold(schema), fold(table), f"{fold(table)[:58]}_pkey", tuple(primary_key), unique=True, primary=True))

        columns = self.spark.read.parquet(path).schema.json()
        self.registry.update(change)

    def configure(self, schema: str, table: str, configuration: dict) -> None:
        """Sets a table's maintenance configuration; one per table."""
        self.registry.update(lambda state: state.configuration.__setitem__((fold(schema), fold(table)), configuration))

    def add_index(self, schema: str, table: str, name: str, columns: list[str], method: str = "btree", unique: bool = False) -> None:
        self.registry.update(lambda state: state.indexes.append(Index(fold(schema), fold(table), name, tuple(columns), method, unique)))

    def add_foreign_key(self, schema: str, table: str, name: str, columns: list[str], parent: str, parent_columns: list[str], parent_schema: str | None = None, valid: bool = True) -> None:
        """A key to a table of `parent_schema`, or of the key's own schema."""
        self.registry.update(lambda state: state.foreign_keys.append(ForeignKey(fold(schema), fold(table), name, tuple(columns), fold(parent), tuple(parent_columns), valid, fold(parent_schema or schema))))

    def validate_foreign_key(self, schema: str, table: str, name: str) -> int:
        """How many rows of the table break the key; it is marked valid if there are none, else not valid."""
        state = self.registry.load()
        own = [f for f in state.foreign_keys if (f.schema_name, f.table_name, f.name) == (fold(schema), fold(table), name)]
        if not own:
            raise PartitionError(f"{schema}.{table} has no foreign key {name}")
        rows = [self._all(state, *at) for at in ((own[0].schema_name, own[0].table_name), (own[0].parent_schema or own[0].schema_name, own[0].parent))]
        broken = checks.foreign_key_violations(rows[0], list(own[0].columns), rows[1], list(own[0].parent_columns)).count()

        def change(state: State) -> None:
            state.foreign_keys = [replace(f, valid=broken == 0) if f == own[0] else f for f in state.foreign_keys]

        self.registry.update(change)
        return broken

    # -- conversion

    def partition_table(self, schema: str, table: str, key_column: str, start, end, interval: str, type: str, nopk: bool = False, move_trg: bool = False, validate: bool = True) -> bool:
        """Partitions a table by range: `native` or `inheritance`."""
        kind = type.strip().lower()
        if kind == "native":
            return self.partition_native(schema, table, key_column, start, end, interval, nopk, move_trg, validate)
        if kind == "inheritance":
            return self.partition_inheritance(schema, table, key_column, start, end, interval, validate)
        raise PartitionError(f"a partition type of {type!r} is not supported: native or inheritance")

    def _convert(self, plan, schema: str, table: str, column: str, start, end, interval: str, validate: bool, change_more) -> bool:
        state = self.registry.load()
        own = state.table(schema, table)
        if own.strategy:
            raise PartitionError(f"{schema}.{table} is partitioned already")
        columns = {f.name.lower(): f for f in self._schema(own).fields}
        if column.lower() not in columns:
            raise UnsupportedKey(f"{schema}.{table} has no column {column}")
        column = columns[column.lower()].name
        key = KeyType.of(columns[column.lower()].dataType)
        new = plan(schema, table, column, key, start, end, interval, own.path, self._folder(own))
        if validate:
            bad = self.spark.read.parquet(own.path).where(checks.outside(column, key, new[0].lower, new[0].upper))
            if not bad.isEmpty():
                raise OutOfRange(f"{schema}.{table} has rows outside {new[0].bounds()} or without a key")

        def change(state: State):
            now = state.table(schema, table)
            if now.strategy:
                raise PartitionError(f"{schema}.{table} is partitioned already")
            state.partitions += new
            state.replace_table(replace(now, key_column=column, key_type=key.value, strategy=new[0].strategy))
            change_more(state, new)
            return True

        return self.registry.update(change)

    def partition_native(self, schema, table, key_column, start, end, interval, nopk=False, move_trg=False, validate=True) -> bool:
        """Adopts the table, without a copy, as the first partition and adds one new partition.

        `nopk`: uniqueness that doesn't include the key is kept by partition, described by a template.
        `validate=False` trusts the bounds without a look at the data. Triggers don't exist here.
        """
        if move_trg:
            log.warning("there are no triggers to move")

        def more(state: State, new: list[Partition]):
            own = state.table(schema, table)
            mammoth, child = new[0].partition_name, new[1].partition_name
            if nopk:
                state.replace_table(replace(own, template=True))
            # the old indexes and keys belong to mammoth; parent, child and template get their like
            at = (own.schema_name, own.table_name)
            old = [i for i in state.indexes if (i.schema_name, i.table_name) == at]
            keys = [f for f in state.foreign_keys if (f.schema_name, f.table_name) == at]
            state.indexes = [i for i in state.indexes if i not in old]
            state.foreign_keys = [f for f in state.foreign_keys if f not in keys]
            for to in [mammoth, child, own.table_name] + [named(own.table_name, "template")] * nopk:
                _add_indexes(state, [i for i in old if not (nopk and to == own.table_name and i.unique)], own.table_name, to)
                _add_foreign_keys(state, keys, own.table_name, to)
            # a key that refers to the table refers to the parent from now on, whose rows are the same: it stays as valid as it was
            state.replace_partition(replace(new[0], options=dict(own.options)))
            if own.options:
                log.info("options of %s.%s stay with its first partition: %s", own.schema_name, own.table_name, own.options)

        return self._convert(layouts.plan_native, schema, table, key_column, start, end, interval, validate, more)

    def partition_inheritance(self, schema, table, key_column, start, end, interval, validate=True) -> bool:
        """Adopts the table as a first child with inclusive bounds; a new child and an overflow child follow."""
        state = self.registry.load()
        if any(f.refers_to(fold(schema), fold(table)) for f in state.foreign_keys):
            raise PartitionError(f"{schema}.{table} is referenced by a foreign key")

        def more(state: State, new: list[Partition]):
            for p in new[1:]:
                _copy_indexes(state, fold(schema), fold(table), p.partition_name)
                _copy_foreign_keys(state, fold(schema), fold(table), p.partition_name)

        return self._convert(layouts.plan_inheritance, schema, table, key_column, start, end, interval, validate, more)

    # -- details

    def partition_get_last_partition_details(self, schema: str, table: str, range_id: str | None = None) -> DataFrame:
        """(childrelname, range) of the attached partition with the highest bounds: one row or none."""
        last = self._last(self.registry.load(), schema, table, range_id)
        return self.spark.createDataFrame([(last.partition_name, last.bounds())] if last else [], "childrelname string, range array<string>")

    @staticmethod
    def _last(state: State, schema: str, table: str, range_id: str | None) -> Partition | None:
        own = [p for p in state.children(schema, table) if p.kind == "regular" and (range_id is None or p.range_id == range_id)]
        return max(own, key=lambda p: p.lower, default=None)

    def partition_calculate_free_partitions(self, schema: str, table: str, range_id: str | None = None, as_of: date | None = None) -> int:
        """How many partitions lie ahead of the data, or of today; the fewest of several ranges."""
        state = self.registry.load()
        own = state.partitioned(schema, table)
        if range_id and own.key_type != "int":
            raise UnsupportedKey("only tables with an integer key have ranges")
        free = self._free(state, own, as_of)
        return free.get(range_id, 0) if range_id else min(free.values(), default=0)

    def _free(self, state: State, own: Table, as_of: date | None, maxima: dict[str | None, int] | None = None) -> dict[str | None, int]:
        """Free partitions by range; a mammoth beside ranges is none."""
        ps = [p for p in state.children(own.schema_name, own.table_name) if p.lower is not None]
        if any(p.range_id for p in ps):
            ps = [p for p in ps if p.range_id or p.kind != "mammoth"]
        found = maxima
        if own.key_type == "int":
            found = self.spark.createDataFrame(list((maxima if maxima is not None else self._max_keys(state, own)).items()), "range_id string, max_key long")
        rows = planners.free_partitions(layouts.frame(self.spark, ps, state.version), found, as_of or today()).collect()
        return {r.range_id: r.free for r in rows}

    # -- growth

    def partition_add_up_to_nr_of_free_partitions(self, schema: str, table: str, nr: int, as_of: date | None = None) -> bool:
        """Adds partitions after the last until `nr` lie ahead, in each range; False if another writer won each time."""
        as_of = as_of or today()

        def change(state: State):
            own = state.partitioned(schema, table)
            maxima = self._max_keys(state, own) if own.key_type == "int" else {}
            for range_id, free in self._free(state, own, as_of, maxima or None).items():
                if free >= nr:
                    continue
                last = self._last(state, schema, table, range_id)
                if last is None:
                    raise PartitionError(f"{schema}.{table} has no partition to go on from")
                if own.key_type == "int":
                    ahead = lambda lower, top=maxima[range_id]: lower > top
                else:
                    ahead = lambda lower: lower.date() > as_of
                new = layouts.plan_growth(last, free, nr, ahead, self._folder(own))
                state.partitions += new
                for p in new:
                    _copy_indexes(state, own.schema_name, last.partition_name, p.partition_name)

        return self._published(change)

    def _max_keys(self, state: State, own: Table) -> dict[str | None, int]:
        """The greatest key below the last bound of each range, 0 without rows.

        Each range's partitions are looked at from the top down, all ranges in one job a round: one round
        usually, however large the table and however many its ranges.
        """
        ps = [p for p in state.children(own.schema_name, own.table_name) if p.upper is not None]
        tops = {r: max((p for p in ps if p.range_id == r), key=lambda p: p.upper) for r in {p.range_id for p in ps}}
        readable = sorted(self.registry.existing(ps), key=lambda p: p.upper)
        left = {r: [p for p in readable if p.lower < top.upper] for r, top in tops.items()}
        out = dict.fromkeys(tops, 0)
        while left := {r: p for r, p in left.items() if p}:
            folders = {f for p in left.values() for f in p.pop().loads}
            data = self.spark.read.schema(self._schema(own)).parquet(*sorted(folders))
            for r in planners.key_maxima(data, [tops[r] for r in left]).collect():
                if r.max_key is not None:
                    out[r.range_id] = r.max_key
                    del left[r.range_id]
        return out

    # -- constraints

    def partition_add_constraints(self, schema: str, table: str, marker: str, column: str) -> int:
        """Records what the data says of a date column in each integer partition; returns how many were new.

        The least value as soon as there are rows, the greatest once the last key is taken. Recorded
        bounds are never refreshed, so inserts are held against them.
        """
        state = self.registry.load()
        own = state.table(schema, table)
        if not own.strategy:
            raise NotPartitioned(f"{schema}.{table} is not partitioned")
        if own.key_type != "int":
            raise UnsupportedKey("only tables with an integer key get date constraints")
        if KeyType.of(self._schema(own)[column].dataType) is KeyType.INT:
            raise UnsupportedKey(f"{column} is neither date nor timestamp")
        ps = [p for p in state.children(schema, table) if p.kind == "regular"]
        name = lambda p, end: f"{p}_{marker}_{end}"
        open_ = [p for p in ps if not {name(p.partition_name, "min"), name(p.partition_name, "max")} <= {c["name"] for c in p.constraints}]
        data = self._read(own, state, (None, None), open_) if open_ else None
        if data is None:
            return 0
        found = {r.partition_name: r for r in planners.date_constraints(data, open_, column).collect()}

        def change(state: State) -> int:
            new = 0
            for p in state.children(schema, table):
                r = found.get(p.partition_name)
                if r is None:
                    continue
                known = {c["name"] for c in p.constraints}
                add = [{"name": name(p.partition_name, end), "column": column, "op": op, "value": str(v)} for end, op, v in (("min", ">=", r.min_value), ("max", "<=", r.max_value)) if v is not None and name(p.partition_name, end) not in known]
                if add:
                    state.replace_partition(replace(p, constraints=p.constraints + tuple(add)))
                    new += len(add)
            return new

        return self.registry.update(change)

    # -- statements

    def partition_add_concurrent_index_on_partitioned_table(self, schema: str, table: str, columns: list[str], method: str = "btree", unique: bool = False) -> DataFrame:
        """(position, table_name, index_name, stmt) to create an index on all children and the parent."""
        state = self.registry.load()
        own = state.table(schema, table)
        taken = self.spark.createDataFrame([(n,) for n in _taken(state, own.schema_name)], "index_name string")
        return ddl.index_statements(layouts.frame(self.spark, state.partitions), taken, schema, table, columns, method, unique, own.key_column, own.template)

    def partition_add_foreign_key_on_partitioned_table(self, schema: str, table: str, constraint: str, parent: str, columns: list[str], parent_columns: list[str], qualify: bool = False) -> DataFrame:
        """(block, position, stmt) to add a foreign key without long locks."""
        state = self.registry.load()
        return ddl.foreign_key_statements(layouts.frame(self.spark, state.partitions), schema, table, constraint, parent, columns, parent_columns, state.table(schema, table).template, qualify)

    # -- detach and drop

    def partition_detach_partition(self, schema: str, parent: str, partition: str, detach_last: bool = True, as_of: date | None = None) -> bool:
        """Detaches a partition and notes it in the journal; by default only the oldest may go.

        False if another writer won each time; nothing is noted then.
        """

        def change(state: State):
            state.table(schema, parent)
            own = state.children(schema, parent)
            p = next((p for p in own if p.partition_name == fold(partition)), None)
            if p is None or p.lower is None:
                raise PartitionError(f"{partition} is no attached partition of {schema}.{parent} with bounds")
            if detach_last:
                oldest = min((x for x in own if x.kind == "regular"), key=lambda x: x.lower, default=None)
                if oldest is None or oldest.partition_name != p.partition_name:
                    raise PartitionError(f"{partition} is not the oldest partition of {schema}.{parent}")
            when = as_of or today()
            state.replace_partition(replace(p, state="detached", detached_date=when))
            state.journal.append({"schema_name": p.schema_name, "parent_name": p.parent_name, "partition_name": p.partition_name, "range": p.bounds(), "detached_date": when})

        return self._published(change)

    def partition_drop_detached_partition(self, schema: str, parent: str, partition: str, purge: bool = False) -> bool:
        """Drops a partition that is detached and noted in the journal.

        Files go after the registry has been published. Files that were adopted, outside the manager's
        folder, go only with `purge`.
        """

        def change(state: State) -> Partition:
            state.table(schema, parent)
            key = (fold(schema), fold(parent), fold(partition))
            if not any((j["schema_name"], j["parent_name"], j["partition_name"]) == key for j in state.journal):
                raise PartitionError(f"{partition} is not noted as detached from {schema}.{parent}")
            own = [p for p in state.partitions if p.schema_name == key[0] and p.partition_name == key[2]]
            if not own:
                raise PartitionError(f"there is no partition {partition}")
            if any(p.state == "attached" for p in own):
                raise PartitionError(f"{partition} is attached")
            state.partitions = [p for p in state.partitions if p not in own]
            state.indexes = [i for i in state.indexes if (i.schema_name, i.table_name) != (key[0], key[2])]
            state.foreign_keys = [f for f in state.foreign_keys if (f.schema_name, f.table_name) != (key[0], key[2])]
            state.journal = [j for j in state.journal if (j["schema_name"], j["parent_name"], j["partition_name"]) != key]
            return own[0]

        gone = self.registry.update(change)
        for folder in (gone.path, *gone.loads):
            if folder and (purge or folder.startswith(f"{self.root}/")):
                self.registry.delete_data(folder)
        return True

    def partition_reattach(self, schema: str, parent: str, partition: str) -> bool:
        """Takes a detached partition back, with the bounds that the journal has noted; False if another writer won each time."""

        def change(state: State):
            key = (fold(schema), fold(parent), fold(partition))
            noted = next((j for j in state.journal if (j["schema_name"], j["parent_name"], j["partition_name"]) == key), None)
            p = next((p for p in state.children(schema, parent, "detached") if p.partition_name == key[2]), None)
            if noted is None or p is None:
                raise PartitionError(f"{partition} is not noted as detached from {schema}.{parent}")
            if noted["range"] != p.bounds():
                raise PartitionError(f"{partition} was noted with bounds {noted['range']} and has {p.bounds()}")
            self._no_overlap(state, p)
            state.replace_partition(replace(p, state="attached", detached_date=None))
            state.journal = [j for j in state.journal if j is not noted]

        return self._published(change)

    def partition_attach(self, schema: str, parent: str, partition: str, path: str | None = None, lower=None, upper=None, range_id: str | None = None, default: bool = False, validate: bool = True) -> bool:
        """Makes a Parquet folder, or nothing yet, a partition [lower, upper), or the default partition.

        The range comes from a name `<parent>_r<digits>_...` unless it is given: so layouts with several
        ranges are made or imported. Rows outside the bounds fail it; of the default, rows inside those of others.
        """
        state = self.registry.load()
        own = state.partitioned(schema, parent)
        key, name = KeyType(own.key_type), fold(partition)
        if not default and (lower is None or upper is None or not key.parse(lower) < key.parse(upper)):
            raise PartitionError(f"bounds {lower} and {upper} of {partition} don't ascend")
        bounds = (None, None) if default else (key.parse(lower), key.parse(upper))
        new = Partition(own.schema_name, own.table_name, name, own.key_column, own.key_type, *bounds, path=path or f"{self._folder(own)}/{name}", range_id=None if default else range_id or range_of(name, own.table_name), kind="default" if default else "regular")
        others = [p for p in state.children(schema, parent) if p.lower is not None]
        if path and validate:
            rows = self.spark.read.parquet(path)
            bad = routing.route(rows, [*others, new]).where(F.col(routing.PARTITION) != name) if default else rows.where(checks.outside(own.key_column, key, *bounds))
            if not bad.isEmpty():
                raise OutOfRange(f"{path} has rows that don't belong in {partition}")
        spare = [p for p in state.children(schema, parent) if p.kind == "default"]
        if validate and spare and not default:
            held = self._read(own, state, (None, None), spare)
            if held is not None and not held.where(~checks.outside(own.key_column, key, *bounds)).isEmpty():
                raise OutOfRange(f"the default partition has rows that belong in {partition}")

        def change(state: State):
            own = state.children(schema, parent)
            if any(p.schema_name == new.schema_name and p.partition_name == name for p in state.partitions) or (default and any(p.kind == "default" for p in own)):
                raise PartitionError(f"{schema}.{parent} has a partition {partition}, or a default, already")
            self._no_overlap(state, new)
            state.partitions.append(new)
            like = next((p.partition_name for p in reversed(own) if p.lower is not None), None)
            if like:
                _copy_indexes(state, new.schema_name, like, name)

        return self._published(change)

    def _no_overlap(self, state: State, new: Partition) -> None:
        for p in state.children(new.schema_name, new.parent_name):
            # the adopted table beside ranges of its own bounds, as several ranges have it, is no overlap
            if p.lower is not None and new.lower is not None and p.lower < new.upper and new.lower < p.upper and not (p.kind == "mammoth" and new.range_id):
                raise PartitionError(f"{new.partition_name} overlaps {p.partition_name}")

    def _published(self, change) -> bool:
        try:
            self.registry.update(change)
        except Conflict:
            return False
        return True

    # -- tables like others

    def partition_create_table_inherits_from_template(self, schema: str, template: str, suffix: str) -> bool:
        """An empty table `<template>_<suffix>` with the template's columns and options."""
        state = self.registry.load()
        own = state.table(schema, template)
        name = named(own.table_name, fold(suffix))
        path = f"{self.root}/data/{own.schema_name}.{own.table_name}/{name}"
        self.spark.createDataFrame([], self._schema(own)).write.mode("errorifexists").parquet(path)
        self.registry.update(lambda s: s.tables.append(Table(own.schema_name, name, path, options=dict(own.options), columns=own.columns)))
        return True

    def partition_copy_indexes_to_new_table(self, schema: str, template: str, new_table: str) -> bool:
        """The template's indexes for another table, under names made from its own; a second primary key is left out."""
        self.registry.update(lambda s: _copy_indexes(s, fold(schema), fold(template), fold(new_table)))
        return True

    def partition_copy_fk_to_new_table(self, schema: str, template: str, new_table: str) -> bool:
        """The template's foreign keys for another table; one that it has already is left out."""
        self.registry.update(lambda s: _copy_foreign_keys(s, fold(schema), fold(template), fold(new_table)))
        return True

    # -- data

    def _folder(self, own: Table) -> str:
        return f"{self.root}/data/{own.schema_name}.{own.table_name}"

    def _schema(self, own: Table) -> StructType:
        return StructType.fromJson(json.loads(own.columns))

    def _all(self, state: State, schema: str, table: str) -> DataFrame:
        """All rows of a table, partitioned or plain."""
        own = state.table(schema, table)
        return self.scan(schema, table) if own.strategy else self.spark.read.schema(self._schema(own)).parquet(own.path)

    def _read(self, own: Table, state: State, key: scans.Bounds, partitions: list[Partition] | None = None) -> DataFrame | None:
        ps = self.registry.existing(partitions if partitions is not None else state.children(own.schema_name, own.table_name))
        return scans.scan(self.spark, ps, own.key_column, self._schema(own), key) if ps else None

    def scan(self, schema: str, table: str, key: scans.Bounds = (None, None), where: dict[str, scans.Bounds] | None = None) -> DataFrame:
        """Rows with keys in [low, high) and values in the bounds of `where`, from the folders that can hold them."""
        state = self.registry.load()
        own = state.table(schema, table)
        if not own.strategy:
            raise NotPartitioned(f"{schema}.{table} is not partitioned")
        ps = self.registry.existing(state.children(schema, table))
        return scans.scan(self.spark, ps, own.key_column, self._schema(own), key, where)

    def insert(self, schema: str, table: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Appends rows to the partitions that their keys belong to: one write, then one version that names its folders.

        A row without a partition, or against a recorded constraint, fails the insert, and nothing is
        visible before the version is there. If meanwhile another writer has changed a partition that rows
        went to, they are routed again. `batch` (stream, number) is published too; False if it was before.
        """
        for attempt in range(1, self.registry.attempts + 1):
            state = self.registry.load()
            if batch and state.streams.get(batch[0], -1) >= batch[1]:
                return False
            try:
                return self._insert(state, schema, table, rows, batch)
            except Conflict:
                if attempt == self.registry.attempts:
                    raise

    def _insert(self, state: State, schema: str, table: str, rows: DataFrame, batch: tuple[str, int] | None) -> bool:
        own = state.table(schema, table)
        ps = state.children(schema, table)
        if not own.strategy:
            raise NotPartitioned(f"{schema}.{table} is not partitioned")
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema(own).fields])
        load, seen, bad = f"{self._folder(own)}/loads/{uuid.uuid4().hex}", Observation(), routing.broken(ps)
        routed = routing.route(rows, ps)
        # bad rows are counted as they are written
        routed = routed.observe(seen, F.count(F.when(F.col(routing.PARTITION).isNull(), 1)).alias("lost"), F.count(F.when(F.lit(False) if bad is None else bad, 1)).alias("broken"))
        published = False
        try:
            routed.hint("rebalance", routing.PARTITION).write.partitionBy(routing.PARTITION).parquet(load)
            escape, start = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName, f"{routing.PARTITION}="
            written = {n for n in self.registry.names(load) if n.startswith(start)}
            found = seen.get if written else {"lost": 0, "broken": 0}  # without rows nothing is observed
            if found["lost"]:
                raise OutOfRange(f"rows have no partition in {schema}.{table}")
            if found["broken"]:
                raise OutOfRange(f"rows break recorded constraints of {schema}.{table}")
            reached = {p.partition_name: p for p in ps if start + escape(p.partition_name) in written}

            def change(state: State) -> bool:
                if batch and state.streams.get(batch[0], -1) >= batch[1]:
                    return False
                now = {p.partition_name: p for p in state.children(schema, table)}
                for name, p in reached.items():
                    if name not in now or replace(now[name], loads=p.loads) != p:
                        raise Conflict(f"{name} has been changed while rows were written to it")
                    state.replace_partition(replace(now[name], loads=now[name].loads + (f"{load}/{start}{escape(name)}",)))
                if batch:
                    state.streams[batch[0]] = batch[1]
                return True

            published = self.registry.update(change)
            return published
        finally:
            if not published:
                self.registry.delete_data(load)


def _taken(state: State, schema: str) -> set[str]:
    return {i.index_name for i in state.indexes if i.schema_name == schema}


def _renamed(name: str, old: str, new: str) -> str:
    """The index's name for another table: the old table's name replaced, or the new one's put first."""
    return name.replace(old, new) if old in name else f"{new}_{name}"


def _add_indexes(state: State, indexes: list[Index], template: str, new: str) -> None:
    """The like of these indexes of a template for another table, under names that no other index has."""
    names = Names(_taken(state, indexes[0].schema_name) if indexes else ())
    for i in indexes:
        name, ending = (f"{new}_pkey", "_pkey") if i.primary else (_renamed(i.index_name, template, new), "_idx")
        state.indexes.append(replace(i, table_name=new, index_name=names.unused(name, ending)))


def _copy_indexes(state: State, schema: str, template: str, new: str) -> None:
    own = [i for i in state.indexes if (i.schema_name, i.table_name) == (schema, template)]
    if any(i.primary for i in state.indexes if (i.schema_name, i.table_name) == (schema, new)) and any(i.primary for i in own):
        log.info("%s.%s has a primary key already", schema, new)
        own = [i for i in own if not i.primary]
    _add_indexes(state, own, template, new)


def _add_foreign_keys(state: State, keys: list[ForeignKey], template: str, new: str) -> None:
    for f in keys:
        name = f.name.replace(template, new)
        if not any((x.schema_name, x.table_name, x.name) == (f.schema_name, new, name) for x in state.foreign_keys):
            state.foreign_keys.append(replace(f, table_name=new, name=name))


def _copy_foreign_keys(state: State, schema: str, template: str, new: str) -> None:
    _add_foreign_keys(state, [f for f in state.foreign_keys if (f.schema_name, f.table_name) == (schema, template)], template, new)
