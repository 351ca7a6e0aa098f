"""Statement text for indexes and foreign keys of a partitioned table; nothing is executed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..types import LONGEST, Names, PartitionError, fold, named

#: The index methods that are known.
METHODS = ("btree", "hash", "gist", "spgist", "gin", "brin")


def bare(column: str) -> str:
    """The column of an index expression: `lower(extra)` and `extra desc nulls first` are both extra."""
    word = column.split(" ")[0]
    inner = re.fullmatch(r".*\((.*)\)", word)
    return inner[1] if inner else word


def quoted(name: str) -> str:
    return name if re.fullmatch(r"[a-z_][a-z0-9_$]*", name) else '"' + name.replace('"', '""') + '"'


def _children(registry: DataFrame, schema: str, table: str) -> DataFrame:
    return registry.where((F.col("schema_name") == schema) & (F.col("parent_name") == table) & (F.col("state") == "attached")).select(F.lit(1).alias("ord"), F.col("partition_name").alias("table_name"))


def _with_parents(children: DataFrame, table: str, parent: bool, template: bool) -> DataFrame:
    spark: SparkSession = children.sparkSession
    more = [(2, table)] * parent + [(3, named(table, "template"))] * template
    return children.unionAll(spark.createDataFrame(more, "ord int, table_name string")) if more else children


def index_statements(registry: DataFrame, taken: DataFrame, schema: str, table: str, columns: list[str], method: str = "btree", unique: bool = False, key_column: str | None = None, template: bool = False) -> DataFrame:
    """(position, table_name, index_name, stmt): children concurrently, then the parent, then its template.

    The parent is left out if the index is unique and lacks the key. `taken` has the schema's index
    names; a name that is taken, by it or by an earlier one of these, gets a number before `_idx`.
    """
    schema, table, method = fold(schema), fold(table), method.lower()
    if method not in METHODS:
        raise PartitionError(f"index method {method} is not supported")
    names = [bare(c).lower() for c in columns]
    work = _with_parents(_children(registry, schema, table), table, not unique or (key_column or "").lower() in names, template)
    names_of = Names(r.name for r in taken.select(F.lower("index_name").alias("name")).collect())
    rows = sorted(tuple(r) for r in work.select("ord", "table_name").collect())  # as many as the registry has partitions
    numbered = [(o, t, names_of.unused(f"{t.lower()}_{'_'.join(names)}"[: LONGEST - 4])) for o, t in rows]
    work = registry.sparkSession.createDataFrame(numbered, "ord int, table_name string, name string")
    position, total = F.row_number().over(Window.orderBy("ord", "name")), F.count(F.lit(1)).over(Window.partitionBy())
    kind, body = ("unique index " if unique else "index "), ", ".join(c.lower() for c in columns)
    statement = F.concat(F.lit("/* Creating index "), position.cast("string"), F.lit(" of "), total.cast("string"), F.lit(f" */ create {kind}"), F.when(F.col("ord") == 1, "concurrently ").otherwise(""), "name", F.lit(f" on {quoted(schema)}."), "table_name", F.lit(f" using {method} ({body});"))
    return work.select(position.alias("position"), "table_name", F.col("name").alias("index_name"), statement.alias("stmt")).orderBy("position")


def foreign_key_statements(registry: DataFrame, schema: str, table: str, constraint: str, parent: str, columns: list[str], parent_columns: list[str], template: bool = False, qualify: bool = False) -> DataFrame:
    """(block, position, stmt): add to each child unvalidated, validate each, then add to parent and template."""
    schema, table = fold(schema), fold(table)
    if len(columns) != len(parent_columns):
        raise PartitionError("a foreign key needs as many columns as it references")
    own, other = (", ".join(quoted(c.lower()) for c in cs) for cs in (columns, parent_columns))
    target = f"{quoted(schema)}.{quoted(parent)}" if qualify else quoted(parent)
    adding = f" add constraint {quoted(constraint)} foreign key ({own}) references {target}({other})"
    children = _children(registry, schema, table)
    n = F.row_number().over(Window.orderBy("table_name"))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    alter = F.concat(F.lit(f"alter table {quoted(schema)}."), F.col("table_name"))
    added = children.select(F.lit(1).alias("block"), n.alias("position"), F.concat(alter, F.lit(f"{adding} not valid;")).alias("stmt"))
    validated = children.select(F.lit(2).alias("block"), n.alias("position"), F.concat(F.lit("/* Validating constraint "), n.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" */ "), alter, F.lit(f" validate constraint {quoted(constraint)};")).alias("stmt"))
    whole = [(3, 1, f"alter table {quoted(schema)}.{quoted(table)}{adding};")] + [(4, 1, f"alter table {quoted(schema)}.{named(table, 'template')}{adding};")] * template
    return added.unionAll(validated).unionAll(registry.sparkSession.createDataFrame(whole, "block int, position int, stmt string")).orderBy("block", "position")
