"""The maintenance run: add, constrain, detach, drop, in that order."""

from __future__ import annotations

import logging
from datetime import date

from .manager import PartitionManager, today
from .plans import planners
from .types import LOGGER, PartitionError

log = logging.getLogger(LOGGER)


def run(manager: PartitionManager, as_of: date | None = None, strict_auto: bool = False) -> list[dict]:
    """Carries out what the configuration asks for and returns a record of each action.

    Only adding heeds `auto-maintenance`; with `strict_auto` the other steps do too. A table whose
    oldest partition can't be detached keeps the rest for the next run.
    """
    as_of = as_of or today()
    registry, done = manager.registry, []

    def note(step: str, schema: str, table: str, what: str, result) -> None:
        done.append({"step": step, "schema_name": schema, "table_name": table, "what": what, "result": result})

    for r in planners.add_requests(registry.configuration(), registry.partitions()).orderBy("schema_name", "parent_name").collect():
        note("add", r.schema_name, r.parent_name, str(r.wanted), manager.partition_add_up_to_nr_of_free_partitions(r.schema_name, r.parent_name, r.wanted, as_of))
    for schema, table, marker, column in planners.constraint_requests(registry.configuration(), strict_auto):
        note("constrain", schema, table, f"{marker}:{column}", manager.partition_add_constraints(schema, table, marker, column))
    stopped = set()
    for r in planners.detach_candidates(registry.partitions(), registry.configuration(), as_of, strict_auto).collect():
        if (r.schema_name, r.parent_name) in stopped:
            continue
        try:
            ok = manager.partition_detach_partition(r.schema_name, r.parent_name, r.partition_name, as_of=as_of)
        except PartitionError as e:
            log.warning("%s", e)
            ok = False
        note("detach", r.schema_name, r.parent_name, r.partition_name, ok)
        if not ok:
            stopped.add((r.schema_name, r.parent_name))
    for r in planners.drop_candidates(registry.journal(), registry.configuration(), as_of, strict_auto).collect():
        note("drop", r.schema_name, r.parent_name, r.partition_name, manager.partition_drop_detached_partition(r.schema_name, r.parent_name, r.partition_name))
    return done
