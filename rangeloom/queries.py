"""Queries over the driver's tables, one for each operator, with SQL that has to give the same rows."""

from __future__ import annotations

import json
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maintenance
from .functions.intervals import Interval, age_days, age_months, next_upper, plus
from .manager import PartitionManager
from .operators import checks, ddl, routing
from .plans import layouts, planners
from .sources.shared import delete_at_exit, shared_folder
from .types import KeyType, Partition, replace

AS_OF = date(2001, 3, 15)  # for tables with an integer key, which have no use for it
LONG = "t" * 59
CONFIGURATION = [
    ("public", "Orders", {"auto-maintenance": True, "nr": 4, "detach": "13 months", "drop_detached": "2 days"}),
    ("public", "events", {"auto-maintenance": True, "date_constraint": {"marker": "ts", "constraint_column": "ts"}}),
    ("public", "lineitem", {"auto-maintenance": False, "nr": 9, "detach": "2 years", "drop_detached": "1 month"}),
]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events_layout(events: DataFrame) -> list[Partition]:
    """Steps of 250 ids after an adopted part of 500, three of them free."""
    top = events.agg(F.max("event_id")).first()[0] or 0
    first = layouts.plan_native("public", "events", "event_id", KeyType.INT, 0, 500, "250")
    ahead = lambda lower: lower > top
    return first + layouts.plan_growth(first[1], int(ahead(first[1].lower)), 3, ahead)


def _span(spark: SparkSession, d: str, table: str = "orders", column: str = "o_orderdate") -> tuple[date, date]:
    """The first day of the table's first month, and the day of the last order, which is today."""
    first = _table(spark, d, table).agg(F.date_trunc("month", F.min(column)).cast("date")).first()[0]
    return first, _table(spark, d, "orders").agg(F.max("o_orderdate").cast("date")).first()[0]


def _after(day: date, step: str) -> date:
    return plus(KeyType.DATE.parse(day), Interval.parse(step)).date()


def _time_layout(table: str, column: str, key: KeyType, start: date, end: date, step: str, as_of: date, wanted: int = 3) -> list[Partition]:
    first = layouts.plan_native("public", table, column, key, start, end, step)
    ahead = lambda lower: lower.date() > as_of
    return first + layouts.plan_growth(first[1], int(ahead(first[1].lower)), wanted, ahead)


def _yearly(spark, d, table: str, column: str, wanted: int = 3) -> list[Partition]:
    """Months after a first part of a year."""
    first, as_of = _span(spark, d, table, column)
    return _time_layout(table, column, KeyType.TIMESTAMP, first, _after(first, "1 year") - timedelta(days=1), "1 month", as_of, wanted)


def _orders_layout(spark, d) -> list[Partition]:
    return _yearly(spark, d, "orders", "o_orderdate")


def _lineitem_layout(spark, d) -> list[Partition]:
    return _yearly(spark, d, "lineitem", "l_shipdate", 12)


def _bounds(layout: DataFrame) -> DataFrame:
    return layout.select("partition_name", "kind", planners.lower_text().alias("lower_bound"), planners.upper_text().alias("upper_bound"))


def _configuration(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t, json.dumps(c)) for s, t, c in CONFIGURATION], "schema_name string, table_name string, configuration string")


def _journal(spark: SparkSession, d: str) -> DataFrame:
    """Detached at, and a day after, what the cool-down of each table allows today."""
    as_of = _span(spark, d)[1]
    rows = [("public", "orders", "orders_a", as_of - timedelta(days=4)), ("public", "orders", "orders_b", as_of - timedelta(days=3)), ("public", "lineitem", "lineitem_a", _after(as_of, "-1 month")), ("public", "lineitem", "lineitem_b", _after(as_of, "-1 month") + timedelta(days=1)), ("public", "part", "part_a", date(1999, 1, 1))]
    return spark.createDataFrame(rows, "schema_name string, parent_name string, partition_name string, detached_date date")


def date_constraint_events(spark, d):
    events = _table(spark, d, "events")
    return planners.date_constraints(events, [p for p in _events_layout(events) if p.kind == "regular"], "ts").withColumnRenamed("rows", "n_rows")


def free_partitions_int(spark, d):
    events = _table(spark, d, "events")
    ps = _events_layout(events)
    return planners.free_partitions(layouts.frame(spark, ps), planners.key_maxima(events, ps), AS_OF)


def free_partitions_date(spark, d):
    return planners.free_partitions(layouts.frame(spark, _orders_layout(spark, d)), None, _span(spark, d)[1])


def free_partitions_multirange(spark, d):
    """Two ranges of order keys with their own last partitions; r1 has the data."""
    orders = _table(spark, d, "orders")
    base = Partition("public", "orders", "", "o_orderkey", "int", 0, 1)
    ps = [replace(base, partition_name=f"orders_{r}_{lo}_{lo + step}", range_id=r, lower=lo, upper=lo + step) for r, start, step, n in (("r1", 0, 500, 4), ("r2", 1_000_000_000, 1000, 5)) for lo in range(start, start + n * step, step)]
    free = planners.free_partitions(layouts.frame(spark, ps), planners.key_maxima(orders, ps), AS_OF)
    return free.select("range_id", "free").unionAll(free.agg(F.lit("least").alias("range_id"), F.min("free").alias("free")))


def last_partition(spark, d):
    ps = _events_layout(_table(spark, d, "events")) + _orders_layout(spark, d)
    return planners.last_partitions(layouts.frame(spark, ps))


def oldest_partition(spark, d):
    ps = _events_layout(_table(spark, d, "events")) + _orders_layout(spark, d)
    return planners.oldest_partitions(layouts.frame(spark, ps))


def growth_int(spark, d):
    return _bounds(layouts.frame(spark, _events_layout(_table(spark, d, "events"))))


def growth_weekly(spark, d):
    first, as_of = _span(spark, d)
    return _bounds(layouts.frame(spark, _time_layout("orders", "o_orderdate", KeyType.TIMESTAMP, first, as_of - timedelta(days=200), "1 week", as_of)))


def growth_monthly(spark, d):
    first, as_of = _span(spark, d)
    return _bounds(layouts.frame(spark, _time_layout("orders", "o_orderdate", KeyType.DATE, first, _after(as_of.replace(day=1), "-18 months"), "1 month", as_of)))


def growth_month_end(spark, d):
    """From the last day of January to that of February; then as many days on as there are between, then whole months."""
    first, as_of = _span(spark, d)
    return _bounds(layouts.frame(spark, _time_layout("orders", "o_orderdate", KeyType.DATE, first, date(as_of.year - 1, 1, 31), "1 month", as_of)))


def _counted(data: DataFrame, ps: list[Partition]) -> DataFrame:
    return planners.partition_statistics(data, ps).select("partition_name", F.col("rows").alias("n_rows"))


def native_layout_int(spark, d):
    orders = _table(spark, d, "orders")
    ps = layouts.plan_native("public", "orders", "o_orderkey", KeyType.INT, 0, 700, "500")
    return _counted(orders, ps + layouts.plan_growth(ps[1], 0, 3, lambda lower: True))


def native_layout_date(spark, d):
    first, as_of = _span(spark, d)
    return _counted(_table(spark, d, "orders"), _time_layout("orders", "o_orderdate", KeyType.DATE, first, _after(first, "1 year"), "1 month", as_of))


def native_layout_ts(spark, d):
    return _counted(_table(spark, d, "events"), _time_layout("events", "ts", KeyType.TIMESTAMP, date(2024, 1, 1), date(2024, 1, 3), "1 day", AS_OF, 20))


def inheritance_layout_int(spark, d):
    """Inclusive bounds; what lies outside all of them, as key 0, overflows."""
    return _routed(_table(spark, d, "orders"), layouts.plan_inheritance("public", "orders", "o_orderkey", KeyType.INT, 1, 499, "500"))


def _inheriting(spark, d) -> tuple[list[Partition], list[Partition]]:
    """Orders by date: two years, a month, the rest; events by time: ten days, a week, the rest."""
    first, _ = _span(spark, d)
    day = _table(spark, d, "events").agg(F.min("ts").cast("date")).first()[0]
    return (
        layouts.plan_inheritance("public", "orders", "o_orderdate", KeyType.DATE, first, _after(first, "2 years") - timedelta(days=1), "1 month"),
        layouts.plan_inheritance("public", "events", "ts", KeyType.TIMESTAMP, day.isoformat(), (day + timedelta(days=9)).isoformat(), "1 week"),
    )


def _routed(data: DataFrame, ps: list[Partition]) -> DataFrame:
    return routing.route(data, ps).groupBy(F.col(routing.PARTITION).alias("partition_name")).agg(F.count(F.lit(1)).alias("n_rows"))


def inheritance_layout_date(spark, d):
    return _routed(_table(spark, d, "orders"), _inheriting(spark, d)[0])


def inheritance_layout_ts(spark, d):
    return _routed(_table(spark, d, "events"), _inheriting(spark, d)[1])


def partition_names(spark, d):
    n = _table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    ps = layouts.plan_native("public", "Neg", "k", KeyType.INT, -3 * n, -2 * n, str(n))
    return _bounds(layouts.frame(spark, ps + [p for x in _inheriting(spark, d) for p in x] + [replace(p, partition_name=f"native_{p.partition_name}") for p in _orders_layout(spark, d)]))


def route_rows(spark, d):
    return routing.route(_table(spark, d, "lineitem"), _lineitem_layout(spark, d)).groupBy(F.col(routing.PARTITION).alias("partition_name")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").cast("long").alias("quantity"))


def _root(spark: SparkSession) -> str:
    """A folder of a managed table, which goes with the driver: what is returned reads it later."""
    root = f"{shared_folder(spark)}/managed-{uuid.uuid4().hex}"
    delete_at_exit(spark, root)
    return root


def _managed_events(spark: SparkSession, d: str) -> PartitionManager:
    """Events in partitions of a tenth of the ids, with date constraints, under a folder of their own."""
    root = _root(spark)
    events = _table(spark, d, "events")
    n = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    step = max(1, n // 10)
    events.where(F.col("event_id") < step).write.parquet(f"{root}/adopted")
    m = PartitionManager(spark, root, back_off=0)
    m.register("public", "events", f"{root}/adopted", primary_key=["event_id"])
    m.partition_table("public", "events", "event_id", 0, step, str(step), "native")
    m.partition_add_up_to_nr_of_free_partitions("public", "events", 11, AS_OF)
    m.insert("public", "events", events.where(F.col("event_id") >= step))
    m.partition_add_constraints("public", "events", "ts", "ts")
    return m


def _held(m: PartitionManager, table: str) -> DataFrame:
    """Every partition that the registry has, with the rows that a scan finds in it."""
    rows = planners.partition_statistics(m.scan("public", table), m.registry.load().children("public", table)).select("partition_name", F.col("rows").alias("n_rows"))
    return m.registry.partitions().join(rows, "partition_name", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))


def pruned_scan_key(spark, d):
    return _managed_events(spark, d).scan("public", "events", (150, 420)).select("event_id", "user_id", "event_type", "value")


def pruned_scan_constraint(spark, d):
    where = {"ts": (date(2024, 1, 10), date(2024, 1, 12))}
    return _managed_events(spark, d).scan("public", "events", where=where).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def life_cycle(spark, d):
    """Adopt, grow, constrain, detach, drop and purge: what the registry says, and a scan finds, in the end."""
    m = _managed_events(spark, d)
    m.configure("public", "events", {"auto-maintenance": True, "nr": 12, "date_constraint": {"marker": "ts", "constraint_column": "ts"}})
    maintenance.run(m, AS_OF)
    first = m.registry.load().children("public", "events")[1].partition_name
    m.partition_detach_partition("public", "events", first, as_of=AS_OF)
    m.partition_drop_detached_partition("public", "events", first)
    second = m.registry.load().children("public", "events")[1].partition_name
    m.partition_detach_partition("public", "events", second, as_of=AS_OF)
    m.partition_detach_partition("public", "events", "events_mammoth", detach_last=False, as_of=AS_OF)
    m.partition_drop_detached_partition("public", "events", "events_mammoth", purge=True)
    third = m.registry.load().children("public", "events")[0].partition_name
    m.partition_detach_partition("public", "events", third, as_of=AS_OF)
    m.partition_reattach("public", "events", third)
    return _held(m, "events").select("partition_name", "kind", "state", "lower_int", "upper_int", F.size("constraints").cast("long").alias("n_constraints"), "n_rows")


def maintenance_run(spark, d):
    """Two runs over orders by month, the second when the cool-down is over: it drops what the first detached."""
    root, orders = _root(spark), _table(spark, d, "orders")
    first, as_of = _span(spark, d)
    year = _after(first, "1 year")
    old = F.col("o_orderdate") < F.lit(year)
    orders.where(old).write.parquet(f"{root}/adopted")
    m = PartitionManager(spark, root, back_off=0)
    m.install()
    m.register("public", "orders", f"{root}/adopted", primary_key=["o_orderkey"])
    m.partition_table("public", "orders", "o_orderdate", first, year - timedelta(days=1), "1 month", "native")
    m.partition_add_up_to_nr_of_free_partitions("public", "orders", 1, as_of)
    m.insert("public", "orders", orders.where(~old))
    m.configure(*CONFIGURATION[0])
    maintenance.run(m, as_of)
    maintenance.run(m, as_of + timedelta(days=4))
    noted = spark.createDataFrame([(j["partition_name"],) for j in m.registry.load().journal], "partition_name string").withColumn("noted", F.lit(True))
    return _held(m, "orders").join(noted, "partition_name", "left").select("partition_name", "kind", "state", planners.lower_text().alias("lower_bound"), F.coalesce("noted", F.lit(False)).alias("noted"), "n_rows")


def copied_objects(spark, d):
    """An empty registry; a table like orders, with its columns, indexes and foreign keys, copied twice."""
    m = PartitionManager(spark, _root(spark), back_off=0)
    m.install()
    m.register("public", "orders", f"{d}/orders.parquet", primary_key=["o_orderkey"], options={"fillfactor": "90"})
    m.add_index("public", "orders", "orders_custkey_idx", ["o_custkey"])
    m.add_index("public", "orders", "by_status", ["o_orderstatus", "o_orderdate"], "hash")
    m.add_foreign_key("public", "orders", "orders_customer_fk", ["o_custkey"], "customer", ["c_custkey"])
    m.partition_create_table_inherits_from_template("public", "orders", "New")
    m.partition_copy_indexes_to_new_table("public", "orders", "orders_new")
    for _ in range(2):
        m.partition_copy_fk_to_new_table("public", "orders", "orders_new")
    state = m.registry.load()
    new = state.table("public", "orders_new")
    rows = [("column", c, str(i)) for i, c in enumerate(spark.read.parquet(new.path).columns, 1)] + [("option", k, v) for k, v in new.options.items()]
    rows += [("index", i.index_name, f"{i.method} {','.join(i.columns)}") for i in state.indexes if i.table_name == "orders_new"]
    rows += [("foreign key", f.name, f"{','.join(f.columns)} {f.parent_schema}.{f.parent}({','.join(f.parent_columns)})") for f in state.foreign_keys if f.table_name == "orders_new"]
    return spark.createDataFrame(rows, "kind string, name string, what string")


def detach_candidates(spark, d):
    ps = _orders_layout(spark, d) + _lineitem_layout(spark, d)
    return planners.detach_candidates(layouts.frame(spark, ps), _configuration(spark), _span(spark, d)[1])


def drop_candidates(spark, d):
    return planners.drop_candidates(_journal(spark, d), _configuration(spark), _span(spark, d)[1])


def config_expand(spark, d):
    """Entries of a configuration for each nation."""
    entries = F.to_json(F.struct((F.col("n_regionkey") % 2 == 0).alias("auto-maintenance"), F.col("n_nationkey").alias("nr"), F.struct(F.lower("n_name").alias("marker"), F.lit("ts").alias("constraint_column")).alias("date_constraint")))
    nations = _table(spark, d, "nation").select(F.lit("Public").alias("schema_name"), F.col("n_name").alias("table_name"), entries.alias("configuration"))
    return planners.expand_configuration(nations)


def add_requests(spark, d):
    ps = _orders_layout(spark, d) + _events_layout(_table(spark, d, "events")) + _lineitem_layout(spark, d)
    return planners.add_requests(_configuration(spark), layouts.frame(spark, ps))


def maintenance_plan(spark, d):
    """What the four steps would do, in one table."""
    ps, conf = layouts.frame(spark, _orders_layout(spark, d) + _events_layout(_table(spark, d, "events")) + _lineitem_layout(spark, d)), _configuration(spark)
    as_of = _span(spark, d)[1]
    out = planners.add_requests(conf, ps).select(F.lit("add").alias("step"), "parent_name", F.col("wanted").cast("string").alias("what"))
    wanted = [(t, f"{m}:{c}") for _, t, m, c in planners.constraint_requests(conf)]
    out = out.unionAll(spark.createDataFrame(wanted, "parent_name string, what string").select(F.lit("constrain").alias("step"), "parent_name", "what"))
    out = out.unionAll(planners.detach_candidates(ps, conf, as_of).select(F.lit("detach").alias("step"), "parent_name", "partition_name"))
    return out.unionAll(planners.drop_candidates(_journal(spark, d), conf, as_of).select(F.lit("drop").alias("step"), "parent_name", "partition_name"))


def index_ddl(spark, d):
    """With a template, and two names that are taken."""
    taken = spark.createDataFrame([("orders_mammoth_o_custkey_o_orderstatus_idx",), ("orders_o_custkey_o_orderstatus_idx",), ("orders_o_custkey_o_orderstatus1_idx",)], "index_name string")
    out = ddl.index_statements(layouts.frame(spark, _orders_layout(spark, d)), taken, "public", "Orders", ["o_custkey desc", "lower(o_orderstatus)"], key_column="o_orderdate", template=True)
    return out.select(F.col("position").cast("long").alias("position"), "table_name", "index_name", "stmt")


def index_ddl_long(spark, d):
    """As many partitions as remainders of order keys, whose names differ beyond what an index name keeps of them."""
    keys = sorted(r[0] for r in _table(spark, d, "orders").select((F.col("o_orderkey") % 152).alias("k")).distinct().collect())
    ps = [Partition("public", LONG, f"{LONG}_{k}", "o_orderkey", "int", k, k + 1) for k in keys]
    out = ddl.index_statements(layouts.frame(spark, ps), spark.createDataFrame([], "index_name string"), "public", LONG, ["o_custkey"])
    return out.select(F.col("position").cast("long").alias("position"), "table_name", "index_name", "stmt")


def index_ddl_unique(spark, d):
    """Without the key, only the children can be unique."""
    out = ddl.index_statements(layouts.frame(spark, _orders_layout(spark, d)), spark.createDataFrame([], "index_name string"), "public", "orders", ["o_orderkey"], "hash", True, "o_orderdate")
    return out.select(F.col("position").cast("long").alias("position"), "stmt")


def fk_ddl(spark, d):
    out = ddl.foreign_key_statements(layouts.frame(spark, _orders_layout(spark, d)), "public", "orders", "orders_customer_fk", "customer", ["o_custkey", "O_Tenant"], ["c_custkey", "c_tenant"], template=True)
    return out.select(F.col("block").cast("long").alias("block"), F.col("position").cast("long").alias("position"), "stmt")


def unique_violations(spark, d):
    return checks.unique_violations(_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def fk_violations(spark, d):
    parent = _table(spark, d, "customer").where("c_custkey >= 50")
    return checks.foreign_key_violations(_table(spark, d, "orders"), ["o_custkey"], parent, ["c_custkey"]).select("o_orderkey", "o_custkey")


def range_validation(spark, d):
    return checks.range_violations(_table(spark, d, "orders"), "o_orderdate", KeyType.TIMESTAMP, KeyType.TIMESTAMP.parse("1996-01-01"), KeyType.TIMESTAMP.parse("2001-01-01")).withColumnRenamed("rows", "n_rows")


def layout_faults(spark, d):
    """A layout with a partition taken out and one put in twice as wide."""
    ps = _orders_layout(spark, d)
    ps = [replace(p, upper=layouts.successor(p)[1]) if i == 9 else p for i, p in enumerate(ps) if i != 5]
    return checks.layout_faults(layouts.frame(spark, ps))


def calendar_steps(spark, d):
    """Ages and the bound one age on, for a pair of dates of every order."""
    lower = F.col("o_orderdate")
    upper = (lower + F.make_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_custkey") % 400 + 1).cast("int"))).cast("timestamp_ntz")
    pairs = _table(spark, d, "orders").select("o_orderkey", lower.alias("lower"), upper.alias("upper"))
    return pairs.select("o_orderkey", age_months(F.col("lower"), F.col("upper")).cast("long").alias("months"), age_days(F.col("lower"), F.col("upper")).cast("long").alias("days"), next_upper(F.col("lower"), F.col("upper")).alias("next_upper"))


_INT = """WITH top AS (SELECT max(event_id) AS m FROM events),
r AS (SELECT lo, lo + 250 AS hi FROM top, generate_series(500, greatest(m, 499) + 1000, 250) g(lo)),
l AS (SELECT lo, hi, 'events_' || lo || '_' || hi AS partition_name FROM r, top WHERE lo <= m OR (SELECT count(*) FROM r q WHERE q.lo > m AND q.lo <= r.lo) BETWEEN 1 AND 3)"""


# today and the first month: what _span reads
_SPAN = "(SELECT date_trunc('month', min({c})) AS first, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS as_of FROM {t})"
_OF = _SPAN.format(c="o_orderdate", t="orders")
_AS_OF = f"(SELECT as_of FROM {_OF})"


def _months(table: str, column: str, wanted: int) -> str:
    """Months after the first year, until so many lie ahead of today."""
    return f"""(SELECT lo, lo + INTERVAL 1 MONTH AS hi, '{table}_' || strftime(lo, '%Y%m%d') || '_' || strftime(lo + INTERVAL 1 MONTH, '%Y%m%d') AS partition_name, strftime(lo, '%Y-%m-%d %H:%M:%S') AS lower_bound, strftime(lo + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS upper_bound
FROM (SELECT unnest(generate_series(CAST(first AS TIMESTAMP) + INTERVAL 12 MONTH, CAST(date_trunc('month', as_of) AS TIMESTAMP) + INTERVAL {wanted} MONTH, INTERVAL 1 MONTH)) AS lo FROM {_SPAN.format(c=column, t=table)}))"""


_ORDERS, _LINES = _months("orders", "o_orderdate", 3), _months("lineitem", "l_shipdate", 12)
_DETACH = f"""SELECT 'public' AS schema_name, 'orders' AS parent_name, partition_name, lower_bound, upper_bound FROM {_ORDERS} WHERE hi < {_AS_OF} - INTERVAL 13 MONTH
UNION ALL SELECT 'public', 'lineitem', partition_name, lower_bound, upper_bound FROM {_LINES} WHERE hi < {_AS_OF} - INTERVAL 2 YEAR"""
# two days are less than the least cool-down of four
_DROP = f"""SELECT 'public' AS schema_name, parent_name, partition_name, detached_date FROM (SELECT as_of, unnest([{{'parent_name': 'orders', 'partition_name': 'orders_a', 'detached_date': CAST(as_of - INTERVAL 4 DAY AS DATE)}}, {{'parent_name': 'orders', 'partition_name': 'orders_b', 'detached_date': CAST(as_of - INTERVAL 3 DAY AS DATE)}},
{{'parent_name': 'lineitem', 'partition_name': 'lineitem_a', 'detached_date': CAST(as_of - INTERVAL 1 MONTH AS DATE)}}, {{'parent_name': 'lineitem', 'partition_name': 'lineitem_b', 'detached_date': CAST(as_of - INTERVAL 1 MONTH + INTERVAL 1 DAY AS DATE)}}], recursive := true) FROM {_OF})
WHERE detached_date <= CASE parent_name WHEN 'orders' THEN as_of - INTERVAL 4 DAY ELSE as_of - INTERVAL 1 MONTH END"""


def _grown(lower: str, upper: str, form: str, mammoth: str) -> str:
    return f"""WITH RECURSIVE s AS (SELECT first, as_of, CAST({lower} AS TIMESTAMP) AS lo FROM {_OF}), g(lo, hi) AS (SELECT lo, CAST({upper} AS TIMESTAMP) FROM s UNION ALL SELECT hi, hi + age(date_trunc('day', hi), date_trunc('day', lo)) FROM g WHERE lo < (SELECT as_of FROM s) + INTERVAL 5 MONTH),
n AS (SELECT lo, hi, sum(CASE WHEN lo::DATE > (SELECT as_of FROM s) THEN 1 ELSE 0 END) OVER (ORDER BY lo) AS ahead FROM g)
SELECT 'orders_' || strftime(lo, '%Y%m%d') || '_' || strftime(hi, '%Y%m%d') AS partition_name, 'regular' AS kind, strftime(lo, '{form}') AS lower_bound, strftime(hi, '{form}') AS upper_bound FROM n WHERE ahead <= 3
UNION ALL SELECT 'orders_mammoth', 'mammoth', strftime(first, '{form}'), strftime({mammoth}, '{form}') FROM s"""


_TS, _DAY = "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"
_WANTED = (
    "(SELECT schema_name, lower(table_name) AS parent_name, greatest(3, coalesce(CAST(json_extract(c, '$.nr') AS INTEGER) + 2, 3)) AS wanted FROM (VALUES "
    + ", ".join(f"('{s}', '{t}', '{json.dumps(c)}'::JSON)" for s, t, c in CONFIGURATION)
    + """) t(schema_name, table_name, c) WHERE json_extract_string(c, '$."auto-maintenance"') = 'true')"""
)
_STEP = "(SELECT max(event_id) AS m, greatest(1, (max(event_id) + 1) // 10) AS step FROM events)"


def oracle_sql() -> dict[str, str]:
    return {
        "date_constraint_events": f"{_INT} SELECT partition_name, lo AS lower_bound, hi AS upper_bound, count(*) AS n_rows, min(ts) AS min_value, CASE WHEN max(event_id) = hi - 1 THEN max(ts) END AS max_value FROM l JOIN events ON event_id >= lo AND event_id < hi GROUP BY partition_name, lo, hi",
        "free_partitions_int": f"{_INT} SELECT 'public' AS schema_name, 'events' AS parent_name, CAST(NULL AS VARCHAR) AS range_id, count(*) AS free FROM (SELECT lo FROM l UNION ALL SELECT 0), top WHERE lo > m",
        "free_partitions_date": f"SELECT 'public' AS schema_name, 'orders' AS parent_name, CAST(NULL AS VARCHAR) AS range_id, count(*) AS free FROM {_ORDERS} WHERE lo::DATE > {_AS_OF}",
        "free_partitions_multirange": """WITH l AS (SELECT 'r1' AS range_id, i * 500 AS lo, 2000 AS top FROM range(4) t(i) UNION ALL SELECT 'r2', 1000000000 + i * 1000, 1000005000 FROM range(5) t(i)),
f AS (SELECT range_id, count(CASE WHEN lo > (SELECT coalesce(max(o_orderkey), 0) FROM orders WHERE o_orderkey < top) THEN 1 END) AS free FROM l GROUP BY range_id) SELECT range_id, free FROM f UNION ALL SELECT 'least', min(free) FROM f""",
        "last_partition": f"{_INT} SELECT * FROM (SELECT 'public' AS schema_name, 'events' AS parent_name, CAST(NULL AS VARCHAR) AS range_id, partition_name, lo::VARCHAR AS lower_bound, hi::VARCHAR AS upper_bound FROM l ORDER BY lo DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'public', 'orders', NULL, partition_name, lower_bound, upper_bound FROM {_ORDERS} ORDER BY lo DESC LIMIT 1)",
        "oldest_partition": f"{_INT} SELECT * FROM (SELECT 'public' AS schema_name, 'events' AS parent_name, CAST(NULL AS VARCHAR) AS range_id, partition_name, lo::VARCHAR AS lower_bound, hi::VARCHAR AS upper_bound FROM l ORDER BY lo LIMIT 1) UNION ALL SELECT * FROM (SELECT 'public', 'orders', NULL, partition_name, lower_bound, upper_bound FROM {_ORDERS} ORDER BY lo LIMIT 1)",
        "growth_int": f"{_INT} SELECT partition_name, 'regular' AS kind, lo::VARCHAR AS lower_bound, hi::VARCHAR AS upper_bound FROM l UNION ALL SELECT 'events_mammoth', 'mammoth', '0', '500'",
        "growth_weekly": _grown("as_of - INTERVAL 199 DAY", "lo + INTERVAL 7 DAY", _TS, "lo"),
        "growth_monthly": _grown("date_trunc('month', as_of) - INTERVAL 18 MONTH", "lo + INTERVAL 1 MONTH", _DAY, "lo"),
        "growth_month_end": _grown("make_date(year(as_of) - 1, 1, 31)", "lo + INTERVAL 1 MONTH", _DAY, "lo"),
        "native_layout_int": "SELECT partition_name, count(*) AS n_rows FROM (SELECT CASE WHEN o_orderkey < 700 THEN 'orders_mammoth' ELSE 'orders_' || ((o_orderkey - 700) // 500 * 500 + 700) || '_' || ((o_orderkey - 700) // 500 * 500 + 1200) END AS partition_name FROM orders WHERE o_orderkey >= 0 AND o_orderkey < 2700) GROUP BY ALL",
        "native_layout_date": f"SELECT partition_name, count(*) AS n_rows FROM (SELECT partition_name, lo, hi FROM {_ORDERS} UNION ALL SELECT 'orders_mammoth', first, first + INTERVAL 12 MONTH FROM {_OF}) JOIN orders ON o_orderdate >= lo AND o_orderdate < hi GROUP BY ALL",
        "native_layout_ts": "SELECT partition_name, count(*) AS n_rows FROM (SELECT CASE WHEN ts < TIMESTAMP '2024-01-04' THEN 'events_mammoth' ELSE 'events_' || strftime(ts, '%Y%m%d') || '_' || strftime(ts + INTERVAL 1 DAY, '%Y%m%d') END AS partition_name FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-24') GROUP BY ALL",
        "inheritance_layout_int": "SELECT CASE WHEN o_orderkey BETWEEN 1 AND 499 THEN 'orders_mammoth' WHEN o_orderkey BETWEEN 500 AND 999 THEN 'orders_500_999' ELSE 'orders_overflow' END AS partition_name, count(*) AS n_rows FROM orders GROUP BY ALL",
        "inheritance_layout_date": f"SELECT CASE WHEN o_orderdate < first + INTERVAL 2 YEAR THEN 'orders_mammoth' WHEN o_orderdate < first + INTERVAL 25 MONTH THEN 'orders_' || strftime(first + INTERVAL 2 YEAR, '%Y%m%d') || '_' || strftime(first + INTERVAL 25 MONTH - INTERVAL 1 DAY, '%Y%m%d') ELSE 'orders_overflow' END AS partition_name, count(*) AS n_rows FROM orders, {_OF} GROUP BY ALL",
        "inheritance_layout_ts": "SELECT CASE WHEN ts < day + INTERVAL 10 DAY THEN 'events_mammoth' WHEN ts < day + INTERVAL 17 DAY THEN 'events_' || strftime(day + INTERVAL 10 DAY, '%Y%m%d') || '_' || strftime(day + INTERVAL 16 DAY, '%Y%m%d') ELSE 'events_overflow' END AS partition_name, count(*) AS n_rows FROM events, (SELECT date_trunc('day', min(ts)) AS day FROM events) GROUP BY ALL",
        "partition_names": f"""WITH o AS (SELECT max(o_orderkey) + 1 AS n FROM orders), e AS (SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS day FROM events), s AS (SELECT CAST(first AS TIMESTAMP) AS first FROM {_OF})
SELECT 'native_' || partition_name AS partition_name, 'regular' AS kind, lower_bound, upper_bound FROM {_ORDERS} UNION ALL SELECT 'native_orders_mammoth', 'mammoth', strftime(first, '{_TS}'), strftime(first + INTERVAL 1 YEAR, '{_TS}') FROM s
UNION ALL SELECT 'neg_mammoth', 'mammoth', CAST(-3 * n AS VARCHAR), CAST(-2 * n AS VARCHAR) FROM o UNION ALL SELECT 'neg_m' || 2 * n || '_m' || n, 'regular', CAST(-2 * n AS VARCHAR), CAST(-n AS VARCHAR) FROM o
UNION ALL SELECT 'orders_mammoth', 'mammoth', strftime(first, '{_DAY}'), strftime(first + INTERVAL 2 YEAR, '{_DAY}') FROM s UNION ALL SELECT 'orders_' || strftime(first + INTERVAL 2 YEAR, '%Y%m%d') || '_' || strftime(first + INTERVAL 25 MONTH - INTERVAL 1 DAY, '%Y%m%d'), 'regular', strftime(first + INTERVAL 2 YEAR, '{_DAY}'), strftime(first + INTERVAL 25 MONTH, '{_DAY}') FROM s UNION ALL SELECT 'orders_overflow', 'overflow', NULL, NULL
UNION ALL SELECT 'events_mammoth', 'mammoth', strftime(day, '{_TS}'), strftime(day + INTERVAL 10 DAY, '{_TS}') FROM e UNION ALL SELECT 'events_' || strftime(day + INTERVAL 10 DAY, '%Y%m%d') || '_' || strftime(day + INTERVAL 16 DAY, '%Y%m%d'), 'regular', strftime(day + INTERVAL 10 DAY, '{_TS}'), strftime(day + INTERVAL 17 DAY, '{_TS}') FROM e UNION ALL SELECT 'events_overflow', 'overflow', NULL, NULL""",
        "route_rows": f"SELECT partition_name, count(*) AS n_rows, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem LEFT JOIN (SELECT partition_name, lo, hi FROM {_LINES} UNION ALL SELECT 'lineitem_mammoth', first, first + INTERVAL 1 YEAR FROM {_SPAN.format(c="l_shipdate", t="lineitem")}) ON l_shipdate >= lo AND l_shipdate < hi GROUP BY ALL",
        "pruned_scan_key": "SELECT event_id, user_id, event_type, value FROM events WHERE event_id >= 150 AND event_id < 420",
        "pruned_scan_constraint": "SELECT event_type, count(*) AS n_rows, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY ALL",
        # free counts from the first key of an empty table on; then 14 more lie above the greatest key
        "life_cycle": f"""WITH s AS {_STEP}, p AS (SELECT i * step AS lo, (i + 1) * step AS hi, (m // step) AS k FROM s, generate_series(2, 60) g(i) WHERE i <= m // step + 14)
SELECT 'events_' || lo || '_' || hi AS partition_name, 'regular' AS kind, CASE WHEN lo = (SELECT 2 * step FROM s) THEN 'detached' ELSE 'attached' END AS state, lo AS lower_int, hi AS upper_int,
(SELECT CASE WHEN count(*) = 0 THEN 0 WHEN max(event_id) = hi - 1 THEN 2 ELSE 1 END FROM events WHERE event_id >= lo AND event_id < hi) AS n_constraints,
CASE WHEN lo = (SELECT 2 * step FROM s) THEN 0 ELSE (SELECT count(*) FROM events WHERE event_id >= lo AND event_id < hi) END AS n_rows FROM p""",
        # the second run comes four days later; what it detaches itself is noted until the cool-down is over
        "maintenance_run": f"""WITH m AS (SELECT lo, hi, 'orders_' || strftime(lo, '%Y%m%d') || '_' || strftime(hi, '%Y%m%d') AS partition_name, as_of FROM (SELECT lo, lo + INTERVAL 1 MONTH AS hi, as_of FROM {_OF}, (SELECT unnest(generate_series(CAST(first AS TIMESTAMP) + INTERVAL 12 MONTH, CAST(date_trunc('month', as_of + INTERVAL 4 DAY) AS TIMESTAMP) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS lo FROM {_OF})))
SELECT partition_name, 'regular' AS kind, CASE WHEN hi < as_of + INTERVAL 4 DAY - INTERVAL 13 MONTH THEN 'detached' ELSE 'attached' END AS state, strftime(lo, '{_TS}') AS lower_bound, hi < as_of + INTERVAL 4 DAY - INTERVAL 13 MONTH AS noted,
CASE WHEN hi < as_of + INTERVAL 4 DAY - INTERVAL 13 MONTH THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_orderdate >= lo AND o_orderdate < hi) END AS n_rows FROM m WHERE hi >= as_of - INTERVAL 13 MONTH
UNION ALL SELECT 'orders_mammoth', 'mammoth', 'attached', strftime(first, '{_TS}'), false, (SELECT count(*) FROM orders WHERE o_orderdate < first + INTERVAL 1 YEAR) FROM {_OF}""",
        "copied_objects": """SELECT 'column' AS kind, column_name AS name, CAST(row_number() OVER () AS VARCHAR) AS what FROM (DESCRIBE orders)
UNION ALL SELECT * FROM (VALUES ('option', 'fillfactor', '90'), ('index', 'orders_new_pkey', 'btree o_orderkey'), ('index', 'orders_new_custkey_idx', 'btree o_custkey'), ('index', 'orders_new_by_status_idx', 'hash o_orderstatus,o_orderdate'), ('foreign key', 'orders_new_customer_fk', 'o_custkey public.customer(c_custkey)'))""",
        "detach_candidates": _DETACH,
        "drop_candidates": _DROP,
        "config_expand": """SELECT 'public' AS schema_name, lower(n_name) AS table_name, unnest(['auto-maintenance', 'nr', 'date_constraint']) AS "key", unnest([CAST(n_regionkey % 2 = 0 AS VARCHAR), CAST(n_nationkey AS VARCHAR), '{"marker":"' || lower(n_name) || '","constraint_column":"ts"}']) AS value FROM nation""",
        "add_requests": f"SELECT schema_name, parent_name, wanted FROM {_WANTED}",
        "maintenance_plan": f"SELECT 'add' AS step, parent_name, CAST(wanted AS VARCHAR) AS what FROM {_WANTED} UNION ALL SELECT 'constrain', 'events', 'ts:ts' UNION ALL SELECT 'detach', parent_name, partition_name FROM ({_DETACH}) UNION ALL SELECT 'drop', parent_name, partition_name FROM ({_DROP})",
        "index_ddl": f"""WITH w AS (SELECT 1 AS ord, partition_name AS table_name FROM {_ORDERS} UNION ALL SELECT 1, 'orders_mammoth' UNION ALL SELECT 2, 'orders' UNION ALL SELECT 3, 'orders_template'),
i AS (SELECT *, left(table_name || '_o_custkey_o_orderstatus', 59) || CASE table_name WHEN 'orders' THEN '2' WHEN 'orders_mammoth' THEN '1' ELSE '' END || '_idx' AS index_name FROM w), n AS (SELECT *, row_number() OVER (ORDER BY ord, index_name) AS position FROM i)
SELECT position, table_name, index_name, '/* Creating index ' || position || ' of ' || (SELECT count(*) FROM n) || ' */ create index ' || CASE WHEN ord = 1 THEN 'concurrently ' ELSE '' END || index_name || ' on public.' || table_name || ' using btree (o_custkey desc, lower(o_orderstatus));' AS stmt FROM n""",
        "index_ddl_long": f"""WITH w AS (SELECT DISTINCT 1 AS ord, '{LONG}_' || o_orderkey % 152 AS table_name FROM orders UNION ALL SELECT 2, '{LONG}'), k AS (SELECT *, row_number() OVER (ORDER BY ord, table_name) - 1 AS k FROM w),
i AS (SELECT ord, table_name, CASE WHEN k = 0 THEN '{LONG}' ELSE left('{LONG}', 59 - length(CAST(k AS VARCHAR))) || k END || '_idx' AS index_name FROM k), n AS (SELECT *, row_number() OVER (ORDER BY ord, index_name) AS position FROM i)
SELECT position, table_name, index_name, '/* Creating index ' || position || ' of ' || (SELECT count(*) FROM n) || ' */ create index ' || CASE WHEN ord = 1 THEN 'concurrently ' ELSE '' END || index_name || ' on public.' || table_name || ' using btree (o_custkey);' AS stmt FROM n""",
        "index_ddl_unique": f"""WITH w AS (SELECT partition_name AS t, left(partition_name || '_o_orderkey', 59) || '_idx' AS i FROM {_ORDERS} UNION ALL SELECT 'orders_mammoth', 'orders_mammoth_o_orderkey_idx'), n AS (SELECT *, row_number() OVER (ORDER BY i) AS position FROM w)
SELECT position, '/* Creating index ' || position || ' of ' || (SELECT count(*) FROM n) || ' */ create unique index concurrently ' || i || ' on public.' || t || ' using hash (o_orderkey);' AS stmt FROM n""",
        "fk_ddl": f"""WITH w AS (SELECT partition_name AS t FROM {_ORDERS} UNION ALL SELECT 'orders_mammoth'), n AS (SELECT t, row_number() OVER (ORDER BY t) AS position, count(*) OVER () AS total FROM w)
SELECT 1::BIGINT AS block, position, 'alter table public.' || t || ' add constraint orders_customer_fk foreign key (o_custkey, o_tenant) references customer(c_custkey, c_tenant) not valid;' AS stmt FROM n
UNION ALL SELECT 2, position, '/* Validating constraint ' || position || ' of ' || total || ' */ alter table public.' || t || ' validate constraint orders_customer_fk;' FROM n
UNION ALL SELECT b, 1, 'alter table public.' || t || ' add constraint orders_customer_fk foreign key (o_custkey, o_tenant) references customer(c_custkey, c_tenant);' FROM (VALUES (3, 'orders'), (4, 'orders_template')) v(b, t)""",
        "unique_violations": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
        "fk_violations": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey >= 50)",
        "range_validation": "SELECT count(*) AS n_rows, count(CASE WHEN o_orderdate IS NULL THEN 1 END) AS null_keys, count(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 END) AS below, count(CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 1 END) AS above FROM orders",
        "layout_faults": f"""WITH k AS (SELECT partition_name, row_number() OVER (ORDER BY lo) AS k FROM {_ORDERS}) SELECT 'public' AS schema_name, 'orders' AS parent_name, CAST(NULL AS VARCHAR) AS range_id, a.partition_name AS before, b.partition_name, CASE a.k WHEN 4 THEN 'gap' ELSE 'overlap' END AS fault FROM k a JOIN k b ON (a.k, b.k) IN ((4, 6), (9, 10))""",
        "calendar_steps": "SELECT o_orderkey, datepart('year', a) * 12 + datepart('month', a) AS months, datepart('day', a) AS days, hi + a AS next_upper FROM (SELECT o_orderkey, hi, age(hi, o_orderdate) AS a FROM (SELECT o_orderkey, o_orderdate, o_orderdate + to_days(CAST(o_custkey % 400 + 1 AS INTEGER)) AS hi FROM orders))",
    }


def queries() -> dict:
    return {name: globals()[name] for name in oracle_sql()}
