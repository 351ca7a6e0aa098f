"""Intervals, ranges, layouts, planners, statements, checks, routing, scans, registry, streaming."""

import random
from datetime import date, datetime, timedelta

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeloom.functions.intervals import Interval, age, age_days, age_months, plus
from rangeloom.functions.ranges import range_index
from rangeloom.manager import PartitionManager
from rangeloom.operators import checks, ddl, routing
from rangeloom.plans import layouts, planners
from rangeloom.sources.registry import Registry, State
from rangeloom.sources.scan import survivors
from rangeloom.streaming.router import route_stream
from rangeloom.types import Conflict, KeyType, NotPartitioned, OutOfRange, Partition, PartitionError, Table, UnsupportedKey, range_of, replace, suffix


@pytest.mark.parametrize(
    ("text", "want"),
    [("1 month", (1, 0, 0)), ("13 days", (0, 13, 0)), ("1 week", (0, 7, 0)), ("2 years 3 mons", (27, 0, 0)), ("1 day 02:30:00", (0, 1, 9_000_000_000)), ("-1 day", (0, -1, 0)), ("1.5 hours", (0, 0, 5_400_000_000)), ("-00:00:01.5", (0, 0, -1_500_000))],
)
def test_interval_text(text, want):
    assert Interval.parse(text) == Interval(*want)


@pytest.mark.parametrize("text", ["", "soon", "1 fortnight", "1.5 months", "month"])
def test_no_interval(text):
    with pytest.raises(ValueError):
        Interval.parse(text)


DAYS = st.dates(date(1990, 1, 1), date(2030, 12, 31))


@settings(max_examples=150, deadline=None)
@given(DAYS, st.integers(0, 900))
def test_age_and_sum_against_duckdb(lower, days):
    upper = lower + timedelta(days=days)
    step = age(upper, lower)
    months, rest, top = duckdb.execute("SELECT datepart('year', a) * 12 + datepart('month', a), datepart('day', a), ?::TIMESTAMP + a FROM (SELECT age(?::TIMESTAMP, ?::TIMESTAMP) AS a)", [upper, upper, lower]).fetchone()
    assert (step.months, step.days) == (months, rest)
    assert plus(datetime(upper.year, upper.month, upper.day), step) == top


def test_age_columns(spark):
    r = random.Random(1)
    pairs = [(a := date(2000, 1, 1) + timedelta(days=r.randrange(4000)), a + timedelta(days=r.randrange(900))) for _ in range(300)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(pairs, "a date, b date").select("a", "b", age_months(F.col("a"), F.col("b")).alias("m"), age_days(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(Interval(x.m, x.d) == age(x.b, x.a) for x in got)


def test_range_index(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    for n in (0, 1, 2, 3, 7, 8, 33):
        cuts = sorted(r.sample(range(-100, 100), 2 * n))
        lowers, uppers = cuts[::2], cuts[1::2]
        keys = [(k,) for k in [*range(-105, 105, 3), *cuts, None]]
        got = spark.createDataFrame(keys, "k long").select("k", range_index(F.col("k"), lowers, uppers, "long").alias("at")).collect()
        for x in got:
            want = [i for i in range(n) if x.k is not None and lowers[i] <= x.k < uppers[i]]
            assert x["at"] == (want[0] if want else None)


def test_range_index_of_runs(spark):
    """Ranges of one width that follow each other, gaps, single ranges and the ends of the type, mixed."""
    from pyspark.sql import functions as F

    r = random.Random(3)
    least, most = -(1 << 63), (1 << 63) - 1
    layouts_ = [([least, 0], [0, most]), ([least, least + 5, most - 9, most - 6], [least + 5, least + 10, most - 6, most - 3]), ([0, 1 << 62], [1 << 62, most])]
    for _ in range(8):
        at, bounds = r.randrange(-60, 0), []
        for _ in range(r.randrange(1, 7)):
            width = r.choice([1, 2, 5, 5, 9])
            for _ in range(r.choice([1, 1, 2, 3, 12])):
                bounds.append((at, at + width))
                at += width
            at += r.choice([0, 0, 3, 11])
        layouts_.append(tuple(map(list, zip(*bounds))))
    for lowers, uppers in layouts_:
        keys = {k for b in (*lowers, *uppers) for k in (b - 1, b, b + 1) if least <= k <= most} | {least, most, *range(-70, 70)}
        got = spark.createDataFrame([(k,) for k in [*keys, None]], "k long").select("k", range_index(F.col("k"), lowers, uppers, "long").alias("at")).collect()
        for x in got:
            want = [i for i in range(len(lowers)) if x.k is not None and lowers[i] <= x.k < uppers[i]]
            assert x["at"] == (want[0] if want else None)


@pytest.mark.parametrize("steps", ["even", "uneven"])
def test_many_partitions_take_few_literals(spark, monkeypatch, steps):
    """A literal for each bound and name takes most of the time beyond some thousand partitions."""
    from pyspark.sql import functions as F

    n = 3000
    width = (lambda i: 10) if steps == "even" else (lambda i: 9 + i % 3)
    at, ps = 0, []
    for i in range(n):
        ps.append(Partition("s", "t", f"t_{at}_{at + width(i)}", "k", "int", at, at + width(i)))
        at += width(i)
    literals, lit = [], F.lit
    data = spark.range(-5, at + 5).select(F.col("id").alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("d"))
    monkeypatch.setattr(F, "lit", lambda x: literals.append(x) or lit(x))
    bounds, routed = planners.date_constraints(data, ps, "d"), routing.route(data, ps)
    assert len(literals) < 100
    found = {r.partition_name: r for r in bounds.collect()}
    second = lambda k: datetime(1970, 1, 1) + timedelta(seconds=k)
    assert {name: tuple(r[1:]) for name, r in found.items()} == {p.partition_name: (p.lower, p.upper, p.upper - p.lower, second(p.lower), second(p.upper - 1)) for p in ps}
    counts = {r[0]: r[1] for r in routed.groupBy(routing.PARTITION).count().collect()}
    assert counts == {p.partition_name: p.upper - p.lower for p in ps} | {None: 10}


def test_names():
    assert suffix(KeyType.INT, -3000, -2000) == "m3000_m2000"
    assert range_of("t_r10_1_2", "t") == "r10" and range_of("t_1_2", "t") is None and range_of("u_r1_1_2", "t") is None
    p = layouts.plan_native("S", "A__b", "k", KeyType.INT, 0, 10, "10")
    assert p[1].partition_name == "a__b_10_20" and p[1].schema_name == "s"


def test_sub_day_steps_are_refused():
    ps = layouts.plan_native("s", "t", "k", KeyType.TIMESTAMP, "2020-01-01", "2020-01-01", "6 hours")
    with pytest.raises(PartitionError, match="less than a day"):
        layouts.plan_growth(ps[1], 0, 1, lambda lower: True)


@pytest.mark.parametrize("args", [(KeyType.INT, 5, 5, "1"), (KeyType.INT, 0, 5, "0"), (KeyType.DATE, "2020-01-02", "2020-01-01", "1 day")])
def test_bounds_have_to_ascend(args):
    with pytest.raises(PartitionError):
        layouts.plan_native("s", "t", "k", *args)


def test_key_types(spark):
    from pyspark.sql import types as T

    assert [KeyType.of(t) for t in (T.ShortType(), T.LongType(), T.DateType(), T.TimestampType(), T.TimestampNTZType())] == [KeyType.INT, KeyType.INT, KeyType.DATE, KeyType.TIMESTAMP, KeyType.TIMESTAMP]
    for t in (T.StringType(), T.DecimalType(), T.DayTimeIntervalType()):
        with pytest.raises(UnsupportedKey):
            KeyType.of(t)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(-50, 50), st.integers(1, 30), st.data())
def test_survivors_keep_every_row(n, start, step, data):
    """No pruned partition holds a wanted row, by key or by recorded bounds."""
    ps = layouts.plan_native("s", "t", "k", KeyType.INT, start - 10, start, str(step))
    ps += layouts.plan_growth(ps[1], 0, n, lambda lower: True)
    values = {p.partition_name: sorted(data.draw(st.lists(st.dates(date(2020, 1, 1), date(2020, 2, 1)), min_size=1, max_size=3))) for p in ps}
    ps = [replace(p, constraints=({"name": "a", "column": "d", "op": ">=", "value": str(values[p.partition_name][0])}, {"name": "b", "column": "d", "op": "<=", "value": str(values[p.partition_name][-1])})) for p in ps]
    key = data.draw(st.tuples(st.none() | st.integers(-80, 1300), st.none() | st.integers(-80, 1300)))
    day = data.draw(st.tuples(st.none() | st.dates(date(2019, 12, 1), date(2020, 3, 1)), st.none() | st.dates(date(2019, 12, 1), date(2020, 3, 1))))
    left = {p.partition_name for p in survivors(ps, key, {"d": day})}
    inside = lambda v, b: (b[0] is None or v >= b[0]) and (b[1] is None or v < b[1])
    for p in ps:
        if any(inside(k, key) for k in range(p.lower, p.upper)) and any(inside(v, day) for v in values[p.partition_name]):
            assert p.partition_name in left


def test_free_counts_an_empty_table_from_zero(spark):
    ps = layouts.plan_native("s", "t", "k", KeyType.INT, -20, -10, "10")
    free = planners.free_partitions(layouts.frame(spark, ps), planners.key_maxima(spark.createDataFrame([], "k long"), ps), date(2020, 1, 1)).first().free
    assert free == 0
    ps = layouts.plan_native("s", "t", "k", KeyType.INT, 1, 10, "10")
    assert planners.free_partitions(layouts.frame(spark, ps), planners.key_maxima(spark.createDataFrame([], "k long"), ps), date(2020, 1, 1)).first().free == 2


def test_default_partitions_take_what_is_left(spark):
    ps = layouts.plan_native("s", "t", "k", KeyType.INT, 0, 10, "10")
    ps.append(replace(ps[1], partition_name="t_default", lower=None, upper=None, kind="default"))
    rows = spark.createDataFrame([(5,), (15,), (25,), (None,)], "k long")
    got = {r.k: r[routing.PARTITION] for r in routing.route(rows, ps).collect()}
    assert got == {5: "t_mammoth", 15: "t_10_20", 25: "t_default", None: "t_default"}
    assert {r.k: r[routing.PARTITION] for r in routing.route(rows, ps[:2]).collect()} == {5: "t_mammoth", 15: "t_10_20", 25: None, None: None}
    reg = layouts.frame(spark, ps)
    assert [r.partition_name for r in planners.last_partitions(reg).collect()] == ["t_10_20"]
    with pytest.raises(NotPartitioned):
        routing.route(rows, ps[2:])


def test_all_null_dates_give_no_constraint(spark):
    ps = layouts.plan_native("s", "t", "k", KeyType.INT, 0, 10, "2")
    data = spark.createDataFrame([(10, None), (11, None)], "k long, d date")
    r = planners.date_constraints(data, ps, "d").first()
    assert (r.partition_name, r.rows, r.min_value, r.max_value) == ("t_10_12", 2, None, None)


def test_statement_names(spark):
    long = "x" * 60
    ps = [Partition("s", long, f"{long}_{i}", "k", "int", i, i + 1) for i in range(3)]
    got = ddl.index_statements(layouts.frame(spark, ps), spark.createDataFrame([("a_b_idx",)], "index_name string"), "s", long, ["b"]).collect()
    names = [r.index_name for r in got]
    assert len(set(names)) == 4 and max(map(len, names)) <= 63
    assert ddl.bare("lower(extra)") == "extra" and ddl.bare("b desc nulls first") == "b"
    with pytest.raises(PartitionError):
        ddl.foreign_key_statements(layouts.frame(spark, ps), "s", long, "c", "p", ["a", "b"], ["a"])
    unique = ddl.index_statements(layouts.frame(spark, ps), spark.createDataFrame([], "index_name string"), "s", long, ["K desc"], unique=True, key_column="k").collect()
    assert unique[-1].table_name == long  # an expression on the key is still the key
    qualified = ddl.foreign_key_statements(layouts.frame(spark, ps), "s", long, "Fk", "P", ["a"], ["A"], qualify=True).collect()[-1].stmt
    assert 'add constraint "Fk" foreign key (a) references s."P"(a);' in qualified


def test_checks(spark):
    child = spark.createDataFrame([(1, 1), (1, None), (2, 9), (None, 9)], "a int, b int")
    parent = spark.createDataFrame([(1, 1)], "x int, y int")
    assert [tuple(r) for r in checks.foreign_key_violations(child, ["a", "b"], parent, ["x", "y"]).collect()] == [(2, 9)]
    assert checks.unique_violations(child.unionAll(child), ["a", "b"]).count() == 2
    r = checks.range_violations(child, "a", KeyType.INT, 2, 3).first()
    assert (r.rows, r.null_keys, r.below, r.above) == (4, 1, 2, 0)


def test_configuration(spark):
    conf = spark.createDataFrame([("S", "T", '{"auto-maintenance": false, "detach": "1 month", "drop_detached": "31 days"}'), ("s", "u", '{"auto-maintenance": true}')], "schema_name string, table_name string, configuration string")
    reg = layouts.frame(spark, layouts.plan_native("s", "t", "k", KeyType.DATE, "2020-01-01", "2020-02-01", "1 month") + layouts.plan_native("s", "u", "k", KeyType.INT, 0, 1, "1"))
    assert [(r.parent_name, r.wanted) for r in planners.add_requests(conf, reg).collect()] == [("u", 3)]
    day = date(2020, 4, 2)
    assert planners.detach_candidates(reg, conf, day).count() == 1 and planners.detach_candidates(reg, conf, date(2020, 4, 1)).count() == 0
    assert planners.detach_candidates(reg, conf, day, strict_auto=True).count() == 0
    journal = spark.createDataFrame([("s", "t", "t_x", date(2020, 3, 2))], "schema_name string, parent_name string, partition_name string, detached_date date")
    assert planners.drop_candidates(journal, conf, day).count() == 1 and planners.drop_candidates(journal, conf, date(2020, 4, 1)).count() == 0
    bad = spark.createDataFrame([("s", "t", '{"date_constraint": {"marker": "x"}}')], "schema_name string, table_name string, configuration string")
    with pytest.raises(PartitionError):
        planners.constraint_requests(bad)


def test_registry_conflicts(spark, tmp_path):
    one, two = (Registry(spark, f"file://{tmp_path}", attempts=2, back_off=0) for _ in range(2))
    one.commit(State())
    old = two.load()
    one.update(lambda s: s.tables.append(Table("s", "a", "x")))
    with pytest.raises(Conflict):
        two.commit(old)
    two.update(lambda s: s.tables.append(Table("s", "b", "x")))
    assert [t.table_name for t in one.load().tables] == ["a", "b"] and one.versions() == [1, 2, 3]

    def losing(state):  # someone else publishes while we work
        Registry(spark, f"file://{tmp_path}").commit(Registry(spark, f"file://{tmp_path}").load())

    with pytest.raises(Conflict):
        one.update(losing)


def managed(spark, folder):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), f"v{i}") for i in range(100)]
    spark.createDataFrame(rows[:40], "id long, at timestamp_ntz, v string").write.parquet(f"{folder}/old")
    m = PartitionManager(spark, f"file://{folder}/m", back_off=0)
    m.register("s", "t", f"file://{folder}/old")
    m.partition_table("s", "t", "id", 0, 40, "10", "native")
    m.partition_add_up_to_nr_of_free_partitions("s", "t", 7)
    return m, rows


def test_scan_equals_filter(spark, tmp_path):
    m, rows = managed(spark, tmp_path)
    m.insert("s", "t", spark.createDataFrame(rows[40:], "id long, at timestamp_ntz, v string"))
    m.partition_add_constraints("s", "t", "at", "at")
    r = random.Random(3)
    for _ in range(6):
        key = tuple(sorted(r.sample(range(-5, 120), 2)))
        when = tuple(sorted(datetime(2024, 1, 1) + timedelta(hours=r.randrange(120)) for _ in range(2)))
        got = m.scan("s", "t", key, {"at": when})
        assert sorted(map(tuple, got.collect())) == [x for x in rows if key[0] <= x[0] < key[1] and when[0] <= x[1] < when[1]]
    few = m.scan("s", "t", (42, 48))
    assert len(few.inputFiles()) <= 4 and all("t_40_50" in f for f in few.inputFiles())


def test_insert_is_all_or_nothing(spark, tmp_path):
    m, rows = managed(spark, tmp_path)
    bad = spark.createDataFrame([rows[50], (5000, None, "x")], "id long, at timestamp_ntz, v string")
    with pytest.raises(OutOfRange):
        m.insert("s", "t", bad)
    assert m.scan("s", "t").count() == 40
    m.insert("s", "t", spark.createDataFrame([(60,)], "id long"))  # missing columns are null
    assert m.scan("s", "t", (60, 61)).first().v is None


def test_stream(spark, tmp_path):
    m, rows = managed(spark, tmp_path)
    spark.createDataFrame(rows[40:], "id long, at timestamp_ntz, v string").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, at timestamp_ntz, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    route_stream(stream, m, "s", "t", f"{tmp_path}/checkpoint", keep_free=2).awaitTermination()
    assert m.scan("s", "t").count() == 100 and m.partition_calculate_free_partitions("s", "t") >= 2


def test_purge(spark, tmp_path):
    m, _ = managed(spark, tmp_path)
    assert m.partition_detach_partition("s", "t", "t_mammoth", detach_last=False)
    assert m.partition_drop_detached_partition("s", "t", "t_mammoth")
    assert (tmp_path / "old").exists()  # adopted files stay unless they are purged
