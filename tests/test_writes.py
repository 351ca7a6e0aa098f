"""Writes that fail, meet other writers or come twice; tables that lose their first folder; names and keys."""

import pytest
from test_parts import managed

from rangeloom import manager as managers
from rangeloom.manager import PartitionManager
from rangeloom.operators import ddl
from rangeloom.plans import layouts
from rangeloom.streaming.router import route_stream
from rangeloom.types import KeyType, OutOfRange, Partition, PartitionError

ROW = "id long, at timestamp_ntz, v string"


def test_purge_leaves_a_table(spark, tmp_path):
    m, rows = managed(spark, tmp_path)
    m.insert("s", "t", spark.createDataFrame(rows[40:], ROW))
    m.partition_detach_partition("s", "t", "t_mammoth", detach_last=False)
    m.partition_drop_detached_partition("s", "t", "t_mammoth", purge=True)
    assert not (tmp_path / "old").exists()
    assert m.scan("s", "t").count() == 60 and m.scan("s", "t").columns == ["id", "at", "v"]
    m.insert("s", "t", spark.createDataFrame([(105,)], "id long"))
    assert m.scan("s", "t").count() == 61 and m.partition_calculate_free_partitions("s", "t") == 0


def test_dropped_partition_takes_its_loads(spark, tmp_path):
    m, rows = managed(spark, tmp_path)
    m.insert("s", "t", spark.createDataFrame(rows[40:], ROW))
    load = next(p for p in m.registry.load().children("s", "t") if p.partition_name == "t_40_50").loads[0]
    m.partition_detach_partition("s", "t", "t_40_50")
    m.partition_drop_detached_partition("s", "t", "t_40_50")
    assert not m.registry.exists(load) and m.scan("s", "t").count() == 90


def test_a_failed_write_shows_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    m, rows = managed(spark, tmp_path)
    data = spark.createDataFrame(rows[40:], ROW).withColumn("v", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        m.insert("s", "t", data)
    assert m.scan("s", "t").count() == 40 and m.registry.names(f"{m.root}/data/s.t/loads") == []


def test_no_rows(spark, tmp_path):
    m, _ = managed(spark, tmp_path)
    assert m.insert("s", "t", spark.createDataFrame([], ROW)) and m.scan("s", "t").count() == 40


def _meanwhile(m, monkeypatch, act):
    """`act` comes between the routing and the publication of the first insert."""
    done, route = [], managers.routing.route

    def routed(*args):
        out = route(*args)
        if not done:
            done.append(True)
            act()
        return out

    monkeypatch.setattr(managers.routing, "route", routed)


def test_detach_during_an_insert(spark, tmp_path, monkeypatch):
    m, rows = managed(spark, tmp_path)
    other = PartitionManager(spark, m.root, back_off=0)
    _meanwhile(m, monkeypatch, lambda: other.partition_detach_partition("s", "t", "t_40_50"))
    with pytest.raises(OutOfRange):  # rows of the detached partition belong nowhere
        m.insert("s", "t", spark.createDataFrame(rows[40:60], ROW))
    assert m.scan("s", "t").count() == 40 and m.registry.names(f"{m.root}/data/s.t/loads") == []


def test_growth_and_insert_during_an_insert(spark, tmp_path, monkeypatch):
    m, rows = managed(spark, tmp_path)
    other = PartitionManager(spark, m.root, back_off=0)

    def act():
        other.insert("s", "t", spark.createDataFrame(rows[50:60], ROW))
        other.partition_add_up_to_nr_of_free_partitions("s", "t", 9)

    _meanwhile(m, monkeypatch, act)
    m.insert("s", "t", spark.createDataFrame(rows[40:50] + rows[60:], ROW))
    assert sorted(map(tuple, m.scan("s", "t").collect())) == rows


def test_constraint_during_an_insert(spark, tmp_path, monkeypatch):
    m, rows = managed(spark, tmp_path)
    m.insert("s", "t", spark.createDataFrame(rows[45:50], ROW))
    other = PartitionManager(spark, m.root, back_off=0)
    _meanwhile(m, monkeypatch, lambda: other.partition_add_constraints("s", "t", "at", "at"))
    with pytest.raises(OutOfRange):  # earlier than the bound recorded meanwhile
        m.insert("s", "t", spark.createDataFrame(rows[40:45], ROW))
    assert m.scan("s", "t").count() == 45


def test_a_replayed_batch(spark, tmp_path):
    m, rows = managed(spark, tmp_path)
    data = spark.createDataFrame(rows[40:60], ROW)
    assert m.insert("s", "t", data, batch=("x", 0)) and not m.insert("s", "t", data, batch=("x", 0))
    assert m.insert("s", "t", spark.createDataFrame(rows[60:], ROW), batch=("x", 1)) and not m.insert("s", "t", data, batch=("x", 0))
    assert m.scan("s", "t").count() == 100


def test_a_stream_that_failed_before_its_batch_was_noted(spark, tmp_path):
    """The rows are published, the engine's note of the batch is lost: the batch comes again and is left out."""
    m, rows = managed(spark, tmp_path)
    spark.createDataFrame(rows[40:], ROW).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(ROW).parquet(f"{tmp_path}/in")
        route_stream(stream, m, "s", "t", f"{tmp_path}/checkpoint").awaitTermination()
        assert m.scan("s", "t").count() == 100
        for note in (tmp_path / "checkpoint" / "commits").iterdir():
            note.unlink()


def test_keys_know_their_schema(spark, tmp_path):
    m, _ = managed(spark, tmp_path)
    spark.createDataFrame([(1,), (40,), (None,)], "id long").write.parquet(f"{tmp_path}/x")
    for schema in ("s1", "s2"):
        m.register(schema, "x", f"file://{tmp_path}/x")
    m.add_foreign_key("s2", "y", "y_x_fk", ["x"], "x", ["id"])
    m.partition_table("s1", "x", "id", 0, 50, "10", "native", validate=False)
    with pytest.raises(PartitionError, match="foreign key"):
        m.partition_table("s2", "x", "id", 0, 50, "10", "inheritance", validate=False)
    m.add_foreign_key("s1", "x", "x_t_fk", ["id"], "t", ["id"], parent_schema="s", valid=False)
    assert m.validate_foreign_key("s1", "x", "x_t_fk") == 1  # 40 is no row of s.t
    assert not next(f for f in m.registry.load().foreign_keys if f.name == "x_t_fk").valid
    m.insert("s", "t", spark.createDataFrame([(40,)], "id long"))
    assert m.validate_foreign_key("s1", "x", "x_t_fk") == 0
    assert next(f for f in m.registry.load().foreign_keys if f.name == "x_t_fk").valid


def test_conversion_keeps_outgoing_keys_and_options(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "id long, o long").write.parquet(f"{tmp_path}/x")
    m = PartitionManager(spark, f"file://{tmp_path}/m", back_off=0)
    m.register("s", "x", f"file://{tmp_path}/x", options={"codec": "zstd"})
    m.add_foreign_key("s", "x", "x_o_fk", ["o"], "o", ["id"])
    m.partition_table("s", "x", "id", 0, 50, "10", "native")
    state = m.registry.load()
    assert {(f.table_name, f.name) for f in state.foreign_keys} == {("x_mammoth", "x_mammoth_o_fk"), ("x_50_60", "x_50_60_o_fk"), ("x", "x_o_fk")}
    state.replace_partition(managers.replace(state.children("s", "x")[1], options={"fillfactor": "70"}))
    m.registry.commit(state)
    m.partition_add_up_to_nr_of_free_partitions("s", "x", 4)
    assert [p.options for p in m.registry.load().children("s", "x")] == [{"codec": "zstd"}] + [{"fillfactor": "70"}] * 4


def test_many_statements_of_one_stem(spark):
    table = "t" * 60
    ps = layouts.plan_native("s", table, "k", KeyType.INT, 0, 100, "10")
    ps += layouts.plan_growth(ps[1], 0, 150, lambda lower: True)
    assert len({p.partition_name for p in ps}) == 152 and max(len(p.partition_name) for p in ps) == 63
    same = [Partition("s", table, f"{table}_{i}", "k", "int", i, i + 1) for i in range(152)]  # beyond 59 characters all alike
    for own in (ps, same):
        got = ddl.index_statements(layouts.frame(spark, own), spark.createDataFrame([], "index_name string"), "s", table, ["a"]).collect()
        assert len(got) == 153 == len({r.index_name for r in got}) and max(len(r.index_name) for r in got) <= 63
        assert [r.position for r in got] == list(range(1, 154)) and got[-1].stmt.startswith("/* Creating index 153 of 153 */")


def test_index_names_stay_apart(spark, tmp_path):
    table = "u" * 55
    spark.createDataFrame([(1, 2, 3)], "id long, a long, b long").write.parquet(f"{tmp_path}/x")
    m = PartitionManager(spark, f"file://{tmp_path}/m", back_off=0)
    m.register("s", table, f"file://{tmp_path}/x", primary_key=["id"])
    for c in "ab":
        m.add_index("s", table, f"{table}_{c}_idx", [c])
    m.partition_table("s", table, "id", 0, 100, "20", "native")
    m.partition_add_up_to_nr_of_free_partitions("s", table, 3)
    names = [i.index_name for i in m.registry.load().indexes]
    assert len(names) == len(set(names)) and max(map(len, names)) <= 63


def test_attach_ranges_and_default(spark, tmp_path):
    m, rows = managed(spark, tmp_path)
    spark.createDataFrame(rows[:1], ROW).selectExpr("id + 500 AS id", "at", "v").write.parquet(f"{tmp_path}/more")
    with pytest.raises(OutOfRange):
        m.partition_attach("s", "t", "t_r1_600_700", f"file://{tmp_path}/more", 600, 700)
    assert m.partition_attach("s", "t", "t_r1_500_600", f"file://{tmp_path}/more", 500, 600)
    assert m.partition_attach("s", "t", "t_r2_1000_1100", lower=1000, upper=1100)
    with pytest.raises(PartitionError, match="overlaps"):
        m.partition_attach("s", "t", "t_590_610", lower=590, upper=610)
    assert {p.partition_name: p.range_id for p in m.registry.load().children("s", "t")}["t_r1_500_600"] == "r1"
    assert m.scan("s", "t", (500, 600)).count() == 1
    assert m.partition_calculate_free_partitions("s", "t", "r1") == 0 and m.partition_calculate_free_partitions("s", "t", "r2") == 1
    assert m.partition_attach("s", "t", "t_default", default=True)
    with pytest.raises(PartitionError, match="default"):
        m.partition_attach("s", "t", "t_other", default=True)
    m.insert("s", "t", spark.createDataFrame([(5000,), (None,)], "id long"))
    assert m.scan("s", "t").count() == 43
    with pytest.raises(OutOfRange, match="default"):
        m.partition_attach("s", "t", "t_r3_5000_5100", lower=5000, upper=5100)


def test_reattach(spark, tmp_path):
    m, _ = managed(spark, tmp_path)
    assert m.partition_detach_partition("s", "t", "t_40_50") and m.partition_reattach("s", "t", "t_40_50")
    state = m.registry.load()
    assert state.journal == [] and "t_40_50" in [p.partition_name for p in state.children("s", "t")]
    with pytest.raises(PartitionError, match="not noted"):
        m.partition_reattach("s", "t", "t_40_50")
    m.partition_detach_partition("s", "t", "t_40_50")
    m.partition_attach("s", "t", "t_45_50", lower=45, upper=50)
    with pytest.raises(PartitionError, match="overlaps"):
        m.partition_reattach("s", "t", "t_40_50")


def test_ranges_are_looked_at_together(spark, tmp_path):
    """The greatest key of each range, though the tops of some are empty."""
    m, rows = managed(spark, tmp_path)
    for r, lo in (("r1", 500), ("r1", 600), ("r2", 1000), ("r2", 1100), ("r2", 1200)):
        m.partition_attach("s", "t", f"t_{r}_{lo}_{lo + 100}", lower=lo, upper=lo + 100)
    m.insert("s", "t", spark.createDataFrame([(510,), (1005,), (1150,)], "id long"))
    state = m.registry.load()
    assert m._max_keys(state, state.table("s", "t")) == {None: 39, "r1": 510, "r2": 1150}
