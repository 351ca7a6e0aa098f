"""The whole life of four tables, with the states that the operators have to leave."""

from datetime import date

import pytest

from rangeloom import maintenance
from rangeloom.manager import PartitionManager
from rangeloom.plans.layouts import audit
from rangeloom.types import NotPartitioned, OutOfRange, PartitionError, UnsupportedKey, replace

AS_OF = date(2023, 3, 1)
COLUMNS = "id bigint, vendor_id int, extra string, rate_code_id string, pickup_longitude decimal(38,18), trip_date {}"


def names(m, table, state="attached"):
    return [p.partition_name.removeprefix(f"{table}_") for p in m.registry.load().children("public", table, state)]


@pytest.fixture(scope="module")
def m(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    m = PartitionManager(spark, f"file://{root}/managed", back_off=0)
    m.install()
    for table, kind, key in (("test_partition", "date", ["id"]), ("test_partition_date", "date", ["id"]), ("test_partition_datetime", "timestamp", ["id", "trip_date"]), ("test_partition_inh", "date", ["id"])):
        path = f"file://{root}/{table}"
        spark.createDataFrame([], COLUMNS.format(kind)).write.parquet(path)
        m.register("public", table, path, primary_key=key)
    return m


def test_1_conversion(m):
    assert m.partition_table("public", "Test_Partition", "id", "1", "7000000", "1000000", "native")
    assert m.partition_table("public", "test_partition_date", "trip_date", "1970-01-01", "2023-01-01", "1 month", "NATIVE", nopk=True)
    assert m.partition_table("public", "test_partition_datetime", "trip_date", "1970-01-01", "2023-01-01", "1 week", "native")
    assert m.partition_table("public", "test_partition_inh", "id", "1", "999999", "1000", "inheritance")
    assert names(m, "test_partition") == ["mammoth", "7000000_8000000"]
    assert names(m, "test_partition_datetime") == ["mammoth", "20230102_20230109"]
    assert names(m, "test_partition_inh") == ["mammoth", "1000000_1000999", "overflow"]
    assert [p.bounds() for p in m.registry.load().children("public", "test_partition_inh")] == [["1", "999999"], ["1000000", "1000999"], []]
    assert m.registry.load().children("public", "test_partition_datetime")[0].bounds() == ["1970-01-01 00:00:00", "2023-01-02 00:00:00"]


def test_2_growth(m):
    for t in ("test_partition", "test_partition_date", "test_partition_datetime"):
        assert m.partition_add_up_to_nr_of_free_partitions("public", t, 3, AS_OF)
        assert m.partition_calculate_free_partitions("public", t, as_of=AS_OF) == 3
    assert names(m, "test_partition") == ["mammoth", "7000000_8000000", "8000000_9000000"]  # an empty table counts its first partition
    assert names(m, "test_partition_date")[1:] == ["20230101_20230201", "20230201_20230301", "20230301_20230401", "20230401_20230501", "20230501_20230601", "20230601_20230701"]
    assert len(names(m, "test_partition_datetime")) == 13 and names(m, "test_partition_datetime")[-1] == "20230320_20230327"
    assert m.partition_get_last_partition_details("public", "test_partition_date").first().asDict() == {"childrelname": "test_partition_date_20230601_20230701", "range": ["2023-06-01", "2023-07-01"]}
    with pytest.raises(NotPartitioned):
        m.partition_add_up_to_nr_of_free_partitions("public", "test_partition_inh", 3, AS_OF)


def test_3_statements(m):
    plain = m.partition_add_concurrent_index_on_partitioned_table("public", "test_partition", ["vendor_id"]).collect()
    assert len(plain) == 4
    assert plain[0].stmt == "/* Creating index 1 of 4 */ create index concurrently test_partition_7000000_8000000_vendor_id_idx on public.test_partition_7000000_8000000 using btree (vendor_id);"
    assert plain[3].stmt == "/* Creating index 4 of 4 */ create index test_partition_vendor_id_idx on public.test_partition using btree (vendor_id);"
    several = m.partition_add_concurrent_index_on_partitioned_table("public", "test_partition_date", ["lower(extra)", "rate_code_id desc nulls first"], "btree").collect()
    assert len(several) == 9 and "extra_rate_code_id" in several[0].index_name and several[8].table_name.endswith("_template")
    unique = m.partition_add_concurrent_index_on_partitioned_table("public", "test_partition_datetime", ["id"], "btree", True).collect()
    assert len(unique) == 13 and all("create unique index concurrently" in r.stmt for r in unique)
    keys = m.partition_add_foreign_key_on_partitioned_table("public", "test_partition_datetime", "fk", "test_partition", ["id"], ["id"]).collect()
    assert [r.block for r in keys] == [1] * 13 + [2] * 13 + [3]
    assert keys[26].stmt == "alter table public.test_partition_datetime add constraint fk foreign key (id) references test_partition(id);"
    with pytest.raises(PartitionError, match="method"):
        m.partition_add_concurrent_index_on_partitioned_table("public", "test_partition", ["id"], "magic")


def insert(m, spark, rows):
    m.insert("public", "test_partition", spark.createDataFrame([(i, date.fromisoformat(d)) for i, d in rows], "id bigint, trip_date date"))


def bounds(m):
    return {p.partition_name.removeprefix("test_partition_"): {c["op"]: c["value"] for c in p.constraints} for p in m.registry.load().children("public", "test_partition") if p.constraints}


def test_4_constraints(m, spark):
    insert(m, spark, [(8000000, "2000-01-01"), (8999999, "2000-12-31")])
    assert m.partition_add_constraints("public", "test_partition", "trip_date", "trip_date") == 2
    assert bounds(m) == {"8000000_9000000": {">=": "2000-01-01", "<=": "2000-12-31"}}
    assert m.partition_add_constraints("public", "test_partition", "trip_date", "trip_date") == 0
    with pytest.raises(OutOfRange):
        insert(m, spark, [(8000005, "1999-01-01")])
    with pytest.raises(OutOfRange):
        insert(m, spark, [(0, "1999-01-01")])
    with pytest.raises(UnsupportedKey):
        m.partition_add_constraints("public", "test_partition", "x", "vendor_id")
    assert m.scan("public", "test_partition", (8000000, 9000000)).count() == 2
    assert m.scan("public", "test_partition", where={"trip_date": (date(2001, 1, 1), None)}).count() == 0


def test_5_detach_and_drop(m):
    with pytest.raises(PartitionError, match="oldest"):
        m.partition_detach_partition("public", "test_partition_datetime", "test_partition_datetime_20230109_20230116", as_of=AS_OF)
    with pytest.raises(PartitionError, match="not noted"):
        m.partition_drop_detached_partition("public", "test_partition_datetime", "test_partition_datetime_20230102_20230109")
    assert m.partition_detach_partition("public", "test_partition_datetime", "test_partition_datetime_20230102_20230109", as_of=AS_OF)
    assert m.registry.load().journal[0]["range"] == ["2023-01-02 00:00:00", "2023-01-09 00:00:00"]
    assert m.partition_drop_detached_partition("public", "test_partition_datetime", "test_partition_datetime_20230102_20230109")
    assert m.registry.load().journal == [] and len(names(m, "test_partition_datetime")) == 12


def test_6_maintenance(m, spark):
    m.configure("public", "test_partition", {"auto-maintenance": True, "date_constraint": {"marker": "trip_date", "constraint_column": "trip_date"}, "nr": 4})
    m.configure("public", "test_partition_datetime", {"auto-maintenance": True, "nr": 6, "detach": "13 days", "drop_detached": "4 days"})
    insert(m, spark, [(7000000, "2001-01-01"), (7999999, "2001-12-31")])
    done = maintenance.run(m, AS_OF)
    assert names(m, "test_partition")[-1] == "14000000_15000000" and len(names(m, "test_partition")) == 9
    assert bounds(m)["7000000_8000000"] == {">=": "2001-01-01", "<=": "2001-12-31"}
    assert names(m, "test_partition_datetime")[-1] == "20230424_20230501"
    assert names(m, "test_partition_datetime", "detached") == ["20230109_20230116", "20230116_20230123", "20230123_20230130", "20230130_20230206", "20230206_20230213"]
    assert [d["step"] for d in done] == ["add", "add", "constrain"] + ["detach"] * 5
    m.registry.update(lambda s: [j.update(detached_date=date(2023, 1, 9 + 14 - 7)) for j in s.journal])
    done = maintenance.run(m, AS_OF)
    assert [d["step"] for d in done][-5:] == ["drop"] * 5 and m.registry.load().journal == []
    assert len(names(m, "test_partition_datetime")) == 12
    assert audit(m.registry.load().partitions) == []


def test_7_refusals(m, spark, tmp_path):
    with pytest.raises(PartitionError, match="already"):
        m.partition_table("public", "test_partition", "id", 1, 2, "1", "native")
    with pytest.raises(PartitionError, match="not supported"):
        m.partition_table("public", "test_partition", "id", 1, 2, "1", "list")
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a", date(2020, 1, 1)), (50, "b", None)], "id bigint, name string, d date").write.parquet(path)
    m.register("public", "t", path)
    with pytest.raises(UnsupportedKey):
        m.partition_table("public", "t", "name", 1, 2, "1", "native")
    with pytest.raises(OutOfRange):
        m.partition_table("public", "t", "id", 1, 50, "10", "native")
    with pytest.raises(OutOfRange):  # a null key
        m.partition_table("public", "t", "d", "2000-01-01", "2021-01-01", "1 month", "native")
    assert m.partition_table("public", "t", "id", 1, 51, "10", "native")
    assert m.scan("public", "t").count() == 2
    with pytest.raises(UnsupportedKey):
        m.partition_calculate_free_partitions("public", "test_partition_date", "r1", AS_OF)
    with pytest.raises(PartitionError):
        m.partition_detach_partition("public", "t", "nothing", detach_last=False)
    m.add_foreign_key("public", "x", "x_t_fk", ["id"], "test_partition_inh2", ["id"])
    m.register("public", "test_partition_inh2", path)
    with pytest.raises(PartitionError, match="foreign key"):
        m.partition_table("public", "test_partition_inh2", "id", 1, 99, "10", "inheritance")


def test_8_ranges(m, spark, tmp_path):
    """Ranges by id, of which r1 is not r10; the fewest free partitions count."""
    path = f"file://{tmp_path}/multi"
    spark.createDataFrame([(5,), (1500,), (10_500,)], "id bigint").write.parquet(path)
    m.register("public", "multi", path)
    m.partition_table("public", "multi", "id", 0, 1_000_000, "1000", "native")

    def change(s):
        base = next(p for p in s.partitions if p.parent_name == "multi" and p.kind == "regular")
        s.partitions = [p for p in s.partitions if p is not base]
        for r, lo in (("r1", 0), ("r1", 1000), ("r1", 2000), ("r10", 10_000), ("r10", 11_000)):
            s.partitions.append(replace(base, partition_name=f"multi_{r}_{lo}_{lo + 1000}", range_id=r, lower=lo, upper=lo + 1000, path=f"{base.path}{lo}{r}"))

    m.registry.update(change)
    assert m.partition_calculate_free_partitions("public", "multi", "r1") == 1
    assert m.partition_calculate_free_partitions("public", "multi", "r10") == 1
    assert m.partition_add_up_to_nr_of_free_partitions("public", "multi", 3)
    got = [p.partition_name for p in m.registry.load().children("public", "multi") if p.range_id == "r10"]
    assert got[-1] == "multi_r10_13000_14000" and m.partition_calculate_free_partitions("public", "multi") == 3
    assert m.partition_get_last_partition_details("public", "multi", "r1").first().childrelname == "multi_r1_4000_5000"


def test_9_likes(m):
    m.add_index("public", "test_partition_inh", "test_partition_inh_extra_idx", ["extra"])
    m.add_foreign_key("public", "test_partition_inh", "test_partition_inh_fk", ["vendor_id"], "vendors", ["id"])
    assert m.partition_create_table_inherits_from_template("public", "test_partition_inh", "Extra")
    assert m.partition_copy_indexes_to_new_table("public", "test_partition_inh", "test_partition_inh_extra")
    assert m.partition_copy_fk_to_new_table("public", "test_partition_inh", "test_partition_inh_extra")
    s = m.registry.load()
    assert sorted(i.index_name for i in s.indexes if i.table_name == "test_partition_inh_extra") == ["test_partition_inh_extra_extra_idx", "test_partition_inh_extra_pkey"]
    assert [f.name for f in s.foreign_keys if f.table_name == "test_partition_inh_extra"] == ["test_partition_inh_extra_fk"]
