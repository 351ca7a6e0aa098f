"""Connected components of an edge table, without the driver and without cached lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared


#: A node with more than one in so many links is a hub.
HUB_SHARE = 1000


def shared_folder(spark: SparkSession) -> str:
    """The URI of a folder that all executors share: what the cluster names; a local one only where master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared.shared_folder(spark))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _star(pairs: DataFrame, total: int | None, larger: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to the least of the node and its neighbours.

    `total`, if given, bounds the number of pairs. Then a hub, with more than one in HUB_SHARE of them, gets its least by broadcast: there are
    fewer than HUB_SHARE hubs, and so no task has all pairs of one.
    """
    low = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    if total is None:
        joined = pairs.join(low.select("u", "m"), "u")
    else:
        hub = F.col("n") * HUB_SHARE > total
        hubs = F.broadcast(low.where(hub).select("u", "m"))
        joined = pairs.join(hubs.select("u"), "u", "left_anti").join(low.where(~hub).select("u", "m"), "u").unionByName(pairs.join(hubs, "u"))
    if larger:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def components(edges: DataFrame, split_hubs: bool = True) -> DataFrame:
    """(node, root) of every node with an edge in edges(a, b): the root is the component's least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): edges never outgrow their first
    number, and the steps needed grow with the logarithm of the longest chain. `split_hubs` keeps the links of a hub out
    of one task, at the cost of broadcasts and of memory.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    while seen[0]:
        total = 2 * seen[0] if split_hubs else None
        grown = _star(_both(edges), total, larger=True)
        # edges now go from a larger node to a smaller one; each node's smaller neighbours are its own rows
        edges = saved(_star(grown.select(F.col("a").alias("u"), F.col("b").alias("v")), total, larger=False))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
