"""Nodes, ways and relations drawn from a star schema of orders, for tests and benchmarks.

A line's part and supplier are a node, an order with its lines is a way (every fourth is
closed by its first node), a customer's orders are a relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import OsmDataset


def _map(*pairs) -> F.Column:
    entries = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in pairs]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id() -> F.Column:
    return F.col("l_partkey") * 100000 + F.col("l_suppkey")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size")
    x, y = (F.col("l_partkey") * 37) % 36000 - 18000, (F.col("l_suppkey") * 53) % 18000 - 9000
    return keys.join(part, "l_partkey", "left").select(
        node_id().alias("id"), (x.cast("double") / F.lit(100.0)).alias("lon"), (y.cast("double") / F.lit(100.0)).alias("lat"),
        _map(("brand", F.col("p_brand")), ("ptype", F.col("p_type")), ("size", F.col("p_size"))).alias("tags"),
        F.lit(None).cast("int").alias("version"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("long").alias("changeset"),
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    listed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("ls"))
    refs = F.transform("ls", lambda x: x["l_partkey"] * 100000 + x["l_suppkey"])
    listed = listed.select(F.col("l_orderkey").alias("id"), refs.alias("refs"), F.element_at("ls", 1)["l_partkey"].alias("p_partkey"))
    closed = listed.withColumn("refs", F.when(F.col("id") % 4 == 0, F.concat("refs", F.slice("refs", 1, 1))).otherwise(F.col("refs")))
    kind = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("kind"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey")
    priority = F.when(F.col("id") % 11 != 0, F.col("o_orderpriority"))
    return closed.join(orders, "id").join(kind, "p_partkey", "left").select(
        "id", "refs", _map(("status", F.col("o_orderstatus")), ("priority", priority), ("kind", F.col("kind"))).alias("tags"),
        (F.col("id") % 7).cast("int").alias("version"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_custkey").alias("changeset"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    role = F.when(F.col("o_orderkey") % 3 == 0, "inner").otherwise("outer")
    member = F.struct(F.col("o_orderkey").alias("ref"), F.lit(1).alias("type"), role.alias("role"))
    listed = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(member)).alias("members"))
    segment = {"AUTOMOBILE": "multipolygon", "BUILDING": "boundary", "MACHINERY": "route"}
    kind = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in segment.items()], F.lower("c_mktsegment"))
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), kind.alias("kind"))
    return listed.join(customer, "o_custkey").select(
        F.col("o_custkey").alias("id"), "members", _map(("type", F.col("kind"))).alias("tags"),
        F.lit(None).cast("int").alias("version"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("long").alias("changeset"),
    )


def dataset(spark: SparkSession, sf_dir: str) -> OsmDataset:
    return OsmDataset(nodes(spark, sf_dir), ways(spark, sf_dir), relations(spark, sf_dir))
