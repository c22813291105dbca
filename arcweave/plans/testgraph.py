"""Graphs derived from the driver's tables; a node is `<table>:<key>`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.session import written
from arcweave.operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def arcs(df: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    return df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers in nations in regions."""
    supplier = arcs(table(spark, sf_dir, "supplier"), node("supplier", "s_suppkey"), "inNation", node("nation", "s_nationkey"))
    customer = arcs(table(spark, sf_dir, "customer"), node("customer", "c_custkey"), "inNation", node("nation", "c_nationkey"))
    return supplier.union(customer).union(arcs(table(spark, sf_dir, "nation"), node("nation", "n_nationkey"), "inRegion", node("region", "n_regionkey")))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their suppliers, those in nations in regions: all rows of lineitem and supplier."""
    first = arcs(table(spark, sf_dir, "lineitem"), node("part", "l_partkey"), "soldBy", node("supplier", "l_suppkey")).distinct()
    second = arcs(table(spark, sf_dir, "supplier"), node("supplier", "s_suppkey"), "inNation", node("nation", "s_nationkey"))
    return first.union(second).union(regions(spark, sf_dir))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcs(table(spark, sf_dir, "nation"), node("nation", "n_nationkey"), "inRegion", node("region", "n_regionkey"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose customers bought from nations' suppliers, over all lineitem, orders, customer and supplier rows, and their regions.

    Orders and lines get their nations before they meet, and the few pairs of
    nations are written: a graph reads its arcs several times, and all lines
    would be joined each time.
    """
    orders, customer, lines, supplier = (table(spark, sf_dir, name) for name in ("orders", "customer", "lineitem", "supplier"))
    buyers = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(customer.select("c_custkey", "c_nationkey"), "c_custkey").select("l_orderkey", "c_nationkey")
    sellers = lines.select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).join(supplier.select("s_suppkey", "s_nationkey"), "s_suppkey").select("l_orderkey", "s_nationkey")
    both = written(sellers.join(buyers, "l_orderkey").select("c_nationkey", "s_nationkey").distinct(), "flows")
    return arcs(both, node("nation", "c_nationkey"), "buysFrom", node("nation", "s_nationkey")).union(regions(spark, sf_dir))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows(), and all suppliers in their nations: a graph with cycles whose pairs of nodes can all be listed."""
    return flows(spark, sf_dir).union(arcs(table(spark, sf_dir, "supplier"), node("supplier", "s_suppkey"), "inNation", node("nation", "s_nationkey")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users to event types, one arc for each event."""
    return arcs(table(spark, sf_dir, "events"), node("user", "user_id"), "did", F.concat(F.lit("type:"), F.col("event_type")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to customers and parts: hubs with many arcs."""
    return arcs(table(spark, sf_dir, "orders"), node("order", "o_orderkey"), "by", node("customer", "o_custkey")).union(arcs(table(spark, sf_dir, "lineitem"), node("order", "l_orderkey"), "of", node("part", "l_partkey")))


def plain(triples: DataFrame) -> DataFrame:
    """Distinct arcs as edges of weight 1."""
    return triples.select(F.col("subject").alias("src"), F.col("object").alias("dst")).distinct().withColumn("weight", F.lit(1.0))


def counted(triples: DataFrame) -> DataFrame:
    """Arcs as edges weighted by how often they occur."""
    return graph.edges_of(triples, "subject", "object", None)


def proximity(triples: DataFrame, weight: str = "degree") -> DataFrame:
    """Arcs as an undirected graph with degree weights."""
    return graph.weighted(plain(triples), weight, True)
