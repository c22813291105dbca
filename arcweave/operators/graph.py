"""Shaping an edge table (src, dst, weight): duplicates, symmetry, degrees, weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.functions.semiring import dist_to_sim
from arcweave.functions.session import stored, written


def edges_of(records: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = "weight") -> DataFrame:
    """Coordinate records as edges: equal coordinates are summed, a missing weight column counts 1."""
    missing = [c for c in (src, dst, weight) if c and c not in records.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    value = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    return records.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.sum(value.cast("double")).alias("weight"))


def edges_of_map(table: DataFrame, column: str) -> DataFrame:
    """Edges of a map<node, map<node, weight>> column; a null or zero weight becomes 1."""
    outer = table.select(F.explode(column).alias("src", "inner"))
    inner = outer.select("src", F.explode("inner").alias("dst", "w"))
    return inner.select("src", "dst", F.when(F.col("w").isNull() | (F.col("w") == 0), 1.0).otherwise(F.col("w")).cast("double").alias("weight"))


def dense(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of a small node table (column id) with their weight, 0 where there is no edge."""
    grid = nodes.select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst")))
    return grid.join(edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def links(edges: DataFrame) -> DataFrame:
    """The edges that count for closures: weight other than zero."""
    return edges.where(F.col("weight") != 0)


def symmetric(edges: DataFrame) -> DataFrame:
    """a + b - sqrt(ab) of the weights of both directions (0 if absent); a self-loop stays as it is.

    Both orientations go through one aggregation: one shuffle, no self-join.
    """
    there = edges.select("src", "dst", F.col("weight").alias("a"), F.lit(0.0).alias("b"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("a"), F.col("weight").alias("b"))
    both = there.unionByName(back).groupBy("src", "dst").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.select("src", "dst", (F.col("a") + F.col("b") - F.sqrt(F.col("a") * F.col("b"))).alias("weight"))


def indegree(edges: DataFrame) -> DataFrame:
    """node, value: sum of the weights of its incoming edges."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("value"))


def log_indegree(edges: DataFrame) -> DataFrame:
    """node, value: natural logarithm of indegree."""
    return indegree(edges).select("node", F.log("value").alias("value"))


WEIGHTS: dict[str, Callable[[DataFrame], DataFrame]] = {"degree": indegree, "logdegree": log_indegree}


def weighted(edges: DataFrame, weight: str | Callable[[DataFrame], DataFrame] = "degree", undirected: bool = False) -> DataFrame:
    """Every edge gets the similarity 1 / (1 + value) of its head node; weight: a registered name, or a function of the edges."""
    if isinstance(weight, str) and weight not in WEIGHTS:
        raise ValueError(f"unknown weight: {weight!r}; one of {sorted(WEIGHTS)}")
    base = symmetric(edges) if undirected else edges_of(edges)
    values = (WEIGHTS[weight] if isinstance(weight, str) else weight)(base)
    return base.join(values.withColumnRenamed("node", "dst"), "dst").select("src", "dst", dist_to_sim(F.col("value")).alias("weight"))


def vertices(triples: DataFrame) -> DataFrame:
    """id, uri: the distinct subjects and objects, numbered from 0 in order.

    Numbers come from a range partitioning: each part counts its rows, and only
    those counts meet, so no single task sorts all nodes.
    """
    nodes = triples.select(F.col("subject").alias("uri")).union(triples.select("object")).distinct()
    return numbered(nodes, "uri", "id")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with a number from 0 in the order of a column of distinct values."""
    parts = written(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parts.withColumn("_rank", rank).join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_before") + F.col("_rank")).cast("long").alias(name)).select(name, *df.columns)


def collapsed(triples: DataFrame) -> DataFrame:
    """Parallel arcs as one: subject, object, and their predicates in order, joined by commas.  The input needs no order."""
    return triples.groupBy("subject", "object").agg(F.concat_ws(",", F.array_sort(F.collect_list("predicate"))).alias("predicates"))


def adjacency(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, uri; edges: k, row, col, predicates): arcs of each pair of nodes as one edge, numbered from 0 by their names."""
    nodes = stored(vertices(triples), "nodes")
    arcs = numbered(collapsed(triples).withColumn("_ends", F.struct("subject", "object")), "_ends", "k").drop("_ends")
    rows = arcs.join(nodes.select(F.col("uri").alias("subject"), F.col("id").alias("row")), "subject")
    return nodes, rows.join(nodes.select(F.col("uri").alias("object"), F.col("id").alias("col")), "object").select("k", "row", "col", "predicates")


def grouped(df: DataFrame, key: Column, value: str, pattern: str = "%s") -> DataFrame:
    """key (formatted) and the sorted values of each group."""
    return df.groupBy(F.format_string(pattern, key).alias("key")).agg(F.array_sort(F.collect_list(value)).alias("values"))


def repeated(df: DataFrame, column: str, times: int) -> DataFrame:
    """Each row's value, `times` times."""
    return df.select(F.explode(F.array_repeat(column, times)).alias(column))
