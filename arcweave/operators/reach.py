"""Reachability and hop-shortest paths; edges of weight zero count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.session import Levels, missing, stored, written, written_with


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """src, node: all nodes that sources(src) reach by one or more edges; a source itself only if it lies on a cycle."""
    steps = stored(edges.select(F.col("src").alias("at"), F.col("dst").alias("node")).distinct(), "steps")
    seen = Levels("seen")
    front, n = written_with(sources.select("src", F.col("src").alias("at")).distinct().join(steps, "at").select("src", "node").distinct(), "seen")
    while True:
        seen.add(front, n)
        if not n:
            return seen.all()
        new = front.withColumnRenamed("node", "at").join(steps, "at").select("src", "node").distinct()
        front, n = written_with(new.join(seen.all(), ["src", "node"], "left_anti"), "seen")


def shortest(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, path: the smallest of the paths of fewest edges for pairs(src, dst); src = dst asks for the shortest cycle; no path, no row.

    The search carries each node's rank, by path, among those a round reaches
    from its source: the least predecessor gives the least path.  Paths are put
    together afterwards, for the pairs asked for, from the predecessors.
    """
    steps = stored(edges.select(F.col("src").alias("at"), F.col("dst").alias("node")).distinct(), "steps")
    wanted = stored(pairs.select("src", F.col("dst").alias("node")).distinct(), "pairs")
    front, n, hops = wanted.select("src", F.col("src").alias("node"), F.lit(0).cast("long").alias("rank")).distinct(), 1, 0
    seen = Levels("seen")
    while n:
        hops += 1
        new = front.select("src", F.col("node").alias("at"), "rank").join(steps, "at").groupBy("src", "node").agg(F.min(F.struct("rank", "at")).alias("b"))
        if seen.parts:
            new = new.join(seen.all().select("src", "node"), ["src", "node"], "left_anti")
        # paths of equal length compare as their predecessors' paths, then by node; numbers that rise in that order need no one task
        ranked = new.select("src", "node", F.col("b.rank").alias("rank"), F.col("b.at").alias("at")).repartitionByRange("rank", "node").sortWithinPartitions("rank", "node")
        front, n = written_with(ranked.select("src", "node", F.monotonically_increasing_id().alias("rank"), "at", F.lit(hops).alias("hops")), "seen")
        seen.add(front, n)
        open_ = wanted.join(seen.all(), ["src", "node"], "left_anti").select("src").distinct()
        if missing(open_):
            break
        front = front.join(open_, "src", "left_semi")
    found = seen.all()
    path = found.join(wanted, ["src", "node"], "left_semi").select("src", F.col("node").alias("dst"), F.array("at", "node").alias("path"), "at", F.col("hops").alias("left"))
    for turn in range(hops - 1):
        back = found.select("src", F.col("node").alias("at"), F.col("at").alias("before"), F.col("hops").alias("back_hops"))
        path = path.join(back, ["src", "at"], "left")
        on = (F.col("left") > 1) & (F.col("back_hops") == F.col("left") - 1)
        path = path.select("src", "dst", F.when(on, F.array_prepend("path", F.col("before"))).otherwise(F.col("path")).alias("path"), F.when(on, F.col("before")).otherwise(F.col("at")).alias("at"), F.when(on, F.col("left") - 1).otherwise(F.col("left")).alias("left"))
        path = written(path, "paths") if turn % 8 == 7 else path
    return path.select("src", "dst", "path")


def shortest_lists(edges: DataFrame, sources: list, targets: list) -> DataFrame:
    """shortest() for two lists of equal length, taken in pairs."""
    if len(sources) != len(targets):
        raise ValueError("sources and targets differ in length")
    kind = dict(edges.dtypes)["src"]
    pairs = edges.sparkSession.createDataFrame(list(zip(sources, targets, strict=True)), f"src {kind}, dst {kind}")
    return shortest(edges, pairs)
