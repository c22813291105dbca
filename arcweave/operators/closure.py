"""Path closures by frontier relaxation.

The state holds the best row of each (key, node) reached: the least cost of a
path from the key's start, and its hops.  A round joins the rows that changed in
the last round with the edges, keeps the best candidate of each (key, node), and
writes those that are better than the state's: only changed rows are written.
Costs never fall along a path, so the loop ends; a node's value is final with the
fewest hops of an optimal path.  All tables are written and read back with known
sizes: the planner broadcasts the smaller side where it is small, and splits hot
nodes.  Once the state is large, candidates are written too, so that a few of
them are broadcast to the state instead of the state being shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.semiring import Semiring, kind_of
from arcweave.functions.session import Levels, stored, written, written_with
from arcweave.operators.graph import links

#: Rows of state from which on candidates are written before they meet it.
LARGE = 1_000_000


def best_rows(paths: bool):
    """Of rows (key, node, cost, hops [, path]), the one of least cost of each (key, node)."""
    fields = ("cost", "hops", "path") if paths else ("cost", "hops")

    def merge(df: DataFrame) -> DataFrame:
        found = df.groupBy("key", "node").agg(F.min(F.struct(*fields)).alias("b"))
        return found.select("key", "node", *(F.col(f"b.{c}").alias(c) for c in fields))

    return merge


def relax(edges: DataFrame, seeds: DataFrame, semiring: Semiring, banned: DataFrame | None = None, paths: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """key, node, cost, hops [, path] from seeds(key, node [, cost]); a seed without a cost starts a path.

    banned(key, node): a first step that the key may not take.  paths: also one
    optimal path, of fewest hops, the smallest by its nodes within a round.
    targets(key, node [, goal]): rows that could no longer better a key's worst
    goal are not extended, and without any other the search ends.  A goal is as
    good as the best of its nodes (a node is a goal of its own by default); the
    best rows of all goals are found as without targets.
    """
    edges = stored(edges, "edges")
    steps = links(edges).select("src", "dst", semiring.of(F.col("weight")).alias("step"))
    fields = ["key", "node", "cost", "hops", *(["path"] if paths else [])]
    if "cost" not in seeds.columns:
        seeds = seeds.distinct().withColumn("cost", F.lit(semiring.start))
    seeds = seeds.withColumn("hops", F.lit(0)).withColumn("path", F.array("node"))
    levels = Levels("state", best_rows(paths))
    if targets is not None:
        targets = stored(targets if "goal" in targets.columns else targets.withColumn("goal", F.col("node")), "targets")
    front, n = written_with(seeds.select(*fields), "state")
    hops = 0
    while n:
        levels.add(front, n)
        hops += 1
        if targets is not None:
            reached = levels.union().select("key", "node", "cost").join(targets.select("key", "node").distinct(), ["key", "node"], "left_semi").groupBy("key", "node").agg(F.min("cost").alias("cost"))
            goals = targets.join(reached, ["key", "node"], "left").groupBy("key", "goal").agg(F.min(F.coalesce("cost", F.lit(float("inf")))).alias("cost"))
            front, n = written_with(front.join(goals.groupBy("key").agg(F.max("cost").alias("worst")), "key").where(F.col("cost") < F.col("worst")).drop("worst"), "front")
            if not n:
                break
        moved = front.join(steps, front.node == steps.src).select("key", F.col("dst").alias("node"), semiring.add(F.col("cost"), F.col("step")).alias("cost"), *([F.array_append("path", F.col("dst")).alias("path")] if paths else []))
        if banned is not None and hops == 1:
            moved = moved.join(banned, ["key", "node"], "left_anti")
        if paths:
            best = moved.groupBy("key", "node").agg(F.min(F.struct("cost", "path")).alias("b")).select("key", "node", F.col("b.cost").alias("cost"), F.col("b.path").alias("path"))
        else:
            best = moved.groupBy("key", "node").agg(F.min("cost").alias("cost"))
        known = levels.union().select("key", "node", F.col("cost").alias("known"))
        if levels.count() > LARGE:
            best = written(best, "candidates")
            known = known.join(best.select("key", "node"), ["key", "node"], "left_semi")
        known = known.groupBy("key", "node").agg(F.min("known").alias("known"))
        better = best.join(known, ["key", "node"], "left").where(F.col("known").isNull() | (F.col("cost") < F.col("known")))
        front, n = written_with(better.withColumn("hops", F.lit(hops)).select(*fields), "state")
    return levels.all() if levels.parts else front


def closure(edges: DataFrame, sources: DataFrame, kind: str = "ultrametric", paths: bool = False) -> DataFrame:
    """src, dst, prox, hops [, path] of all nodes reached from sources(src); a source reaches itself with 1."""
    semiring = kind_of(kind)
    found = relax(edges, sources.select(F.col("src").alias("key"), F.col("src").alias("node")), semiring, paths=paths)
    return found.select(F.col("key").alias("src"), F.col("node").alias("dst"), semiring.back(F.col("cost")).alias("prox"), "hops", *(["path"] if paths else []))


def closure_st(edges: DataFrame, pairs: DataFrame, kind: str = "ultrametric", paths: bool = False) -> DataFrame:
    """src, dst, prox, hops [, path] of pairs(src, dst); a pair without a path has no row."""
    semiring = kind_of(kind)
    seeds = pairs.select(F.col("src").alias("key"), F.col("src").alias("node")).distinct()
    targets = pairs.select(F.col("src").alias("key"), F.col("dst").alias("node")).distinct()
    found = relax(edges, seeds, semiring, paths=paths, targets=targets).join(targets, ["key", "node"])
    return found.select(F.col("key").alias("src"), F.col("node").alias("dst"), semiring.back(F.col("cost")).alias("prox"), "hops", *(["path"] if paths else []))


def in_range(df: DataFrame, column: str, start: int | None = None, offset: int | None = None) -> DataFrame:
    """Rows with start <= column < start + offset; offset is a count, None leaves that side open."""
    low = 0 if start is None else start
    df = df.where(F.col(column) >= low) if start is not None else df
    return df.where(F.col(column) < low + offset) if offset is not None else df


def closure_all(edges: DataFrame, kind: str = "ultrametric", start: int | None = None, offset: int | None = None, paths: bool = False) -> DataFrame:
    """closure() from every node that has an edge, or (numeric nodes) from those in a range."""
    edges = stored(edges, "edges")
    nodes = links(edges).select("src").union(links(edges).select("dst")).distinct()
    return closure(edges, in_range(nodes, "src", start, offset), kind, paths)


def through_neighbours(found: DataFrame, edges: DataFrame, paths: bool = False) -> DataFrame:
    """key, node, cost [, path]: the best value of an in-neighbour of each node; ties: fewest hops, then the smallest neighbour."""
    steps = links(edges).select(F.col("src").alias("node"), F.col("dst"))
    joined = found.join(steps, "node")
    best = F.min(F.struct("cost", "hops", "node", *(["path"] if paths else []))).alias("b")
    out = joined.groupBy("key", "dst").agg(best if paths else F.min("cost").alias("cost"))
    if not paths:
        return out.select("key", F.col("dst").alias("node"), "cost")
    return out.select("key", F.col("dst").alias("node"), F.col("b.cost").alias("cost"), F.array_append("b.path", F.col("dst")).alias("path"))


def epistemic(edges: DataFrame, sources: DataFrame, kind: str = "ultrametric", paths: bool = False) -> DataFrame:
    """src, dst, value [, path]: 1 for the source itself and its neighbours (empty path), else the best in-neighbour's closure.

    One relaxation serves all targets of a source.
    """
    semiring, edges = kind_of(kind), stored(edges, "edges")
    seeds = sources.select(F.col("src").alias("key"), F.col("src").alias("node")).distinct()
    found = relax(edges, seeds, semiring, paths=paths)
    reached = through_neighbours(found, edges, paths)
    sure = links(edges).join(seeds.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("src").alias("key"), F.col("dst").alias("node"))
    sure = sure.union(seeds).distinct().withColumn("sure", F.lit(True))
    merged = reached.join(sure, ["key", "node"], "full")
    value = F.when(F.col("sure"), F.lit(1.0)).otherwise(semiring.back(F.col("cost"))).alias("value")
    path = [F.when(F.col("sure"), F.slice("path", 1, 0)).otherwise(F.col("path")).alias("path")] if paths else []
    return merged.select(F.col("key").alias("src"), F.col("node").alias("dst"), value, *path)


def epistemic_st(edges: DataFrame, pairs: DataFrame, kind: str = "ultrametric", paths: bool = False) -> DataFrame:
    """epistemic() for pairs(src, dst)."""
    return epistemic(edges, pairs.select("src").distinct(), kind, paths).join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
