"""All pairs of nodes, without a search from each: nodes that hang from one other node are left out of it.

A node all of whose links are with one and the same other node, its root, lies
inside no path between others, and every path from or to it takes that one
link.  The search so runs between the remaining nodes, the core; values of
hanging nodes follow from their roots' by one step at either end, exactly, in
two joins that give each pair of nodes once and shuffle no pair.  A graph
without such nodes is searched as before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.functions.semiring import Semiring, kind_of
from arcweave.functions.session import stored, written, written_with
from arcweave.operators.closure import closure_all, epistemic, relax, through_neighbours
from arcweave.operators.graph import links

#: Tables of at most so many rows go to all tasks of a spread whole; larger ones are the planner's choice.
SMALL = 1_000_000
#: Pairs of a task of a spread.
SHARE = 4_000_000


@dataclass
class Hanging:
    """A graph taken apart: edges of the core, and node, root, up, down, out of all nodes.

    up, down: best weight of the links to and from the root, null if there is
    none or the node is of the core (then root is the node itself).  out: has a
    link that leaves it.
    """

    core: DataFrame
    places: DataFrame
    nodes: int
    hanging: int

    def inner(self) -> DataFrame:
        """The nodes of the core, as seeds."""
        return self.places.where("node = root").select(F.col("node").alias("key"), "node")

    def ends(self, weight: str, semiring: Semiring, start: float) -> DataFrame:
        """node, root, step: the cost between a node and its root (0 steps: start); nodes without that link are left out."""
        step = F.when(F.col("node") == F.col("root"), F.lit(start)).otherwise(semiring.of(F.col(weight)))
        return self.places.where((F.col("node") == F.col("root")) | F.col(weight).isNotNull()).select("node", "root", step.alias("step"))

    def spread(self, found: DataFrame, sources: DataFrame, targets: DataFrame, cost) -> DataFrame:
        """src, dst, cost, from found(key, node, cost) of the core: every source with every target that its root reaches.

        cost(up, cost, down): the cost of a pair.  Only sources are dealt to tasks; a pair is made where it is written.
        """
        found, n = written_with(found.select("key", "node", "cost"), "found")
        whole = lambda df, rows: F.broadcast(df) if rows <= SMALL else df
        sources = sources.select(F.col("node").alias("src"), F.col("root").alias("key"), F.col("step").alias("up"))
        if n <= SMALL:
            tasks = max(1, min(self.nodes, self.nodes**2 // SHARE))
            first = sources.repartition(tasks, "src").join(whole(found, n), "key")
        else:
            first = found.join(whole(sources, self.nodes), "key")
        last = targets.select(F.col("node").alias("dst"), F.col("root").alias("node"), F.col("step").alias("down"))
        return first.join(whole(last, self.nodes), "node").select("src", "dst", cost(F.col("up"), F.col("cost"), F.col("down")).alias("cost"))


def hanging(edges: DataFrame) -> Hanging:
    """Of two nodes that are linked with each other only, the larger hangs; a node with a loop does not."""
    edges = stored(edges, "edges")
    used, none = links(edges), F.lit(None).cast("double")
    ends = used.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("weight").alias("up"), none.alias("down"))
    ends = ends.union(used.select(F.col("dst").alias("node"), F.col("src").alias("other"), none, F.col("weight")))
    nodes = ends.groupBy("node").agg(F.min("other").alias("root"), F.max("other").alias("last"), F.max("up").alias("up"), F.max("down").alias("down"))
    nodes = written(nodes.withColumn("lone", (F.col("root") == F.col("last")) & (F.col("root") != F.col("node"))), "nodes")
    lone = nodes.where("lone").select(F.col("node").alias("root"), F.lit(True).alias("both"))
    hangs = F.col("lone") & (F.col("both").isNull() | (F.col("node") > F.col("root")))
    kept = lambda c: F.when(F.col("hangs"), F.col(c))
    places = nodes.join(lone, "root", "left").withColumn("hangs", hangs)
    places = places.select("node", F.coalesce(kept("root"), F.col("node")).alias("root"), kept("up").alias("up"), kept("down").alias("down"), F.col("up").isNotNull().alias("out"), "hangs")
    places, n = written_with(places, "places", "hangs")
    gone = places.where("hangs").select("node")
    core = used.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return Hanging(written(core.select("src", "dst", "weight"), "core"), places.drop("hangs"), places.count(), n)


def pairs(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.select("src", "dst", value.alias(name))


def closure_pairs(edges: DataFrame, kind: str = "ultrametric") -> DataFrame:
    """src, dst, prox of every node with all that it reaches, itself (1) included: closure_all() without hops."""
    semiring, edges = kind_of(kind), stored(edges, "edges")
    graph = hanging(edges)
    if not graph.hanging:
        return closure_all(edges, kind).select("src", "dst", "prox")
    up, down = (graph.ends(c, semiring, semiring.start) for c in ("up", "down"))
    found = relax(graph.core, graph.inner(), semiring)
    both = graph.spread(found, up, down, lambda u, c, d: semiring.add(semiring.add(u, c), d)).where("src <> dst")
    own = graph.places.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(semiring.start).alias("cost"))
    return pairs(both.union(own), semiring.back(F.col("cost")), "prox")


def epistemic_pairs(edges: DataFrame, kind: str = "ultrametric") -> DataFrame:
    """src, dst, value: epistemic() from every node that a link leaves.

    A hanging target has one neighbour, its root: its value is the root's
    closure.  A target of the core takes its best neighbour of the core, or 1
    where a link leads to it.
    """
    semiring, edges = kind_of(kind), stored(edges, "edges")
    graph = hanging(edges)
    if not graph.hanging:
        return epistemic(edges, links(edges).select("src").distinct(), kind)
    start = F.lit(semiring.start)
    sources = graph.ends("up", semiring, semiring.start).join(graph.places.where("out").select("node"), "node", "left_semi")
    found = written(relax(graph.core, graph.inner(), semiring), "closure")
    leaves = graph.ends("down", semiring, semiring.start).where("node <> root")
    far = graph.spread(found, sources, leaves, lambda u, c, d: semiring.add(u, c)).where("src <> dst")
    best = through_neighbours(found, graph.core).where("key <> node")
    direct = graph.core.select(F.col("src").alias("key"), F.col("dst").alias("node"), F.lit(True).alias("sure")).distinct()
    best = best.join(direct, ["key", "node"], "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
    joined = sources.select(F.col("node").alias("src"), F.col("root").alias("key"), "step").join(best, "key")
    near = joined.select("src", F.col("node").alias("dst"), F.when((F.col("src") == F.col("key")) & F.col("sure"), start).otherwise(semiring.add(F.col("step"), F.col("cost"))).alias("cost"))
    own = sources.select(F.col("node").alias("src"), F.explode(F.array_distinct(F.array("node", "root"))).alias("dst"), start.alias("cost"))
    return pairs(far.union(near).union(own), semiring.back(F.col("cost")), "value")


def maxmin_pairs(edges: DataFrame, semiring: Semiring) -> DataFrame:
    """src, dst, cost of the best path of one link or more between every two nodes; of a node with itself: its best cycle."""
    graph = hanging(edges)
    if not graph.hanging:
        found = relax(edges, edges.select(F.col("src").alias("key"), F.col("dst").alias("node"), semiring.of(F.col("weight")).alias("cost")), semiring)
        return found.select(F.col("key").alias("src"), F.col("node").alias("dst"), "cost")
    none = float("-inf")
    up, down = (graph.ends(c, semiring, none) for c in ("up", "down"))
    core = graph.core
    found = written(relax(core, core.select(F.col("src").alias("key"), F.col("dst").alias("node"), semiring.of(F.col("weight")).alias("cost")), semiring), "closure")
    still = found.where("key <> node").select("key", "node", "cost").union(graph.inner().withColumn("cost", F.lit(none)))
    both = graph.spread(still, up, down, lambda u, c, d: F.greatest(u, c, d)).where(F.col("cost") > F.lit(none))
    turn = graph.places.where("up IS NOT NULL AND down IS NOT NULL").select(F.col("root").alias("node"), F.greatest(semiring.of(F.col("up")), semiring.of(F.col("down"))).alias("cost"))
    cycles = found.where("key = node").select("node", "cost").union(turn).groupBy("node").agg(F.min("cost").alias("cost"))
    return both.union(cycles.select(F.col("node").alias("src"), F.col("node").alias("dst"), "cost"))


def closeness_of_edges(edges: DataFrame, kind: str = "ultrametric") -> DataFrame:
    """src, dst, weight, prox of each edge of positive weight: its own weight and the closure of its ends."""
    semiring, edges = kind_of(kind), stored(edges, "edges")
    graph = hanging(edges)
    own = links(edges).where("weight > 0")
    found = relax(graph.core, graph.inner(), semiring).select(F.col("key").alias("src"), F.col("node").alias("dst"), "cost")
    inner = own.join(found, ["src", "dst"])
    if graph.hanging:
        hung, start = graph.places.where("node <> root"), F.lit(semiring.start)
        for a, b, weight in (("src", "dst", "up"), ("dst", "src", "down")):
            at = hung.select(F.col("node").alias(a), semiring.add(start, semiring.of(F.col(weight))).alias("cost"))
            inner = inner.union(own.join(at, a).select("src", "dst", "weight", "cost"))
    return inner.select("src", "dst", "weight", semiring.back(F.col("cost")).alias("prox"))
