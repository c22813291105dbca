"""Tasks on top of closures: backbone, link prediction, confusion matrix, batches, the baseline without closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.semiring import kind_of
from arcweave.functions.session import stored, written
from arcweave.operators.closure import closure, epistemic, in_range, relax, through_neighbours
from arcweave.operators.graph import links
from arcweave.operators.hanging import closeness_of_edges


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def backbone(edges: DataFrame, kind: str = "ultrametric", start: int | None = None, offset: int | None = None) -> DataFrame:
    """src, dst of the edges whose weight equals their closure; start, offset: a range of (numeric) sources."""
    edges = stored(edges, "edges")
    if start is None and offset is None:
        return closeness_of_edges(edges, kind).where(is_close(F.col("weight"), F.col("prox"))).select("src", "dst")
    own = in_range(links(edges), "src", start, offset).where("weight > 0")
    found = closure(edges, own.select("src").distinct(), kind).select("src", "dst", "prox")
    return own.join(found, ["src", "dst"]).where(is_close(F.col("weight"), F.col("prox"))).select("src", "dst")


def link_prediction(edges: DataFrame, pairs: DataFrame, kind: str = "ultrametric", paths: bool = False) -> DataFrame:
    """src, dst, value, removed [, path] of pairs(src, dst): the epistemic closure without the edge src -> dst.

    Pairs without that edge share one search per source.  A search from src can
    use the edge on its first step only, so each other pair is a key of its own
    whose first step to dst is banned, in the same relaxation.
    """
    semiring = kind_of(kind)
    edges = stored(links(edges), "edges")
    wanted = pairs.select("src", "dst").distinct().join(edges.select("src", "dst").distinct().withColumn("removed", F.lit(True)), ["src", "dst"], "left")
    wanted = wanted.withColumn("removed", F.coalesce("removed", F.lit(False)) & (F.col("src") != F.col("dst")))
    wanted = written(wanted.withColumn("key", F.struct("src", F.when(F.col("removed"), F.col("dst")).alias("ban"))), "pairs")
    wanted = wanted.withColumn("key", F.concat_ws("\u0001", F.col("src").cast("string"), F.col("key.ban").cast("string")))
    banned = wanted.where("removed").select("key", F.col("dst").alias("node"))
    # a pair needs the best neighbour of its goal; the source, the only row of a key without hops, is none of those of a banned edge
    goals = wanted.where("src <> dst").select("key", F.col("src").alias("from"), F.col("dst").alias("goal"), "removed")
    last = stored(edges.join(goals.select(F.col("goal").alias("dst")).distinct(), "dst", "left_semi"), "last")
    gates = goals.join(last.select(F.col("dst").alias("goal"), F.col("src").alias("node")).distinct(), "goal").where("NOT (removed AND node = from)").select("key", "node", "goal")
    found = relax(edges, wanted.select("key", F.col("src").alias("node")).distinct(), semiring, banned=banned, paths=paths, targets=gates)
    # the last step may not be the banned edge either: it leaves from the source, the only row of a key without hops
    open_ = found.join(wanted.where("removed").select("key", F.lit(True).alias("barred")).distinct(), "key", "left")
    free = through_neighbours(open_.where("barred IS NULL OR hops > 0").drop("barred"), last, paths)
    value = wanted.join(free.withColumnRenamed("node", "dst"), ["key", "dst"], "left")
    result = F.when(F.col("src") == F.col("dst"), F.lit(1.0)).otherwise(F.coalesce(semiring.back(F.col("cost")), F.lit(0.0)))
    path = [F.when(F.col("src") != F.col("dst"), F.col("path")).alias("path")] if paths else []
    return value.select("src", "dst", result.alias("value"), "removed", *path)


def pairs_of(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Every source with every target: both are the small tables of a request."""
    return sources.select("src").distinct().crossJoin(targets.select("dst").distinct())


def confusion_matrix(edges: DataFrame, sources: DataFrame, targets: DataFrame, kind: str = "ultrametric") -> DataFrame:
    """src, dst, value of all sources by all targets, each direct edge removed for its own cell."""
    return link_prediction(edges, pairs_of(sources, targets), kind).select("src", "dst", "value")


def target_pairs(spark: SparkSession, sources: list, targets: list | dict, kind: str = "string") -> DataFrame:
    """Pairs of a target specification: one list for all sources; a list of lists, one for each source; or a map of lists (a source it lacks: all targets named)."""
    if isinstance(targets, dict):
        every = sorted({t for ts in targets.values() for t in ts})
        rows = [(s, t) for s in sources for t in targets.get(s, every)]
    elif not isinstance(targets, (list, tuple)):
        raise ValueError("targets: a list, a list of lists or a map")
    elif targets and all(isinstance(t, (list, tuple)) for t in targets):
        if len(targets) != len(sources):
            raise ValueError("as many lists of targets as sources are needed")
        rows = [(s, t) for s, ts in zip(sources, targets, strict=True) for t in ts]
    elif any(isinstance(t, (list, tuple)) for t in targets):
        raise ValueError("targets mix lists and nodes")
    else:
        rows = [(s, t) for s in sources for t in targets]
    return spark.createDataFrame(rows, f"src {kind}, dst {kind}")


def batch(edges: DataFrame, pairs: DataFrame, kind: str = "ultrametric") -> DataFrame:
    """src, dst, value: epistemic closure of pairs(src, dst), 0 where nothing leads."""
    found = epistemic(edges, pairs.select("src").distinct(), kind)
    return pairs.select("src", "dst").join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("value", F.lit(0.0)).alias("value"))


def baseline(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, value: the plain weight of the edge, 0 without one."""
    return pairs.select("src", "dst").join(edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("value"))


def matrix(cells: DataFrame, columns: list, row: str = "src", column: str = "dst", value: str = "value") -> DataFrame:
    """Long cells as a wide matrix with the named columns."""
    return cells.groupBy(row).pivot(column, columns).agg(F.max(value))
