"""Nodes that hang from one other: searched from the core only, with the values of a search from every node."""

import random

import pytest
from compare import connection, same

from arcweave.operators import closure, hanging, maxmin, tasks
from arcweave.plans import catalogue


def drawn(spark, seed):
    """A directed graph with hanging nodes, with and without links back, chains, a pair of its own and loops."""
    r = random.Random(seed)
    weight = lambda: r.choice([0.1, 0.2, 0.25, 0.5, 0.8, 1.0])
    edges = {(a, b): weight() for a in range(4) for b in range(4) if r.random() < 0.5}
    for leaf in range(10, 18):
        root = r.choice([0, 1, 2, 3, 10])
        if root != leaf:
            edges |= {e: weight() for e in ((leaf, root), (root, leaf)) if r.random() < 0.8}
    edges |= {(30, 31): 0.5, (31, 30): 0.25, (40, 40): 0.5, (41, 40): 0.2}
    return spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src int, dst int, weight double")


def cells(df):
    rows = df.collect()
    found = {(r[0], r[1]): round(r[2], 9) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture
def seeds(monkeypatch):
    """How many rows each search starts from."""
    counts, relax = [], closure.relax
    counted = lambda edges, start, *a, **k: (counts.append(start.count()), relax(edges, start, *a, **k))[1]
    for module in (closure, hanging):
        monkeypatch.setattr(module, "relax", counted)
    return counts


def star(spark, n=60):
    rows = [(0, 1, 0.5), (1, 0, 0.4), (1, 2, 0.3), (2, 0, 0.6)] + [e for i in range(10, 10 + n) for e in ((i, i % 3, 0.2), (i % 3, i, 1 / (i + 1)))]
    return spark.createDataFrame(rows, "src int, dst int, weight double")


def kept_edges(edges, kind):
    prox = cells(closure.closure_all(edges, kind).select("src", "dst", "prox"))
    return {(r.src, r.dst) for r in edges.collect() if abs(r.weight - prox[r.src, r.dst]) <= 1e-8 + 1e-5 * prox[r.src, r.dst]}


@pytest.mark.parametrize("kind", ["metric", "ultrametric"])
def test_backbone(spark, seeds, kind):
    for edges in (drawn(spark, 1), star(spark)):
        assert {tuple(r) for r in tasks.backbone(edges, kind).collect()} == kept_edges(edges, kind)
    assert seeds[-2] == 3  # of 63 nodes


@pytest.mark.parametrize("kind", ["metric", "ultrametric"])
def test_closure_pairs(spark, seeds, kind):
    for edges in (drawn(spark, 2), star(spark)):
        assert cells(hanging.closure_pairs(edges, kind)) == cells(closure.closure_all(edges, kind).select("src", "dst", "prox"))
    assert seeds[-2] == 3


@pytest.mark.parametrize("kind", ["metric", "ultrametric"])
def test_epistemic_pairs(spark, seeds, kind):
    for edges in (drawn(spark, 3), star(spark)):
        assert cells(hanging.epistemic_pairs(edges, kind)) == cells(closure.epistemic(edges, edges.select("src").distinct(), kind))
    assert seeds[-2] == 3


def test_fixpoint(spark, seeds):
    for edges in (drawn(spark, 4), star(spark)):
        assert cells(maxmin.fixpoint(edges)) == cells(maxmin.squared(edges))
    assert seeds[-1] == 4  # links of the core, of 124


def multiplied(edges):
    rows, found = [tuple(r) for r in edges.collect()], {}
    for a, b, w in rows:
        for c, d, v in rows:
            if b == c:
                found[a, d] = max(found.get((a, d), 0), round(min(w, v), 9))
    return found


def test_product_of_lone_rows_and_columns(spark):
    for edges in (drawn(spark, 5), star(spark)):
        assert cells(maxmin.product(edges)) == multiplied(edges)
    plan = maxmin.product(star(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # pairs of hanging nodes pass no aggregation


def test_maximum_looks_a_small_matrix_up(spark):
    edges = star(spark)
    found = maxmin.maximum(edges, maxmin.product(edges), once=True)
    want = multiplied(edges)
    assert cells(found) == want | {(r.src, r.dst): max(round(r.weight, 9), want.get((r.src, r.dst), 0)) for r in edges.collect()}
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_link_prediction_stops_at_its_goals(spark, monkeypatch):
    """A long chain behind the goal is not searched; values and paths are those of the whole search."""
    rows = [(0, 1, 0.9), (0, 2, 0.5), (2, 1, 0.4), (1, 0, 0.3)] + [(i, i + 1, 0.4) for i in range(2, 40)]
    edges = spark.createDataFrame(rows, "src int, dst int, weight double")
    rounds = []
    written = closure.written_with
    monkeypatch.setattr(closure, "written_with", lambda df, name: (rounds.append(name), written(df, name))[1])
    pairs = spark.createDataFrame([(0, 1), (0, 0), (2, 1), (0, 99)], "src int, dst int")
    found = {(r.src, r.dst): (r.value, r.removed, r.path) for r in tasks.link_prediction(edges, pairs, paths=True).collect()}
    assert found == {(0, 1): (0.5, True, [0, 2, 1]), (0, 0): (1.0, False, None), (2, 1): (0.0, True, None), (0, 99): (0.0, False, None)}
    rounds.clear()
    tasks.link_prediction(edges, pairs.where("src = 0 AND dst = 1")).collect()
    assert rounds.count("state") < 6


def test_directory_tree_of_many_parts(spark, tmp_path):
    spark.range(999_990, 1_000_020).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    con = connection(str(tmp_path))
    assert not same(spark, con, str(tmp_path), catalogue.QUERIES["dirtree_path"], catalogue.ORACLE_SQL["dirtree_path"])
