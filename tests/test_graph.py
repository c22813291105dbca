"""Golden values, small differentials against plain Python, and every catalogued query against its SQL."""

import heapq

import pytest
from compare import connection, same
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcweave.functions.semiring import dombi, sim_to_dist
from arcweave.operators import closure, graph, maxmin, reach, stats, tasks
from arcweave.plans import catalogue
from arcweave.sources import ntriples, tables


def edges_df(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src int, dst int, weight double")


def undirected(spark, text):
    return graph.weighted(edges_df(spark, [(*map(int, e.split("-")), 1) for e in text.split()]), undirected=True)


# fixed values: the published closures of these graphs, rounded to two decimals
GOLDEN = {
    "0-1 0-5 1-2 1-6 2-3 3-4 3-5 3-6 5-7": "1 1 .25 .25 .2 1 .25 .25/1 1 1 .33 .2 .33 1 .25/.25 1 1 1 .2 .25 .25 .25/.25 .33 1 1 1 1 1 .25/.2 .2 .2 1 1 .2 .2 .2/1 .33 .25 1 .2 1 .25 1/.25 1 .25 1 .2 .25 1 .25/.25 .25 .25 .25 .2 1 .25 1",
    "0-1 0-2 0-3 1-2 1-4 2-5": "1 1 1 1 .25 .25/1 1 1 .25 1 .25/1 1 1 .25 .25 1/1 .25 .25 1 .25 .25/.25 1 .25 .25 1 .25/.25 .25 1 .25 .25 1",
    "0-1 1-2 2-3 3-4 4-0": "1 1 .33 .33 1/1 1 1 .33 .33/.33 1 1 1 .33/.33 .33 1 1 1/1 .33 .33 1 1",
    "0-2 0-3 0-5 1-3 1-5 2-4 4-5": "1 .33 1 1 .33 1/.33 1 .25 1 .25 1/1 .25 1 .25 1 .33/1 1 .25 1 .25 .33/.33 .25 1 .25 1 1/1 1 .33 .33 1 1",
    "0-3 0-5 1-2 2-5 3-4 4-5": "1 .25 .25 1 .33 1/.25 1 1 .25 .25 .33/.25 1 1 .25 .25 1/1 .25 .25 1 1 .33/.33 .25 .25 1 1 1/1 .33 1 .33 1 1",
    "0-2 0-3 0-4 1-2 1-3 3-4": "1 .33 1 1 1/.33 1 1 1 .25/1 1 1 .33 .25/1 1 .33 1 1/1 .25 .25 1 1",
}


@pytest.mark.parametrize("text", GOLDEN)
def test_epistemic_goldens(spark, text):
    want = [[float(x) for x in row.split()] for row in GOLDEN[text].split("/")]
    edges = undirected(spark, text)
    weight = {(r.src, r.dst): r.weight for r in edges.collect()}
    found = closure.epistemic(edges, edges.select("src").distinct(), paths=True).collect()
    assert {(r.src, r.dst): round(r.value, 2) for r in found} == {(i, j): x for i, row in enumerate(want) for j, x in enumerate(row)}
    for r in found:
        if r.src == r.dst or (r.src, r.dst) in weight:
            assert r.path == []
        else:
            steps = list(zip(r.path, r.path[1:], strict=False))
            assert r.path[0] == r.src and r.path[-1] == r.dst and min(weight[s] for s in steps[:-1]) == r.value


def test_balanced_tree(spark):
    edges = undirected(spark, "0-1 0-2 0-3 1-4 1-5 1-6 2-7 2-8 2-9 3-10 3-11 3-12")
    near = {(r.src, r.dst) for r in edges.collect()}
    for r in closure.epistemic(edges, edges.select("src").distinct()).collect():
        inner = {r.src, r.dst} <= {1, 2, 3} and r.src != r.dst
        assert round(r.value, 2) == (1 if r.src == r.dst or (r.src, r.dst) in near else 0.25 if inner else 0.2)


# fixed values: matrices and their max-min closures
MATRICES = [
    ("0,1,.5 1,2,.1 2,0,.2", ".1 .5 .1/.1 .1 .1/.2 .2 .1"),
    ("0,1,.5 1,2,.2 2,3,.4 3,0,.1", ".1 .5 .2 .2/.1 .1 .2 .2/.1 .1 .1 .4/.1 .1 .1 .1"),
    ("0,1,.3 1,2,.2 1,3,.1 2,4,.1", "0 .3 .2 .1 .1/0 0 .2 .1 .1/0 0 0 0 .1/0 0 0 0 0/0 0 0 0 0"),
    ("0,1,.3 0,2,.3 1,1,.1 1,3,.2 2,3,.4", "0 .3 .3 .3/0 .1 0 .2/0 0 0 .4/0 0 0 0"),
    ("0,2,.09 1,0,.01 1,2,.61 2,1,.98", ".01 .09 .09/.01 .61 .61/.01 .98 .61"),
]


def test_squaring_gives_the_same_and_says_when_it_stops_short(spark, tmp_path):
    path = edges_df(spark, [(i, i + 1, 0.9 - i / 100) for i in range(20)] + [(20, 3, 0.5)])
    want = {(r.src, r.dst): r.weight for r in maxmin.fixpoint(path).collect()}
    assert {(r.src, r.dst): r.weight for r in maxmin.squared(path, dump=str(tmp_path / "d")).collect()} == want and (tmp_path / "d" / "closure_4").exists()
    with pytest.raises(RuntimeError, match="no fixpoint"):
        maxmin.squared(path, max_rounds=3)


def test_long_chain_merges_its_levels(spark):
    """More rounds than parts of a state are kept; a large state takes the other way to its candidates."""
    chain = edges_df(spark, [(i, i + 1, 1 / 2) for i in range(25)])
    one = spark.createDataFrame([(0,)], "src int")
    for limit in (closure.LARGE, 3):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(closure, "LARGE", limit)
            assert sorted((r.dst, r.prox, r.hops, len(r.path)) for r in closure.closure(chain, one, "metric", paths=True).collect()) == [(i, 1 / (1 + i), i, i + 1) for i in range(26)]
    assert reach.reachable(chain, one).count() == 25
    assert reach.shortest(chain, spark.createDataFrame([(0, 25)], "src int, dst int")).first().path == list(range(26))


def test_near_weights_stay_apart(spark):
    """Tiny distances are kept, and those of degree weights are whole."""
    a, b = 1 - 1e-10, 1 - 3e-10
    found = closure.closure(edges_df(spark, [(0, 1, a), (1, 2, b), (0, 2, 1 - 5e-10)]), spark.createDataFrame([(0,)], "src int"), "metric")
    prox = {r.dst: r.prox for r in found.collect()}
    assert abs(1 / prox[1] - 1 - 1e-10) < 1e-14 and abs(1 / prox[2] - 1 - 4e-10) < 1e-14
    whole = spark.range(1, 200_000, 7).select(F.col("id").alias("k"), sim_to_dist(1.0 / (1.0 + F.col("id"))).alias("d"))
    assert whole.where("d <> k").count() == 0


@pytest.mark.parametrize(("text", "rows"), MATRICES)
def test_matrix_closure(spark, text, rows):
    edges = edges_df(spark, [(int(a), int(b), float(w)) for a, b, w in (e.split(",") for e in text.split())])
    want = {(i, j): float(x) for i, row in enumerate(rows.split("/")) for j, x in enumerate(row.split()) if float(x)}
    assert {(r.src, r.dst): r.weight for r in maxmin.fixpoint(edges).collect()} == want


def best_paths(edges, source, kind):
    """Dijkstra over proximities."""
    out, heap = {}, [(-1.0, source)]
    while heap:
        p, v = heapq.heappop(heap)
        if v in out:
            continue
        out[v] = -p
        for a, b, w in edges:
            if a == v and w:
                heapq.heappush(heap, (-min(-p, w) if kind == "ultrametric" else -(-p * w / (-p + w + p * w)), b))
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.tuples(st.integers(0, 7), st.integers(0, 7)), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]), min_size=1, max_size=25), st.sampled_from(["ultrametric", "metric"]))
def test_closure_against_dijkstra(spark, table, kind):
    edges = [(a, b, w) for (a, b), w in table.items()]
    df = edges_df(spark, edges)
    sources = spark.createDataFrame([(i,) for i in range(8)], "src int")
    found = {(r.src, r.dst): r.prox for r in closure.closure(df, sources, kind).collect()}
    want = {(s, t): p for s in range(8) for t, p in best_paths(edges, s, kind).items()}
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-6 for k in want)


def test_metric_ring_path_and_backbone(spark):
    ring = [(0, 1, 0.1), (1, 2, 0.1), (2, 3, 0.1), (3, 4, 0.1), (0, 4, 0.8)]
    df = edges_df(spark, [e for a, b, d in ring for e in ((a, b, 1 / (1 + d)), (b, a, 1 / (1 + d)))])
    pair = spark.createDataFrame([(0, 4)], "src int, dst int")
    assert closure.closure_st(df, pair, "metric", paths=True).first().path == [0, 1, 2, 3, 4]
    cliques = [(a, b, 1.0) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a < b] + [(0, 4, 4.0), (2, 6, 0.5)]
    df = edges_df(spark, [e for a, b, d in cliques for e in ((a, b, 1 / (1 + d)), (b, a, 1 / (1 + d)))])
    kept = {(r.src, r.dst) for r in tasks.backbone(df, "metric").collect()}
    assert kept == {(a, b) for a, b, d in cliques if d < 4} | {(b, a) for a, b, d in cliques if d < 4}
    star = edges_df(spark, [e for i in range(10) for e in {(0, i, 1.0), (i, 0, 1.0)}])
    assert tasks.backbone(star).count() == star.count()


def test_link_prediction_without_the_edge(spark):
    edges = edges_df(spark, [(0, 1, 0.9), (0, 2, 0.5), (2, 1, 0.4), (1, 0, 0.3)])
    pairs = spark.createDataFrame([(0, 1), (0, 0), (2, 0), (1, 2)], "src int, dst int")
    found = {(r.src, r.dst): (r.value, r.removed, r.path) for r in tasks.link_prediction(edges, pairs, paths=True).collect()}
    assert found == {(0, 1): (0.5, True, [0, 2, 1]), (0, 0): (1.0, False, None), (2, 0): (0.4, False, [2, 1, 0]), (1, 2): (0.3, False, [1, 0, 2])}


def test_reach(spark):
    path = edges_df(spark, [e for i in range(4) for e in ((i, i + 1, 1), (i + 1, i, 1))])
    assert {r.node for r in reach.reachable(path, spark.createDataFrame([(0,)], "src int")).collect()} == {0, 1, 2, 3, 4}
    loop = edges_df(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (0, 3, 0)])
    found = {(r.src, r.dst): r.path for r in reach.shortest_lists(loop, [0, 0, 3], [0, 3, 0]).collect()}
    assert found == {(0, 0): [0, 1, 2, 0], (0, 3): [0, 3]}
    with pytest.raises(ValueError):
        reach.shortest_lists(loop, [0], [])


def test_shaping(spark):
    df = edges_df(spark, [(0, 1, 4), (1, 0, 9), (2, 2, 5), (0, 2, 1)])
    assert {(r.src, r.dst): r.weight for r in graph.symmetric(df).collect()} == {(0, 1): 7.0, (1, 0): 7.0, (2, 2): 5.0, (0, 2): 1.0, (2, 0): 1.0}
    assert {r.dst: r.weight for r in graph.weighted(edges_df(spark, [(0, 1, 1)]), "logdegree").collect()} == {1: 1.0}
    with pytest.raises(ValueError):
        graph.weighted(df, "none")
    with pytest.raises(ValueError):
        graph.edges_of(df, "row")
    with pytest.raises(ValueError):
        closure.closure(df, df.select("src"), "none")
    values = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 0.5)], "a double, b double").select(dombi(F.col("a"), F.col("b")).alias("x"))
    assert [round(r.x, 6) for r in values.collect()] == [0, 1, 0.333333]
    with pytest.raises(Exception, match="dombi"):
        spark.createDataFrame([(2.0, 0.5)], "a double, b double").select(dombi(F.col("a"), F.col("b"))).collect()


def test_targets(spark):
    pairs = lambda t: {tuple(r) for r in tasks.target_pairs(spark, ["a", "b"], t).collect()}
    assert pairs(["x"]) == {("a", "x"), ("b", "x")}
    assert pairs([["x"], ["y", "z"]]) == {("a", "x"), ("b", "y"), ("b", "z")}
    assert pairs({"a": ["x"]}) == {("a", "x"), ("b", "x")}
    for bad in ("x", [["x"]], ["x", ["y"]]):
        with pytest.raises(ValueError):
            tasks.target_pairs(spark, ["a", "b"], bad)


def test_ingest(spark, tmp_path):
    (tmp_path / "a.nt").write_text('# note\n<http://a/x> <http://a/p> <http://a/b/y> .\n\n<http://a/x> <http://a/p> "lit with space"^^<http://t/s> .\n_:n <http://a/p> "plain" .\n')
    (tmp_path / "ns").write_text("http://a/ a\nhttp://a/b/ ab\nhttp://t/ t\n")
    triples, names = ntriples.scan(spark, str(tmp_path / "a.nt")), ntriples.namespaces(spark, str(tmp_path / "ns"))
    assert triples.count() == 3
    assert [tuple(r) for r in ntriples.abbreviate_triples(triples, names).collect()] == [("a:x", "a:p", "ab:y")]
    assert {tuple(r) for r in ntriples.abbreviate_triples(triples, names, True).collect()} == {("a:x", "a:p", "ab:y"), ("a:x", "a:p", '"lit with space"^^t:s'), ("_:n", "a:p", '"plain"')}
    nodes = graph.vertices(spark.createDataFrame([("b", "p", "a"), ("c", "q", "a")], "subject string, predicate string, object string"))
    assert [tuple(r) for r in nodes.orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    with pytest.raises(Exception, match="unknown URI"):
        ntriples.resolve(spark.createDataFrame([("zz",)], "uri string"), nodes, strict=True).collect()
    tree = tables.DirTree("root", "test", ".dat", (2, 5, 10))
    assert spark.range(37, 38).select(tree.leaf(F.col("id"))).first()[0] == "root/test00/test30/test37.dat"
    assert tree.walk(spark, files_only=True).count() == 100 and tree.walk(spark, dirs_only=True).count() == 13
    with pytest.raises(Exception, match="outside"):
        spark.range(100, 101).select(tree.leaf(F.col("id"))).collect()


def test_many_namespaces(spark):
    """Any number of namespaces; the longest match wins."""
    spaces = spark.range(12_000).selectExpr("concat('http://a/', id, '/') AS ns", "concat('n', id) AS abbr").union(spark.createDataFrame([("http://a/", "a"), ("http://a/1/x/", "deep")], "ns string, abbr string"))
    values = spark.createDataFrame([("http://a/11999/q", 1), ("http://a/1/x/y", 2), ("http://a/zz", 3), ("other", 4), (None, 5)], "u string, i int")
    assert {r.i: r.u for r in ntriples.abbreviated(values, ["u"], spaces).collect()} == {1: "n11999:q", 2: "deep:y", 3: "a:zz", 4: "other", 5: None}
    assert ntriples.abbreviated(values, ["u"], spaces.where("false")).where("u = 'other'").count() == 1
    with pytest.raises(Exception, match="no namespace for other"):
        ntriples.abbreviated(values, ["u"], spaces, strict=True).collect()


def test_stats(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 8, 0)], "x int")
    assert {r.x: round(r.y, 6) for r in stats.ccdf(df, "x").collect()} == {0: 0.8, 1: 0.6, 2: 0.3, 8: 0.0}
    assert sorted((r.x, round(r.y, 6)) for r in stats.ccdf_ordinal(df, "x").collect()) == [(0, 0.8), (1, 0.6), (2, 0.2), (2, 0.4), (8, 0.0)]
    ties = spark.range(1000).selectExpr("id % 3 AS x")
    got = sorted(r.y for r in stats.ccdf_ordinal(ties, "x", block=50).collect())
    assert got == [i / 1000 for i in range(1000)]
    assert {r.x: r.y for r in stats.pdf_log2(df, "x").collect()} == {2.0: 1.0, 4.0: 1.0, 8.0: 0.25}


@pytest.fixture(scope="session")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_catalogue(spark, con, sf, name):
    assert not same(spark, con, sf, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("kind", ["ultrametric", "metric"])
def test_all_pairs(spark, sf, kind):
    """The closures of all pairs of the trade graph against Dijkstra's search."""
    edges = [(r.src, r.dst, r.weight) for r in catalogue.trade(spark, sf).collect()]
    out, nodes = {}, sorted({a for a, _, _ in edges})
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    want = {}
    for s in nodes:
        best, heap = {}, [(-1.0, s)]
        while heap:
            p, v = heapq.heappop(heap)
            if v not in best:
                best[v] = -p
                for b, w in out[v]:
                    if b not in best:
                        heapq.heappush(heap, (-min(-p, w) if kind == "ultrametric" else -1 / (1 / -p - 1 + 1 / w), b))
        want |= {(s, t): p for t, p in best.items()}
    run = lambda name: catalogue.QUERIES[f"{name}_{kind}"](spark, sf).collect()
    found = {(r.src, r.dst): r.prox for r in run("closure_ap")}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert {(r.src, r.dst) for r in run("backbone")} == {(a, b) for a, b, w in edges if abs(w - want[a, b]) <= 1e-8 + 1e-5 * want[a, b]}
    direct, near = {(a, b) for a, b, _ in edges} | {(s, s) for s in nodes}, {}
    for a, b, _ in edges:
        near.setdefault(b, []).append(a)
    found = {(r.src, r.dst): r.value for r in run("epclosure")}
    assert found.keys() == want.keys()
    assert all(abs(v - (1 if k in direct else max(want[k[0], u] for u in near[k[1]]))) < 1e-9 for k, v in found.items())
    if kind == "ultrametric":
        found = {(r.src, r.dst): r.weight for r in catalogue.QUERIES["maxmin_closure"](spark, sf).collect()}
        cycle = {s: max(min(w, want[b, s]) for b, w in out[s]) for s in nodes}
        assert found == {k: cycle[k[0]] if k[0] == k[1] else v for k, v in want.items()}
