"""The nations' trade: all lines are joined once, not each time the graph reads its arcs."""

from compare import connection

from arcweave.plans import catalogue
from arcweave.plans import testgraph as tg


def put(spark, at, name, columns, rows):
    spark.createDataFrame(rows, columns).write.parquet(f"{at}/{name}.parquet")


def test_lines_are_joined_once(spark, sf):
    edges = catalogue.trade(spark, sf)
    assert not any(name in path for path in edges.inputFiles() for name in ("lineitem", "orders", "customer"))
    found = connection(sf).execute(f"WITH {catalogue.TRADE} SELECT src, dst FROM edges").fetchall()
    assert sorted(map(tuple, edges.select("src", "dst").collect())) == sorted(found)


def test_lines_without_an_end(spark, tmp_path):
    """Keys that are null, unknown or used twice: what the SQL gives."""
    at = str(tmp_path)
    put(spark, at, "region", "r_regionkey long, r_name string", [(0, "R")])
    put(spark, at, "nation", "n_nationkey long, n_name string, n_regionkey long", [(0, "A", 0), (1, "B", 0), (2, "C", 0)])
    put(spark, at, "customer", "c_custkey long, c_nationkey long", [(1, 0), (2, 1), (3, 2)])
    put(spark, at, "supplier", "s_suppkey long, s_nationkey long", [(1, 1), (2, 2), (3, 0)])
    put(spark, at, "orders", "o_orderkey long, o_custkey long", [(1, 1), (2, 2), (3, 99), (4, None), (None, 3)])
    put(spark, at, "lineitem", "l_orderkey long, l_suppkey long", [(1, 1), (1, 1), (1, 2), (2, 1), (2, 99), (2, None), (3, 3), (4, 3), (99, 3), (None, 3)])
    arcs = tg.flows(spark, at).where("predicate = 'buysFrom'").select("subject", "object")
    found = connection(at).execute(catalogue.FLOWS).fetchall()
    assert sorted(map(tuple, arcs.collect())) == sorted(found) == [("nation:0", "nation:1"), ("nation:0", "nation:2"), ("nation:1", "nation:1")]
