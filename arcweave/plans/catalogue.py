"""Registered graph queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave import cli
from arcweave.functions.semiring import dist_to_sim, dombi
from arcweave.functions.session import shared_path, stored
from arcweave.operators import closure, graph, hanging, maxmin, reach, stats, tasks
from arcweave.plans import testgraph as tg
from arcweave.sources import ntriples, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GEO = """geo AS (SELECT 'supplier:' || s_suppkey AS s, 'inNation' AS p, 'nation:' || s_nationkey AS o FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'inNation', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'inRegion', 'region:' || n_regionkey FROM nation)"""


REGIONS = "SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation"
PLACED = "SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier"
FLOWS = "SELECT DISTINCT 'nation:' || c_nationkey AS s, 'nation:' || s_nationkey AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey"


def weighted_sql(arcs: str) -> str:
    """Arcs (s, o) both ways, with degree weights."""
    return f"""arcs AS ({arcs}),
sym AS (SELECT s, o FROM arcs UNION SELECT o, s FROM arcs),
deg AS (SELECT o AS node, count(*) AS k FROM sym GROUP BY o),
edges AS (SELECT s AS src, o AS dst, k, 1.0::DOUBLE / (1 + k) AS w FROM sym JOIN deg ON node = o)"""


#: All parts with their suppliers; the nations' trade alone; the same with all suppliers; parts and suppliers by number.
SUPPLY = weighted_sql(f"SELECT DISTINCT 'part:' || l_partkey AS s, 'supplier:' || l_suppkey AS o FROM lineitem UNION {PLACED} UNION {REGIONS}")
FLOW = weighted_sql(f"{FLOWS} UNION {REGIONS}")
TRADE = weighted_sql(f"{FLOWS} UNION {PLACED} UNION {REGIONS}")
NUMERIC = weighted_sql("SELECT DISTINCT l_partkey AS s, 100000000 + l_suppkey AS o FROM lineitem")
WIDEST = "c(src, node, v) AS (SELECT DISTINCT src, src, 1.0::DOUBLE FROM edges WHERE {seed} UNION SELECT c.src, e.dst, least(c.v, e.w) FROM c JOIN edges e ON c.node = e.src), best AS (SELECT src, node AS dst, max(v) AS prox FROM c GROUP BY src, node)"
NEAREST = """c(src, node, d, hops) USING KEY (src, node) AS (SELECT DISTINCT src, src, 0::BIGINT, 0::BIGINT FROM edges WHERE {seed}
  UNION (SELECT c.src, e.dst, min(c.d + e.k)::BIGINT, min(c.hops + 1)::BIGINT FROM c JOIN edges e ON c.node = e.src LEFT JOIN recurring.c r ON r.src = c.src AND r.node = e.dst WHERE r.d IS NULL OR c.d + e.k < r.d GROUP BY c.src, e.dst)),
best AS (SELECT src, node AS dst, 1.0::DOUBLE / (1 + d) AS prox, hops FROM c)"""
EPISTEMIC = """sure AS (SELECT src, dst FROM edges WHERE {seed} UNION SELECT src, src FROM edges WHERE {seed}),
via AS (SELECT b.src, e.dst, max(b.prox) AS v FROM best b JOIN edges e ON b.dst = e.src GROUP BY b.src, e.dst),
ep AS (SELECT coalesce(s.src, v.src) AS src, coalesce(s.dst, v.dst) AS dst, CASE WHEN s.src IS NOT NULL THEN 1.0::DOUBLE ELSE v.v END AS value FROM via v FULL JOIN sure s ON v.src = s.src AND v.dst = s.dst)"""
SOME = "src IN ('part:1', 'part:2', 'nation:3')"
SOME_NODES = ["part:1", "part:2", "nation:3"]
GOALS = [f"supplier:{i}" for i in range(1, 9)]
PAIRS = f"pairs AS (SELECT s, t FROM (SELECT unnest({SOME_NODES}) AS s), (SELECT unnest({GOALS}) AS t))"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def nodes(spark: SparkSession, names: list[str], column: str = "src") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def pairs(spark: SparkSession) -> DataFrame:
    return tasks.pairs_of(nodes(spark, SOME_NODES), nodes(spark, GOALS, "dst"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.proximity(tg.supply(spark, sf_dir))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.proximity(tg.trade(spark, sf_dir))


def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = tg.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100_000_000).alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    return graph.weighted(arcs, undirected=True)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-Triples text of the geo graph with customer names as literals and one comment per region."""
    uri = lambda c: F.concat(F.lit("<http://ex.org/"), F.regexp_replace(c, ":", "/"), F.lit(">"))
    links = tg.geo(spark, sf_dir).select(F.concat_ws(" ", uri(F.col("subject")), F.concat(F.lit("<http://ex.org/p/"), "predicate", F.lit(">")), uri(F.col("object")), F.lit(".")).alias("value"))
    typed = tg.table(spark, sf_dir, "customer").select(F.concat(F.lit("<http://ex.org/customer/"), F.col("c_custkey").cast("string"), F.lit('> <http://ex.org/p/name> "'), "c_name", F.lit('"^^<http://www.w3.org/2001/XMLSchema#string> .')).alias("value"))
    named = tg.table(spark, sf_dir, "nation").select(F.concat(F.lit("<http://ex.org/nation/"), F.col("n_nationkey").cast("string"), F.lit('> <http://ex.org/p/name> "'), "n_name", F.lit('" .')).alias("value"))
    comments = tg.table(spark, sf_dir, "region").select(F.concat(F.lit("# "), "r_name").alias("value"))
    return links.union(typed).union(named).union(comments)


SPACES = [("http://ex.org/", "ex"), ("http://ex.org/nation/", "nat"), ("http://www.w3.org/2001/XMLSchema#", "xsd")]
TRIPLES = f"""{GEO},
raw AS (SELECT '<http://ex.org/' || replace(s, ':', '/') || '>' AS subject, '<http://ex.org/p/' || p || '>' AS predicate, '<http://ex.org/' || replace(o, ':', '/') || '>' AS object FROM geo
  UNION ALL SELECT '<http://ex.org/customer/' || c_custkey || '>', '<http://ex.org/p/name>', '"' || c_name || '"^^<http://www.w3.org/2001/XMLSchema#string>' FROM customer
  UNION ALL SELECT '<http://ex.org/nation/' || n_nationkey || '>', '<http://ex.org/p/name>', '"' || n_name || '"' FROM nation)"""


def short_sql(c: str) -> str:
    body = f"substr({c}, 2, length({c}) - 2)"
    return f"CASE WHEN starts_with({c}, '<http://ex.org/nation/') THEN 'nat:' || substr({body}, 22) WHEN starts_with({c}, '<http://ex.org/') THEN 'ex:' || substr({body}, 15) ELSE replace({c}, '<http://www.w3.org/2001/XMLSchema#string>', 'xsd:string') END"


SHORT = ", ".join(f"{short_sql(c)} AS {c}" for c in ("subject", "predicate", "object"))


def spaces(spark: SparkSession) -> DataFrame:
    """Through a namespaces file."""
    path = shared_path(spark, "spaces")
    spark.createDataFrame(SPACES, "ns string, abbr string").select(F.concat_ws(" ", "ns", "abbr")).write.text(path)
    return ntriples.namespaces(spark, path)


# ingest


@query(f"WITH {TRIPLES} SELECT subject, predicate, object FROM raw")
def ntriples_parse(spark, sf_dir):
    return ntriples.parse(lines(spark, sf_dir))


@query(f"WITH {TRIPLES} SELECT {SHORT} FROM raw")
def abbreviate_uris(spark, sf_dir):
    return ntriples.abbreviate_triples(ntriples.parse(lines(spark, sf_dir)), spaces(spark), properties=True)


@query(f"WITH {TRIPLES} SELECT {SHORT} FROM raw WHERE starts_with(object, '<')")
def drop_literals(spark, sf_dir):
    return ntriples.abbreviate_triples(ntriples.parse(lines(spark, sf_dir)), spaces(spark))


@query(f"WITH {GEO}, n AS (SELECT s AS uri FROM geo UNION SELECT o FROM geo) SELECT row_number() OVER (ORDER BY uri) - 1 AS id, uri FROM n")
def vertex_ids(spark, sf_dir):
    return graph.vertices(tg.geo(spark, sf_dir))


@query(f"WITH {GEO}, n AS (SELECT s AS uri FROM geo UNION SELECT o FROM geo), ids AS (SELECT row_number() OVER (ORDER BY uri) - 1 AS node_id, uri FROM n) SELECT 'part:' || p_partkey AS uri, node_id FROM part LEFT JOIN ids ON uri = 'part:' || p_partkey UNION ALL SELECT 'supplier:' || s_suppkey, node_id FROM supplier LEFT JOIN ids ON uri = 'supplier:' || s_suppkey")
def resolve_uris(spark, sf_dir):
    wanted = tg.table(spark, sf_dir, "part").select(tg.node("part", "p_partkey").alias("uri")).union(tg.table(spark, sf_dir, "supplier").select(tg.node("supplier", "s_suppkey")))
    return ntriples.resolve(wanted, graph.vertices(tg.geo(spark, sf_dir))).select("uri", "node_id")


@query("SELECT 'user:' || user_id AS subject, 'type:' || event_type AS object, string_agg('v' || floor(value / 25)::BIGINT, ',' ORDER BY 'v' || floor(value / 25)::BIGINT) AS predicates FROM events GROUP BY 1, 2")
def collapse_parallel_arcs(spark, sf_dir):
    banded = tg.table(spark, sf_dir, "events").select(tg.node("user", "user_id").alias("subject"), F.concat(F.lit("v"), F.floor(F.col("value") / 25).cast("string")).alias("predicate"), F.concat(F.lit("type:"), "event_type").alias("object"))
    return graph.collapsed(banded)


@query("SELECT 'user_' || user_id AS key, list_sort(list(event_type)) AS values FROM events GROUP BY user_id")
def group_values(spark, sf_dir):
    return graph.grouped(tg.table(spark, sf_dir, "events"), F.col("user_id"), "event_type", "user_%d")


@query("SELECT n_nationkey FROM nation, range(3)")
def chain_repeat(spark, sf_dir):
    return graph.repeated(tg.table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 3)


@query("SELECT '<http://ex.org/nation/' || n_nationkey || '>' AS subject, '<http://www.w3.org/2000/01/rdf-schema#subClassOf>' AS predicate, '<http://ex.org/region/' || n_regionkey || '>' AS object FROM nation")
def owl_subclass(spark, sf_dir):
    """Each nation as a class below its region, through an OWL file: one document, so one task writes its lines."""
    path = shared_path(spark, "owl")
    one = F.concat(F.lit('<owl:Class rdf:about="http://ex.org/nation/'), F.col("n_nationkey").cast("string"), F.lit('"><rdfs:subClassOf rdf:resource="http://ex.org/region/'), F.col("n_regionkey").cast("string"), F.lit('"/></owl:Class>'))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
    ends = spark.createDataFrame([(0, head), (2, "</rdf:RDF>")], "i int, value string")
    ends.union(tg.table(spark, sf_dir, "nation").select(F.lit(1), one)).coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
    return tables.owl(spark, path, {"rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#"})


@query("SELECT p_partkey, 'root/d' || lpad((p_partkey - p_partkey % 1000)::VARCHAR, 6, '0') || '/d' || lpad((p_partkey - p_partkey % 10)::VARCHAR, 6, '0') || '/d' || lpad(p_partkey::VARCHAR, 6, '0') || '.dat' AS path FROM part")
def dirtree_path(spark, sf_dir):
    """A tree as wide at its top as the parts need.  Names have six digits, as in the SQL, which shortens those of keys from 1,000,000 on."""
    part = tg.table(spark, sf_dir, "part")
    last = part.agg(F.max("p_partkey")).first()[0] or 0
    tree = tables.DirTree("root", "d", ".dat", (max(1000, last // 1000 + 1), 100, 10), width=6)
    return part.select("p_partkey", tree.leaf(F.col("p_partkey")).alias("path"))


@query("SELECT p_partkey, list_extract(string_split(p_name || '/' || p_brand, '/'), -1) AS title FROM part")
def short_titles(spark, sf_dir):
    return tg.table(spark, sf_dir, "part").select("p_partkey", tables.short_title(F.concat_ws("/", "p_name", "p_brand")).alias("title"))


def asked(spark: SparkSession, sf_dir: str) -> str:
    """A statements file: each supplier of part 1 with parts 1 to 3, two ratings each."""
    path = shared_path(spark, "statements")
    near = tg.table(spark, sf_dir, "lineitem").where("l_partkey = 1").select("l_suppkey").distinct()
    rows = near.select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("part"), "l_suppkey")
    rows.select(F.concat_ws(" ", F.concat(F.lit("f"), "part"), "part", F.lit("A"), F.concat(F.lit("s"), "l_suppkey"), F.col("l_suppkey") + 100_000_000, F.lit("B"), F.concat_ws(",", F.col("part") % 2, F.lit("yes")))).write.text(path)
    return path


ASKED = "asked AS (SELECT p AS sid, 100000000 + k AS tid FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_partkey = 1), range(1, 4) r(p))"


@query(f"WITH {ASKED} SELECT 'f' || sid AS sfid, sid, 'A' AS stitle, 's' || (tid - 100000000) AS tfid, tid, 'B' AS ttitle, [(sid % 2)::VARCHAR, 'yes'] AS rating FROM asked")
def statements_file(spark, sf_dir):
    return tables.statements(spark, asked(spark, sf_dir))


@query(f"WITH {TRIPLES} SELECT subject, predicate, object FROM raw")
def triples_file(spark, sf_dir):
    path = shared_path(spark, "triples")
    tables.write_triples(ntriples.parse(lines(spark, sf_dir)), path)
    return ntriples.scan(spark, path)


@query("SELECT 'supplier:' || s_suppkey AS supplier, 'nation:' || s_nationkey AS uri, s_nationkey::BIGINT AS node_id FROM supplier")
def resolve_strict(spark, sf_dir):
    """Through a node list file of `id uri` lines; an unknown URI would be an error."""
    path = shared_path(spark, "nodes")
    tg.table(spark, sf_dir, "nation").select(F.concat_ws(" ", "n_nationkey", tg.node("nation", "n_nationkey"))).write.text(path)
    wanted = tg.table(spark, sf_dir, "supplier").select(tg.node("supplier", "s_suppkey").alias("supplier"), tg.node("nation", "s_nationkey").alias("uri"))
    return ntriples.resolve(wanted, tables.node_list(spark, path), strict=True).select("supplier", "uri", "node_id")


@query(f"WITH {GEO}, n AS (SELECT s AS uri FROM geo UNION SELECT o FROM geo), ids AS (SELECT row_number() OVER (ORDER BY uri) - 1 AS id, uri FROM n), e AS (SELECT s, o, string_agg(p, ',' ORDER BY p) AS predicates FROM geo GROUP BY s, o) SELECT row_number() OVER (ORDER BY s, o) - 1 AS k, a.id AS row, b.id AS col, predicates FROM e JOIN ids a ON a.uri = s JOIN ids b ON b.uri = o")
def import_edges(spark, sf_dir):
    return graph.adjacency(tg.geo(spark, sf_dir))[1]


@query("SELECT DISTINCT n_regionkey::BIGINT AS src, n_nationkey::BIGINT AS dst, 1.0::DOUBLE AS weight FROM nation")
def coordinates_table(spark, sf_dir):
    """Rows and columns with missing weights, through a table by target and back."""
    path = shared_path(spark, "coordinates")
    rows = tg.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"), F.lit(None).cast("double").alias("weight"))
    tables.write_edges(rows, path, by="dst")
    renamed = shared_path(spark, "coordinates")
    spark.read.parquet(path).withColumnsRenamed({"src": "row", "dst": "col"}).write.parquet(renamed)
    return tables.coordinates(spark, renamed)


@query("SELECT '%%MatrixMarket matrix coordinate real general' AS line UNION ALL SELECT '%x' UNION ALL SELECT '25 25 ' || count(*) FROM nation UNION ALL SELECT (n_regionkey + 1) || ' ' || (n_nationkey + 1) || ' 1.0' FROM nation")
def matrix_market_file(spark, sf_dir):
    path = shared_path(spark, "matrix")
    tables.write_matrix_market(tg.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")), path, 25, "x")
    return spark.read.text(path).withColumnRenamed("value", "line")


# shaping


@query(f"WITH {GEO} SELECT DISTINCT s AS src, o AS dst, 1.0::DOUBLE AS weight FROM geo")
def arcs_directed(spark, sf_dir):
    return tg.plain(tg.geo(spark, sf_dir))


@query(f"WITH {GEO} SELECT s AS src, o AS dst, 1.0::DOUBLE AS weight FROM geo UNION SELECT o, s, 1.0::DOUBLE FROM geo")
def arcs_symmetric(spark, sf_dir):
    return graph.symmetric(tg.plain(tg.geo(spark, sf_dir)))


COUNTED = "e AS (SELECT 'user:' || user_id AS src, 'type:' || event_type AS dst, count(*)::DOUBLE AS weight FROM events GROUP BY 1, 2 UNION ALL SELECT 'type:' || event_type, 'user:' || user_id, 1.0::DOUBLE FROM events WHERE value > 50 GROUP BY 1, 2)"


@query(f"WITH {COUNTED}, u AS (SELECT src, dst, weight AS a, 0.0::DOUBLE AS b FROM e UNION ALL SELECT dst, src, 0.0::DOUBLE, weight FROM e), g AS (SELECT src, dst, sum(a) AS a, sum(b) AS b FROM u GROUP BY src, dst) SELECT src, dst, round(a + b - sqrt(a * b), 9) AS weight FROM g")
def symmetrize_weighted(spark, sf_dir):
    there = tg.counted(tg.events(spark, sf_dir))
    back = tg.table(spark, sf_dir, "events").where("value > 50").select(F.concat(F.lit("type:"), "event_type").alias("src"), tg.node("user", "user_id").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    return graph.symmetric(there.union(back)).withColumn("weight", F.round("weight", 9))


@query("SELECT 'type:' || event_type AS node, count(*)::DOUBLE AS value FROM events GROUP BY 1")
def indegree(spark, sf_dir):
    return graph.indegree(tg.counted(tg.events(spark, sf_dir)))


@query("SELECT 'type:' || event_type AS node, round(ln(count(*)), 9) AS value FROM events GROUP BY 1")
def logindegree(spark, sf_dir):
    return graph.log_indegree(tg.counted(tg.events(spark, sf_dir))).withColumn("value", F.round("value", 9))


@query(f"WITH {GEO}, e AS (SELECT DISTINCT s, o FROM geo), k AS (SELECT o, count(*) AS k FROM e GROUP BY o) SELECT s AS src, o AS dst, 1.0::DOUBLE / (1 + k) AS weight FROM e JOIN k USING (o)")
def weighted_degree_directed(spark, sf_dir):
    return graph.weighted(tg.plain(tg.geo(spark, sf_dir)))


@query(f"WITH {SUPPLY} SELECT src, dst, w AS weight FROM edges")
def weighted_degree_undirected(spark, sf_dir):
    return supply(spark, sf_dir)


@query(f"WITH {SUPPLY} SELECT src, dst, round(1.0::DOUBLE / (1 + ln(k)), 9) AS weight FROM edges")
def weighted_logdegree(spark, sf_dir):
    return tg.proximity(tg.supply(spark, sf_dir), "logdegree").withColumn("weight", F.round("weight", 9))


@query("SELECT p_partkey, 1.0::DOUBLE / (p_size + 1.0::DOUBLE) AS similarity FROM part")
def disttosim(spark, sf_dir):
    return tg.table(spark, sf_dir, "part").select("p_partkey", dist_to_sim(F.col("p_size").cast("double")).alias("similarity"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 ELSE l_discount * l_tax / (l_discount + l_tax - l_discount * l_tax) END, 9) AS value FROM lineitem")
def dombi_pairs(spark, sf_dir):
    return tg.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(dombi(F.col("l_discount"), F.col("l_tax")), 9).alias("value"))


@query("SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
def records_to_edges(spark, sf_dir):
    return graph.edges_of(tg.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT n_regionkey AS src, n_nationkey AS dst, CASE WHEN n_nationkey = 0 THEN 1.0::DOUBLE ELSE n_nationkey::DOUBLE END AS weight FROM nation")
def map_to_edges(spark, sf_dir):
    inner = tg.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", F.col("n_nationkey").cast("double").alias("w")))).alias("inner"))
    return graph.edges_of_map(inner.select(F.create_map("n_regionkey", "inner").alias("m")), "m")


@query("SELECT a.n_nationkey AS src, b.n_nationkey AS dst, CASE WHEN a.n_regionkey = b.n_nationkey THEN 1.0::DOUBLE ELSE 0 END AS weight FROM nation a, nation b")
def dense_view(spark, sf_dir):
    n = tg.table(spark, sf_dir, "nation")
    edges = n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit(1.0).alias("weight"))
    return graph.dense(edges, n.select(F.col("n_nationkey").alias("id")))


# matrix algebra


@query(f"WITH {TRADE} SELECT a.src, b.dst, max(least(a.w, b.w)) AS weight FROM edges a JOIN edges b ON a.dst = b.src GROUP BY a.src, b.dst")
def maxmin_product(spark, sf_dir):
    return maxmin.product(trade(spark, sf_dir))


@query(f"WITH {NUMERIC} SELECT a.src, b.dst, max(least(a.w, b.w)) AS weight FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src >= 2 AND a.src < 6 GROUP BY a.src, b.dst")
def maxmin_rows_range(spark, sf_dir):
    return maxmin.product(numeric(spark, sf_dir), start=2, stop=6)


@query(f"WITH {TRADE}, p AS (SELECT a.src, b.dst, max(least(a.w, b.w)) AS w FROM edges a JOIN edges b ON a.dst = b.src GROUP BY a.src, b.dst), u AS (SELECT src, dst, w FROM edges UNION ALL SELECT src, dst, w FROM p) SELECT src, dst, max(w) AS weight FROM u GROUP BY src, dst")
def elementwise_max(spark, sf_dir):
    edges = stored(trade(spark, sf_dir), "edges")
    return maxmin.maximum(edges, maxmin.product(edges), once=True)


@query(f"WITH RECURSIVE {TRADE}, c(src, node, v) AS (SELECT src, dst, w FROM edges UNION SELECT c.src, e.dst, least(c.v, e.w) FROM c JOIN edges e ON c.node = e.src) SELECT src, node AS dst, max(v) AS weight FROM c GROUP BY src, node")
def maxmin_closure(spark, sf_dir):
    return maxmin.fixpoint(trade(spark, sf_dir))


# closures


@query(f"WITH RECURSIVE {SUPPLY}, {WIDEST.format(seed=SOME)} SELECT src, dst, prox FROM best")
def closure_ss_ultrametric(spark, sf_dir):
    return closure.closure(supply(spark, sf_dir), nodes(spark, SOME_NODES)).select("src", "dst", "prox")


@query(f"WITH RECURSIVE {TRADE}, {WIDEST.format(seed='true')} SELECT src, dst, prox FROM best")
def closure_ap_ultrametric(spark, sf_dir):
    return hanging.closure_pairs(trade(spark, sf_dir))


@query(f"WITH RECURSIVE {SUPPLY}, {NEAREST.format(seed=SOME)} SELECT src, dst, prox FROM best")
def closure_ss_metric(spark, sf_dir):
    return closure.closure(supply(spark, sf_dir), nodes(spark, SOME_NODES), "metric").select("src", "dst", "prox")


@query(f"WITH RECURSIVE {TRADE}, {NEAREST.format(seed='true')} SELECT src, dst, prox FROM best")
def closure_ap_metric(spark, sf_dir):
    return hanging.closure_pairs(trade(spark, sf_dir), "metric")


@query(f"WITH RECURSIVE {SUPPLY}, {PAIRS}, {NEAREST.format(seed=SOME)} SELECT src, dst, prox FROM best JOIN pairs ON src = s AND dst = t")
def closure_st(spark, sf_dir):
    return closure.closure_st(supply(spark, sf_dir), pairs(spark), "metric").select("src", "dst", "prox")


@query(f"WITH RECURSIVE {SUPPLY}, {NEAREST.format(seed=SOME)} SELECT src, dst, prox, hops FROM best")
def closure_paths(spark, sf_dir):
    found = closure.closure(supply(spark, sf_dir), nodes(spark, SOME_NODES), "metric", paths=True)
    return found.select("src", "dst", "prox", (F.size("path") - 1).cast("long").alias("hops"))


@query(f"WITH RECURSIVE {TRADE}, {WIDEST.format(seed='true')}, {EPISTEMIC.format(seed='true')} SELECT src, dst, value FROM ep")
def epclosure_ultrametric(spark, sf_dir):
    return hanging.epistemic_pairs(trade(spark, sf_dir))


@query(f"WITH RECURSIVE {TRADE}, {NEAREST.format(seed='true')}, {EPISTEMIC.format(seed='true')} SELECT src, dst, value FROM ep")
def epclosure_metric(spark, sf_dir):
    return hanging.epistemic_pairs(trade(spark, sf_dir), "metric")


@query(f"WITH RECURSIVE {SUPPLY}, {PAIRS}, {WIDEST.format(seed=SOME)}, {EPISTEMIC.format(seed=SOME)} SELECT src, dst, value FROM ep JOIN pairs ON src = s AND dst = t")
def epclosure_st(spark, sf_dir):
    return closure.epistemic_st(supply(spark, sf_dir), pairs(spark), paths=True).select("src", "dst", "value")


# tasks

CLOSE = "abs(w - prox) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(prox)"


@query(f"WITH RECURSIVE {TRADE}, {WIDEST.format(seed='true')} SELECT e.src, e.dst FROM edges e JOIN best b ON e.src = b.src AND e.dst = b.dst WHERE {CLOSE}")
def backbone_ultrametric(spark, sf_dir):
    return tasks.backbone(trade(spark, sf_dir))


@query(f"WITH RECURSIVE {TRADE}, {NEAREST.format(seed='true')} SELECT e.src, e.dst FROM edges e JOIN best b ON e.src = b.src AND e.dst = b.dst WHERE {CLOSE}")
def backbone_metric(spark, sf_dir):
    return tasks.backbone(trade(spark, sf_dir), "metric")


@query(f"WITH RECURSIVE {NUMERIC}, {WIDEST.format(seed='src >= 3 AND src < 8')} SELECT e.src, e.dst FROM edges e JOIN best b ON e.src = b.src AND e.dst = b.dst WHERE {CLOSE}")
def backbone_range(spark, sf_dir):
    return tasks.backbone(numeric(spark, sf_dir), start=3, offset=5)


PREDICTED = f"""WITH RECURSIVE {SUPPLY}, {PAIRS},
c(s, t, node, v) AS (SELECT s, t, s, 1.0::DOUBLE FROM pairs UNION SELECT c.s, c.t, e.dst, least(c.v, e.w) FROM c JOIN edges e ON c.node = e.src WHERE NOT (e.src = c.s AND e.dst = c.t)),
caps AS (SELECT s, t, node, max(v) AS v FROM c GROUP BY s, t, node),
via AS (SELECT s, t, max(v) AS v FROM caps JOIN edges e ON e.src = node AND e.dst = t WHERE node <> s GROUP BY s, t),
sp AS (SELECT p.s, p.t, CASE WHEN p.s = p.t THEN 1.0::DOUBLE ELSE coalesce(via.v, 0.0::DOUBLE) END AS value, EXISTS (SELECT 1 FROM edges e WHERE e.src = p.s AND e.dst = p.t) AS removed FROM pairs p LEFT JOIN via ON via.s = p.s AND via.t = p.t)"""


@query(f"{PREDICTED} SELECT s AS src, t AS dst, value, removed FROM sp")
def linkpred(spark, sf_dir):
    return tasks.link_prediction(supply(spark, sf_dir), pairs(spark))


@query(f"{PREDICTED} SELECT s AS src, t AS dst, value FROM sp")
def confmatrix(spark, sf_dir):
    return tasks.confusion_matrix(supply(spark, sf_dir), nodes(spark, SOME_NODES), nodes(spark, GOALS, "dst"))


BATCH = f"WITH RECURSIVE {SUPPLY}, {{pairs}}, {WIDEST.format(seed=SOME)}, {EPISTEMIC.format(seed=SOME)} SELECT s AS src, t AS dst, coalesce(value, 0.0::DOUBLE) AS value FROM pairs LEFT JOIN ep ON src = s AND dst = t"
LISTS = [GOALS[:2], GOALS[3:4], GOALS[4:7]]
LISTED = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}')" for s, ts in zip(SOME_NODES, LISTS, strict=True) for t in ts) + ") v(s, t))"


@query(BATCH.format(pairs=PAIRS))
def batch_targets_array(spark, sf_dir):
    return tasks.batch(supply(spark, sf_dir), tasks.target_pairs(spark, SOME_NODES, GOALS))


@query(BATCH.format(pairs=LISTED))
def batch_targets_map(spark, sf_dir):
    return tasks.batch(supply(spark, sf_dir), tasks.target_pairs(spark, SOME_NODES, dict(zip(SOME_NODES, LISTS, strict=True))))


@query(BATCH.format(pairs=LISTED))
def batch_targets_lists(spark, sf_dir):
    return tasks.batch(supply(spark, sf_dir), tasks.target_pairs(spark, SOME_NODES, LISTS))


@query(f"WITH {SUPPLY}, {PAIRS} SELECT s AS src, t AS dst, coalesce(w, 0.0::DOUBLE) AS value FROM pairs LEFT JOIN edges ON src = s AND dst = t")
def baseline_noclosure(spark, sf_dir):
    return tasks.baseline(supply(spark, sf_dir), pairs(spark))


@query(f"WITH {SUPPLY}, {PAIRS}, v AS (SELECT s, t, coalesce(w, 0.0::DOUBLE) AS value FROM pairs LEFT JOIN edges ON src = s AND dst = t) SELECT s AS src, " + ", ".join(f"max(CASE WHEN t = '{t}' THEN value END) AS \"{t}\"" for t in GOALS) + " FROM v GROUP BY s")
def result_pivot(spark, sf_dir):
    return tasks.matrix(tasks.baseline(supply(spark, sf_dir), pairs(spark)), GOALS)


# paths: one optimal path of many may be given, so what its edges come to is compared


def bottlenecks(found: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, value and the least weight along the path without its last edge; null without a path."""
    steps = found.where("size(path) > 2").select("src", "dst", F.posexplode(F.expr("transform(sequence(1, size(path) - 2), i -> struct(path[i - 1] AS a, path[i] AS b))")).alias("i", "step"))
    least = steps.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight"), (F.col("step.a") == F.col("a")) & (F.col("step.b") == F.col("b"))).groupBy("src", "dst").agg(F.min("weight").alias("least"), F.count("*").alias("n"))
    joined = found.join(least, ["src", "dst"], "left")
    return joined.select("src", "dst", "value", F.when(F.size("path") > 2, F.when(F.col("n") == F.size("path") - 2, F.col("least")).otherwise(-1.0)).alias("bottleneck"))


@query(f"{PREDICTED} SELECT s AS src, t AS dst, value, CASE WHEN s <> t AND value > 0 THEN value END AS bottleneck FROM sp")
def linkpred_paths(spark, sf_dir):
    edges = supply(spark, sf_dir)
    return bottlenecks(tasks.link_prediction(edges, pairs(spark), paths=True), edges)


@query(f"WITH RECURSIVE {SUPPLY}, {PAIRS}, {WIDEST.format(seed=SOME)}, {EPISTEMIC.format(seed=SOME)} SELECT src, dst, value, CASE WHEN NOT EXISTS (SELECT 1 FROM sure x WHERE x.src = ep.src AND x.dst = ep.dst) THEN value END AS bottleneck FROM ep JOIN pairs ON src = s AND dst = t")
def epclosure_paths(spark, sf_dir):
    edges = supply(spark, sf_dir)
    return bottlenecks(closure.epistemic_st(edges, pairs(spark), paths=True), edges)


@query(f"WITH RECURSIVE {NUMERIC}, {WIDEST.format(seed='src BETWEEN 95 AND 104')} SELECT src, dst, prox FROM best WHERE src IN (95, 104) OR (src >= 98 AND src < 103)")
def closure_rows_tree(spark, sf_dir):
    """A range of rows of a closure, written as a tree of folders; some of them read back, by range and by source."""
    path = shared_path(spark, "rows")
    edges = numeric(spark, sf_dir)
    tables.write_rows(closure.closure_all(edges, start=95, offset=10).select("src", "dst", "prox"), path, span=5)
    return tables.read_rows(spark, path, start=98, offset=5, span=5).union(tables.read_rows(spark, path, sources=[95, 104], span=5))


@query(f"WITH RECURSIVE {FLOW}, c(src, node, v) AS (SELECT src, dst, w FROM edges UNION SELECT c.src, e.dst, least(c.v, e.w) FROM c JOIN edges e ON c.node = e.src) SELECT src, node AS dst, max(v) AS weight FROM c GROUP BY src, node")
def maxmin_rounds(spark, sf_dir):
    """The last table that squaring leaves in its folder of rounds."""
    path = shared_path(spark, "rounds")
    maxmin.squared(tg.proximity(tg.flows(spark, sf_dir)), dump=path)
    rounds = spark.read.format("parquet").load(f"{path}/closure_*").withColumn("turn", F.regexp_extract(F.input_file_name(), "closure_([0-9]+)", 1).cast("int"))
    return rounds.groupBy("src", "dst").agg(F.max_by("weight", "turn").alias("weight"))


# the command line, through its files


def graph_file(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "graph")
    tg.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), (F.col("l_suppkey") + 100_000_000).alias("col")).distinct().write.parquet(path)
    return path


ASKED_PAIRS = f"{ASKED}, pairs AS (SELECT sid AS s, tid AS t FROM asked)"
CLI = PREDICTED.replace(SUPPLY, NUMERIC).replace(PAIRS, ASKED_PAIRS)


@query(f"{CLI} SELECT s AS sid, t AS tid, 'f' || s AS sfid, 'yes' AS rated, value AS simil, removed AS rem, CASE WHEN value > 0 THEN 'node/' || s END AS first FROM sp")
def cli_linkpred(spark, sf_dir):
    out, uris, path = shared_path(spark, "links"), shared_path(spark, "uris"), graph_file(spark, sf_dir)
    ids = spark.read.parquet(path)
    ids.select(F.explode(F.array("row", "col")).alias("id")).distinct().select(F.concat(F.col("id").cast("string"), F.lit(" node/"), F.col("id").cast("string"))).write.text(uris)
    cli.main(["linkpred", path, asked(spark, sf_dir), out, "-u", "--uris", uris])
    schema = "sid long, tid long, sfid string, rating array<string>, simil double, rem boolean, paths array<string>"
    return spark.read.schema(schema).json(out).select("sid", "tid", "sfid", F.col("rating")[1].alias("rated"), "simil", "rem", F.get("paths", F.lit(0)).alias("first"))


@query(f"WITH {NUMERIC}, {ASKED} SELECT sid, tid, coalesce(w, 0.0::DOUBLE) AS simil, false AS rem FROM asked LEFT JOIN edges ON src = sid AND dst = tid")
def cli_linkpred_noclosure(spark, sf_dir):
    out = shared_path(spark, "links")
    cli.main(["linkpred", graph_file(spark, sf_dir), asked(spark, sf_dir), out, "-u", "-N"])
    return spark.read.schema("sid long, tid long, simil double, rem boolean").json(out)


def request(spark: SparkSession, ids: list[int], text: str) -> str:
    path = shared_path(spark, "request")
    spark.createDataFrame([(text.format(i),) for i in ids], "value string").coalesce(1).write.text(path)
    return path


CELLS = "pairs AS (SELECT s, t FROM range(1, 4) a(s), (SELECT unnest([5, 6]) AS t) b)"


@query(f"WITH RECURSIVE {NUMERIC}, {CELLS}, {WIDEST.format(seed='src IN (1, 2, 3)')}, {EPISTEMIC.format(seed='src IN (1, 2, 3)')} SELECT s AS src, max(CASE WHEN t = 5 THEN coalesce(value, 0) END) AS five, max(CASE WHEN t = 6 THEN coalesce(value, 0) END) AS six FROM pairs LEFT JOIN ep ON src = s AND dst = t GROUP BY s")
def cli_batch(spark, sf_dir):
    out = shared_path(spark, "batch")
    cli.main(["batch", graph_file(spark, sf_dir), request(spark, [1, 2, 3], "{}|x"), request(spark, [5, 6], "{}|y"), out, "-u", "-S", "|", "-H", "node_id,node_title"])
    return spark.read.csv(out, header=True).select(F.col("src").cast("long").alias("src"), F.col("5").cast("double").alias("five"), F.col("6").cast("double").alias("six"))


@query(CLI.replace(ASKED_PAIRS, CELLS) + " SELECT s AS src, max(CASE WHEN t = 5 THEN value END) AS five, max(CASE WHEN t = 6 THEN value END) AS six FROM sp GROUP BY s")
def cli_confmatrix(spark, sf_dir):
    out = shared_path(spark, "conf")
    cli.main(["confmatrix", graph_file(spark, sf_dir), request(spark, [1, 2, 3], "{} x"), request(spark, [5, 6], "{} y"), out, "-u"])
    return spark.read.csv(out, header=True).select(F.col("src").cast("long").alias("src"), F.col("5").cast("double").alias("five"), F.col("6").cast("double").alias("six"))


@query(f"WITH {TRIPLES}, t AS (SELECT {SHORT} FROM raw WHERE starts_with(object, '<')), n AS (SELECT subject AS uri FROM t UNION SELECT object FROM t), ids AS (SELECT row_number() OVER (ORDER BY uri) - 1 AS id, uri FROM n) SELECT DISTINCT a.id AS row, b.id AS col, a.uri AS subject, 1.0::DOUBLE AS weight FROM t JOIN ids a ON a.uri = subject JOIN ids b ON b.uri = object")
def cli_import(spark, sf_dir):
    names, text, out = shared_path(spark, "ns"), shared_path(spark, "nt"), shared_path(spark, "import")
    spark.createDataFrame([(f"{a}\t{b}",) for a, b in SPACES], "value string").write.text(names)
    lines(spark, sf_dir).write.text(text, compression="gzip")
    cli.main(["import", names, text, out])
    named = tables.node_list(spark, f"{out}/nodes").select(F.col("id").alias("row"), F.col("uri").alias("subject"))
    return spark.read.parquet(f"{out}/adjacency").join(named, "row").select("row", "col", "subject", "weight")


# reachability


@query(f"WITH RECURSIVE {GEO}, r(src, node) AS (SELECT s, o FROM geo WHERE s = 'supplier:1' UNION SELECT r.src, geo.o FROM r JOIN geo ON geo.s = r.node) SELECT src, node FROM r")
def reachable(spark, sf_dir):
    return reach.reachable(tg.plain(tg.geo(spark, sf_dir)), nodes(spark, ["supplier:1"]))


@query(f"WITH RECURSIVE {GEO}, r(src, node) AS (SELECT s, o FROM geo UNION SELECT r.src, geo.o FROM r JOIN geo ON geo.s = r.node) SELECT src, node FROM r")
def reachable_many(spark, sf_dir):
    edges = tg.plain(tg.geo(spark, sf_dir))
    return reach.reachable(edges, edges.select("src").distinct())


HOPS = f"""WITH RECURSIVE {SUPPLY}, {PAIRS},
r(src, node, path) USING KEY (src, node) AS (SELECT src, dst, min([src, dst]) FROM edges WHERE {{seed}} GROUP BY src, dst
  UNION (SELECT r.src, e.dst, min(list_append(r.path, e.dst)) FROM r JOIN edges e ON e.src = r.node LEFT JOIN recurring.r x ON x.src = r.src AND x.node = e.dst WHERE x.src IS NULL GROUP BY r.src, e.dst))
SELECT src, node AS dst, path FROM r JOIN pairs ON s = src AND t = node"""


@query(HOPS.format(seed="src = 'part:1'"))
def hop_shortest_path(spark, sf_dir):
    return reach.shortest(supply(spark, sf_dir), pairs(spark).where("src = 'part:1'"))


@query(HOPS.format(seed=SOME))
def hop_shortest_path_many(spark, sf_dir):
    return reach.shortest(supply(spark, sf_dir), pairs(spark))


# statistics

FAN = "v AS (SELECT o_custkey AS k, count(*) AS x FROM orders GROUP BY 1)"


def fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("x"))


@query(f"WITH {FAN}, g AS (SELECT x, count(*) AS n FROM v GROUP BY x), c AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total FROM g) SELECT x, round((total - (upto - n + 1 + (n - 1) / 2.0::DOUBLE)) / total::DOUBLE, 9) AS y FROM c")
def ccdf_fractional(spark, sf_dir):
    return stats.ccdf(fan(spark, sf_dir), "x").withColumn("y", F.round("y", 9))


@query(f"WITH {FAN} SELECT x, round((count(*) OVER () - row_number() OVER (ORDER BY x)) / (count(*) OVER ())::DOUBLE, 9) AS y FROM v")
def ccdf_ordinal(spark, sf_dir):
    return stats.ccdf_ordinal(fan(spark, sf_dir), "x").withColumn("y", F.round("y", 9))


@query(f"WITH {FAN}, l AS (SELECT greatest(ceil(log2(max(x))) - 1, 0) AS last FROM v), b AS (SELECT least(floor(log2(x)), last) AS b FROM v, l WHERE x >= 1) SELECT pow(2.0::DOUBLE, b + 1) AS x, round(count(*) / pow(2.0::DOUBLE, b), 9) AS y FROM b GROUP BY b")
def pdf_log2(spark, sf_dir):
    return stats.pdf_log2(fan(spark, sf_dir), "x").withColumn("y", F.round("y", 9))


