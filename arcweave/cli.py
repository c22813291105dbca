"""Command line: backbone, linkpred, batch, confmatrix, import, onto.

Graphs are Parquet tables (row, col [, weight]); results are Parquet, JSON or CSV folders.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.session import stored
from arcweave.operators import graph, tasks
from arcweave.sources import ntriples, tables


def load(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return graph.weighted(tables.coordinates(spark, args.graph), args.weight, args.undirected)


def run_backbone(spark: SparkSession, args: argparse.Namespace) -> None:
    found = tasks.backbone(load(spark, args), args.kind, args.start, args.offset)
    if args.matrix_market:
        tables.write_matrix_market(found, args.output, args.nodes, f"backbone, {args.kind}")
    else:
        found.write.parquet(args.output)


def run_linkpred(spark: SparkSession, args: argparse.Namespace) -> None:
    edges, asked = load(spark, args), tables.statements(spark, args.input)
    pairs = asked.select(F.col("sid").alias("src"), F.col("tid").alias("dst"))
    if args.no_closure:
        found = tasks.baseline(edges, pairs.distinct()).withColumn("removed", F.lit(False)).withColumn("path", F.array().cast("array<long>"))
    else:
        found = tasks.link_prediction(edges, pairs, args.kind, paths=True)
    named = found.select(F.col("src").alias("sid"), F.col("dst").alias("tid"), F.col("value").alias("simil"), F.col("removed").alias("rem"), "path")
    if args.uris:
        labels = tables.node_list(spark, args.uris).select(F.col("id").alias("node"), "uri")
        steps = named.select("sid", "tid", F.posexplode("path").alias("i", "node")).join(labels, "node", "left")
        paths = steps.groupBy("sid", "tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("uri", F.col("node").cast("string")).alias("u")))), lambda x: x["u"]).alias("paths"))
        named = named.drop("path").join(paths, ["sid", "tid"], "left")
    asked.join(named, ["sid", "tid"], "left").write.json(args.output)


def run_batch(spark: SparkSession, args: argparse.Namespace) -> None:
    edges = load(spark, args)
    names = args.header.split(",") if args.header else None
    ids = []
    for name, path in (("sources", args.sources), ("targets", args.targets)):
        asked = tables.requests(spark, path, args.separator, names)
        if "node_id" not in asked.columns:
            asked = ntriples.resolve(asked.withColumnRenamed("node_title", "uri"), tables.node_list(spark, args.uris))
        known, unknown = ntriples.unresolved(asked)
        count = unknown.count()
        if count:
            at = f"{args.output.rstrip('/')}-unknown-{name}"
            unknown.write.parquet(at)
            print(f"unknown {name}: {count} rows, in {at}")
        ids.append(known)
    sources, targets = ids
    pairs = tasks.pairs_of(sources.select(F.col("node_id").alias("src")), targets.select(F.col("node_id").alias("dst")))
    cells = tasks.baseline(edges, pairs) if args.no_closure else tasks.batch(edges, pairs, args.kind)
    columns = [r[0] for r in targets.select("node_id").distinct().orderBy("node_id").collect()]
    tasks.matrix(cells, columns).write.csv(args.output, header=True)


def run_confmatrix(spark: SparkSession, args: argparse.Namespace) -> None:
    read = lambda path, name: spark.read.csv(path, sep=" ", schema="node_id long, node_title string").select(F.col("node_id").alias(name))
    sources, targets = read(args.sources, "src"), read(args.targets, "dst")
    cells = tasks.confusion_matrix(load(spark, args), sources, targets, args.kind)
    columns = [r[0] for r in targets.distinct().orderBy("dst").collect()]
    tasks.matrix(cells, columns).write.csv(args.output, header=True)


def run_import(spark: SparkSession, args: argparse.Namespace) -> None:
    triples = ntriples.abbreviate_triples(ntriples.scan(spark, args.triples), ntriples.namespaces(spark, args.namespaces), args.properties)
    tables.write_triples(triples, f"{args.output}/triples")
    nodes, edges = graph.adjacency(triples)
    nodes.write.csv(f"{args.output}/nodes", sep=" ")
    edges = stored(edges, "edges")
    edges.write.parquet(f"{args.output}/edges")
    edges.select("row", "col", F.lit(1.0).alias("weight")).write.parquet(f"{args.output}/adjacency")


def run_onto(spark: SparkSession, args: argparse.Namespace) -> None:
    tables.write_triples(tables.owl(spark, args.owl, dict(s.split("=", 1) for s in args.space)), args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arcweave")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, run, *positional):
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.set_defaults(run=run)
        return p

    for name, run, positional in (("backbone", run_backbone, ("graph", "output", "nodes")), ("linkpred", run_linkpred, ("graph", "input", "output")), ("batch", run_batch, ("graph", "sources", "targets", "output")), ("confmatrix", run_confmatrix, ("graph", "sources", "targets", "output"))):
        p = add(name, run, *positional)
        p.add_argument("-u", "--undirected", action="store_true")
        p.add_argument("-k", "--kind", default="ultrametric", choices=["ultrametric", "metric"])
        p.add_argument("-w", "--weight", default="degree", choices=sorted(graph.WEIGHTS))
        if name == "backbone":
            p.add_argument("-s", "--start", type=int)
            p.add_argument("-o", "--offset", type=int)
            p.add_argument("--matrix-market", action="store_true")
        if name in ("linkpred", "batch"):
            p.add_argument("-N", "--no-closure", action="store_true")
            p.add_argument("--uris")
        if name == "batch":
            p.add_argument("-S", "--separator", default=",")
            p.add_argument("-H", "--header")
    p = add("import", run_import, "namespaces", "triples", "output")
    p.add_argument("-p", "--properties", action="store_true")
    p = add("onto", run_onto, "owl", "output")
    p.add_argument("--space", action="append", default=[], help="prefix=URI")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("arcweave").getOrCreate(), args)


if __name__ == "__main__":
    main()
