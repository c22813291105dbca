"""Other sources and sinks: node lists, statements, request tables, OWL, directory trees, matrix files."""

from __future__ import annotations

from math import ceil, log10, prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.operators.graph import numbered

STATEMENTS = "sfid string, sid long, stitle string, tfid string, tid long, ttitle string, rating string"


def node_list(spark: SparkSession, path: str) -> DataFrame:
    """id, uri of a file of `id uri` lines, or of URIs alone (then numbered in order of URI)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    both = lines.select(F.split(F.trim("value"), r"\s+", 2).alias("p"))
    if both.where("size(p) < 2").limit(1).count():
        return numbered(both.select(F.col("p")[0].alias("uri")).distinct(), "uri", "id")
    return both.select(F.col("p")[0].cast("long").alias("id"), F.col("p")[1].alias("uri"))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements of a space-separated file; rating becomes an array."""
    return spark.read.csv(path, sep=" ", schema=STATEMENTS).withColumn("rating", F.split("rating", ","))


def requests(spark: SparkSession, path: str, sep: str = ",", names: list[str] | None = None) -> DataFrame:
    """Sources or targets: node_id and / or node_title; names stand for a header line."""
    df = spark.read.csv(path, sep=sep, header=names is None)
    df = df.toDF(*names) if names else df
    return df.withColumn("node_id", F.col("node_id").cast("long")) if "node_id" in df.columns else df


def short_title(title: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(title, "/"), -1)


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight of a table of coordinates (row, col [, weight])."""
    df = spark.read.parquet(path)
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    return df.select(F.col("row").alias("src"), F.col("col").alias("dst"), weight.cast("double").alias("weight"))


def owl(spark: SparkSession, path: str, spaces: dict[str, str], row_tag: str = "owl:Class") -> DataFrame:
    """subject, predicate, object for each child with rdf:resource of each class with a non-empty rdf:about; spaces: prefix to URI."""
    df = spark.read.format("xml").option("rowTag", row_tag).load(path)
    if "_rdf:about" not in df.columns:
        return spark.createDataFrame([], "subject string, predicate string, object string")
    out = None
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if "_rdf:resource" not in kind:
            continue
        prefix, _, tag = field.name.rpartition(":")
        items = F.explode(F.col(f"`{field.name}`")) if kind.startswith("array") else F.col(f"`{field.name}`")
        one = df.where("coalesce(`_rdf:about`, '') <> ''").select(F.col("`_rdf:about`").alias("s"), items.alias("i")).where(F.col("i")["_rdf:resource"].isNotNull())
        one = one.select(F.concat(F.lit("<"), "s", F.lit(">")).alias("subject"), F.lit(f"<{spaces.get(prefix, prefix + ':' if prefix else '')}{tag}>").alias("predicate"), F.concat(F.lit("<"), F.col("i")["_rdf:resource"], F.lit(">")).alias("object"))
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "subject string, predicate string, object string")


class DirTree:
    """Paths of a tree of directories with the given numbers of children; leaves hold one value each.

    width: digits of a name, by default those of the largest value.  A smaller
    one shortens longer names to their first digits, so that they are no longer
    unique.
    """

    def __init__(self, root: str, prefix: str, suffix: str, children: tuple[int, ...], width: int | None = None):
        if not children or min(children) < 1:
            raise ValueError("children: positive numbers")
        self.root, self.prefix, self.suffix, self.children = root, prefix, suffix, tuple(children)
        self.capacity = prod(children)
        self.width = width or (max(1, ceil(log10(self.capacity))) if self.capacity > 1 else 1)
        self.spans = [prod(children[i + 1 :]) for i in range(len(children) - 1)]  # values below one directory of each level

    def leaf(self, value: Column) -> Column:
        """The path of a value's file; an error outside the tree."""
        parts = [F.lit(self.root)]
        for span in self.spans:
            start = value - value % F.lit(span)
            parts.append(F.concat(F.lit(self.prefix), F.lpad(start.cast("string"), self.width, "0")))
        parts.append(F.concat(F.lit(self.prefix), F.lpad(value.cast("string"), self.width, "0"), F.lit(self.suffix)))
        error = F.raise_error(F.lit(f"value outside [0, {self.capacity})")).cast("string")
        return F.when((value >= 0) & (value < self.capacity), F.concat_ws("/", *parts)).otherwise(error)

    def directory(self, value: Column, depth: int) -> Column:
        """The path of the directory of a value at a depth from 0 (the root)."""
        if not 0 <= depth <= len(self.spans):
            raise ValueError(f"depth: 0 to {len(self.spans)}")
        names = [F.concat(F.lit(self.prefix), F.lpad((value - value % F.lit(s)).cast("string"), self.width, "0")) for s in self.spans[:depth]]
        return F.concat_ws("/", F.lit(self.root), *names)

    def walk(self, spark: SparkSession, dirs_only: bool = False, files_only: bool = False) -> DataFrame:
        """path, is_file of all directories and files."""
        if dirs_only and files_only:
            raise ValueError("either directories or files")
        value = spark.range(self.capacity).select(F.col("id"))
        files = value.select(self.leaf(F.col("id")).alias("path"), F.lit(True).alias("is_file"))
        dirs = None
        for depth, span in enumerate([self.capacity, *self.spans]):
            one = spark.range(0, self.capacity, span).select(self.directory(F.col("id"), depth).alias("path"), F.lit(False).alias("is_file"))
            dirs = one if dirs is None else dirs.union(one)
        return dirs if dirs_only else files if files_only else dirs.union(files)


def write_triples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "subject", "predicate", "object", F.lit("."))).write.text(path)


def write_edges(edges: DataFrame, path: str, by: str = "src", parts: int | None = None) -> None:
    """Edges by source (or, by='dst', by target), sorted within files."""
    other = "dst" if by == "src" else "src"
    placed = edges.repartition(by) if parts is None else edges.repartition(parts, by)
    placed.sortWithinPartitions(by, other).write.parquet(path)


def write_rows(found: DataFrame, path: str, span: int = 1000) -> None:
    """Closure rows (src, dst, ...) as a tree: a folder for each `span` sources, rows in order of source; zero rows are left out."""
    first = (F.floor(F.col("src") / span) * span).cast("long")
    values = [c for c in ("prox", "value", "weight") if c in found.columns]
    kept = found.where(F.col(values[0]) != 0) if values else found
    kept.withColumn("first", first).repartition("first").sortWithinPartitions("first", "src", "dst").write.partitionBy("first").parquet(path)


def read_rows(spark: SparkSession, path: str, start: int | None = None, offset: int | None = None, sources: list[int] | None = None, span: int = 1000) -> DataFrame:
    """The rows of write_rows(): those with start <= src < start + offset, or of some sources; only their folders are read."""
    df = spark.read.parquet(path)
    low = 0 if start is None else start
    if start is not None:
        df = df.where((F.col("first") >= low - low % span) & (F.col("src") >= low))
    if offset is not None:
        df = df.where((F.col("first") < low + offset) & (F.col("src") < low + offset))
    if sources is not None:
        df = df.where(F.col("first").isin(sorted({s - s % span for s in sources})) & F.col("src").isin(list(sources)))
    return df.drop("first")


def write_matrix_market(edges: DataFrame, path: str, size: int, comment: str = "") -> None:
    """Coordinates from 1 with a header; a text folder whose parts, in order of their names, make the file."""
    n = edges.count()
    head = [f"%%MatrixMarket matrix coordinate real general\n%{comment}\n{size} {size} {n}"]
    first = edges.sparkSession.createDataFrame([(-1, -1, h) for h in head], "src long, dst long, value string")
    line = F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), F.lit("1.0"))
    body = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), line.alias("value"))
    first.union(body).orderBy("src", "dst").select("value").write.text(path)
