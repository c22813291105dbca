"""N-Triples and namespaces: scanning, abbreviating, resolving.  Everything is a column expression or a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.session import written

#: Type of a typed literal: lexical form, then ^^<uri>.
TYPED = r'^(.*\^\^)<([^>]*)>$'


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """subject, predicate, object of N-Triples lines; comments and blank lines are dropped, a final dot is cut."""
    line = F.trim(F.regexp_replace(F.trim(F.col(column)), r"^\.+|\.+$", ""))
    clean = lines.select(F.col(column).alias("raw"), line.alias("line")).where(~F.col("raw").startswith("#") & (F.col("line") != ""))
    part = lambda i: F.regexp_extract("line", r"^(\S+) (\S+) (.*)$", i)
    return clean.select(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """parse() of text files; .gz is inflated by Spark."""
    return parse(spark.read.text(path))


def namespaces(spark: SparkSession, path: str) -> DataFrame:
    """ns, abbr of a two-column file separated by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("ns"), parts[1].alias("abbr"))


def abbreviated(df: DataFrame, columns: list[str], spaces: DataFrame, strict: bool = False) -> DataFrame:
    """The columns with their longest matching namespace replaced by `abbr:`; unmatched values stay, or (strict) are an error.

    Distinct values are joined to the namespaces on their prefixes of the
    namespaces' lengths (few, whatever the number of namespaces), the longest
    match of each wins, and the columns are joined to it: namespaces may be any
    number, and are broadcast only if the planner finds them small.
    """
    spaces = spaces.select("ns", "abbr").groupBy("ns").agg(F.max("abbr").alias("abbr"))
    lengths = [r[0] for r in spaces.select(F.length("ns").alias("n")).distinct().orderBy("n").collect()]
    values = df.select(F.explode(F.array(*columns)).alias("value")).distinct()
    prefixes = F.array(*(F.when(F.length("value") >= n, F.substring("value", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    hits = values.select("value", F.explode(prefixes).alias("ns")).join(spaces, "ns").groupBy("value").agg(F.max(F.struct(F.length("ns").alias("n"), "abbr")).alias("b"))
    short = written(hits.select("value", F.concat("b.abbr", F.lit(":"), F.expr("substring(value, b.n + 1)")).alias("short")), "short")
    for c in columns:
        missed = F.raise_error(F.concat(F.lit("no namespace for "), F.col(c))).cast("string") if strict else F.col(c)
        df = df.join(short.select(F.col("value").alias(c), F.col("short").alias("_short")), c, "left").withColumn(c, F.coalesce("_short", missed)).drop("_short")
    return df


def abbreviate_triples(triples: DataFrame, spaces: DataFrame, properties: bool = False) -> DataFrame:
    """Triples with URIs abbreviated.  Typed literals keep their text and get their type abbreviated; plain literals and blank nodes stay.

    Triples with a literal or blank node are dropped unless properties is set.
    """
    out = triples
    for c in ("subject", "predicate", "object"):
        uri = F.col(c).startswith("<")
        typed = ~uri & F.col(c).endswith(">")
        out = out.withColumn(f"_{c}", F.when(uri, F.regexp_replace(c, "^<|>$", "")).when(typed, F.regexp_extract(c, TYPED, 2)).otherwise(F.lit("")))
        out = out.withColumn(f"_lit_{c}", ~uri).withColumn(f"_typed_{c}", typed)
    out = abbreviated(out, ["_subject", "_predicate", "_object"], spaces)
    for c in ("subject", "predicate", "object"):
        out = out.withColumn(c, F.when(~F.col(f"_lit_{c}"), F.col(f"_{c}")).when(F.col(f"_typed_{c}"), F.concat(F.regexp_extract(c, TYPED, 1), F.col(f"_{c}"))).otherwise(F.col(c)))
    if not properties:
        out = out.where(~(F.col("_lit_subject") | F.col("_lit_predicate") | F.col("_lit_object")))
    return out.select("subject", "predicate", "object")


def resolve(uris: DataFrame, nodes: DataFrame, column: str = "uri", strict: bool = False) -> DataFrame:
    """uris with the id of nodes(id, uri): null where unknown, or (strict) an error."""
    out = uris.join(nodes.select(F.col("uri").alias(column), F.col("id").alias("node_id")), column, "left")
    if strict:
        error = F.raise_error(F.concat(F.lit("unknown URI "), F.col(column)))
        return out.withColumn("node_id", F.coalesce("node_id", error.cast(dict(out.dtypes)["node_id"])))
    return out


def unresolved(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an id, rows without: the report)."""
    return resolved.where("node_id IS NOT NULL"), resolved.where("node_id IS NULL")
