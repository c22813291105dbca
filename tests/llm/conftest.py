import pytest

ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "x" * 30_000), (10**6 + 3, " \n\t "), (10**6 + 4, "same text here now"), (10**6 + 4, "same text here now"), (None, "no id at all"), (10**6 + 5, "é🙂 ñ\u0301 \x00 \u2003z")]


@pytest.fixture(scope="session")
def docs(spark, sf):
    """Documents with odd rows and a column whose name clashes with an operator's."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], table.schema)
    return table.union(odd).selectExpr("*", "'clash' AS score", "1 AS kept", "2 AS word").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return docs.select("doc_id", "text", "lang").collect()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
