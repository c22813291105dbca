"""The registered query of each text operator: production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arcweave.llm import bpe, langid, lattice, media, neardup, packing, pii, quality, urlfilter, warc
from arcweave.llm.common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(read(spark, sf_dir, "documents"))


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(read(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read(spark, sf_dir, "documents"), k=4, percent=80)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), least=0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


#: Verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_packing, op3_webp, op4_lattice_score, op5_near_duplicates, op6_warc, op7_byte_bpe, op8_language_id, op9_url_filter, op10_quality_rules)}

#: DuckDB SQL for the queries that it can express; the others are tested against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op5_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS r(i) WHERE len(words) > 0),
n AS (SELECT w.doc_id, count(shingle) AS n_shingles FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
c(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.other)
SELECT n.doc_id, any_value(n_shingles) AS n_shingles, min(other) AS component_id, min(other) = n.doc_id AS kept FROM n JOIN c ON c.doc_id = n.doc_id GROUP BY n.doc_id
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
o AS (SELECT hex, max(page_id) AS owner FROM p GROUP BY hex),
d AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> (15 - 5 * k)) & 31)::INTEGER, 1), '' ORDER BY i, k) AS digest
  FROM (SELECT hex, i, list_sum(list_transform(range(1, 6), lambda j: (strpos('0123456789ABCDEF', substr(hex, 5 * i + j, 1)) - 1) * (16 ** (5 - j))::BIGINT))::BIGINT AS v FROM o, unnest(range(0, 8)) AS r(i)), unnest(range(0, 4)) AS q(k) GROUP BY hex)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM p JOIN o USING (hex) JOIN d USING (hex)
""",
}
