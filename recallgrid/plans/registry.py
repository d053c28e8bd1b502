"""Queries by name, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Fragments that queries' SQL names in braces.
DRAWERS = """drawers AS (SELECT 'drawer_' || lang || '_' || source || '_' || substr(md5(doc_id::VARCHAR), 1, 16) AS drawer_id, lang AS wing, source AS room, text AS document,
    source AS source_file, doc_id AS chunk_index, (19723 + doc_id % 365)::INT AS filed_day FROM documents)"""
VECTORS = "vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
TRIPLES = """triples AS (
    SELECT c_name AS subject, 'located_in' AS predicate, n_name AS object, NULL::VARCHAR AS valid_from, NULL::VARCHAR AS valid_to, 1.0::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_name, 'part_of', r_name, NULL, NULL, 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT s_name, 'located_in', n_name, NULL, NULL, 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT c_name, 'ordered', 'Order ' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate::DATE + 90, '%Y-%m-%d') END, 1.0 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql may name DRAWERS, VECTORS, TRIPLES, TOKENS and POSTINGS in double brackets."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = expand(sql)
        return f

    return put


#: The words that the SQL leaves out of indexes, written here so that it doesn't lean on the engine's list.
SQL_STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might must shall can "
    "this that these those it its they them their we our you your i my me he she his her who what when where why how which if then so not no yes ok okay just very really "
    "also already still even only here there now too up out about like use get got make made take put come go see know think true false none null new old all any some"
).split()


def expand(sql: str) -> str:
    stop = ", ".join(f"'{w}'" for w in SQL_STOPWORDS)
    postings = f"""postings AS (SELECT DISTINCT drawer_id, token FROM (SELECT drawer_id, lower(unnest(regexp_extract_all(document, '[A-Za-z][A-Za-z0-9_\\-]+'))) AS token FROM drawers) WHERE token NOT IN ({stop}))"""
    tokens = f"""tokens AS (SELECT drawer_id, token FROM (SELECT drawer_id, lower(unnest(regexp_extract_all(document, '[A-Za-z][A-Za-z0-9_\\-]+'))) AS token FROM drawers) WHERE token NOT IN ({stop}))"""
    for key, value in {"DRAWERS": DRAWERS, "VECTORS": VECTORS, "TRIPLES": TRIPLES, "POSTINGS": postings, "TOKENS": tokens}.items():
        sql = sql.replace(f"[[{key}]]", value)
    return sql


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query: a keyword search in one wing since a day, newest first."""
    return QUERIES["kw_scope"](spark, "/root/testdata/sf0.001")


def _load() -> None:
    from recallgrid.plans import drawers, knowledge, modes, ranking, texts  # noqa: F401  they register their queries


_load()
