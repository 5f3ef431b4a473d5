"""Frames of the data model derived from the supplied star-schema tables, the same way in Spark and in DuckDB SQL.

These are analogues: the tables hold no repositories, so documents stand for files, parts for declarations, line items and
events for syntax sites, orders for generations, conversations for version chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(view: str, columns: str, source: str) -> str:
    return f"{view} AS (SELECT {columns} FROM {source})"


LANG = "CASE lang WHEN 'en' THEN 'rust' WHEN 'de' THEN 'go' WHEN 'fr' THEN 'typescript' ELSE 'python' END"
EXT = "CASE lang WHEN 'en' THEN '.rs' WHEN 'de' THEN '.go' WHEN 'fr' THEN '.ts' ELSE '.py' END"
KIND = "CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'SMALL' THEN 'method' WHEN 'LARGE' THEN 'struct' WHEN 'MEDIUM' THEN 'module' WHEN 'PROMO' THEN 'trait' ELSE 'enum' END"
NAME = "CASE p_name WHEN 'red widget' THEN 'main' ELSE p_name END"

#: View name: (select list, source table); sha256 of DuckDB is sha2(.., 256) of Spark.
VIEWS = {
    "files": (f"CASE WHEN doc_id % 50 = 0 THEN '' ELSE source || '/' END || CAST(doc_id AS VARCHAR) || {EXT} AS path, {LANG} AS language, sha256(coalesce(text, '')) AS content_digest, sha256(coalesce(text, '')) AS artifact_digest, CAST(length(coalesce(text, '')) AS BIGINT) AS fact_count, doc_id", "documents"),
    "facts": (f"p_brand || '/' || CAST(p_partkey % 97 AS VARCHAR) || '.rs' AS path, p_partkey AS ordinal, {KIND} AS kind, {NAME} AS name, p_brand || '::' || {NAME} AS qualified_name, CASE WHEN p_size % 2 = 0 THEN 'rust' ELSE 'go' END AS language, p_brand AS artifact_digest, sha256(p_brand || '/' || CAST(p_partkey % 97 AS VARCHAR)) AS content_digest", "part"),
    "sites": ("'order/' || CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS ordinal, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'import' ELSE 'test_marker' END AS site_kind, 'part' || CAST(l_partkey % 100 AS VARCHAR) AS raw_target, CASE WHEN l_suppkey % 3 = 0 THEN 'rust' ELSE 'go' END AS language, CAST(l_quantity AS BIGINT) AS start, l_orderkey AS artifact_digest", "lineitem"),
    "generations": ("o_custkey AS slot, o_orderkey AS generation_id, strftime(o_orderdate, '%Y%m%d') AS epoch, CASE o_orderstatus WHEN 'P' THEN 'active' ELSE 'retained' END AS state, o_orderpriority AS snapshot", "orders"),
    "audit": ("event_id, user_id AS record_id, event_id % 7 AS revision, CASE event_type WHEN 'purchase' THEN 'locally_approved' WHEN 'view' THEN 'observed' ELSE 'other' END AS operation, ts AS recorded_at, CAST(floor(value) AS BIGINT) AS display_revision", "events"),
}


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    columns, source = VIEWS[view]
    columns = columns.replace("VARCHAR", "STRING").replace("sha256(", "sha256_(").replace("strftime(o_orderdate, '%Y%m%d')", "date_format(o_orderdate, 'yyyyMMdd')")
    return table(spark, sf_dir, source).selectExpr(*_split(_sha2(columns)))


def _sha2(text: str) -> str:
    """``sha256_(x)`` as ``sha2(x, 256)``."""
    while (at := text.find("sha256_(")) >= 0:
        depth, k = 1, at + 8
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        text = f"{text[:at]}sha2({text[at + 8 : k - 1]}, 256){text[k:]}"
    return text


def _split(columns: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(columns):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(columns[at:k])
            at = k + 1
    return [*out, columns[at:]]


def with_views(*names: str, then: str) -> str:
    return "WITH " + ",\n".join(_sql(n, *VIEWS[n]) for n in names) + "\n" + then


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> supplier and customer, as edges of a graph; every fifth customer edge is ambiguous."""
    t = lambda n: table(spark, sf_dir, n)
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    flag = F.lit(False)
    cols = lambda s, e, k, amb: [s.alias("source"), e.alias("target"), F.lit(k).alias("edge_kind"), amb.alias("ambiguous"), flag.alias("heuristic"), F.lit("").alias("site")]
    a = t("nation").select(*cols(text("r", "n_regionkey"), text("n", "n_nationkey"), "imports", flag))
    b = t("supplier").select(*cols(text("n", "s_nationkey"), text("s", "s_suppkey"), "calls", flag))
    c = t("customer").select(*cols(text("n", "c_nationkey"), text("c", "c_custkey"), "calls", F.col("c_custkey") % 5 == 0))
    return a.unionAll(b).unionAll(c)


EDGES_SQL = """edges AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'imports' AS edge_kind, false AS ambiguous FROM nation
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'calls', false FROM supplier
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'calls', c_custkey % 5 = 0 FROM customer)"""
