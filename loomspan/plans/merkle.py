"""Manifests as stored trees of digests: a difference goes down only where digests differ, and reads rows of those leaves only."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifests import manifest_diff
from ..operators.shared import written
from .catalog import Catalog

#: Rows that a leaf has on average at most, and the children of a node: a hexadecimal digit of the path's digest each.
LEAF, FAN = 4096, 16


def _digest(df: DataFrame, key: str, parts: str) -> DataFrame:
    """(key, digest, rows): of each key's ``parts``, whatever their order. A key has one leaf's rows or one node's children."""
    return df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ""), 256).alias("digest"), F.sum("rows").alias("rows"))


def store(manifest: DataFrame, folder: str, leaf: int = LEAF) -> int:
    """Writes a manifest (path, content_digest; paths are unique) and the digests of all levels; returns the depth. Leaves are the
    directories of its rows, by the first ``depth`` digits of the path's sha256, so they are of like size whatever the paths."""
    n = manifest.count()
    depth = max(0, ceil(log(max(1, n / leaf), FAN)))
    at = F.sha2("path", 256)
    rows = manifest.select("path", "content_digest", F.concat(F.lit("-"), F.substring(at, 1, depth)).alias("leaf"))
    rows.repartition("leaf").write.partitionBy("leaf").parquet(f"{folder}/rows")
    spark = manifest.sparkSession
    line = F.sha2(F.to_json(F.struct("path", "content_digest")), 256)
    held = spark.read.schema("path string, content_digest string, leaf string").parquet(f"{folder}/rows").select("leaf", line.alias("part"), F.lit(1).cast("long").alias("rows"))
    level = _digest(held, "leaf", "part").withColumnRenamed("leaf", "node")
    for k in range(depth, -1, -1):
        level.write.parquet(f"{folder}/level={k}")
        below = spark.read.schema(level.schema).parquet(f"{folder}/level={k}")
        up = below.select(F.expr("substring(node, 1, length(node) - 1)").alias("node"), F.concat("node", F.lit("="), "digest").alias("part"), "rows")
        level = _digest(up, "node", "part")
    Catalog(spark, folder)._put("tree.json", {"depth": depth, "rows": n})
    return depth


def root(spark: SparkSession, folder: str) -> str | None:
    """The digest of a stored manifest; None if it is empty."""
    r = spark.read.parquet(f"{folder}/level=0").first()
    return r and r["digest"]


def differences(spark: SparkSession, before: str, after: str) -> tuple[DataFrame, dict[str, int]]:
    """((path, change, before_digest, after_digest) of added, removed and changed paths, what was read: nodes by all levels, leaves and their
    rows). A level reads the children of the nodes that differed above; rows are read of leaves that differ, each a directory of
    its own. The driver holds counts. Trees of different depths are compared by all their rows."""
    depth = {Catalog(spark, f)._read("tree.json")["depth"] for f in (before, after)}
    level = lambda f, k: spark.read.schema("node string, digest string, rows long").parquet(f"{f}/level={k}")
    read, differ = {"nodes": 0, "leaves": 0, "rows": 0}, None
    rows = {f: spark.read.schema("path string, content_digest string, leaf string").parquet(f"{f}/rows") for f in (before, after)}
    if len(depth) == 1:
        for k in range(depth.pop() + 1):
            a, b = level(before, k), level(after, k).select("node", F.col("digest").alias("other"), F.col("rows").alias("more"))
            if differ is not None:
                up = differ.select(F.col("node").alias("above"))
                a, b = (x.join(up, F.expr("substring(node, 1, length(node) - 1)") == F.col("above"), "left_semi") for x in (a, b))
            both = written(a.join(b, "node", "full_outer"), "nodes")
            read["nodes"] += both.count()
            differ = both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("node", (F.coalesce("rows", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("rows"))
            n = differ.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
            read |= {"leaves": n["n"], "rows": n["rows"]}
            if not n["n"]:
                break
        rows = {f: r.join(differ.select(F.col("node").alias("leaf")), "leaf", "left_semi") for f, r in rows.items()}
    return manifest_diff(rows[before], rows[after]).where("change <> 'unchanged'"), read
