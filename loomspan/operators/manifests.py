"""Differences of manifests, reuse of analyses, change review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, before_digest, after_digest): added, removed, changed or unchanged, by a full outer join on the path."""
    b = before.select("path", F.col("content_digest").alias("before_digest"))
    a = after.select("path", F.col("content_digest").alias("after_digest"))
    change = F.when(F.col("before_digest").isNull(), "added").when(F.col("after_digest").isNull(), "removed").when(F.col("before_digest") != F.col("after_digest"), "changed").otherwise("unchanged")
    return b.join(a, "path", "full_outer").select("path", change.alias("change"), "before_digest", "after_digest")


def reconcile(before: DataFrame, after: DataFrame, hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differences, counters): hints (path) only feed the counters, so lost or late ones do no harm."""
    d = manifest_diff(before, after).where(F.col("change") != "unchanged")
    h = hints.groupBy("path").agg(F.count("*").alias("n"))
    j = h.join(d.select("path", "change"), "path", "left")
    counters = j.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("hints"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"), F.coalesce(F.sum(F.when(F.col("change").isNull(), 1).otherwise(0)), F.lit(0)).cast("long").alias("unmatched"))
    return d, counters


def reuse_plan(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(path, artifact_digest, action): reuse where a complete artifact of the key exists, else analyze."""
    done = artifacts.where(F.col("lifecycle_state") == "complete").select("artifact_digest", F.lit(True).alias("_done")).distinct()
    j = manifest.join(done, "artifact_digest", "left")
    return j.select("path", "artifact_digest", F.when(F.col("_done"), "reuse").otherwise("analyze").alias("action"))


def new_artifacts(staged: DataFrame, known: DataFrame) -> DataFrame:
    """What an idempotent content-addressed insert adds."""
    return staged.dropDuplicates(["artifact_digest"]).join(known.select("artifact_digest"), "artifact_digest", "left_anti")


def change_manifest(base: DataFrame, work: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, change): added, modified, deleted, type_changed or untracked against a base, in path order; no renames."""
    b = base.select("path", F.col("content_digest").alias("b_digest"), F.col("file_kind").alias("b_kind"))
    w = work.select("path", F.col("content_digest").alias("w_digest"), F.col("file_kind").alias("w_kind"))
    t = tracked.select("path", F.lit(True).alias("tracked")).distinct()
    j = b.join(w, "path", "full_outer").join(t, "path", "left")
    change = (
        F.when(F.col("w_kind").isNull(), "deleted")
        .when(F.col("b_kind").isNull(), F.when(F.col("tracked"), "added").otherwise("untracked"))
        .when(F.col("b_kind") != F.col("w_kind"), "type_changed")
        .when(F.col("b_digest") != F.col("w_digest"), "modified")
    )
    return j.select("path", change.alias("change")).where(F.col("change").isNotNull()).orderBy("path")


def change_review(changes: DataFrame, index_digest: str | None, worktree_digest: str) -> tuple[DataFrame, DataFrame]:
    """(changes, status): a change manifest, and one row of counts by change with the index's state: aligned if it was made from
    this work tree, stale if not, absent if there is none."""
    kinds = ("added", "modified", "deleted", "type_changed", "untracked")
    counts = changes.agg(F.count("*").alias("paths"), *[F.sum(F.when(F.col("change") == k, 1).otherwise(0)).alias(k) for k in kinds]).fillna(0)
    state = "absent" if index_digest is None else "aligned" if index_digest == worktree_digest else "stale"
    return changes, counts.withColumn("index_state", F.lit(state))


def hint_batch(hints: DataFrame, max_paths: int = 10_000, max_bytes: int = 1 << 20) -> DataFrame:
    """One row (paths, hints, bytes, full): a micro-batch's distinct paths. ``full``: more paths or bytes than the limits, so that
    only a full reconciliation will do and the paths themselves say nothing."""
    by = hints.groupBy("path").agg(F.count("*").alias("n"))
    row = by.agg(F.count("*").alias("paths"), F.coalesce(F.sum("n"), F.lit(0)).alias("hints"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("bytes"))
    return row.withColumn("full", (F.col("paths") > max_paths) | (F.col("bytes") > max_bytes))
