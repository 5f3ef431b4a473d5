"""Retention of superseded generations, and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retention_plan(generations: DataFrame, roots: list[DataFrame], pins: DataFrame | None = None, keep: int = 2, budget: int | None = None) -> DataFrame:
    """Generations that may go: retained ones beyond the newest ``keep`` of their slot (by epoch, then id) that no root refers
    to and no pin holds; the oldest first, at most ``budget``. Each root is a frame of generation_id."""
    w = Window.partitionBy("slot").orderBy(F.desc("epoch"), F.desc("generation_id"))
    ranked = generations.where(F.col("state") == "retained").withColumn("rank", F.row_number().over(w)).where(F.col("rank") > keep)
    held = [r.select("generation_id") for r in [*roots, *([pins] if pins is not None else [])]]
    free = ranked.join(reduce(DataFrame.unionAll, held).distinct(), "generation_id", "left_anti") if held else ranked
    free = free.select("slot", "generation_id", "epoch", "rank").orderBy("epoch", "generation_id")
    return free if budget is None else free.limit(budget)


def superseded_in_every_slot(generations: DataFrame, keep: int = 2) -> DataFrame:
    """Snapshots of which every use ranks beyond ``keep`` (least rank over it)."""
    w = Window.partitionBy("slot").orderBy(F.desc("epoch"), F.desc("generation_id"))
    return generations.withColumn("rank", F.row_number().over(w)).groupBy("snapshot").agg(F.min("rank").alias("rank")).where(F.col("rank") > keep)


def violations(**checks: DataFrame) -> DataFrame:
    """(check, rows): rows of each validator that must be empty."""
    each = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("check"), "rows") for name, df in checks.items()]
    return reduce(DataFrame.unionAll, each)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    return child.join(parent.select(*key).distinct(), key, "left_anti")


def diagnostics(generations: DataFrame, files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per generation: files, those without a complete artifact, and parse error totals."""
    a = artifacts.select("artifact_digest", "lifecycle_state", "syntax_error_nodes")
    j = generations.select("generation_id").join(files, "generation_id", "left").join(a, "artifact_digest", "left")
    bad = F.col("path").isNotNull() & F.coalesce(F.col("lifecycle_state") != "complete", F.lit(True))
    return j.groupBy("generation_id").agg(F.count("path").alias("files"), F.sum(F.when(bad, 1).otherwise(0)).alias("incomplete"), F.coalesce(F.sum("syntax_error_nodes"), F.lit(0)).cast("long").alias("syntax_errors"), F.sum(F.when(F.col("syntax_error_nodes") > 0, 1).otherwise(0)).alias("files_with_errors"))
