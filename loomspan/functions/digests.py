"""Digests of content and of whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def artifact_digest(content: Column, producer: str, configuration: str, schema: str, version: int = 1) -> Column:
    """The key of an analysis: equal bytes under equal producer, configuration and schema share it."""
    return F.sha2(F.concat_ws("\x1f", content, F.lit(producer), F.lit(configuration), F.lit(schema), F.lit(str(version))), 256)


def row_digest(df: DataFrame, cols: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in cols])), 256)


def frame_digest(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(rows, digest) of a frame, whatever its order and partitions. Rows' digests are folded in two steps by the beginning of
    the digests, in order within a fold: as many first letters as leave some 4,096 rows a fold, so that no task
    sorts more however many rows there are, then folds of folds."""
    cols = cols or df.columns
    rows = df.select(row_digest(df, cols).alias("d")).withColumn("n", F.lit(1).cast("long"))
    n, length = df.count(), 0
    while n > 4096 * 16**length:
        length += 1
    fold = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d")
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")
    for k in range(length, 0, -3):
        rows = rows.groupBy(F.substring("d", 1, k).alias("p")).agg(fold, total).select(F.concat("p", "d").alias("d"), "n")
    return rows.agg(total, fold).select(F.col("n").alias("rows"), F.col("d").alias("digest"))
