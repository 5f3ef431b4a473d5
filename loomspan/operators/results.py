"""Bounded results: a total order, a limit, and a receipt of what was left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounded:
    """``rows`` in their order, at most ``limit``; ``receipt`` has total, returned, omitted and availability."""

    rows: DataFrame
    receipt: DataFrame


def bounded(df: DataFrame, order: list[Column | str], limit: int, availability: str = "available") -> Bounded:
    """Top-k with the exact total beside it: the total is a separate aggregate, never a window over all rows."""
    if limit < 1:
        raise ValueError("a limit is positive")
    total = df.agg(F.count("*").alias("total"))
    back = F.least(F.col("total"), F.lit(limit))
    receipt = total.select("total", back.alias("returned"), (F.col("total") - back).alias("omitted"), F.lit(availability).alias("availability"))
    return Bounded(df.orderBy(*order).limit(limit), receipt)


def not_produced(empty: DataFrame) -> Bounded:
    """The answer of a projection that was never built, which isn't the same as an empty one."""
    r = empty.sparkSession.createDataFrame([(0, 0, 0, "not_produced")], "total long, returned long, omitted long, availability string")
    return Bounded(empty.limit(0), r)


def within_bytes(df: DataFrame, size: Column, budget: int, order: list[Column | str], fail: bool = False) -> DataFrame:
    """Rows until their sizes reach a byte budget; ``fail`` makes an overflow an error. For frames already limited."""
    used = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    held = df.withColumn("_used", used)
    if fail:
        over = F.raise_error(F.lit("the result exceeds its byte budget")).cast("boolean")
        return held.where(F.when(F.col("_used") <= budget, F.lit(True)).otherwise(over)).drop("_used")
    return held.where(F.col("_used") <= budget).drop("_used")
