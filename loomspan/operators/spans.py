"""Containment of half-open spans, without comparing all spans of a document with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contained(points: DataFrame, spans: DataFrame, keys: list[str], inner: tuple[str, str] = ("start", "end"), outer: tuple[str, str] = ("o_start", "o_end")) -> DataFrame:
    """Every (point, span) of equal ``keys`` with the point inside the span; columns of both sides have different names but for the keys.

    A span of length 2^k lies in at most three cells of that width, and a point in one cell of each width that some span
    has. So the equi join on keys, width and cell meets only spans of about their own length nearby, however many a
    document holds; the exact test follows.
    """
    a, b = (F.col(c) for c in outer)
    width = F.ceil(F.log2(F.greatest(b - a, F.lit(1)).cast("double"))).cast("int")
    cell = lambda c, w: F.call_function("shiftright", c.cast("long"), w)
    spans = spans.withColumn("_width", width)
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(a, F.col("_width")), cell(F.greatest(a, b), F.col("_width")))))
    widths = sorted(r[0] for r in spans.select("_width").distinct().collect())  # at most 64
    if not widths:
        widths = [0]
    points = points.withColumn("_width", F.explode(F.array(*map(F.lit, widths)))).withColumn("_cell", cell(F.col(inner[0]), F.col("_width")))
    s, e = (F.col(c) for c in inner)
    return points.join(spans, [*keys, "_width", "_cell"]).where((s >= a) & (e <= b)).drop("_width", "_cell")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: list[str], value: str, inner: tuple[str, str] = ("start", "end"), outer: tuple[str, str] = ("o_start", "o_end")) -> DataFrame:
    """(keys, point columns, value): of the spans around each point that with the latest start, then the earliest end, then the largest value."""
    order: list[Column] = [F.col(outer[0]), -F.col(outer[1]), F.col(value)]
    return contained(points, spans, keys, inner, outer).groupBy(*keys, *point).agg(F.max_by(value, F.struct(*order)).alias(value))
