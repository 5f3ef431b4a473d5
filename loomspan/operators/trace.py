"""Breadth-first traces over edge frames, with deterministic limits, and impact classes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ORDER = ["edge_kind", "resolution_evidence", "extraction_evidence", "source", "site", "target"]


@dataclass
class Trace:
    """``edges`` in order of depth and relationship; ``flags`` has which limits cut, ``depth`` how deep levels are complete."""

    edges: DataFrame
    nodes: DataFrame
    depth: int
    flags: set[str] = field(default_factory=set)


@dataclass(frozen=True)
class Limits:
    depth: int = 16
    results: int = 10_000
    nodes: int = 100_000
    edges: int = 500_000
    frontier: int = 100_000


#: For traces that must be whole, whatever their size.
WHOLE = Limits(results=1 << 40, nodes=1 << 40, edges=1 << 40, frontier=1 << 40)


def graph_trace(edges: DataFrame, start: list, direction: str = "outbound", kinds: list[str] | None = None, limits: Limits = Limits()) -> Trace:
    """Level by level from ``start``: ``edges`` has source, target, site and the columns of ORDER (missing ones are constant).

    A node is expanded once. A level's edges are those of its frontier, in ORDER; back edges to seen nodes are in the result
    too. The limits cut in that order: edges looked at, new nodes, frontier, results, and each sets its flag. A level is one
    pass over the edges, joined with the frontier and written; what follows reads only the level. The driver holds counts.
    """
    spark = edges.sparkSession
    e = edges
    for c in ORDER:
        e = e if c in e.columns else e.withColumn(c, F.lit(""))
    if kinds is not None:
        e = e.where(F.col("edge_kind").isin(kinds))
    origin, end = ("source", "target") if direction == "outbound" else ("target", "source")
    kind = e.schema[origin].dataType
    seen = spark.createDataFrame([(s, 0) for s in start], f"node {kind.simpleString()}, depth int")
    frontier, out, flags, looked, results, nodes, done = seen.select("node"), None, set(), 0, 0, len(start), 0
    for depth in range(1, limits.depth + 2):
        level = e.join(frontier, e[origin] == frontier["node"], "left_semi")
        if depth > limits.depth:
            if not level.isEmpty():
                flags.add("depth")
            break
        level = written(level)
        total = level.count()
        if not total:
            break
        stop = looked + total > limits.edges
        if stop:
            flags.add("edges")
            level = level.orderBy(origin, *ORDER).limit(limits.edges - looked)
        looked += min(total, limits.edges - looked)
        fresh = level.join(seen, level[end] == seen["node"], "left_anti")
        admitted = written(fresh.groupBy(F.col(end).alias("node")).agg(F.min(F.struct(*ORDER)).alias("at")))
        n_new = admitted.count()
        room = limits.nodes - nodes
        shown = level
        if n_new > room:
            flags.add("nodes")
            admitted = written(admitted.orderBy("at", "node").limit(room))
            known = seen.select("node").unionAll(admitted.select("node"))
            shown = level.join(known, level[end] == known["node"], "left_semi")
        n_new = min(n_new, room)
        nodes += n_new
        shown = shown.withColumn("depth", F.lit(depth))
        n_shown = total if shown is level else shown.count()
        if results + n_shown > limits.results:
            flags.add("results")
            shown = shown.orderBy(*ORDER, end).limit(limits.results - results)
            stop = True
        results = min(limits.results, results + n_shown)
        out = shown if out is None else out.unionByName(shown)
        seen = seen.unionAll(admitted.select("node", F.lit(depth).alias("depth")))
        if depth % 16 == 0:
            seen = written(seen)
        frontier = admitted
        if n_new > limits.frontier:
            flags.add("frontier")
            frontier = written(admitted.orderBy("at", "node").limit(limits.frontier))
        frontier = frontier.select("node")
        if stop:
            break
        done = depth
        if not n_new:
            break
    out = e.limit(0).withColumn("depth", F.lit(0)) if out is None else out
    return Trace(out.orderBy("depth", *ORDER), seen, done, flags)


def impact_analyze(edges: DataFrame, start: object, limits: Limits = Limits(), kinds: list[str] | None = None) -> tuple[DataFrame, bool]:
    """(impacted, unknown_coverage): what depends on ``start``, each with its strongest class and least depth.

    ``directly_connected`` needs a directly connected parent and an edge that is unique and not heuristic (columns ambiguous,
    heuristic); else ``possible``. A class can only come from the level before or the same one, so levels are folded in turn.
    """
    trace = graph_trace(edges, [start], "inbound", kinds, limits)
    spark = edges.sparkSession
    kind = edges.schema["source"].dataType.simpleString()
    best = spark.createDataFrame([(start, 0, 0)], f"node {kind}, class int, depth int")
    for depth in range(1, max(trace.depth, 1) + 1 + bool(trace.flags)):
        level = trace.edges.where(F.col("depth") == depth)
        parent = best.select(F.col("node").alias("target"), F.col("class").alias("parent"))
        weak = F.col("ambiguous") | F.col("heuristic") | (F.col("parent") != 0)
        got = level.join(parent, "target").select(F.col("source").alias("node"), F.when(weak, 1).otherwise(0).alias("class"), F.lit(depth).alias("depth"))
        best = written(best.unionAll(got).groupBy("node").agg(F.min("class").alias("class"), F.min("depth").alias("depth")))
    rows = best.where(F.col("node") != F.lit(start)).select("node", F.when(F.col("class") == 0, "directly_connected").otherwise("possible").alias("class"), "depth")
    return rows.orderBy("depth", "class", "node"), bool(trace.flags)


def ancestry(commits: DataFrame, descendant: object, max_rounds: int = 10_000) -> DataFrame:
    """All ancestors of a commit, itself included, over (commit, parent) rows."""
    t = graph_trace(commits.select(F.col("commit").alias("source"), F.col("parent").alias("target"), F.lit("").alias("site")), [descendant], "outbound", None, replace(WHOLE, depth=max_rounds))
    return t.nodes.select(F.col("node").alias("ancestor"))
