"""Whether commits are ancestors of others, for many pairs at once: chains of single parents by pointer doubling, merges by rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ANCESTOR, NOT_ANCESTOR, INDETERMINATE = "ancestor", "not_ancestor", "indeterminate"


def jump_tables(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Level k: (node, at, steps), where 2^k single parents lead, or as many as there are; and (node, tail, dist), where all of
    them lead. A node without a parent or with several leads nowhere. A level is a join of the one before with itself: as many
    rounds as the longest chain's length has bits. All levels are written; the driver gets one number a round."""
    nodes = edges.select(F.col("commit").alias("node")).unionAll(edges.select(F.col("parent").alias("node"))).distinct()
    single = edges.groupBy("commit").agg(F.min("parent").alias("parent"), F.count("*").alias("n")).where("n = 1").select(F.col("commit").alias("node"), F.col("parent").alias("at"))
    first = nodes.join(single, "node", "left").select("node", F.coalesce("at", "node").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    levels = [written(first, "jumps")]
    while True:
        now = levels[-1]
        far = now.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more")).hint("merge")
        after = written(now.join(far, "at").select("node", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("more")), "jumps")
        if not after.agg(F.max("more")).first()[0]:
            return levels, now.select("node", F.col("at").alias("tail"), F.col("steps").alias("dist"))
        levels.append(after.drop("more"))


def lifted(rows: DataFrame, levels: list[DataFrame], start: str, steps: str) -> DataFrame:
    """``rows`` with ``at``: the node ``steps`` single parents above ``start``, by the bits of that number."""
    out = rows.withColumn("at", F.col(start))
    for k, level in enumerate(levels):
        jump = level.select(F.col("node").alias("at"), F.col("at").alias("_to")).hint("merge")  # a broadcast a level would send them all to the driver
        out = out.join(jump, "at", "left").withColumn("at", F.when(F.col(steps).bitwiseAND(1 << k) != 0, F.col("_to")).otherwise(F.col("at"))).drop("_to")
    return out


def ancestry_of_pairs(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(descendant, ancestor, ancestry) for every distinct pair: "ancestor" (a commit is its own), "not_ancestor", or "indeterminate"
    where history that isn't there decides: a commit that is named as a parent but has no row, as in a shallow clone, or a
    descendant without one.

    ``commits`` has a row a commit and parent, parent null for a first commit. In a round every open pair goes down one chain of
    single parents: if the ancestor lies on it, it is found by lifting; else the pair goes on at the parents of the
    merge that the chain ends at, each merge once a pair. So a history without merges takes as many rounds as its length has
    bits, whatever the number of pairs, and one with merges as many more as merges follow one another. Frontiers are written."""
    edges = commits.where(F.col("parent").isNotNull()).select("commit", "parent").distinct()
    known = commits.select(F.col("commit").alias("node")).distinct()
    levels, ends = jump_tables(edges)
    lone = known.join(ends, "node", "left_anti").select("node", F.col("node").alias("tail"), F.lit(0).cast("long").alias("dist"))
    ends = written(ends.unionAll(lone).join(known.withColumn("has", F.lit(True)), F.expr("tail") == known["node"], "left").select(ends["node"], "tail", "dist", F.coalesce("has", F.lit(False)).alias("has")), "ends")
    up = edges.join(edges.groupBy("commit").agg(F.count("*").alias("n")).where("n > 1").select("commit"), "commit")
    asked = pairs.select("descendant", "ancestor").where(F.col("descendant").isNotNull() & F.col("ancestor").isNotNull()).distinct()
    goal = ends.select(F.col("node").alias("ancestor"), F.col("tail").alias("goal"), F.col("dist").alias("goal_dist"))
    key = ["descendant", "ancestor"]
    asked = written(asked.join(goal, "ancestor", "left"), "asked")
    frontier = asked.withColumn("node", F.col("descendant"))
    found, open_, seen = asked.where(F.col("descendant") == F.col("ancestor")).select(*key), None, None
    found = written(found, "found")
    while True:
        at = frontier.join(found, key, "left_anti").join(ends, "node", "left")
        lost = F.col("tail").isNull() | (~F.col("has"))  # the walk comes to a commit that isn't there
        steps = F.when((F.col("goal") == F.col("tail")) & (F.col("dist") >= F.col("goal_dist")), F.col("dist") - F.col("goal_dist")).otherwise(F.lit(0))
        at = written(at.withColumns({"lost": lost, "steps": steps, "same": F.coalesce((F.col("goal") == F.col("tail")) & (F.col("dist") >= F.col("goal_dist")), F.lit(False))}), "frontier")
        hit = lifted(at.where("same"), levels, "node", "steps").where(F.col("at") == F.col("ancestor")).select(*key)
        found = written(found.unionAll(hit).distinct(), "found")
        rest = at.join(found, key, "left_anti")
        stuck = rest.where("lost").select(*key)
        open_ = written((stuck if open_ is None else open_.unionAll(stuck)).distinct(), "open")
        merges = rest.where("NOT lost").select(*key, "goal", "goal_dist", "tail").distinct()
        merges = written(merges if seen is None else merges.join(seen, [*key, "tail"], "left_anti"), "merges")
        frontier = written(merges.join(up, F.col("tail") == F.col("commit")).select(*key, "goal", "goal_dist", F.col("parent").alias("node")).distinct(), "frontier")
        if frontier.isEmpty():
            break
        seen = written(merges.select(*key, "tail") if seen is None else seen.unionAll(merges.select(*key, "tail")), "seen")
    out = asked.select(*key).join(found.withColumn("_f", F.lit(True)), key, "left").join(open_.withColumn("_o", F.lit(True)), key, "left")
    return out.select(*key, F.when(F.col("_f"), ANCESTOR).when(F.col("_o"), INDETERMINATE).otherwise(NOT_ANCESTOR).alias("ancestry"))
