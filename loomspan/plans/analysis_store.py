"""Analyses by the digest of what they were made from: stored once, shared by all slots and generations, swept when none refers to them.

The store is a commit log. A commit adds the rows of digests that no one has added before, with the digests themselves, so a
digest that is known has all its rows. A generation holds no analyses: it is a list of files with digests, and its facts are the join of
the two. What can go is found by mark and sweep: digests that no generation lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import released, written
from .commit_log import CommitLog, Snapshot

KEY = "artifact_digest"


class AnalysisStore:
    """Tables with a column artifact_digest under a folder. Their schemas are those of the first rows added."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root, {})

    def known(self, now: Snapshot | None = None) -> DataFrame:
        """The digests that are there."""
        got = (now or self.log.snapshot()).read("digests")
        return self.spark.createDataFrame([], f"{KEY} string") if got is None else got

    def add(self, digests: DataFrame, tables: dict[str, DataFrame]) -> int:
        """Adds the rows of those of ``digests`` that aren't known, and returns how many those were. Two writers of one digest: the
        second one finds it known when its commit is refused, and leaves it out."""

        def make(now: Snapshot) -> tuple[dict[str, DataFrame], int]:
            new = written(digests.select(KEY).distinct().join(self.known(now), KEY, "left_anti"), "digests")
            n = new.count()
            if not n:
                return {}, 0
            rows = {name: df.join(new, KEY, "left_semi").sortWithinPartitions(KEY) for name, df in tables.items()}
            return {"digests": new, **rows}, n

        with released():
            return self.log.transact(make)

    def read(self, table: str, of: DataFrame, now: Snapshot | None = None) -> DataFrame | None:
        """The rows of a table for a frame's digests, with the frame's other columns: a digest at two paths has its rows at both."""
        rows = (now or self.log.snapshot()).read(table)
        return None if rows is None else rows.join(of, KEY)

    def references(self, generations: list[DataFrame]) -> DataFrame:
        """(artifact_digest, generations, files) of all known digests: how many of the generations' lists of files name each, and files in them."""
        each = [g.groupBy(KEY).agg(F.count("*").alias("files"), F.lit(1).alias("one")) for g in generations]
        by = reduce(DataFrame.unionAll, each).groupBy(KEY).agg(F.sum("one").alias("generations"), F.sum("files").alias("files")) if each else self.known().limit(0).selectExpr(KEY, "0L AS generations", "0L AS files")
        return self.known().join(by, KEY, "left").fillna(0, ["generations", "files"])

    def sweep(self, generations: list[DataFrame], rewrite: float = 0.5) -> dict[str, int]:
        """Takes out what no generation refers to. A part of the log whose digests are all dead goes without a look at its rows; one
        of which at least a share ``rewrite`` is dead is written again without them; one with fewer stays until more are. One commit
        swaps the parts; their files go with the log's ``vacuum``, once no reader can hold them."""
        done = {"dead": 0, "dropped": 0, "rewritten": 0}

        def make(now: Snapshot) -> tuple[dict[str, DataFrame], dict[str, int]]:
            live = written(reduce(DataFrame.unionAll, [g.select(KEY) for g in generations]).distinct(), "live") if generations else self.known(now).limit(0)
            marked = now.tagged("digests")
            if marked is None:
                return {}, done
            counts = marked.join(live.withColumn("live", F.lit(1)), KEY, "left").groupBy("part").agg(F.count("*").alias("all"), F.count("live").alias("live")).collect()  # a row a commit
            gone = [r["part"] for r in counts if r["live"] < r["all"] and (r["all"] - r["live"]) >= rewrite * r["all"]]
            partly = [r["part"] for r in counts if r["part"] in gone and r["live"]]
            stay = {t: df.join(live, KEY, "left_semi") for t, df in now.only(partly).items()} if partly else {}
            value = {"dead": sum(r["all"] - r["live"] for r in counts if r["part"] in gone), "dropped": len(gone) - len(partly), "rewritten": len(partly)}
            return ({"removed": gone, **stay} if gone else {}), value

        with released():
            return self.log.transact(make)
