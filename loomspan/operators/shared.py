"""Intermediate tables in the folder that every machine sees, and their deletion."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that may be sent to every machine.
FEW = 50_000
#: Tables that frames may still read, by path.
_live: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that every machine sees: in ``spark.checkpoint.dir``. Where it is unset, a temporary one if the whole session
    runs on this machine (as in tests); on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.gettempdir()
    return f"{folder.rstrip('/')}/loomspan/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "trace") -> DataFrame:
    """``df`` written to the shared folder and read from there, which cuts its lineage. The table stays until ``release`` or
    the end of the ``released`` block that it was made in."""
    path = scratch(df.sparkSession, name)
    _live[path] = df.sparkSession
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to four tasks a core: for rows of few bytes that much work in Python follows, which by their bytes would be one task.
    The number is fixed, so that adaptive execution doesn't merge the tasks again."""
    return df.repartition(4 * max(df.sparkSession.sparkContext.defaultParallelism, 2))


def by_merge(df: DataFrame, other: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """``df.join(other, on, how)`` by merge, whatever the sides' estimates: for sides that both grow with the data. Written tables of
    few bytes a row look small enough to be broadcast long after their rows no longer are, and each such join sends them through the driver."""
    return df.join(other.hint("merge"), on, how)


def few(df: DataFrame) -> bool:
    """Whether a written table has at most ``FEW`` rows, counted: its files say nothing of what it takes in memory."""
    return df.count() <= FEW


def by_rows(df: DataFrame) -> DataFrame:
    """The written table ``df`` as the right side of joins: broadcast where it has few rows, so that the other side stays where it
    is, else by merge."""
    return F.broadcast(df) if few(df) else df.hint("merge")


def _delete(paths: set[str]) -> None:
    for path in paths & _live.keys():
        spark = _live.pop(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> int:
    """Deletes all tables that ``written`` has made; returns how many. Frames that read them must have been written or counted."""
    paths = set(_live)
    _delete(paths)
    return len(paths)


@contextmanager
def released() -> Iterator[None]:
    """Deletes, at its end, the tables made inside it: for steps that write their result."""
    before = set(_live)
    try:
        yield
    finally:
        _delete(set(_live) - before)
