"""Engineering-memory records from JSON lines: strict shape, canonical form, digest; and exported history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the record format.
KINDS = ("decision", "constraint", "convention", "procedure", "finding")
LIFECYCLES = ("active", "draft", "archived", "superseded")
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("lifecycle", T.StringType()),
        T.StructField("parents", T.ArrayType(T.StringType())),
        T.StructField("introduced_by", T.ArrayType(T.StringType())),
        T.StructField("invalidated_by", T.ArrayType(T.StringType())),
    ]
)
#: Limits in bytes, and of lists.
MAX_TITLE, MAX_BODY, MAX_PARENTS, MAX_COMMITS = 256, 16_384, 8, 16


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected): records with canonical_json and its digest as revision; lists are sorted and distinct in it, so
    equal content has one revision however it was written. Rejected lines keep their text and the first reason."""
    return checked(spark.read.text(path).where(F.trim("value") != ""))


def checked(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of JSON texts (value)."""
    parsed = raw.withColumn("r", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}))
    r = lambda c: F.col(f"r.{c}")
    n = lambda c: F.coalesce(F.size(r(c)), F.lit(0))
    reason = (
        F.when(r("record_id").isNull() | ~r("record_id").rlike("^[0-9a-f]{32}$"), "record_id")
        .when(r("schema_version").isNull() | ~r("schema_version").isin(1, 2), "schema_version")
        .when(r("kind").isNull() | ~r("kind").isin(*KINDS), "kind")
        .when(r("title").isNull() | (F.octet_length(r("title")) > MAX_TITLE) | (r("title") == ""), "title")
        .when(r("body").isNull() | (F.octet_length(r("body")) > MAX_BODY), "body")
        .when(r("lifecycle").isNull() | ~r("lifecycle").isin(*LIFECYCLES), "lifecycle")
        .when(n("parents") > MAX_PARENTS, "parents")
        .when((n("introduced_by") > MAX_COMMITS) | (n("invalidated_by") > MAX_COMMITS), "commits")
    )
    parsed = parsed.withColumn("reason", reason)
    tidy = lambda c: F.array_sort(F.array_distinct(F.coalesce(r(c), F.array().cast("array<string>")))).alias(c)
    fields = [tidy(f.name) if isinstance(f.dataType, T.ArrayType) else r(f.name).alias(f.name) for f in RECORD]
    good = parsed.where(F.col("reason").isNull()).select(F.to_json(F.struct(*fields)).alias("canonical_json"), *fields)
    return good.withColumn("revision", F.sha2("canonical_json", 256)), parsed.where(F.col("reason").isNotNull()).select("value", "reason")


def parents_of(records: DataFrame) -> DataFrame:
    return records.select("record_id", "revision", F.explode("parents").alias("parent"))


def validity_commits(records: DataFrame) -> DataFrame:
    side = lambda c: records.select("record_id", "revision", F.lit(c).alias("side"), F.explode(c).alias("commit"))
    return side("introduced_by").unionAll(side("invalidated_by"))


def import_history(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """Observations of records in reachable history, one per (record, revision), at its first commit; all of them, never approvals."""
    seen = trees.join(commits.select("commit", "at_ms").distinct(), "commit")
    first = seen.groupBy("record_id", "revision").agg(F.min(F.struct("at_ms", "commit")).alias("f"))
    return first.select("record_id", "revision", F.lit("observed").alias("operation"), F.col("f.at_ms").alias("recorded_at"), F.col("f.commit").alias("source_revision")).orderBy("recorded_at", "record_id", "revision")
