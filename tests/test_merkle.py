"""Stored trees of digests: the same differences as a full comparison, and reads that follow the change."""

from pyspark.sql import functions as F

from loomspan.operators.manifests import manifest_diff
from loomspan.plans import merkle


def test_differences_read_what_changed(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    whole = spark.range(3000).select(F.concat(F.lit("dir/f"), "id").alias("path"), F.col("id").cast("string").alias("content_digest"))
    one = whole.withColumn("content_digest", F.when(F.col("path") == "dir/f7", "new").otherwise(F.col("content_digest"))).where("path <> 'dir/f9'")
    assert [merkle.store(df, at(n), leaf=20) for n, df in (("a", whole), ("b", one), ("same", whole.repartition(5)), ("none", whole.limit(0)))] == [2, 2, 2, 0]
    assert merkle.root(spark, at("a")) == merkle.root(spark, at("same")) != merkle.root(spark, at("b")) and merkle.root(spark, at("none")) is None
    rows, read = merkle.differences(spark, at("a"), at("b"))
    assert {tuple(r) for r in rows.collect()} == {("dir/f7", "changed", "7", "new"), ("dir/f9", "removed", "9", None)}
    assert read["leaves"] <= 2 and read["nodes"] <= 1 + 16 + 32 and 0 < read["rows"] < 100
    rows, read = merkle.differences(spark, at("a"), at("same"))
    assert rows.count() == 0 and read == {"nodes": 1, "leaves": 0, "rows": 0}
    assert merkle.differences(spark, at("none"), at("a"))[0].where("change = 'added'").count() == 3000
    other = whole.select(F.concat("path", F.when(F.col("path").endswith("3"), "x").otherwise("")).alias("path"), "content_digest")
    merkle.store(other, at("c"), leaf=20)
    full = manifest_diff(whole, other).where("change <> 'unchanged'")
    assert {tuple(r) for r in merkle.differences(spark, at("a"), at("c"))[0].collect()} == {tuple(r) for r in full.collect()}
