"""Rows that repeat a doc_id: in SimHash groups, and in the order of token files."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomspan.llm.line_dedup import line_dedup
from loomspan.llm.simhash import simhash_dedup
from loomspan.llm.token_files import token_files, write_token_files
from loomspan.llm.tokens import tokenizer_path

BYTE = "byte_bpe_50k.json"


def test_each_group_keeps_one(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("apple", "stone", "river"))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, a, "y"), (3, b, "y"), (4, c, "y"), (None, a, "z")]
    got = simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, more string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a, "x"), (1, b, "x"), (4, c, "y"), (None, a, "z")]))


def test_start_is_the_place_in_the_files(spark, tmp_path):
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in [(7, 1), (7, 9), (7, 3), (7, 30), (7, 9), (7, 2), (7, 14), (2, 5), (9, 4), (None, 6), (7, 0)]]
    got = token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer_path(BYTE), path=f"{tmp_path}/f").collect()
    files = sorted((t for p in (tmp_path / "f").glob("part-*.parquet") if (t := pq.read_table(p)).num_rows), key=lambda t: t.column("file")[0].as_py())
    at, want = 0, []
    for t in files:
        assert t.column("row").to_pylist() == list(range(t.num_rows))
        for i, ids in zip(t.column("doc_id").to_pylist(), t.column("ids").to_pylist(), strict=True):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert [r[0] for r in want] == [None, 2, *[7] * 8, 9]


def test_meta_columns_of_any_name(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "x", 5, 6)], "doc_id long, text string, file string, `a.b` int, IDS int")
    write_token_files(docs, f"{tmp_path}/f", tokenizer_path(BYTE), meta=["file", "doc_id", "a.b", "IDS"])
    row = spark.read.parquet(f"{tmp_path}/f").first()
    assert (row["meta_file"], row["meta_doc_id"], row["a.b"], row["meta_IDS"], row["n_tokens"]) == ("x", 1, 5, 6, 3)
    with pytest.raises(ValueError, match="one name"):
        write_token_files(docs, f"{tmp_path}/g", tokenizer_path(BYTE), meta=["file", "file"])


def test_lines_of_a_hot_id(spark):
    """Many rows of one id, or of none, each lose their lines."""
    line = "a shared line of more than twenty characters"
    rows = [(i, f"{line}\nown {k % 50}") for i in (5, None) for k in range(300)] + [(9, line)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "n_dropped").count().collect()
    assert {tuple(r) for r in got} == {(5, 1, 300), (None, 1, 300), (9, 0, 1)}


def test_null_and_repeated_ids_fill_no_partition(spark):
    """20,000 rows without an id, and as many of one id: counts of the first differ by text, and no partition gets more than its share."""
    from pyspark.sql import functions as F

    from loomspan.llm.mixing import mix_sources

    n = 20_000
    docs = spark.range(2 * n, numPartitions=4).select(F.when(F.col("id") >= n, 7).cast("long").alias("doc_id"), F.when(F.col("id") < n, F.concat(F.lit("text "), "id")).otherwise("same").alias("text"), F.lit("s").alias("source"))
    mixed = mix_sources(docs, epochs=3.0)
    sizes = [r["n"] for r in mixed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    rows = mixed.count()
    assert max(sizes) <= 1.2 * rows / len(sizes) or len(sizes) == 1
    assert mixed.where("doc_id IS NULL").select("copies").distinct().count() > 4 and mixed.where("doc_id = 7").select("copies").distinct().count() <= 1
