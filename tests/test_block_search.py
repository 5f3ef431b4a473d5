"""Search by blocks against search by positions: the same ranks, fewer blocks."""

import random

import pytest

from loomspan.operators import block_search, search
from loomspan.operators.block_search import block_index, top_hits
from loomspan.operators.shared import release

FACTS = "path string, ordinal int, kind string, name string, qualified_name string"


def test_same_ranks_and_blocks_are_skipped(spark):
    """``hot`` is in every document, often or once, in names of one to forty tokens."""
    rnd = random.Random(1)
    words = ["w%d" % i for i in range(50)]
    rows = [(f"p{i % 90}", i, "function", " ".join(["hot"] * rnd.choice([1, 1, 1, 2, 5]) + rnd.choices(words, k=rnd.randrange(40))), rnd.choice(words) if i % 9 else None) for i in range(3000)]
    facts = spark.createDataFrame(rows, FACTS)
    index = block_index(facts)
    assert index.blocks.where("term = 'hot'").selectExpr("sum(n) AS n").first()["n"] == 3000
    assert index.blocks.selectExpr("max(size(offsets)) AS m").first()["m"] <= 128
    filled = facts.fillna("")
    for query, skips in (("hot", True), ("hot w3", True), ("hot hot", True), ("w1 w2 w3", False), ("function", True), ("none hot", False)):
        got, want = top_hits(index, query, 10), search.code_search(filled, query, 10)
        flat = lambda df: [(r["path"], r["ordinal"], round(r["rank"], 9)) for r in df.collect()]
        assert flat(got.rows) == flat(want.rows), query
        n = got.receipt.first()
        assert n["blocks_read"] <= n["blocks"] and (not skips or n["blocks_read"] < n["blocks"]), (query, n)
    release()


def test_edges(spark):
    facts = spark.createDataFrame([("a", 0, "struct", "", None), ("b", 0, "struct", "x", "x"), ("a", 1, "struct", "x", "x")], FACTS)
    index = block_index(facts)
    assert [(r["path"], r["ordinal"]) for r in top_hits(index, "x").rows.collect()] == [("a", 1), ("b", 0)]  # a tie goes by key
    assert top_hits(index, "x", 1).rows.first()["path"] == "a" and top_hits(index, "?").rows.count() == 0
    with pytest.raises(ValueError):
        top_hits(index, "a.b")
    empty = block_index(facts.limit(0))
    assert top_hits(empty, "x").rows.count() == 0 and top_hits(empty, "x").receipt.first()["blocks"] == 0
    release()


def test_tasks_follow_the_postings(spark, monkeypatch):
    """An index of many postings is made by more tasks than shuffles have, with the same ranks; hits are summed within their rows."""
    rnd = random.Random(2)
    rows = [(f"p{i % 9}", i, "k", " ".join(rnd.choices(["a", "b", "c", "d"], k=rnd.randrange(90))), "a" if i % 2 else None) for i in range(900)]
    facts = spark.createDataFrame(rows, FACTS)
    monkeypatch.setattr(block_search, "TASK_POSTINGS", 100, raising=False)
    index = block_index(facts)
    for table in (index.blocks, index.documents):
        assert len(table.inputFiles()) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = lambda df: [(r["path"], r["ordinal"], round(r["rank"], 9)) for r in df.collect()]
    assert flat(top_hits(index, "a c", 15).rows) == flat(search.code_search(facts.fillna(""), "a c", 15).rows)
    release()
