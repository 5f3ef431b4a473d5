"""Ancestry of many pairs against a walk over all parents, and candidates at keys that everything shares."""

import random

from pyspark.sql import functions as F

from loomspan.operators import memory
from loomspan.operators.ancestry import ancestry_of_pairs, jump_tables

from .test_graph_and_memory import FACT, SUBJ


def walked(parents, known, a, b):
    todo, seen, lost = [a], {a}, a not in known
    while todo:
        for p in parents.get(todo.pop(), ()):
            lost |= p not in known
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return "ancestor" if b in seen else "indeterminate" if lost else "not_ancestor"


def test_pairs_of_merged_histories(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1, 60):
        named = {max(0, k - 1 - rng.randrange(3)) for _ in range(rng.choice([1, 1, 1, 2, 3]))} - {0}
        rows += [(k, p) for p in named] or [(k, None)]
    rows += [(100 + k, 99 + k) for k in range(1, 20)] + [(200, None), (200, None)]  # 100 is only named
    df = spark.createDataFrame(rows, "commit long, parent long")
    parents = {}
    for c, p in rows:
        parents.setdefault(c, set()).update({p} - {None})
    pairs = [(a, b) for a in [*range(1, 60, 3), 101, 119, 200, 300] for b in [*range(1, 60, 5), 100, 110, 200, 300]]
    got = ancestry_of_pairs(df, spark.createDataFrame([*pairs, pairs[0], (None, 1)], "descendant long, ancestor long")).collect()
    want = {(a, b): "ancestor" if a == b else walked(parents, parents.keys(), a, b) for a, b in pairs}
    assert {(r["descendant"], r["ancestor"]): r["ancestry"] for r in got} == want and len(got) == len(pairs)


def test_a_long_chain_takes_few_rounds(spark):
    levels, ends = jump_tables(spark.range(1, 1000).select(F.col("id").alias("commit"), (F.col("id") - 1).alias("parent")))
    assert len(levels) == 11 and ends.where("tail = 0 AND dist = node").count() == 1000


def test_a_key_that_everything_shares_is_no_product(spark):
    """4,000 declarations and as many subjects of one container: every subject has 17 candidates to look at, not 4,000."""
    facts = spark.range(4000).selectExpr("concat('f', id) AS path", "CAST(id AS INT) AS ordinal", "'function' AS kind", "concat('n', id) AS name", "concat('m::n', id) AS qualified_name", "'m' AS container", "concat('d', id) AS declaration", "concat('e', id) AS name_elided")
    subjects = facts.selectExpr("path AS record_id", "0 AS evidence_ordinal", "path", "kind", "name", "qualified_name", "container", "declaration", "name_elided")
    out = memory.correspondence(subjects, facts, spark.createDataFrame([], "old_path string, new_path string"))
    assert [tuple(r) for r in out.groupBy("outcome", "candidates").count().collect()] == [("indeterminate", 17, 4000)]
    assert set(FACT) and set(SUBJ)
