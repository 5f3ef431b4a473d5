"""What was wrong on larger tables, on small ones that show it."""

import duckdb
import pytest

from loomspan.operators import ancestry, graph, memory, overlay, shared
from loomspan.plans import engine_queries  # noqa: F401  adds its queries
from loomspan.plans.queries import ORACLES, QUERIES
from loomspan.sources import scip


@pytest.fixture(scope="module")
def wide_tree(tmp_path_factory):
    """Tables of a region whose nations have more customers than the limits of a trace."""
    d = tmp_path_factory.mktemp("tree")
    for name, of in {
        "region": "SELECT 1 AS r_regionkey",
        "nation": "SELECT range AS n_nationkey, 1 AS n_regionkey FROM range(3)",
        "supplier": "SELECT range AS s_suppkey, range % 3 AS s_nationkey FROM range(30)",
        "customer": "SELECT range AS c_custkey, range % 3 AS c_nationkey FROM range(10500)",
    }.items():
        duckdb.sql(f"COPY ({of}) TO '{d}/{name}.parquet'")
    return str(d)


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = QUERIES[name](spark, d)
    want = con.execute(ORACLES[name])
    at = [got.columns.index(c[0]) for c in want.description]
    assert sorted(tuple(r[k] for k in at) for r in got.collect()) == sorted(want.fetchall())


def test_trace_over_its_limits(spark, wide_tree):
    same_as_sql(spark, wide_tree, "graph_trace")


def test_relationship_trace_with_wide_levels(spark, wide_tree):
    same_as_sql(spark, wide_tree, "scip_relationship_trace")


def test_sites_of_the_same_keys_share_their_merged_targets(spark):
    """A thousand sites through sixty imports of one alias: the targets are merged once, not once a site."""
    d = spark.createDataFrame([("s", f"d{i % 7}", i, "function", f"n{i % 60}", f"m::n{i % 60}") for i in range(600)], "slot string, path string, ordinal int, kind string, name string, qualified_name string")
    bind = [("s", "f", i, "import", f"m::n{i} as a", None, None) for i in range(60)]
    s = spark.createDataFrame([*bind, *[("s", "f", 100 + i, "call", "a", None, None) for i in range(1000)]], "slot string, path string, site_ordinal int, kind string, raw_target string, enclosing string, enclosing_kind string")
    lists = graph._targets(d, 64)
    chosen = graph._chosen(graph._evidence_keys(graph.prepared(d, s)), lists)
    assert chosen.count() == 1060 and graph._merged(chosen, lists).count() == 61
    res, cand = graph.resolve_sites(d, s)
    assert {tuple(r) for r in res.where("kind = 'call'").select("outcome", "candidate_count", "candidates_truncated").collect()} == {("ambiguous", 64, True)}
    first = sorted(("s", f"d{i % 7}", i) for i in range(600))[:64]
    got = cand.where("site_ordinal = 700").orderBy("candidate_ordinal").select("target_slot", "target_path", "target_ordinal", "evidence").collect()
    assert [tuple(r) for r in got] == [(*t, "import_syntax") for t in first]


def test_parts_are_parsed_by_all_cores(spark, tmp_path):
    """A table of one small file, which its bytes would make one task."""
    duckdb.sql(f"COPY (SELECT range AS p_partkey, 'a b' AS p_name FROM range(50)) TO '{tmp_path}/part.parquet'")
    for name in ("rust_facts", "typescript_sites"):
        got = QUERIES[name](spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_spans_of_many_documents_take_few_calls(spark):
    """Documents with, without and with twice their content, and one without a path; no group of its own for each."""
    rows = [(f"d{i}", i, k, "s", 1, [0, 0, k], 1) for i in range(300) for k in range(2)] + [(None, 1, 0, None, 1, [0, 0, 1], 1)]
    held = [(f"d{i}", b"ab") for i in range(299)] + [("d7", b"ab"), (None, b"x")]
    got = scip.with_spans(spark.createDataFrame(rows, scip.OCCURRENCES), spark.createDataFrame(held, "path string, content binary"))
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    out = {(r["path"], r["occurrence_ordinal"]): (r["start"], r["end"], r["problem"]) for r in got.collect()}
    assert len(out) == 601 and out["d3", 1] == (0, 1, None) and out[None, 0] == (0, 1, None)
    assert all(out[d, 0] == (None, None, "no content of the document") for d in ("d7", "d299"))


def test_subjects_of_full_keys_meet_no_target(spark):
    """Forty subjects and facts of one container: each has too many candidates by that key alone."""
    side = "path string, kind string, name string, qualified_name string, container string, declaration string, name_elided string"
    row = lambda i, box: (f"p{i}", "k", f"n{i}", f"q{i}", box, f"d{i}", f"e{i}")
    every = [row(i, "box") for i in range(40)] + [row(99, "alone")]
    subjects = spark.createDataFrame([(i, 0, *r) for i, r in enumerate(every)], f"record_id int, evidence_ordinal int, {side}")
    facts = spark.createDataFrame([(i, *r) for i, r in enumerate(every)], f"ordinal int, {side}")
    before = set(shared._live)
    out = {r["record_id"]: tuple(r)[2:] for r in memory.correspondence(subjects, facts, spark.createDataFrame([], "old_path string, new_path string")).collect()}
    assert out.pop(40) == ("exact", "exact", "p99", 40, 1)
    assert set(out.values()) == {("indeterminate", None, None, None, 17)} and len(out) == 40
    many = [p for p in set(shared._live) - before if "/many-" in p]
    assert spark.read.parquet(*many).count() == 40


def test_ancestry_broadcasts_no_level(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 50)], "commit long, parent long")
    levels, _ = ancestry.jump_tables(edges)
    out = ancestry.lifted(spark.createDataFrame([(49, 30)], "node long, steps long"), levels, "node", "steps")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.first()["at"] == 19


def test_memory_broadcasts_no_side_that_grows(spark):
    """Written tables, whose files look small enough to be broadcast."""
    n = range(40)
    versions = shared.written(spark.createDataFrame([(f"r{i}", "1") for i in n], "record_id string, revision string"))
    parents = shared.written(spark.createDataFrame([("r1", "1", "0")], "record_id string, revision string, parent string"))
    heads = memory.select_heads(versions, versions, parents)
    records = shared.written(versions.selectExpr("*", "'finding' AS kind", "1 AS schema_version", "'active' AS lifecycle", "'commits' AS validity_kind", "'' AS source_snapshot"))
    checks = shared.written(versions.selectExpr("record_id", "'introduced_by' AS side", "'ancestor' AS ancestry"))
    facts = shared.written(spark.createDataFrame([(f"p{i}", "k", f"n{i}", f"q{i}", f"c{i}", f"d{i}", f"e{i}", i) for i in n], "path string, kind string, name string, qualified_name string, container string, declaration string, name_elided string, ordinal int"))
    subjects = shared.written(facts.selectExpr("concat('r', ordinal) AS record_id", "0 AS evidence_ordinal", "* EXCEPT (ordinal)"))
    moves = spark.createDataFrame([], "old_path string, new_path string")
    done = memory.revalidate(versions, versions, parents, records, checks, subjects, facts, moves)
    for df in (heads, memory.open_heads(versions, versions, parents), memory.project_validity(records, checks, None), memory.correspondence(subjects, facts, moves), done):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in done.select("record_id", "effective_state").collect()} == {(f"r{i}", "indeterminate" if i == 1 else "current") for i in n}
