"""Graph resolution sends no side that grows through the driver."""

import duckdb

from loomspan.operators import graph, graph_delta, shared
from loomspan.plans import queries

DEFS = "slot string, path string, ordinal int, kind string, name string, qualified_name string"
SITES = "slot string, path string, site_ordinal int, kind string, raw_target string, enclosing string, enclosing_kind string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def recorded(monkeypatch, module):
    """The plans of all that the module writes."""
    plans = []
    monkeypatch.setattr(module, "written", lambda df, name="x": plans.append(plan(df)) or shared.written(df, name))
    return plans


def tables(spark):
    """Written tables, whose files look small enough to be broadcast."""
    d = [("s", "f", i, "function", f"n{i}", f"m::n{i}") for i in range(40)] + [("s", "f", 50, "module", "m", "m"), ("s", "f", 51, "method", "run", "m::run")]
    s = [("s", "f", i, "call", f"n{i}", *((None, None), ("m", "module"), ("m::g", None))[i % 3]) for i in range(40)]
    s += [("s", "f", 60, "import", "m::n1 as a", None, None), ("s", "f", 61, "call", "a", None, None), ("s", "f", 62, "call", "run", None, None), ("s", "f", 63, "call", "m::run", "m", "module"), ("s", "f", 64, "macro_call", "x", None, None)]
    return shared.written(spark.createDataFrame(d, DEFS)), shared.written(spark.createDataFrame(s, SITES))


def test_resolution_broadcasts_no_side_that_grows(spark, monkeypatch):
    plans = recorded(monkeypatch, graph)
    res, cand = graph.resolve_sites(*tables(spark))
    assert not [p for p in [*plans, plan(res), plan(cand)] if "Broadcast" in p] and len(plans) == 4
    assert tuple(graph.graph_status(res, res, cand).rows.first()) == (45, 42, 0, 3, 3, 42)
    out = {r["site_ordinal"]: (r["outcome"], r["unresolved_reason"]) for r in res.collect()}
    assert out[61] == ("unique", None) and out[62] == out[63] == ("unresolved", "dynamic_or_method_call")
    evidence = {r["site_ordinal"]: (r["target_ordinal"], r["evidence"]) for r in cand.collect()}
    assert [evidence[k] for k in (0, 1, 2, 61)] == [(0, "exact_name_heuristic"), (1, "lexical_syntax"), (2, "lexical_syntax"), (1, "import_syntax")]
    shared.release()


def test_sites_of_customers_broadcast_no_table(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT range AS p_partkey, 'a b' AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, 1 AS p_size FROM range(50)) TO '{tmp_path}/part.parquet'")
    duckdb.sql(f"COPY (SELECT range AS c_custkey, 1 AS c_nationkey FROM range(50)) TO '{tmp_path}/customer.parquet'")
    sites = queries._definitions_and_sites(spark, str(tmp_path))[1]
    assert "Broadcast" not in plan(sites) and sites.count() == 50


def test_a_large_edit_broadcasts_no_side_that_grows(spark, monkeypatch):
    """An edit of ten files of thirty counts as large: what it leaves is joined by merge, and equals a full run."""
    monkeypatch.setattr(shared, "FEW", 0, raising=False)
    d = [("s", f"f{i}", k, kind, name, name) for i in range(30) for k, kind, name in ((0, "function", f"n{i}"), (1, "module", "m"))]
    s = [("s", f"f{i}", k, kind, raw, "m", "module") for i in range(30) for k, kind, raw in ((0, "call", f"n{i}"), (1, "call", f"n{(i + 1) % 30}"), (2, "import", f"n{(i + 2) % 30} as b"), (3, "call", "b"))]
    edited = [(*r[:4], "new", "new") if r[3] == "function" and int(r[1][1:]) < 10 else r for r in d]
    before, after, sites = (shared.written(spark.createDataFrame(*x)) for x in ((d, DEFS), (edited, DEFS), (s, SITES)))
    previous = graph_delta.Graph(*[shared.written(t) for t in graph_delta.resolve_all(before, sites)])
    files = shared.written(sites.where("CAST(substr(path, 2) AS INT) < 10").select("slot", "path"))
    seen = [recorded(monkeypatch, m) for m in (graph, graph_delta)]
    change = graph_delta.resolve_changes(previous, before, after, sites, files)
    assert all(seen) and not [p for p in [*sum(seen, []), *map(plan, change.graph)] if "Broadcast" in p]
    assert 40 < change.again.count() < 120
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for got, want in zip(change.graph, graph_delta.resolve_all(after, sites), strict=True):
        assert rows(got) == rows(want)
    shared.release()


def test_a_small_edit_moves_no_stored_candidates(spark):
    d, s = tables(spark)
    previous = graph_delta.Graph(*[shared.written(t) for t in graph_delta.resolve_all(d, s)])
    change = graph_delta.resolve_changes(previous, d, d, s, spark.createDataFrame([], "slot string, path string"))
    stored = plan(change.graph.candidates).split("Union")[1].split("FileScan")[0]
    assert "BroadcastHashJoin" in stored and "SortMergeJoin" not in stored and change.again.count() == 0
    shared.release()
