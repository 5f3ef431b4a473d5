"""Resolution, traces, overlays, memory, manifests, retention: small golden frames."""

from pyspark.sql import functions as F

from loomspan.operators import context, graph, manifests, memory, overlay, retention, trace

DEFS = "slot string, path string, ordinal int, kind string, name string, qualified_name string"
SITES = "slot string, path string, site_ordinal int, kind string, raw_target string, enclosing string, enclosing_kind string"


def resolve(spark, defs, sites, **kw):
    d = spark.createDataFrame(defs, DEFS)
    s = spark.createDataFrame([("s", "f", i, *x) if len(x) == 4 else (*x[:2], i, *x[2:]) for i, x in enumerate(sites)], SITES)
    res, cand = graph.resolve_sites(d, s, **kw)
    by = {}
    for r in cand.orderBy("site_ordinal", "candidate_ordinal").collect():
        by.setdefault(r["site_ordinal"], []).append((r["target_path"], r["target_ordinal"], r["evidence"]))
    return {r["site_ordinal"]: (r["outcome"], r["unresolved_reason"]) for r in res.collect()}, by


def test_resolution_tiers(spark):
    defs = [
        ("s", "f", 0, "function", "go", "go"), ("s", "f", 1, "module", "m", "m"), ("s", "f", 2, "function", "go", "m::go"), ("s", "f", 3, "struct", "W", "m::W"),
        ("s", "f", 4, "method", "run", "m::W::run"), ("t", "g", 0, "function", "far", "lib::far"), ("t", "g", 1, "function", "go", "go"), ("s", "f", 5, "function", "outer", "m::outer"),
    ]
    sites = [
        ("call", "go", "m::outer", "function"),  # 0 the inner scope wins
        ("call", "go", None, None),  # 1 top level of the slot, not the other slot
        ("call", "crate::m::go", None, None),  # 2
        ("call", "lib::far", None, None),  # 3 a qualified path may be in another slot
        ("call", "far", None, None),  # 4 by name only
        ("call", "run", None, None),  # 5 only a method has it
        ("call", "x.run", None, None), ("call", "<T>::f", None, None), ("macro_call", "go", None, None), ("import", "a::{b}", None, None),  # 6 to 9
        ("import", "lib::far as near", None, None),  # 10
        ("call", "near", None, None),  # 11 through the import
        ("call", "near", "m::outer", "function"),  # 12 the import isn't in that module
        ("call", "go::<u8>", None, None), ("reference", "W", "m::outer", "function"), ("call", "W", "m::outer", "function"), ("call", "nothing", None, None),  # 13 to 16
        ("reference", "go", "m", "module"),  # 17
    ]
    out, cand = resolve(spark, defs, sites)
    assert cand[0] == [("f", 2, "lexical_syntax")] and cand[1] == [("f", 0, "lexical_syntax")] and cand[2] == [("f", 2, "qualified_syntax")]
    assert cand[3] == [("g", 0, "qualified_syntax")] and cand[4] == [("g", 0, "exact_name_heuristic")] and cand[10] == [("g", 0, "import_syntax")]
    assert cand[11] == [("g", 0, "import_syntax")] and out[12] == ("unresolved", "no_candidate") and cand[13] == cand[1]
    assert [out[k][1] for k in (5, 6, 7, 8, 9)] == ["dynamic_or_method_call"] * 3 + ["unsupported_site_kind", "unsupported_import_shape"]
    assert cand[14] == [("f", 3, "lexical_syntax")] and out[15] == ("unresolved", "no_candidate") and out[16] == ("unresolved", "no_candidate")
    assert cand[17] == [("f", 2, "lexical_syntax")]


def test_path_grammar(spark):
    from loomspan.functions.text import import_parts, path_parts, strip_turbofish

    paths = {
        "a::b": ("a::b", False, False), "::a::b": ("a::b", False, False), "crate::f": ("f", True, True), "f": ("f", False, True), "r#type": ("r#type", False, True), "self": ("self", False, True),
        "self::a": None, "super::a": None, "crate::": None, "é": None, "a::é": None, "a:b": None, "a::": None, "": None, "a b": None, "a.b": None, "a\n": None, "1a": None, "::crate::a": ("crate::a", False, False),
    }
    imports = {
        "a::b": ("a::b", "b", False), "crate::a as c": ("a", "c", True), "a as _": ("a", None, False), "a::self": ("a::self", None, False), "  a::b   as\tc ": ("a::b", "c", False),
        "a as 1": None, "a as b c": None, "a::{b}": None, "a in b": None, "a::*": None,
    }
    generic = {"f::<T>": "f", "a::<T>::b::<U>": "a::<T>::b", "f::<Vec<u8>>": "f", "f::<T>x": "f::<T>x", "::<T>": "::<T>", "f": "f", "f::<a>>b<c>": "f::<a>>b<c>"}
    at = lambda x, f: {r[0]: r[1] and tuple(r[1]) if not isinstance(r[1], str) else r[1] for r in spark.createDataFrame([(k,) for k in x], "p string").select("p", f(F.col("p"))).collect()}
    assert at(paths, path_parts) == paths and at(imports, import_parts) == imports and at(generic, strip_turbofish) == generic


def test_methods_by_exact_name(spark):
    defs = [("s", "f", 0, "method", "run", "m::W::run"), ("t", "g", 0, "method", "stop", "q::stop")]
    out, _ = resolve(spark, defs, [("call", "m::W::run", None, None), ("call", "other::run", None, None), ("call", "crate::stop", None, None), ("call", "stop", None, None), ("call", "crate::run::<u8>", None, None)])
    assert [out[k][1] for k in range(5)] == ["dynamic_or_method_call", "no_candidate", "no_candidate", "dynamic_or_method_call", "dynamic_or_method_call"]


def test_hot_names(spark):
    """A name that everything defines and everything calls costs a row a site and a bounded list."""
    d = spark.range(3000).selectExpr("'t' AS slot", "CAST(id AS STRING) AS path", "0 AS ordinal", "'function' AS kind", "'new' AS name", "concat('m', id, '::new') AS qualified_name")
    s = spark.range(3000).selectExpr("'s' AS slot", "'f' AS path", "CAST(id AS INT) AS site_ordinal", "'call' AS kind", "'new' AS raw_target", "CAST(NULL AS STRING) AS enclosing", "CAST(NULL AS STRING) AS enclosing_kind")
    res, cand = graph.resolve_sites(d, s)
    assert {tuple(r) for r in res.select("outcome", "candidate_count", "candidates_truncated").distinct().collect()} == {("ambiguous", 64, True)}
    assert cand.count() == 64 * 3000


def test_contained_spans(spark):
    import random

    from loomspan.operators.spans import contained, innermost

    rng = random.Random(1)
    spans = [(rng.randrange(3), a := rng.randrange(1000), a + rng.choice([0, 1, 5, 40, 500]), f"f{i}") for i in range(120)]
    points = [(rng.randrange(3), i, s := rng.randrange(1100), s + rng.randrange(4)) for i in range(150)]
    p = spark.createDataFrame(points, "doc int, n int, start int, end int")
    s = spark.createDataFrame(spans, "doc int, o_start int, o_end int, name string")
    want = {(d, n, name) for d, n, a, b in points for e, x, y, name in spans if d == e and x <= a and b <= y}
    assert {(r["doc"], r["n"], r["name"]) for r in contained(p, s, ["doc"]).collect()} == want and len(want) > 100
    best = {}
    for d, n, a, b in points:
        hit = [(x, -y, name) for e, x, y, name in spans if d == e and x <= a and b <= y]
        if hit:
            best[n] = max(hit)[2]
    assert {r["n"]: r["name"] for r in innermost(p, s, ["doc"], ["n"], "name").collect()} == best
    assert contained(p, s.limit(0), ["doc"]).count() == 0


def test_candidate_limit(spark):
    defs = [("t", f"p{i:03d}", 0, "function", "f", f"m{i}::f") for i in range(70)]
    out, cand = resolve(spark, defs, [("call", "f", None, None)])
    assert out[0][0] == "ambiguous" and len(cand[0]) == 64 and cand[0][0][0] == "p000"
    d, s = spark.createDataFrame(defs, DEFS), spark.createDataFrame([("s", "f", 0, "call", "f", None, None)], SITES)
    r = graph.resolve_sites(d.repartition(5), s)[0].first()
    assert r["candidates_truncated"] and r["candidate_count"] == 64
    res, c = graph.resolve_sites(d, s)
    assert graph.graph_status(d, res, c).rows.first()["ambiguous"] == 1
    assert graph.graph_status(d.limit(0), res, c).receipt.first()["availability"] == "not_produced"
    assert graph.graph_evidence(res, c, {"slot": "s", "path": "f", "site_ordinal": 0}).count() == 64


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k, amb, False, "") for a, b, k, amb in rows], "source string, target string, edge_kind string, ambiguous boolean, heuristic boolean, site string")


def test_trace(spark):
    e = edges(spark, ("a", "b", "calls", False), ("a", "c", "calls", True), ("b", "d", "calls", False), ("c", "d", "imports", False), ("d", "a", "calls", False), ("x", "y", "calls", False))
    t = trace.graph_trace(e, ["a"])
    assert [(r["depth"], r["source"], r["target"]) for r in t.edges.collect()] == [(1, "a", "b"), (1, "a", "c"), (2, "b", "d"), (2, "c", "d"), (3, "d", "a")]
    assert not t.flags and {r["node"] for r in t.nodes.collect()} == set("abcd")
    short = trace.graph_trace(e, ["a"], limits=trace.Limits(depth=1))
    assert short.flags == {"depth"} and short.edges.count() == 2
    cut = trace.graph_trace(e, ["a"], limits=trace.Limits(results=3))
    assert cut.flags == {"results"} and [(r["source"], r["target"]) for r in cut.edges.collect()] == [("a", "b"), ("a", "c"), ("b", "d")]
    few = trace.graph_trace(e, ["a"], limits=trace.Limits(nodes=2))
    assert "nodes" in few.flags and {r["node"] for r in few.nodes.collect()} == {"a", "b"}
    assert trace.graph_trace(e, ["a"], limits=trace.Limits(frontier=1)).flags >= {"frontier"}
    assert [r["target"] for r in trace.graph_trace(e, ["a"], kinds=["imports"]).edges.collect()] == []
    assert {r["source"] for r in trace.graph_trace(e, ["d"], "inbound", limits=trace.Limits(depth=1)).edges.collect()} == {"b", "c"}


def test_impact(spark):
    e = edges(spark, ("b", "a", "calls", False), ("c", "a", "calls", True), ("d", "b", "calls", False), ("d", "c", "calls", False), ("e", "c", "calls", False))
    rows, unknown = trace.impact_analyze(e, "a")
    assert [tuple(r) for r in rows.collect()] == [("b", "directly_connected", 1), ("c", "possible", 1), ("d", "directly_connected", 2), ("e", "possible", 2)]
    assert not unknown and trace.impact_analyze(e, "a", trace.Limits(depth=1))[1]


def test_ancestry(spark):
    c = spark.createDataFrame([("d", "c"), ("c", "b"), ("c", "x"), ("b", "a"), ("a", None), ("x", "a"), ("z", "a")], "commit string, parent string")
    known = trace.ancestry(c.where("parent is not null"), "d")
    assert {r[0] for r in known.collect()} == {"d", "c", "b", "x", "a"}
    checks = memory.ancestry_checks(spark.createDataFrame([("b",), ("z",), ("gone",)], "commit string"), known, c)
    assert {r["commit"]: r["ancestry"] for r in checks.collect()} == {"b": "ancestor", "z": "not_ancestor", "gone": "indeterminate"}


def test_overlay(spark):
    occ = spark.createDataFrame([("o", 0, 0, "F", 1, 0, 1), ("o", 0, 1, "T", 0, 5, 6), ("o", 0, 2, "T", 8, 7, 8), ("o", 0, 3, "U", 0, 30, 31), ("o", 0, 4, "V", 0, 99, 100)], "overlay_digest string, document_ordinal int, occurrence_ordinal int, symbol string, roles int, start long, end long")
    fun = spark.createDataFrame([("o", 0, 0, 40, "F"), ("o", 0, 4, 10, "G")], "overlay_digest string, document_ordinal int, start long, end long, symbol string")
    declared = spark.createDataFrame([("o", 0, 0, "F", "U", 3), ("o", 0, 1, "U", "W", 1)], "overlay_digest string, document_ordinal int, relationship_ordinal int, source_symbol string, target_symbol string, kinds int")
    derived = overlay.enclosed_reference_edges(occ, fun, declared)
    assert [(r["source_symbol"], r["target_symbol"], r["relationship_ordinal"]) for r in derived.collect()] == [("G", "T", 0)]
    rel = overlay.all_relationships(declared, derived)
    o, r = overlay.scip_evidence(occ, rel, "U")
    assert o.rows.count() == 1 and {(x["direction"], tuple(x["kind_names"])) for x in r.rows.collect()} == {("incoming", ("reference", "implementation")), ("outgoing", ("reference",))}
    t, state, open_ = overlay.scip_relationship_trace(rel, "F")
    assert [(x["source"], x["target"]) for x in t.edges.collect()] == [("F", "U"), ("U", "W")] and state == "available" and not open_ and not t.flags
    t, _, open_ = overlay.scip_relationship_trace(rel, "F", depth=1)
    assert t.edges.count() == 1 and open_ == 1 and t.flags == {"depth"}
    t, _, open_ = overlay.scip_relationship_trace(rel, "F", max_bytes=70)
    assert t.edges.count() == 1 and open_ == 1 and "bytes" in t.flags
    assert overlay.scip_relationship_trace(rel, "none")[1] == "no_relationships"
    at = occ.withColumn("path", F.lit("p"))
    assert [overlay.scip_symbol_resolve(at.unionAll(at.where("symbol = 'U'").withColumn("symbol", F.lit("U2"))), "p", *s).first()[0] for s in ((5, 6), (30, 31), (1, 2))] == ["exact", "ambiguous", "none"]


def test_heads(spark):
    v = spark.createDataFrame([(r, x) for r, xs in {1: "ab", 2: "ab", 3: "a", 4: "ab", 5: "a"}.items() for x in xs], "record_id int, revision string")
    approved = v.where("record_id <> 5 AND NOT (record_id = 4 AND revision = 'b')")
    parents = spark.createDataFrame([(1, "b", "a"), (3, "a", "missing"), (4, "b", "a")], "record_id int, revision string, parent string")
    got = {r["record_id"]: (r["outcome"], r["revision"]) for r in memory.select_heads(v, approved, parents).collect()}
    assert got == {1: ("selected", "b"), 2: ("conflicted", None), 3: ("indeterminate", None), 4: ("selected", "a")}


def test_validity(spark):
    r = spark.createDataFrame([(i, "worktree" if i > 7 else "commits", {8: "now", 9: "then"}.get(i)) for i in range(1, 10)], "record_id int, validity_kind string, source_snapshot string")
    checks = [(1, "introduced_by", "ancestor"), (1, "invalidated_by", "not_ancestor"), (2, "introduced_by", "ancestor"), (2, "invalidated_by", "ancestor"), (3, "introduced_by", "indeterminate"), (4, "introduced_by", "indeterminate"), (4, "invalidated_by", "ancestor"), (5, "introduced_by", "not_ancestor"), (6, "introduced_by", "ancestor"), (6, "invalidated_by", "indeterminate"), (7, "introduced_by", "indeterminate"), (7, "introduced_by", "ancestor")]
    c = spark.createDataFrame(checks, "record_id int, side string, ancestry string")
    got = {x["record_id"]: x["validity"] for x in memory.project_validity(r, c, "now").collect()}
    n, i, v = "not_applicable", "indeterminate", "valid"
    assert got == {1: v, 2: n, 3: i, 4: n, 5: n, 6: i, 7: v, 8: v, 9: n}


SUBJ = "record_id int, evidence_ordinal int, path string, kind string, name string, qualified_name string, container string, declaration string, name_elided string"
FACT = "path string, ordinal int, kind string, name string, qualified_name string, container string, declaration string, name_elided string"


def test_correspondence(spark):
    s = [(1, 0, "p", "function", "f", "m::f", "m", "D1", "E1"), (2, 0, "p", "function", "g", "m::g", "m", "D2", "E2"), (3, 0, "q", "function", "h", "n::h", "n", "D3", "E3"), (4, 0, "r", "struct", "S", "o::S", "o", "D4", "E4"), (5, 0, "u", "enum", "Z", "z::Z", "z", "D9", "E9"), (6, 0, "u", "enum", "Z", "z::Z", "z", "D9", None), (7, 0, "w", "trait", "T", "t::T", "t", "D7", "E7")]
    f = [("p", 0, "function", "f", "m::f", "m", "D1", "E1"), ("p", 1, "function", "g2", "m::g2", "m", "D2b", "E2"), ("q2", 0, "function", "h", "n::h", "n", "D3", "E3"), ("r", 0, "struct", "S", "o::S", "o", "D4b", "E4b")]
    f += [("w", k, "trait", f"T{k}", f"t::T{k}", "t", f"X{k}", f"Y{k}") for k in range(17)]
    moves = spark.createDataFrame([("q", "q2")], "old_path string, new_path string")
    out = memory.correspondence(spark.createDataFrame(s, SUBJ), spark.createDataFrame(f, FACT), moves)
    got = {r["record_id"]: (r["outcome"], r["relation"]) for r in out.collect()}
    assert got == {1: ("exact", "exact"), 2: ("corresponded", "renamed"), 3: ("corresponded", "moved"), 4: ("changed", "changed"), 5: ("missing", None), 6: ("indeterminate", None), 7: ("indeterminate", None)}
    items = spark.createDataFrame([(1, 0, "corresponded", "renamed", "p", 0), (1, 1, "exact", "exact", "p", 0), (2, 0, "corresponded", "renamed", "p", 0)], "record_id int, evidence_ordinal int, outcome string, relation string, target_path string, target_ordinal int")
    assert {(r["record_id"], r["evidence_ordinal"]): r["outcome"] for r in memory.reject_many_to_one(items).collect()} == {(1, 0): "needs_review", (1, 1): "exact", (2, 0): "corresponded"}


def test_fold_and_revalidate(spark):
    rec = spark.createDataFrame([(i, "a", "procedure" if i == 8 else "decision", 2, "archived" if i == 7 else "active", "valid") for i in range(1, 9)], "record_id int, revision string, kind string, schema_version int, lifecycle string, validity string")
    worst = {1: ["exact"], 2: ["exact", "corresponded"], 3: ["exact", "missing"], 4: ["missing", "changed"], 5: ["changed", "needs_review"], 6: ["needs_review", "indeterminate"], 8: ["exact"]}
    items = spark.createDataFrame([(k, o) for k, v in worst.items() for o in v], "record_id int, outcome string")
    got = {r["record_id"]: (r["effective_state"], r["evidence_state"]) for r in memory.fold_evidence(rec, items).collect()}
    assert got == {1: ("current", "exact"), 2: ("current", "corresponded"), 3: ("stale", "missing"), 4: ("stale", "changed"), 5: ("needs_review", "ambiguous"), 6: ("indeterminate", "indeterminate"), 7: ("archived", "not_evaluated"), 8: ("needs_review", "not_evaluated")}
    v = rec.select("record_id", "revision")
    subjects = spark.createDataFrame([(1, 0, "p", "function", "f", "f", "", "D", "E")], SUBJ)
    out = memory.revalidate(v, v, spark.createDataFrame([], "record_id int, revision string, parent string"), rec.drop("validity").withColumn("validity_kind", F.lit("worktree")).withColumn("source_snapshot", F.lit("now")), spark.createDataFrame([], "record_id int, side string, ancestry string"), subjects, spark.createDataFrame([("p", 0, "function", "f", "f", "", "D", "E")], FACT), spark.createDataFrame([], "old_path string, new_path string"), "now")
    assert {r["record_id"]: r["effective_state"] for r in out.collect()}[1] == "current"


def test_recall_and_tasks(spark):
    p = spark.createDataFrame([(1, "Use À", "Retry loops", "current"), (2, "x", "retry\nonly", "stale")], "record_id int, title string, body string, effective_state string")
    assert [r["record_id"] for r in memory.memory_recall(p, "RETRY use")[0].rows.collect()] == [1]
    assert memory.memory_recall(p, "à")[0].rows.count() == 0 and memory.memory_recall(p)[0].rows.count() == 2
    c = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("u", 2, "c")], "task_id string, sequence int, status string")
    assert [tuple(r) for r in memory.latest_checkpoints(c).rows.collect()] == [("t", 2, "b"), ("u", 2, "c")] and [r[0] for r in memory.sequence_gaps(c).collect()] == ["u"]


def test_manifests(spark):
    m = lambda **kw: spark.createDataFrame([(k, v) for k, v in kw.items()], "path string, content_digest string")
    d, n = manifests.reconcile(m(a="1", b="2", c="3"), m(a="1", b="9", d="4"), spark.createDataFrame([("b",), ("b",), ("zz",)], "path string"))
    assert {(r["path"], r["change"]) for r in d.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")} and tuple(n.first()) == (3, 1, 1)
    k = lambda df, kind="file": df.withColumn("file_kind", F.lit(kind))
    out = manifests.change_manifest(k(m(a="1", b="2", c="3", l="5")), k(m(a="1", b="9", d="4", e="5")).unionAll(k(m(l="5"), "link")), m(d="").select("path"))
    assert [tuple(r) for r in out.collect()] == [("b", "modified"), ("c", "deleted"), ("d", "added"), ("e", "untracked"), ("l", "type_changed")]
    for index, state in (("x", "aligned"), ("y", "stale"), (None, "absent")):
        assert tuple(manifests.change_review(out, index, "x")[1].first()) == (5, 1, 1, 1, 1, 1, state)
    hints = spark.createDataFrame([("a",), ("a",), ("bcd",)], "path string")
    assert [tuple(manifests.hint_batch(hints, *x).first()) for x in ((2, 4), (1, 9), (9, 3))] == [(2, 3, 4, False), (2, 3, 4, True), (2, 3, 4, True)]


def test_retention(spark):
    g = spark.createDataFrame([("s", i, i, "retained") for i in range(1, 8)] + [("s", 8, 8, "active"), ("t", 20, 1, "retained")], "slot string, generation_id int, epoch int, state string")
    roots = [spark.createDataFrame([(2,)], "generation_id int")]
    pins = spark.createDataFrame([(3,), (None,)], "generation_id int")
    assert [r["generation_id"] for r in retention.retention_plan(g, roots, pins).collect()] == [1, 4, 5]
    assert [r["generation_id"] for r in retention.retention_plan(g, [], budget=2).collect()] == [1, 2]


def test_context(spark):
    c = spark.createDataFrame([("p1", "precise_overlay", 0, 2), ("p2", "precise_overlay", 1, 2), ("s1", "syntax", 0, 2), ("m1", "memory", 0, 2), ("m2", "memory", 1, 2), ("s1", "structural", 0, 1)], "identity string, tier string, rank int, units int")
    items, omitted, used = context.evidence_context(c, 12, {"identity": "a", "rank": 0, "units": 2})
    assert [i["identity"] for i in items] == ["a", "p1", "s1", "m1", "p2", "m2"] and used == 12 and not omitted
    items, omitted, used = context.evidence_context(c, 7)
    assert [i["identity"] for i in items] == ["p1", "s1", "m1"] and omitted == {"precise_overlay": 1, "memory": 1}
    pack = spark.createDataFrame([("a", "source", 1, 5, None), ("b", "memory", 1, 1, "stale"), ("c", "source", 2, 9, None), ("d", "source", 3, 2, None)], "identity string, provider string, rank int, units int, state string")
    items, omitted, used = context.context_pack(pack.fillna("current", ["state"]), 8)
    assert [i["identity"] for i in items] == ["a", "d"] and omitted == {"not_current": 1, "budget": 1}
