"""A repository end to end: index, query, change, index again; incremental equals clean."""

import json

import pytest

from loomspan.plans.engine import Engine
from loomspan.sources.memory import import_history, parents_of, read_records, validity_commits


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src" / "lib.rs").write_text("mod net { pub fn parse_url() { helper(); } fn helper() {} }\nfn main() { net::parse_url(); }\n#[test]\nfn t() { main(); }\n")
    (root / "src" / "copy.py").write_text("def main():\n    run()\n")
    (root / "src" / "same.py").write_text("def main():\n    run()\n")
    (root / "README.md").write_text("hi")
    return root


def test_index_and_queries(spark, tree, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/catalog")
    with pytest.raises(LookupError):
        e.code_search("s", "x")
    first = e.index("s", str(tree))
    assert first["outcome"] == "published" and first["analyzed"] == 4 and e.index("s", str(tree))["outcome"] == "unchanged"
    assert [(r["path"], r["name"]) for r in e.code_search("s", "parse_url").rows.collect()] == [("src/lib.rs", "parse_url")]
    assert e.symbol_search("s", "main").receipt.first()["total"] == 3
    assert {r["path"] for r in e.relevant_paths("s", "main").collect()} == {"src/lib.rs", "src/copy.py", "src/same.py"}
    assert e.architecture_map("s")[0].first()["files"] == 4
    assert e.architecture_overview("s")["entry_points"].rows.count() == 3
    assert {r["category"]: r["paths"] for r in e.repository_topology("s").collect()} == {"documentation": 1, "other": 3}
    main = e.symbol_search("s", "main", language="rust").rows.first()
    assert [r["raw_target"] for r in e.outbound_sites("s", main["path"], main["ordinal"]).rows.collect()] == ["net::parse_url"]
    assert e.syntax_site_search("s", "run").rows.count() == 2 and e.test_markers("s")[0].rows.count() == 1
    out = e.graph_trace("s", main["path"], main["ordinal"])
    names = {f"{r['path']}#{r['ordinal']}": r["name"] for r in e.table("s", "facts").collect()}
    assert [(r["depth"], names[r["source"]], names[r["target"]]) for r in out.edges.collect()] == [(1, "main", "parse_url"), (2, "parse_url", "helper")]
    helper = e.graph_search("s", "helper").rows.first()
    assert [(names[r["node"]], r["class"]) for r in e.impact_analyze("s", helper["path"], helper["ordinal"])[0].collect()] == [("parse_url", "directly_connected"), ("main", "directly_connected"), ("t", "directly_connected")]
    assert e.graph_status("s").receipt.first()["availability"] == "available" and e.graph_architecture("s").count() == 3
    assert e.diagnostics("s").first()["incomplete"] == 0

    one = e.symbol_get("s", str(tree), main["path"], main["ordinal"]).first()
    assert bytes(one["source"]).decode() == "fn main() { net::parse_url(); }"
    assert e.symbol_get("s", str(tree), main["path"], main["ordinal"], content_digest="0").count() == 0
    assert e.code_graph_query("s", {"kind": "symbol_search", "name": "helper"}).rows.count() == 1
    assert e.verify("s", str(tree))[1].first()["index_state"] == "aligned" and e.uncovered("s").count() == 0
    assert {r["rows"] for r in e.doctor("s").collect()} == {0}
    items, _, used = e.context("s", "parse_url", 10)
    assert [(i["identity"], i["tier"]) for i in items] == [(f"{main['path']}#1", "syntax"), (f"{main['path']}#2", "references")] and used == 2

    (tree / "src" / "copy.py").write_text("def other():\n    pass\n")
    (tree / "new.go").write_text("package n\nfunc main() {}\n")
    assert [tuple(r) for r in e.changes("s", str(tree)).collect()] == [("new.go", "untracked"), ("src/copy.py", "modified")]
    second = e.index("s", str(tree))
    assert (second["reused"], second["analyzed"]) == (3, 2)
    clean = Engine(spark, f"file://{tmp_path}/clean")
    clean.index("s", str(tree))
    for name in ("facts", "sites", "files", "resolutions", "candidates", "edges", "postings", "document_stats", "topology"):
        cols = sorted(e.table("s", name).columns)
        rows = lambda x, n=name, c=cols: sorted(map(str, x.table("s", n).select(*c).collect()))
        assert rows(e) == rows(clean), name
    assert e.rebuild_search("s") == "published" and e.code_search("s", "other").rows.count() == 1
    assert len(e.catalog.history("s")) == 3 and e.verify("s", str(tree))[1].first()["index_state"] == "aligned"
    (tree / "big.py").write_text("x = 1\n" * 50)
    third = e.index("s", str(tree), max_bytes=200)
    assert third["omitted"] == 1 and e.table("s", "omitted").first()["path"] == "big.py" and e.symbol_search("s", "main").receipt.first()["total"] == 3
    assert e.publish_view("v", ["s"]) == "published" and e.view("v", "files").count() == 5
    plan, digest = e.retention_plan(["s"], keep=1)
    assert e.retention_apply(plan, digest) == 2 and e.catalog.generations("s").count() == 2
    with pytest.raises(ValueError):
        e.retention_apply(plan.limit(1), digest)
    found = e.cross_repository_search(["s", "s"], "main", 2)
    assert found.rows.count() == 2 and [tuple(r)[1:] for r in found.receipts.collect()] == [("partial", 3, 2, None)]


def test_precise_index(spark, tmp_path):
    """An index file for a generation: spans, derived edges, reads, and what is refused."""
    from .test_sources_and_catalog import _field, _varint

    root = tmp_path / "tree"
    root.mkdir()
    text = "fn outer() {\n    inner();\n}\nfn inner() {}\n"
    (root / "a.rs").write_text(text)
    occ = lambda r, symbol, roles: _field(2, _field(1, b"".join(map(_varint, r))) + _field(2, symbol) + _field(3, roles))
    rel = _field(3, _field(1, b"outer()") + _field(4, _field(1, b"Trait") + _field(3, 1)))
    doc = lambda path, *more: _field(2, _field(1, path) + occ((0, 3, 8), b"outer()", 1) + occ((1, 4, 9), b"inner()", 0) + occ((3, 3, 8), b"inner()", 1) + rel + b"".join(more) + _field(6, 1))
    (tmp_path / "good.scip").write_bytes(doc(b"a.rs"))
    (tmp_path / "other.scip").write_bytes(doc(b"b.rs"))
    (tmp_path / "outside.scip").write_bytes(doc(b"a.rs", occ((9, 0, 1), b"x", 0)))
    e = Engine(spark, f"file://{tmp_path}/catalog")
    with pytest.raises(LookupError):
        e.scip_import("s", str(tmp_path / "good.scip"), str(root))
    e.index("s", str(root))
    for bad in ("other", "outside"):
        with pytest.raises(ValueError):
            e.scip_import("s", str(tmp_path / f"{bad}.scip"), str(root))
    with pytest.raises(LookupError):
        e.scip_evidence("s", "inner()")
    assert e.scip_import("s", str(tmp_path / "good.scip"), str(root)) == {"outcome": "published", "documents": 1, "occurrences": 3, "relationships": 2}
    o, r = e.scip_evidence("s", "inner()")
    assert [(x["start"], x["end"]) for x in o.rows.collect()] == [(17, 22), (31, 36)] and text[17:22] == text[31:36] == "inner"
    assert [(x["source_symbol"], x["evidence"], x["direction"]) for x in r.rows.collect()] == [("outer()", "enclosed_reference", "incoming")]
    assert e.scip_symbol_resolve("s", "a.rs", 17, 22).first()["symbol"] == "inner()"
    t, state, open_ = e.scip_relationship_trace("s", "outer()")
    assert sorted(x["target"] for x in t.edges.collect()) == ["Trait", "inner()"] and state == "available" and not open_
    (root / "a.rs").write_text(text + "fn more() {}\n")
    e.index("s", str(root))
    with pytest.raises(LookupError):  # made for the generation before
        e.scip_evidence("s", "inner()")


def test_memory_store(spark, tmp_path):
    from loomspan.plans.memory_store import MemoryStore

    store = MemoryStore(spark, f"file://{tmp_path}/memory")
    line = lambda title, parents=(), kind="decision": json.dumps({"record_id": "a" * 32, "schema_version": 1, "kind": kind, "title": title, "body": "why", "lifecycle": "active", "parents": list(parents), "introduced_by": ["c1"], "invalidated_by": []})

    def read(*lines):
        (tmp_path / "m.jsonl").write_text("\n".join(lines))
        got = read_records(spark, str(tmp_path / "m.jsonl"))[0]
        return spark.createDataFrame(got.collect(), got.schema)

    first = read(line("one"))
    a = first.first()["revision"]
    ev = spark.createDataFrame([("a" * 32, a, 0, "f", "function", "go", "m::go", "m", "d1", "e1")], "record_id string, revision string, evidence_ordinal int, path string, kind string, name string, qualified_name string, container string, declaration string, name_elided string")
    assert store.write(first, ev, at=1) == {"written": 1, "known": 0} and store.write(first, at=2) == {"written": 0, "known": 1}
    assert store.heads().count() == 0  # not approved yet
    assert store.approve(first, at=3) == {"approved": 1, "known": 0} and store.approve(first, at=4) == {"approved": 0, "known": 1}
    with pytest.raises(ValueError, match="unknown"):
        store.approve(spark.createDataFrame([("a" * 32, "zz")], "record_id string, revision string"))
    with pytest.raises(ValueError, match="head"):
        store.sync(read(line("fork")))
    second = read(line("two", [a]))
    assert store.sync(second, at=5)["written"] == 1
    store.approve(second, at=6)
    assert store.heads().first()["revision"] == second.first()["revision"] and [r["display_revision"] for r in store.read("audit").where("operation = 'locally_approved'").orderBy("event_id").collect()] == [1, 2]
    facts = spark.createDataFrame([("f", 0, "function", "go", "m::go", "m", "d1", "e1")], "path string, ordinal int, kind string, name string, qualified_name string, container string, declaration string, name_elided string")
    checks = spark.createDataFrame([("a" * 32, "introduced_by", "ancestor")], "record_id string, side string, ancestry string")
    moves = spark.createDataFrame([], "old_path string, new_path string")
    with pytest.raises(LookupError):
        store.recall("g1")
    late = lambda: store.approve(read(line("three")), at=9) and True
    store.write(read(line("three")), at=8)
    assert store.revalidate(facts, moves, checks, "g1", fence=lambda: False) == "changed"
    assert store.revalidate(facts, moves, checks, "g1") == "published"
    rows, states = store.recall("g1", "TWO")
    assert [r["effective_state"] for r in rows.rows.collect()] == ["current"] == [r["effective_state"] for r in states.collect()]
    with pytest.raises(LookupError):
        store.recall("g2")
    inner = []
    assert store.revalidate(facts, moves, checks, "g1", fence=lambda: bool(inner.append(store.revalidate(facts, moves, checks, "g1"))) or True) == "lost" and inner == ["published"]
    assert late() and store.heads().first()["outcome"] == "conflicted"
    store.review("a" * 32, a, 0, "confirmed", ("f", 0), at=10)
    with pytest.raises(ValueError):
        store.review("a" * 32, a, 7, "confirmed")
    assert {r["entry"] for r in store.history().collect()} == {"observation", "correspondence"}
    assert [store.checkpoint("t", s, at=1) for s in ("open", "done")] == [1, 2] and store.verify("t", "x", "passed", at=2) == 2
    assert store.task("t") == {"task_id": "t", "sequence": 2, "status": "done", "verifications": 1} and store.task("u") is None
    assert [store.note("me", "r", "n", x, "", at=i) for i, x in enumerate("ab")] == [1, 2] and [r["title"] for r in store.notes("me", "r").collect()] == ["b"] and store.notes("you", "r").count() == 0
    assert {r["rows"] for r in store.problems().collect()} == {0}


def test_diagnostics_count_parse_errors(spark, tree, tmp_path):
    (tree / "src" / "broken.py").write_text("def main(:\n    run()\n")
    e = Engine(spark, f"file://{tmp_path}/catalog")
    e.index("s", str(tree))
    for _ in range(2):  # the second generation reuses the analysis of the broken file
        d = e.diagnostics("s").first()
        assert (d["incomplete"], d["syntax_errors"], d["files_with_errors"]) == (0, 1, 1)
        (tree / "src" / "new.py").write_text("def other():\n    pass\n")
        e.index("s", str(tree))
    assert e.diagnostics("s").first()["files"] == 6


def test_memory_records(spark, tmp_path):
    good = {"record_id": "a" * 32, "schema_version": 1, "kind": "decision", "title": "Use X", "body": "Because", "lifecycle": "active", "parents": ["b", "a", "b"], "introduced_by": ["c1"], "invalidated_by": []}
    lines = [json.dumps(good), json.dumps({**good, "parents": ["a", "b"]}), json.dumps({**good, "title": "é" * 129}), json.dumps({**good, "kind": "other"}), "{not json"]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    records, rejected = read_records(spark, str(tmp_path / "m.jsonl"))
    rows = records.collect()
    assert len(rows) == 2 and rows[0]["revision"] == rows[1]["revision"] and sorted(r["reason"] for r in rejected.collect()) == ["kind", "record_id", "title"]
    assert parents_of(records).count() == 4 and validity_commits(records).count() == 2
    commits = spark.createDataFrame([("c1", None, 5), ("c2", "c1", 9)], "commit string, parent string, at_ms long")
    trees = spark.createDataFrame([("c1", "r", "v1"), ("c2", "r", "v1"), ("c2", "r", "v2")], "commit string, record_id string, revision string")
    assert [(r["revision"], r["recorded_at"]) for r in import_history(commits, trees).collect()] == [("v1", 5), ("v2", 9)]


def test_analyses_are_shared_by_generations_and_slots(spark, tree, tmp_path):
    """A changed file writes its own analysis only; another slot of the same tree writes none; the sweep leaves what is listed."""
    e = Engine(spark, f"file://{tmp_path}/catalog")
    rows = lambda: [spark.read.parquet(f"{e.analyses.log.root}/{f}").count() for f in e.analyses.log.snapshot().folders("digests")]
    first = e.index("s", str(tree))
    (tree / "src" / "more.py").write_text("def fresh():\n    pass\n")
    assert e.index("s", str(tree))["analyzed"] == 1 and e.index("t", str(tree))["analyzed"] == 0
    contents = first["analyzed"] - 1  # two files are equal
    assert rows() == [contents, 1]
    facts = sorted(map(tuple, e.table("s", "facts").select("path", "ordinal", "name").collect()))
    assert facts == sorted(map(tuple, e.table("t", "facts").select("path", "ordinal", "name").collect())) and ("src/more.py", 0, "fresh") in [(p, o, n) for p, o, n in facts if n == "fresh"]
    (tree / "src" / "more.py").unlink()
    e.index("s", str(tree))
    assert e.sweep()["dead"] == 0  # the other slot, and generations that are retained, still list it
    e.index("t", str(tree))
    for s in "st":
        for g in e.catalog._names(f"generations/{s}"):
            if g != e.catalog.pointer(s)["generation"]:
                e.catalog.drop(s, g)
    assert e.sweep(0)["dead"] == 1 and rows() == [contents]
    assert e.table("s", "facts").where("name = 'fresh'").count() == 0 and e.table("s", "facts").count() == len(facts) - 1
