"""Sources, extractors, publication and streaming on temporary folders."""

import subprocess

import pytest
from pyspark.sql import functions as F

from loomspan.operators.retention import repeated_keys, violations
from loomspan.plans.catalog import Catalog, allowed
from loomspan.sources import extract, files, scip
from loomspan.streaming.reconciliation import Reconciler, Schedule


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "r"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("import os\n\n\nclass A:\n    def run(self):\n        return os.path.join('é', 'x')\n\n\ndef main():\n    A().run()\n")
    (root / "src" / "b.rs").write_text("use crate::m::go as g;\nmod m {\n    pub fn go() { helper(1); }\n    struct W;\n    impl W { fn run(&self) { self.x(); println!(\"}\"); } }\n}\n// fn no() {}\n#[test]\nfn t() { m::go(); }\n")
    (root / "src" / "c.go").write_text('package c\nimport "fmt"\ntype T struct{}\nfunc (t *T) Do() { fmt.Println("x") }\nfunc main() { local() }\n')
    (root / "src" / "d.ts").write_text("import { x } from 'y';\nexport class K { m() { return call(x); } }\nconst v = 1;\n")
    (root / "README.md").write_text("hi")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "src"), git("commit", "-qm", "one")
    return root


def test_git(spark, repo):
    assert [r["path"] for r in files.git_paths(spark, str(repo)).collect()] == ["README.md", "src/a.py", "src/b.rs", "src/c.go", "src/d.ts"]
    assert files.git_paths(spark, str(repo), cached=True).count() == 4
    before = files.source_state(str(repo))
    (repo / "README.md").write_text("more")
    (repo / "new").write_text("x")
    after = files.source_state(str(repo))
    assert before["head"] == after["head"] and before["status_digest"] != after["status_digest"]
    assert files.git_commits(spark, str(repo)).first()["parent"] is None
    assert files.resolve_selector(str(repo), revision=before["head"]) == before["head"] and files.resolve_selector(str(repo)) is None
    with pytest.raises(ValueError):
        files.resolve_selector(str(repo), ref="HEAD~1")


def test_extract(spark, repo):
    tree = files.read_tree(spark, str(repo), packages=["src"]).cache()
    assert {r["path"]: r["language"] for r in tree.collect()} == {"src/a.py": "python", "src/b.rs": "rust", "src/c.go": "go", "src/d.ts": "typescript"}
    got = {(r["path"][-1], r["kind"], r["qualified_name"]) for r in extract.facts(tree).collect()}
    assert {("y", "class", "A"), ("y", "method", "A::run"), ("y", "function", "main")} <= got
    assert {("s", "module", "m"), ("s", "function", "m::go"), ("s", "struct", "m::W"), ("s", "method", "m::W::run"), ("s", "function", "t")} <= got and not any("no" in x[2] for x in got)
    assert {("o", "struct", "c::T"), ("o", "method", "c::T::Do"), ("o", "function", "c::main"), ("s", "class", "K"), ("s", "method", "K::m"), ("s", "variable", "v")} <= got
    sites = {(r["path"][-1], r["site_kind"], r["raw_target"], r["enclosing"]) for r in extract.sites(tree).collect()}
    assert {("y", "import", "os", None), ("y", "call", "os.path.join", "A::run"), ("s", "import", "crate::m::go as g", None), ("s", "call", "helper", "m::go"), ("s", "macro_call", "println", "m::W::run"), ("s", "test_marker", "test", "t"), ("s", "call", "m::go", "t"), ("s", "call", "call", "K::m"), ("o", "import", "fmt", None), ("o", "call", "fmt.Println", "c::T::Do"), ("s", "import", "y", None)} <= sites
    digests = extract.name_elided_digests(extract.facts(tree).where("name = 'main'"), tree)
    assert digests.select("declaration").distinct().count() == 2
    run = extract.facts(tree).where("qualified_name = 'A::run'").first()
    raw = (repo / "src" / "a.py").read_bytes()
    assert raw[run["name_start"] : run["name_end"]] == b"run" and raw[run["decl_start"] : run["decl_end"]].startswith(b"def run")
    assert extract.extract("def (", "python").errors == 1 and extract.extract(None, "rust").facts == []


TS = """namespace Api {
  export interface Client { fetch(): Promise<void> }
  export abstract class Base { abstract run(): void }
  export class Service extends Base { run(): void {} async stop(){} private x = build(2)
    get y(): number { return this.x } }
  export enum Mode { Fast, Safe }
  export type Identifier = string
  export function build(): Service { return new Service() }
  export function* stream(): Generator<number> { yield 1 }
  export const Component = () => new Service(), Other = 2
  export const { skipped } = { skipped: true }
  function outer(): void { const local = 1 }
  if (true) { const block = 3 }
}
for (const loop of []) { let body = 5 }
declare function declared(value: string): void
const o = { m() { call(1) } }
"""


def test_typescript():
    found = extract.extract(TS, "typescript")
    got = [f[:3] for f in found.facts]
    names = lambda kind: [q for k, _, q in got if k == kind]
    assert names("module") == ["Api"] and names("interface") == ["Api::Client"] and names("enum") == ["Api::Mode"] and names("type_alias") == ["Api::Identifier"]
    assert names("class") == ["Api::Base", "Api::Service"] and names("function") == ["Api::build", "Api::stream", "Api::outer", "declared"]
    assert names("method") == ["Api::Client::fetch", "Api::Base::run", "Api::Service::run", "Api::Service::stop", "Api::Service::y", "o::m"]
    assert names("variable") == ["Api::Component", "Api::Other", "o"]
    assert [(s[1], s[4]) for s in found.sites if s[0] == "call"] == [("build", "Api::Service"), ("Service", "Api::build"), ("Service", "Api::Component"), ("call", "o::m")]
    assert all(TS.encode()[f[3] : f[4]].decode() == f[1] for f in found.facts) and not found.errors
    assert extract.extract("class A { m( { }", "typescript").errors > 0


def test_rust_sites():
    text = "use a::b;\nfn go(x: u8) -> Thing { helper(1); let y = a.b; Widget { x: other }; f::<T>(y) }\n#[cfg(test)]\nmod t { const fn c() {} }\n#[derive(Debug)]\nstruct S { f: Field }\n"
    found = extract.extract(text, "rust")
    sites = [(s[0], s[1], s[4], s[6]) for s in found.sites]
    assert [(s[0], s[1]) for s in sites] == [("import", "a::b"), ("reference", "Thing"), ("call", "helper"), ("reference", "a.b"), ("reference", "Widget"), ("reference", "other"), ("call", "f::<T>"), ("reference", "y"), ("test_marker", "test"), ("reference", "Field")]
    assert ("test_marker", "test", "t", "syntax_heuristic") in sites and ("call", "helper", "go", "direct_syntax") in sites
    assert [f[2] for f in found.facts] == ["go", "t", "t::c", "S"]


def test_go_declarations():
    text = "package c\ntype T struct{ a int }\ntype I interface { M() }\ntype N int\ntype Al = N\nconst (\n  A = 1\n  B = 2\n)\nvar v = func() { var local = 1 }\nfunc (t *T) Do() { x(1) }\n"
    found = extract.extract(text, "go")
    assert [f[:3:2] for f in found.facts] == [("struct", "c::T"), ("interface", "c::I"), ("defined_type", "c::N"), ("type_alias", "c::Al"), ("constant", "c::A"), ("constant", "c::B"), ("variable", "c::v"), ("method", "c::T::Do")]
    assert [s[1] for s in found.sites] == ["x"]


def test_extractors_take_time_as_files_grow():
    import time

    for lang, line in (("rust", "fn f%d() { g(a.b, c); }\n"), ("typescript", "export class A%d { m(x: number) { return g(x) } }\n"), ("go", "func F%d() { g(1) }\n")):
        began = time.time()
        assert len(extract.extract("".join(line % i for i in range(20_000)), lang).facts) >= 20_000
        assert time.time() - began < 15
    assert extract.extract("x = " + "-" * 50_000 + "1", "python").facts == []
    assert len(extract.extract("def f():\n" + "".join(" " * (i + 1) + f"if x:\n" for i in range(60)) + " " * 61 + "g()\n", "python").sites) == 1


def test_contained_read(tmp_path):
    root = tmp_path / "c++ (a)"
    (root / "d").mkdir(parents=True)
    (root / "d" / "f").write_bytes(b"abc")
    assert files.read_contained(str(root), "d/f")[0] == b"abc"
    (root / "link").symlink_to(root / "d" / "f")
    (root / "folder").symlink_to(root / "d")
    (root / "hard").hardlink_to(root / "d" / "f")
    (root / "d" / "big").write_bytes(b"x" * 11)
    for bad in ("link", "folder/f", "hard", "../x", "/etc/passwd", "d", "none", "", "d/f"):
        with pytest.raises((ValueError, FileNotFoundError)):
            files.read_contained(str(root), bad)
    with pytest.raises(ValueError, match="over"):
        files.read_contained(str(root), "d/big", 10)


def test_tree_of_any_name(spark, tmp_path):
    root = tmp_path / "c++ (a)%20 b"
    root.mkdir()
    (root / "x y.rs").write_text("fn a() {}")
    (root / "big.rs").write_text("fn b() {}" * 9)
    assert [r["path"] for r in files.read_tree(spark, str(root), max_bytes=20).collect()] == ["x y.rs"]
    assert [tuple(r) for r in files.omitted_files(spark, str(root), max_bytes=20).collect()] == [("big.rs", 81, "over_max_bytes")]


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(n, value):
    return _varint(n << 3) + _varint(value) if isinstance(value, int) else _varint(n << 3 | 2) + _varint(len(value)) + value


def test_index_files(spark, tmp_path):
    occ = _field(1, b"".join(map(_varint, (0, 3, 6)))) + _field(2, b"sym") + _field(3, 1)
    rel = _field(1, b"other") + _field(2, 1) + _field(3, 1)
    doc = _field(1, b"src/a.rs") + _field(2, occ) + _field(3, _field(1, b"sym") + _field(4, rel)) + _field(6, 1)
    (tmp_path / "i.scip").write_bytes(_field(1, b"meta") + _field(2, doc))
    o, r = scip.read_index(spark, str(tmp_path))
    assert tuple(o.first()) == ("src/a.rs", 0, 0, "sym", 1, [0, 3, 6], 1) and tuple(r.first()) == ("src/a.rs", 0, 0, "sym", "other", 3)
    with pytest.raises(ValueError):
        list(scip.fields(b"\x0a\x05ab"))
    text = "a\n😀é x\n".encode()
    assert scip.span_of(text, [1, 0, 3], 2) == (2, 8) and scip.span_of(text, [1, 0, 2], 3) == (2, 8) and scip.span_of(text, [0, 0, 1, 4], 1) == (0, 6)
    with pytest.raises(ValueError):
        scip.span_of(text, [1, 0, 1], 2)
    for bad, encoding in (([9, 0, 1], 1), ([1, 1, 4], 1), ([0, 0, 1], 0), ([1, 3, 2], 3), ([0], 1)):
        with pytest.raises(ValueError):
            scip.span_of(text, bad, encoding)
    rows = [("a", 0, 0, "s", 1, [1, 0, 3], 2), ("a", 0, 1, "s", 0, [7, 0, 3], 2), ("b", 1, 0, "t", 0, [0, 0, 1], 1)]
    held = spark.createDataFrame([("a", bytearray(text))], "path string, content binary")
    got = {(r["path"], r["occurrence_ordinal"]): (r["start"], r["end"], r["problem"] is None) for r in scip.with_spans(spark.createDataFrame(rows, scip.OCCURRENCES), held).collect()}
    assert got == {("a", 0): (2, 8, True), ("a", 1): (None, None, False), ("b", 0): (None, None, False)}


def test_configuration(spark, tmp_path):
    assert files.resolve_configuration({"max_bytes": 10, "allow_writes": True, "languages": ["rust", "go"]}, {"max_bytes": 20, "allow_writes": False, "languages": ["go"]}) == {"max_bytes": 10, "allow_writes": False, "languages": ["go"]}
    with pytest.raises(ValueError):
        files.resolve_configuration({"other": 1})
    (tmp_path / "c.toml").write_text("max_paths = 5\n")
    assert files.load_configuration(str(tmp_path / "c.toml")) == {"max_paths": 5}
    assert files.workspace_manifest(spark, {"slots": [{"slot": "a", "root": "/x"}]}).count() == 1
    with pytest.raises(ValueError):
        files.workspace_manifest(spark, {"slots": [{"slot": "a", "root": "/x"}] * 2})


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    assert c.pointer("s") is None and c.read("s", "files") is None
    c.stage("s", "g1", {"files": df})
    assert c.unfinished("s") == ["g1"]
    check = lambda t: violations(keys=repeated_keys(t["files"], ["path"]))
    assert c.publish("s", "g1", validators=check) == "published" and c.read("s", "files").count() == 2 and c.read("s", "other") is None
    c.stage("s", "g2", {"files": df.unionAll(df)})
    with pytest.raises(ValueError, match="keys"):
        c.publish("s", "g2", validators=check)
    c.stage("s", "g3", {"files": df.limit(1)})
    assert c.publish("s", "g3", fence=lambda: False) == "changed" and c.pointer("s")["generation"] == "g1"
    assert c.publish("s", "g3") == "published" and c.pointer("s") == {"epoch": 2, "generation": "g3", "previous": "g1", "tables": ["files"]}
    c.stage("t", "h1", {"files": df})
    with pytest.raises(ValueError):
        c.publish_view("v", ["s", "t"])
    c.publish("t", "h1")
    assert c.publish_view("v", ["s", "t"]) == "published" and c.read_view("v", "files").groupBy("slot").count().count() == 2
    assert [tuple(r) for r in c.generations("s").orderBy("epoch").collect()] == [("s", "g1", 1, "retained"), ("s", "g3", 2, "active")]
    plan = spark.createDataFrame([("s", "g1")], "slot string, generation_id string")
    with pytest.raises(ValueError, match="changed"):
        c.apply_retention(plan.limit(0), c.plan_digest(plan))
    for bad in (("s", "g3"), ("t", "h1")):  # active ones
        wrong = spark.createDataFrame([bad], "slot string, generation_id string")
        with pytest.raises(ValueError, match="active"):
            c.apply_retention(wrong, c.plan_digest(wrong))
    assert c.apply_retention(plan, c.plan_digest(plan)) == 1 and [p["generation"] for p in c.history("s")] == ["g1", "g3"]
    assert c.audit() == [{"dropped": [["s", "g1"]]}] and c.generations("s").count() == 1
    with pytest.raises(ValueError):
        c.drop("s", "g3")
    assert c.doctor("s") == {"missing_tables": 0, "epoch_gaps": 0, "broken_chain": 0, "unfinished": 1}
    assert c.unfinished("s", 3_600_000) == [] and c.recover("s", 0) == ["g2"]
    c.backup("s", f"file://{tmp_path}/backup")
    copy = Catalog(spark, f"file://{tmp_path}/backup")
    assert copy.read("s", "files").count() == 1 and copy.pointer("s") == c.pointer("s")
    assert allowed("staging", "x") is False and allowed("ready", "active") and allowed("ready", "failed") and not allowed("active", "failed")


def test_two_writers(spark, tmp_path):
    """Of writers that meet at any step, one gets the epoch, and the pointer is that one's own."""
    from concurrent.futures import ThreadPoolExecutor

    c = Catalog(spark, f"file://{tmp_path}/catalog")
    df = spark.createDataFrame([("a",)], "path string")
    for g in ("a", "b"):
        c.stage("s", g, {"files": df})
    inner = []
    assert c.publish("s", "a", fence=lambda: inner.append(c.publish("s", "b")) or True) == "lost" and inner == ["published"]
    assert c.pointer("s")["generation"] == "b" and c.publish("s", "a", base=0) == "lost" and c.publish("s", "a", base=1) == "published"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: c._put("pointers/t/000000000001.json", {"by": i}), range(32)))
    assert sum(won) == 1 and c._read("pointers/t/000000000001.json") == {"by": won.index(True)}
    assert not [n for n in c._names("pointers/t") if n.endswith(".tmp")]
    c.publish_view("v", ["s"])
    assert c.publish_view("v", ["s"], {"s": 1}) == "changed" and c.publish_view("v", ["s"], {"s": 2}) == "published"


def test_schedule():
    s = Schedule(debounce_ms=100, period_ms=10_000, retries=1)
    assert s.poll(0) == "idle" and not s.begin(0)
    s.observe_dirty(10)
    s.observe_dirty(50)
    assert s.poll(120) == "debouncing" and s.begin(150) and s.poll(160) == "pending"
    s.observe_dirty(170)
    s.complete("published", 200)  # what came meanwhile is still to do
    assert s.begin(300)
    s.complete("changed", 310)
    assert s.poll(300) == "due" and s.regressions == 1 and s.begin(320)
    s.complete("failed", 330)
    assert s.poll(900) == "idle" and s.begin(10_400)
    s.complete("unchanged", 10_500)
    assert s.poll(10_600) == "idle" and s.poll(20_600) == "due"
    with pytest.raises(ValueError):
        s.complete("published", 1)


def test_streaming(spark, tmp_path):
    state = {"now": spark.createDataFrame([("a", "1")], "path string, content_digest string")}
    source = spark.createDataFrame([("a", "2"), ("b", "1")], "path string, content_digest string")
    seen = []

    def publish(diff, batch):
        seen.append((batch, sorted(r["path"] for r in diff.collect())))
        state["now"] = source

    r = Reconciler(lambda: state["now"], lambda: source, publish, max_hints=3)
    spark.createDataFrame([("a",), ("a",), ("q",)], "path string").coalesce(1).write.parquet(f"{tmp_path}/hints")
    stream = lambda: spark.readStream.schema("path string").parquet(f"{tmp_path}/hints")
    r.start(stream(), f"{tmp_path}/state").awaitTermination()
    assert seen == [(0, ["a", "b"])] and r.log[0]["outcome"] == "published" and r.log[0]["duplicates"] == 1 and r.log[0]["unmatched"] == 1
    spark.range(9).select(F.col("id").cast("string").alias("path")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/hints")
    r.start(stream(), f"{tmp_path}/state").awaitTermination()
    assert len(seen) == 1 and r.log[1]["outcome"] == "unchanged" and r.log[1]["full"]
    r(spark.createDataFrame([("a",)], "path string"), 1)
    assert len(r.log) == 2

    def broken(diff, batch):
        raise RuntimeError("no")

    bad = Reconciler(lambda: source.limit(0), lambda: source, broken, retries=1)
    with pytest.raises(RuntimeError):
        bad(spark.createDataFrame([("a",)], "path string"), 0)
    assert bad.log[-1]["outcome"] == "failed"


def test_yaml_records(spark, tmp_path):
    from loomspan.sources import yaml_records as y

    record = {"record_id": "b" * 32, "schema_version": 1, "kind": "decision", "title": 'a "b": c', "body": "line\nline\u00e9 # no comment", "lifecycle": "active", "parents": ["p1"], "introduced_by": [], "invalidated_by": None}
    assert y.parse(y.write(record)) == {k: v for k, v in record.items() if v is not None}
    assert y.parse("a:\n  b: 'it''s'\n  c:\n    - x: 1\n      y: -2\n    - z: null\nd: plain text\n# comment\ne: {}\n") == {"a": {"b": "it's", "c": [{"x": 1, "y": -2}, {"z": None}]}, "d": "plain text", "e": {}}
    for bad in ("a: &x 1", "a: *x", "a: !!str 1", "a: |\n  x", "a: [1]", "a: 1\na: 2", "a:\nb: 1", "a: 1\n  b: 2", "- a", "a: 'x' y'", 'a: "x', "a: b: c", "\ta: 1", "", "a:\n" + "".join("  " * i + "a:\n" for i in range(1, 12)), "a: x #y", "x" * 70_000):
        with pytest.raises(ValueError):
            y.parse(bad)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "good.yaml").write_text(y.write(record))
    (tmp_path / "r" / "bad.yaml").write_text("a: |\n  x")
    (tmp_path / "r" / "kind.yaml").write_text(y.write({**record, "kind": "other"}))
    good, bad = y.read_yaml_records(spark, str(tmp_path / "r"))
    assert [(r["title"], r["body"], r["parents"]) for r in good.collect()] == [(record["title"], record["body"], ["p1"])] and sorted(r["reason"] for r in bad.collect()) == ["kind", "yaml"]
