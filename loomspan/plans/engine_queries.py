"""Queries that run sources, the catalog, the engine and the memory store on data derived from the supplied tables, each with
the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import json
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from ..functions.digests import frame_digest
from ..functions.text import language_of
from ..operators import ancestry as ancestry_
from ..operators import architecture as arch
from ..operators import context, graph, manifests, memory, overlay, retention, search, trace
from ..operators.results import within_bytes
from ..operators.shared import scratch, spread, written
from ..sources import extract, files, scip
from ..sources import memory as records
from ..sources import yaml_records as yaml
from ..streaming.reconciliation import Reconciler, Schedule
from . import merkle
from .adapter import EDGES_SQL, VIEWS, frame, table, tree_edges, with_views
from .analysis_store import AnalysisStore
from .catalog import Catalog
from .engine import Engine
from .memory_store import MemoryStore
from .queries import _DIFF, _SEARCH, ORACLES, WORD, _manifests, query


def sql(spark, d, text, *tables):
    """The same SQL in Spark: over the tables as temporary views."""
    for t in tables:
        table(spark, d, t).createOrReplaceTempView(f"loomspan_{t}")
        text = text.replace(f"FROM {t}", f"FROM loomspan_{t}").replace(f"JOIN {t}", f"JOIN loomspan_{t}")
    return spark.sql(text.replace("VARCHAR", "STRING"))


# --- sources


def _repository(spark, d, folder):
    """Suppliers as files of a repository: two in three in its index, the others not; those of names with a 7 at the end ignored."""
    for r in table(spark, d, "supplier").select("s_suppkey").collect():
        k = r[0]
        p = Path(folder, "ignored" if k % 10 == 7 else f"src{k % 3}", f"s{k}.rs")
        p.parent.mkdir(exist_ok=True)
        p.write_text(f"fn s{k}() {{}}\n")
    Path(folder, ".gitignore").write_text("ignored/\n")
    git = lambda *a: subprocess.run(["git", "-C", folder, "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".gitignore", *(x for x in ("src0", "src1") if Path(folder, x).is_dir()))
    git("commit", "-qm", "one")


_PATHS = "SELECT 'src' || CAST(s_suppkey % 3 AS VARCHAR) || '/s' || CAST(s_suppkey AS VARCHAR) || '.rs' AS path FROM supplier WHERE s_suppkey % 10 <> 7"


@query(f"{_PATHS} UNION ALL SELECT '.gitignore'")
def git_discovery(spark, d):
    with tempfile.TemporaryDirectory() as folder:  # Git runs on the driver only
        _repository(spark, d, folder)
        return files.git_paths(spark, folder).select("path")


@query(f"{_PATHS} AND s_suppkey % 3 <> 2 UNION ALL SELECT '.gitignore'")
def git_cached_discovery(spark, d):
    with tempfile.TemporaryDirectory() as folder:
        _repository(spark, d, folder)
        return files.git_paths(spark, folder, cached=True).select("path")


@query("SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'index,status' ELSE 'head,index,status' END AS changed FROM region")
def source_state(spark, d):
    """What of a repository's state a change moves: a new file, one added to the index, one committed."""
    out = []
    with tempfile.TemporaryDirectory() as folder:
        git = lambda *a: subprocess.run(["git", "-C", folder, "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
        git("init", "-q")
        Path(folder, "first").write_text("x")
        git("add", "first")
        git("commit", "-qm", "first")
        for (k,) in table(spark, d, "region").select("r_regionkey").orderBy("r_regionkey").collect():
            before = files.source_state(folder)
            Path(folder, f"f{k}").write_text("x")
            if k % 3:
                git("add", f"f{k}")
            if k % 3 == 2:
                git("commit", "-qm", "more")
            after = files.source_state(folder)
            out.append((k, ",".join(n for n in ("head", "index", "status") if any(before[x] != after[x] for x in (n, f"{n}_digest") if x in before))))
    return spark.createDataFrame(out, "r_regionkey int, changed string")


@query("SELECT s_suppkey, sha256(s_name || chr(10)) AS content_digest, CAST(strlen(s_name) + 1 AS BIGINT) AS size FROM supplier")
def tree_read(spark, d):
    out = scratch(spark, "tree")
    names = spread(table(spark, d, "supplier").select("s_suppkey", "s_name"))  # a file each: much work for few bytes
    names.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").text(out)  # tasks move their files, not the driver
    read = files.read_tree(spark, out, glob="part-*")
    return read.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"), "content_digest", "size")


@query("SELECT s_suppkey, sha256(s_name) AS content_digest FROM supplier")
def contained_read(spark, d):
    with tempfile.TemporaryDirectory() as folder:
        for k, name in table(spark, d, "supplier").select("s_suppkey", "s_name").collect():
            Path(folder, f"f{k}").write_text(name)
        rows = [(int(p.name[1:]), files.read_contained(folder, p.name)[1]) for p in Path(folder).iterdir()]
    return spark.createDataFrame(rows, "s_suppkey long, content_digest string")


@query(with_views("files", then="SELECT path, language FROM files"))
def language_sniff(spark, d):
    return frame(spark, d, "files").select("path", language_of(F.col("path")).alias("language"))


_K = "CAST(p_partkey AS VARCHAR)"
_N = f"replace(p_name, ' ', '_') || {_K}"
#: By language: a part's source text, and the facts and sites that it holds: (kind, name, qualified name), (kind, target, enclosing).
SOURCES = {
    "rust": (
        f"'#[test]\nfn ' || {_N} || '() {{ helper(1); let x = other.y; }}\nstruct S' || {_K} || ';\nimpl S' || {_K} || ' {{ fn run(&self) {{ println!(\"a\"); }} }}\nuse a::b;\n'",
        [("function", _N, _N), ("struct", f"'S' || {_K}", f"'S' || {_K}"), ("method", "'run'", f"'S' || {_K} || '::run'")],
        [("test_marker", "'test'", _N), ("call", "'helper'", _N), ("reference", "'other.y'", _N), ("reference", f"'S' || {_K}", "NULL"), ("macro_call", "'println'", f"'S' || {_K} || '::run'"), ("import", "'a::b'", "NULL")],
    ),
    "go": (
        f"'package p\nimport \"fmt\"\nfunc ' || {_N} || '() {{ fmt.Println(1) }}\ntype S' || {_K} || ' struct {{ a int }}\nfunc (s *S' || {_K} || ') Run() {{ var local = 1 }}\nconst C = 1\n'",
        [("function", _N, f"'p::' || {_N}"), ("struct", f"'S' || {_K}", f"'p::S' || {_K}"), ("method", "'Run'", f"'p::S' || {_K} || '::Run'"), ("constant", "'C'", "'p::C'")],
        [("import", "'fmt'", "NULL"), ("call", "'fmt.Println'", f"'p::' || {_N}")],
    ),
    "typescript": (
        f"'import {{ x }} from \"y\"\nexport class S' || {_K} || ' {{ run() {{ go(1) }} }}\nexport const v = 1\nfunction ' || {_N} || '() {{ const local = 1 }}\nif (true) {{ let no = 2 }}\ninterface I {{ m(): void }}\n'",
        [("class", f"'S' || {_K}", f"'S' || {_K}"), ("method", "'run'", f"'S' || {_K} || '::run'"), ("variable", "'v'", "'v'"), ("function", _N, _N), ("interface", "'I'", "'I'"), ("method", "'m'", "'I::m'")],
        [("import", "'y'", "NULL"), ("call", "'go'", f"'S' || {_K} || '::run'")],
    ),
    "python": (
        f"'import os\ndef ' || {_N} || '():\n    helper(1)\nclass S' || {_K} || ':\n    def run(self):\n        pass\n'",
        [("function", _N, _N), ("class", f"'S' || {_K}", f"'S' || {_K}"), ("method", "'run'", f"'S' || {_K} || '::run'")],
        [("import", "'os'", "NULL"), ("call", "'helper'", _N)],
    ),
}


def _analysed(spark, d, language):
    """Parts are few bytes and much work: they are dealt to all cores before they become texts."""
    text = spread(table(spark, d, "part").select("p_partkey", "p_name")).selectExpr("p_partkey", f"{SOURCES[language][0]} AS text".replace("VARCHAR", "STRING"))
    return extract.analyses(text.select(F.col("p_partkey").cast("string").alias("path"), F.sha2("text", 256).alias("content_digest"), F.lit(language).alias("language"), F.col("text").cast("binary").alias("content")))


def _facts(language):
    of = " UNION ALL ".join(f"SELECT {_K} AS path, '{kind}' AS kind, {name} AS name, {qualified} AS qualified_name, {i} AS ordinal FROM part" for i, (kind, name, qualified) in enumerate(SOURCES[language][1]))

    def run(spark, d):
        return extract.facts(_analysed(spark, d, language)).select("path", "kind", "name", "qualified_name", "ordinal")

    run.__name__ = f"{language}_facts"
    return query(of)(run)


def _sites(language):
    of = " UNION ALL ".join(f"SELECT {_K} AS path, '{kind}' AS site_kind, {target} AS raw_target, {around} AS enclosing FROM part" for kind, target, around in SOURCES[language][2])

    def run(spark, d):
        return extract.sites(_analysed(spark, d, language)).select("path", "site_kind", "raw_target", "enclosing")

    run.__name__ = f"{language}_sites"
    return query(of)(run)


for _language in SOURCES:
    _facts(_language)
    _sites(_language)


def _byte(x):
    return f"unhex(lpad(hex({x}), 2, '0'))"


def _message(number, of):
    """A length-delimited field of fewer than 128 bytes."""
    return f"concat({_byte(number << 3 | 2)}, {_byte(f'octet_length({of})')}, {of})"


def _index(spark, d):
    """An index file's bytes a supplier: one document, a definition of its name, and a relationship."""
    name = "CAST(s_name AS BINARY)"
    occ = f"concat({_message(1, 'concat(' + _byte(0) + ', ' + _byte(3) + ', ' + _byte('3 + octet_length(s_name)') + ')')}, {_message(2, name)}, {_byte(24)}, {_byte(1)})"
    rel = f"concat({_message(1, _bytes_of('concat(chr(110), s_nationkey)'))}, {_byte(16)}, {_byte(1)}, {_byte(32)}, {_byte('s_suppkey % 2')})"
    info = f"concat({_message(1, name)}, {_message(4, rel)})"
    path = _bytes_of("concat('s', s_suppkey, '.rs')")
    doc = f"concat({_message(1, path)}, {_message(2, occ)}, {_message(3, info)}, {_byte(48)}, {_byte(1)})"
    return spread(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")).selectExpr(f"{_message(2, doc)} AS content")


def _bytes_of(text):
    return f"CAST({text} AS BINARY)"


@query("SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.rs' AS path, s_name AS symbol, 1 AS roles, '0,3,' || CAST(3 + strlen(s_name) AS VARCHAR) AS span FROM supplier")
def scip_read(spark, d):
    return scip.decode(_index(spark, d))[0].select("path", "symbol", "roles", F.array_join(F.col("range").cast("array<string>"), ",").alias("span"))


@query("SELECT s_name AS source_symbol, 'n' || CAST(s_nationkey AS VARCHAR) AS target_symbol, CASE WHEN s_suppkey % 2 = 1 THEN 5 ELSE 1 END AS kinds FROM supplier")
def scip_read_relationships(spark, d):
    return scip.decode(_index(spark, d))[1].select("source_symbol", "target_symbol", "kinds")


@query("SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.rs' AS path, CAST(CASE WHEN s_suppkey % 5 <> 0 THEN 3 ELSE -1 END AS BIGINT) AS start, CAST(CASE WHEN s_suppkey % 5 <> 0 THEN 3 + strlen(s_name) ELSE -1 END AS BIGINT) AS stop, s_suppkey % 5 = 0 AS problem FROM supplier")
def scip_spans(spark, d):
    """Every fifth document is too short for its range."""
    held = table(spark, d, "supplier").selectExpr("concat('s', s_suppkey, '.rs') AS path", "CAST(IF(s_suppkey % 5 = 0, 'fn', concat('fn ', s_name, '() {}')) AS BINARY) AS content")
    return scip.with_spans(scip.decode(_index(spark, d))[0], held).select("path", F.coalesce("start", F.lit(-1)).cast("long").alias("start"), F.coalesce("end", F.lit(-1)).cast("long").alias("stop"), F.col("problem").isNotNull().alias("problem"))


_REL = "SELECT CAST(CASE source WHEN 'r1' THEN 0 ELSE 1 END AS BIGINT) AS document_ordinal, CAST(substr(target, 2) AS BIGINT) + CASE WHEN starts_with(target, 'c') THEN 1000000 ELSE 0 END AS relationship_ordinal, source, target FROM edges"


@query(f"WITH {EDGES_SQL}, rel AS ({_REL}), one AS (SELECT * FROM rel WHERE source = 'r1'), two AS (SELECT r.* FROM rel r WHERE r.source IN (SELECT target FROM one) ORDER BY document_ordinal, relationship_ordinal LIMIT (SELECT 100 - count(*) FROM one)) SELECT 1 AS depth, source, target FROM one UNION ALL SELECT 2, source, target FROM two")
def scip_relationship_trace(spark, d):
    e = tree_edges(spark, d).selectExpr("CAST(IF(source = 'r1', 0, 1) AS BIGINT) AS document_ordinal", "CAST(substr(target, 2) AS BIGINT) + IF(startswith(target, 'c'), 1000000, 0) AS relationship_ordinal", "source AS source_symbol", "target AS target_symbol", "'declared' AS evidence")
    return overlay.scip_relationship_trace(e, "r1")[0].edges.select("depth", "source", "target")


@query("WITH RECURSIVE up AS (SELECT (SELECT max(c_custkey) FROM customer) AS k UNION ALL SELECT k // 2 FROM up WHERE k // 2 > 0) SELECT k AS ancestor FROM up")
def ancestry(spark, d):
    """Customers as commits: the parent of each is half its key."""
    c = table(spark, d, "customer").selectExpr("c_custkey AS commit", "IF(c_custkey > 1, c_custkey DIV 2, NULL) AS parent")
    top = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    return trace.ancestry(c.where("parent is not null"), top)


@query("""WITH n AS (SELECT count(*) AS n FROM customer) SELECT c_custkey AS descendant, c_custkey * 7919 % n + 1 AS ancestor, CASE WHEN c_custkey % 2 = (c_custkey * 7919 % n + 1) % 2 AND c_custkey * 7919 % n + 1 <= c_custkey THEN 'ancestor' WHEN c_custkey % 2 = 1 THEN 'not_ancestor' ELSE 'indeterminate' END AS ancestry FROM customer, n""")
def ancestry_of_pairs(spark, d):
    """Customers as two chains of commits, odd and even keys, the even one without its first commit, which its second names; a pair a customer."""
    c = table(spark, d, "customer")
    n = c.count()
    commits = c.selectExpr("c_custkey AS commit", "IF(c_custkey = 1, NULL, c_custkey - 2) AS parent")
    pairs = c.selectExpr("c_custkey AS descendant", f"c_custkey * 7919 % {n} + 1 AS ancestor")
    return ancestry_.ancestry_of_pairs(commits, pairs)


@query("SELECT o_custkey AS record_id, o_orderpriority AS revision, min(o_orderkey) AS recorded_at FROM orders GROUP BY 1, 2")
def history_import(spark, d):
    o = table(spark, d, "orders")
    commits = o.selectExpr("o_orderkey AS commit", "o_orderkey AS at_ms")
    return records.import_history(commits, o.selectExpr("o_orderkey AS commit", "o_custkey AS record_id", "o_orderpriority AS revision")).select("record_id", "revision", "recorded_at")


@query("SELECT CASE WHEN conv_id % 7 = 0 THEN 'record_id' WHEN turn % 5 = 3 THEN 'schema_version' WHEN role = 'system' THEN 'kind' WHEN strlen(role || '/' || text) > 256 THEN 'title' WHEN strlen(text) > 16384 THEN 'body' END AS reason, count(*) AS n FROM conversations GROUP BY 1")
def record_validation(spark, d):
    """Turns of conversations as records: some without an id, of another schema, of no kind, or too long."""
    out = scratch(spark, "records")
    rows = table(spark, d, "conversations").selectExpr(
        "IF(conv_id % 7 = 0, 'no id', lpad(lower(hex(conv_id * 1000 + turn)), 32, '0')) AS record_id", "IF(turn % 5 = 3, 9, 1 + conv_id % 2) AS schema_version", "IF(role = 'system', 'other', 'finding') AS kind", "concat(role, '/', text) AS title", "text AS body", "'active' AS lifecycle"
    )
    rows.select(F.to_json(F.struct("*"))).write.text(out)
    good, bad = records.read_records(spark, out)
    return good.select(F.lit(None).cast("string").alias("reason")).unionAll(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_YAML = """concat('schema_version: ', 1 + conv_id % 2, char(10), 'record_id: ', lpad(lower(hex(conv_id * 1000 + turn)), 32, '0'), char(10), IF(turn % 4 = 3, concat(char(9), 'kind: x'), IF(turn % 4 = 2, 'kind: [finding]', 'kind: finding')), char(10),
 'title: "t', turn, '"', char(10), 'body: ', char(39), role, char(39), char(10), 'lifecycle: active', char(10), IF(turn > 0, concat('parents:', char(10), '  - "p', turn, '"', char(10), '  - "a"'), 'parents: []'), char(10))"""


@query("SELECT lpad(lower(hex(conv_id * 1000 + turn)), 32, '0') AS record_id, 't' || CAST(turn AS VARCHAR) AS title, role AS body, CASE WHEN turn > 0 THEN 'a,p' || CAST(turn AS VARCHAR) ELSE '' END AS parents FROM conversations WHERE turn % 4 < 2")
def yaml_records(spark, d):
    """Turns of conversations as YAML documents, half of them outside of the subset."""
    good, _ = yaml.parsed(table(spark, d, "conversations").selectExpr(f"{_YAML} AS value"))
    return good.select("record_id", "title", "body", F.array_join("parents", ",").alias("parents"))


@query("SELECT 'max_results' AS setting, CAST(min(n_nationkey + 5) AS VARCHAR) AS value FROM nation UNION ALL SELECT 'allow_writes', CASE WHEN bool_and(n_nationkey < 20) THEN 'true' ELSE 'false' END FROM nation UNION ALL SELECT 'languages', 'rust'")
def configuration(spark, d):
    layers = [{"max_results": k + 5, "allow_writes": k < 20, "languages": ["rust", "go"] if k % 2 else ["python", "rust"]} for (k,) in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    got = files.resolve_configuration(*layers)
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else json.dumps(v)) for k, v in got.items()], "setting string, value string")


@query("SELECT r_name AS slot, '/repositories/' || lower(r_name) AS root FROM region")
def workspace_manifest(spark, d):
    slots = [{"slot": n, "root": f"/repositories/{n.lower()}"} for (n,) in table(spark, d, "region").select("r_name").collect()]
    return files.workspace_manifest(spark, {"slots": slots}).select("slot", "root")


# --- catalog and engine


def _catalog(spark, name):
    return Catalog(spark, scratch(spark, name))


@query(with_views("files", then="SELECT path, language, fact_count FROM files"))
def publish_generation(spark, d):
    """Files as a generation: staged, validated, published behind a fence, and read through the pointer."""
    c, f = _catalog(spark, "generation"), frame(spark, d, "files").drop("doc_id")
    c.stage("s", "g1", {"files": f.limit(3)})
    c.publish("s", "g1")
    c.stage("s", "g2", {"files": f})
    if c.publish("s", "g2", fence=lambda: False) != "changed" or c.publish("s", "g2", base=0) != "lost":
        raise AssertionError("a generation was published in spite of its fence")
    c.publish("s", "g2", base=1, validators=lambda t: retention.violations(paths=retention.repeated_keys(t["files"], ["path"])))
    return c.read("s", "files").select("path", "language", "fact_count")


@query(with_views("files", then="SELECT CASE WHEN language IN ('rust', 'go') THEN 'systems' ELSE 'scripts' END AS slot, path FROM files"))
def publish_view(spark, d):
    c, f = _catalog(spark, "view"), frame(spark, d, "files").drop("doc_id")
    systems = F.coalesce(F.col("language").isin("rust", "go"), F.lit(False))
    for s, of in (("systems", systems), ("scripts", ~systems)):
        c.stage(s, "g1", {"files": f.where(of)})
        c.publish(s, "g1")
    c.publish_view("v", ["systems", "scripts"])
    c.stage("systems", "g2", {"files": f.limit(1)})
    c.publish("systems", "g2")  # the view keeps what it has pinned
    return c.read_view("v", "files").select("slot", "path")


@query(with_views("facts", then="").rstrip() + ORACLES["code_search"][len(with_views("facts", then="").rstrip()) :])
def rebuild_search(spark, d):
    """Search over a generation whose postings have been made again."""
    e, f = Engine(spark, scratch(spark, "search")), frame(spark, d, "facts")
    e.catalog.stage("s", "g1", {"facts": f, "postings": search.postings(f).limit(0), "document_stats": search.document_stats(f).limit(0)})
    e.catalog.publish("s", "g1")
    e.rebuild_search("s")
    return e.code_search("s", "function Bolt").rows.select("path", "ordinal", F.round("rank", 6).alias("rank"))


@query("SELECT 'g' || CAST(n_nationkey AS VARCHAR) AS generation_id, CASE WHEN n_nationkey = (SELECT max(n_nationkey) FROM nation) THEN 'active' ELSE 'retained' END AS state FROM nation WHERE n_nationkey >= (SELECT max(n_nationkey) - 2 FROM nation) OR n_nationkey % 9 = 4")
def retention_apply(spark, d):
    """A generation a nation; all but the active one, two retained and some pinned go by an approved plan."""
    e = Engine(spark, scratch(spark, "retention"))
    keys = [k for (k,) in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    one = table(spark, d, "region")
    for k in keys:
        e.catalog.stage("s", f"g{k}", {"files": one})
        e.catalog.publish("s", f"g{k}")
    plan, digest = e.retention_plan(["s"], pins=[f"g{k}" for k in keys if k % 9 == 4])
    e.retention_apply(plan, digest)
    return e.catalog.generations("s").select("generation_id", "state")


@query('SELECT \'broken_chain\' AS "check", 0 AS rows UNION ALL SELECT \'epoch_gaps\', 0 UNION ALL SELECT \'missing_tables\', 0 UNION ALL SELECT \'unfinished\', count(*) FROM region')
def doctor(spark, d):
    c = _catalog(spark, "doctor")
    for (k,) in table(spark, d, "region").select("r_regionkey").collect():
        c.stage("s", f"abandoned{k}", {"files": table(spark, d, "region")})
    c.stage("s", "g", {"files": table(spark, d, "region")})
    c.publish("s", "g")
    return spark.createDataFrame(sorted(c.doctor("s").items()), "check string, rows long")


@query("SELECT 0 AS batch, 'unchanged' AS outcome, 0 AS differences, count(*) AS hints FROM customer")
def quiet_poll(spark, d):
    """Every customer as a hint, and nothing has changed: nothing is published."""
    m = table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS path", "c_name AS content_digest")

    def publish(diff, batch):
        raise AssertionError("published without a difference")

    r = Reconciler(lambda: m, lambda: m, publish, max_hints=1 << 30, max_bytes=1 << 40)
    r(m.select("path"), 0)
    return spark.createDataFrame([(x["batch"], x["outcome"], x["differences"], x["hints"]) for x in r.log], "batch int, outcome string, differences long, hints long")


@query("SELECT count(DISTINCT user_id) AS paths, count(*) AS hints, count(DISTINCT user_id) > 100 AS \"full\" FROM events")
def hint_overflow(spark, d):
    return manifests.hint_batch(table(spark, d, "events").select(F.col("user_id").cast("string").alias("path")), max_paths=100).select("paths", "hints", "full")


@query("WITH e AS (SELECT (date_diff('millisecond', TIMESTAMP '2024-01-01', date_trunc('second', ts)))::BIGINT AS ms FROM events), g AS (SELECT DISTINCT ms FROM e), n AS (SELECT ms, lead(ms) OVER (ORDER BY ms) AS next FROM g) SELECT count(*) AS runs FROM n WHERE next IS NULL OR next - ms >= 30000")
def reconciliation_schedule(spark, d):
    """The events as hints in time: a run follows each that none follows within the debounce."""
    at = table(spark, d, "events").select((F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))).alias("s")).distinct().orderBy("s").collect()
    s, runs = Schedule(debounce_ms=30_000, period_ms=1 << 60), 0
    for (t,) in at:
        now = int(t) * 1000
        if s.dirty_at is not None and s.begin(now):
            s.complete("published", now)
            runs += 1
        s.observe_dirty(now)
    return spark.createDataFrame([(runs + bool(at),)], "runs long")


_TREES = "WITH b AS (SELECT c_custkey AS k, c_name AS v FROM customer), w AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS k, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_name END AS v FROM customer), j AS (SELECT coalesce(b.k, w.k) AS k, b.v AS bv, w.v AS wv FROM b FULL JOIN w ON b.k = w.k), c AS (SELECT CASE WHEN wv IS NULL THEN 'deleted' WHEN bv IS NULL THEN 'untracked' WHEN bv <> wv THEN 'modified' END AS change FROM j)"


@query(f"{_TREES} SELECT count(change) AS paths, CAST(0 AS BIGINT) AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted, CAST(0 AS BIGINT) AS type_changed, count(*) FILTER (change = 'untracked') AS untracked, 'stale' AS index_state FROM c")
def change_review(spark, d):
    c = table(spark, d, "customer")
    base = c.selectExpr("c_custkey AS path", "c_name AS content_digest", "'file' AS file_kind")
    work = c.selectExpr("IF(c_custkey % 7 = 0, c_custkey + 1000000, c_custkey) AS path", "IF(c_custkey % 3 = 0, 'x', c_name) AS content_digest", "'file' AS file_kind")
    digest = lambda f: frame_digest(f, ["path", "content_digest"]).first()["digest"]
    return manifests.change_review(manifests.change_manifest(base, work, base.select("path").limit(0)), digest(base), digest(work))[1]


_JSON = "'{\"path\":\"' || path || '\",\"language\":\"' || language || '\",\"content_digest\":\"' || content_digest || '\"}'"


@query(with_views("files", then=f""", r AS (SELECT sha256({_JSON}) AS d FROM files), t AS (SELECT count(*) AS n, CASE WHEN count(*) <= 4096 THEN 0 WHEN count(*) <= 65536 THEN 1 WHEN count(*) <= 1048576 THEN 2 ELSE 3 END AS k FROM r),
p AS (SELECT substr(d, 1, k) || sha256(string_agg(d, '' ORDER BY d)) AS d FROM r, t WHERE k > 0 GROUP BY substr(d, 1, k), k), a AS (SELECT d FROM p UNION ALL SELECT d FROM r, t WHERE k = 0)
SELECT (SELECT n FROM t) AS rows, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM a""").replace("\n, r AS", ", r AS"))
def frame_fold(spark, d):
    return frame_digest(frame(spark, d, "files"), ["path", "language", "content_digest"])


@query(with_views("files", then="SELECT path, language FROM files WHERE doc_id % 3 <> 0"))
def complete_files(spark, d):
    """Files whose artifact is complete: every third document's isn't."""
    f = frame(spark, d, "files").withColumn("artifact_digest", F.col("doc_id"))
    arts = f.selectExpr("artifact_digest", "IF(doc_id % 3 = 0, 'staging', 'complete') AS lifecycle_state", "content_digest", "fact_count", "language")
    return arch.complete_files(f.select("path", "content_digest", "artifact_digest"), arts).select("path", "language")


@query(with_views("files", then=", o AS (SELECT path, sum(strlen(path) + 136) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT path FROM files ORDER BY path LIMIT 200)) SELECT path FROM o WHERE used <= 20000").replace("\n, o AS", ", o AS"))
def byte_budget(spark, d):
    rows = arch.architecture_map(frame(spark, d, "files"))[2].rows
    return within_bytes(rows, search.hit_size("path"), 20_000, ["path"]).select("path")


@query(with_views("files", "facts", then="""SELECT 'symbol_search' AS kind, count(*) AS rows FROM facts WHERE name = 'main' UNION ALL SELECT 'syntax_site_search', count(*) FROM lineitem WHERE l_partkey % 100 = 7
UNION ALL SELECT 'architecture_map', count(*) FROM files UNION ALL SELECT 'architecture_overview', count(*) FROM facts WHERE kind = 'function' AND name = 'main' UNION ALL SELECT 'test_markers', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT 'outbound_sites', count(*) FROM lineitem WHERE l_orderkey = 1 AND l_quantity >= 10 AND l_quantity < 40 UNION ALL SELECT 'relevant_paths', least(count(*), 12) FROM (SELECT path FROM (SELECT path, ordinal FROM facts WHERE kind = 'method' ORDER BY 1) GROUP BY 1 LIMIT 12)"""))
def code_graph_query(spark, d):
    """The seven tagged requests; for each the exact number of rows it found."""
    facts = frame(spark, d, "facts")
    sites = frame(spark, d, "sites").withColumns({"start": F.col("start"), "end": F.col("start") + 1})
    by = {"files": frame(spark, d, "files").unionByName(facts.select("path", "language", "content_digest", "artifact_digest").distinct().withColumns({"fact_count": F.lit(0).cast("long"), "doc_id": F.lit(0).cast("long")})), "facts": facts, "sites": sites}
    ask = lambda kind, **args: arch.code_graph_query({"kind": kind, **args}, **by)
    total = lambda b: b.receipt.first()["total"]
    rows = [
        ("symbol_search", total(ask("symbol_search", name="main"))),
        ("syntax_site_search", total(ask("syntax_site_search", raw_target="part7"))),
        ("architecture_map", arch.code_graph_query({"kind": "architecture_map"}, files=frame(spark, d, "files"))[0].first()["files"]),
        ("architecture_overview", total(ask("architecture_overview")["entry_points"])),
        ("test_markers", total(ask("test_markers"))),
        ("outbound_sites", total(ask("outbound_sites", declaration={"artifact_digest": 1, "decl_start": 10, "decl_end": 40}))),
        ("relevant_paths", ask("relevant_paths", query="method").count()),
    ]
    return spark.createDataFrame(rows, "kind string, rows long")


@query(f"{_DIFF} SELECT path, change, before_digest, after_digest FROM j WHERE change <> 'unchanged'")
def merkle_differences(spark, d):
    """The manifests of all orders, before and after, as stored trees."""
    before, after = (scratch(spark, n) for n in ("before", "after"))
    for manifest, folder in zip(_manifests(spark, d), (before, after), strict=True):
        merkle.store(manifest, folder, leaf=256)
    return merkle.differences(spark, before, after)[0]


@query("""WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS a, sha256(coalesce(text, '') || CASE WHEN doc_id % 97 = 5 THEN '!' ELSE '' END) AS b, strlen(coalesce(text, '')) + CASE WHEN doc_id % 97 = 5 THEN 1 ELSE 0 END AS bytes FROM documents)
SELECT t.doc_id, bytes, CAST(CASE WHEN t.b IN (SELECT a FROM t) THEN 2 ELSE 1 END AS INTEGER) AS generations FROM t""")
def shared_analyses(spark, d):
    """Two generations of all documents, the second with every 97th changed: it writes rows of contents that the first hadn't, and
    after the sweep no others are left but those that it shares. Returned: its analyses, and how many generations had each."""
    store = AnalysisStore(spark, scratch(spark, "analyses"))
    text = lambda new: table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when((F.col("doc_id") % 97 == 5) & F.lit(new), "!").otherwise("")).alias("t")).withColumn("artifact_digest", F.sha2("t", 256))
    made = lambda df: df.groupBy("artifact_digest").agg(F.first(F.octet_length("t")).alias("bytes"))
    old, new = text(False), text(True)
    store.add(old, {"sizes": made(old)})
    added, first = store.add(new, {"sizes": made(new)}), store.log.snapshot().folders("sizes")[-1:]
    if added != spark.read.parquet(*[f"{store.log.root}/{f}" for f in first]).count() or added != new.select("artifact_digest").distinct().join(old, "artifact_digest", "left_anti").count():
        raise AssertionError("a generation writes what it alone has")
    by = written(store.references([old, new]).select("artifact_digest", "generations"), "references")
    store.sweep([new], rewrite=0.0)
    if not store.known().join(new, "artifact_digest", "left_anti").isEmpty():
        raise AssertionError("an analysis that no generation lists is left")
    return store.read("sizes", new.select("doc_id", "artifact_digest")).join(by, "artifact_digest").select("doc_id", "bytes", "generations")


# --- memory store


@query("""WITH v AS (SELECT conv_id, turn, role FROM conversations), a AS (SELECT * FROM v WHERE turn % 2 = 0), h AS (SELECT conv_id, count(*) AS heads, min(turn) AS turn FROM a WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn - 2 FROM a WHERE turn > 0) GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS record_id, CAST(turn AS VARCHAR) AS revision FROM h WHERE heads = 1""")
def memory_manage(spark, d):
    """Turns as versions, each even one a child of the even one before: written, approved, written again and approved again."""
    store = MemoryStore(spark, scratch(spark, "memory"))
    c = table(spark, d, "conversations")
    r = c.selectExpr("CAST(conv_id AS STRING) AS record_id", "CAST(turn AS STRING) AS revision", "1 AS schema_version", "'finding' AS kind", "role AS title", "text AS body", "'active' AS lifecycle", "'{}' AS canonical_json", "IF(turn > 0, array(CAST(turn - 2 AS STRING)), CAST(array() AS array<string>)) AS parents", "CAST(array() AS array<string>) AS introduced_by", "CAST(array() AS array<string>) AS invalidated_by")
    even = r.where("CAST(revision AS INT) % 2 = 0")
    store.write(r, at=1)
    store.approve(even, at=2)
    if store.write(r, at=3)["written"] or store.approve(even, at=4)["approved"]:
        raise AssertionError("known versions were taken again")
    return store.heads().where("outcome = 'selected'").select("record_id", "revision")


@query("SELECT CAST(o_custkey AS VARCHAR) AS record_id, CASE WHEN o_custkey % 6 = 0 THEN 'archived' WHEN o_custkey % 5 = 0 THEN 'stale' ELSE 'current' END AS effective_state FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 2 = 0")
def memory_revalidate(spark, d):
    """Customers with orders as records with one piece of evidence each: revalidated against declarations of which every fifth has
    changed, published, and recalled for the generation it was made for."""
    store = MemoryStore(spark, scratch(spark, "memory"))
    k = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    decl = ["concat('f', k) AS path", "'function' AS kind", "concat('n', k) AS name", "concat('m', k, '::n') AS qualified_name", "concat('m', k) AS container"]
    r = k.selectExpr("CAST(k AS STRING) AS record_id", "'1' AS revision", "1 AS schema_version", "'finding' AS kind", "IF(k % 2 = 0, 'even', 'odd') AS title", "'body' AS body", "IF(k % 6 = 0, 'archived', 'active') AS lifecycle", "'{}' AS canonical_json", "CAST(array() AS array<string>) AS parents", "array('c1') AS introduced_by", "CAST(array() AS array<string>) AS invalidated_by")
    store.write(r, k.selectExpr("CAST(k AS STRING) AS record_id", "'1' AS revision", "0 AS evidence_ordinal", *decl, "concat('d', k) AS declaration", "concat('e', k) AS name_elided"), at=1)
    store.approve(r, at=2)
    facts = k.selectExpr(*decl, "0 AS ordinal", "IF(k % 5 = 0, 'changed', concat('d', k)) AS declaration", "concat('e', k) AS name_elided")
    checks = store.read("commits").select("record_id", "side", F.lit("ancestor").alias("ancestry"))
    moves = spark.createDataFrame([], "old_path string, new_path string")
    if store.revalidate(facts, moves, checks, "g1", fence=lambda: False) != "changed" or store.revalidate(facts, moves, checks, "g1") != "published":
        raise AssertionError("the fence doesn't hold")
    projection = store.catalog.read("memory", "projection")
    store.recall("g1", "even")
    return projection.where("title = 'even'").select("record_id", "effective_state")


@query("SELECT CAST(conv_id AS VARCHAR) AS record_id, CAST(turn AS VARCHAR) AS revision, CASE WHEN turn > 0 THEN CAST(turn - 1 AS VARCHAR) END AS parent, 'c' || CAST(turn % 5 AS VARCHAR) AS \"commit\", 'observed' AS operation FROM conversations")
def memory_transaction(spark, d):
    """Turns as versions with parents, commits and audit events, written by one commit. A writer that stops between any two
    parts leaves nothing to be seen; the next one writes all."""
    store = MemoryStore(spark, scratch(spark, "memory"))
    r = table(spark, d, "conversations").selectExpr("CAST(conv_id AS STRING) AS record_id", "CAST(turn AS STRING) AS revision", "1 AS schema_version", "'finding' AS kind", "role AS title", "text AS body", "'active' AS lifecycle", "'{}' AS canonical_json", "IF(turn > 0, array(CAST(turn - 1 AS STRING)), CAST(array() AS array<string>)) AS parents", "array(concat('c', turn % 5)) AS introduced_by", "CAST(array() AS array<string>) AS invalidated_by")
    write = store.log._write

    def stops(journal, rows):
        if journal == "audit":
            raise InterruptedError(journal)
        return write(journal, rows)

    store.log._write = stops
    try:
        store.write(r, at=1)
    except InterruptedError:
        pass
    if any(store.state().values()):
        raise AssertionError("a part of an unfinished write is visible")
    store.log._write = write
    store.write(r, at=1)
    if store.log.version() != 1 or not store.log.vacuum(older_than_s=0):
        raise AssertionError("one commit makes all parts visible, and the unfinished write's folders go")
    now, key = store.log.snapshot(), ["record_id", "revision"]
    got = now.read("versions").select(*key).join(now.read("parents"), key, "left").join(now.read("commits").select(*key, "commit"), key).join(now.read("audit").select(*key, "operation"), key)
    return got.select(*key, "parent", "commit", "operation")


@query("SELECT CAST(conv_id AS VARCHAR) AS task_id, count(*) AS sequence, arg_max(role, turn) AS status FROM conversations GROUP BY conv_id")
def task_journal(spark, d):
    """Conversations as tasks, their turns as checkpoints: all in one commit, each task's numbered on without gaps."""
    store = MemoryStore(spark, scratch(spark, "tasks"))
    c = table(spark, d, "conversations").selectExpr("CAST(conv_id AS STRING) AS task_id", "role AS status", "CAST('' AS STRING) AS note", "CAST(turn AS BIGINT) AS recorded_at", "turn")
    store.checkpoints(c.where("turn % 2 = 0").drop("turn"))
    store.checkpoints(c.where("turn % 2 = 1").drop("turn").withColumn("recorded_at", F.col("recorded_at") + 1_000_000))
    store.checkpoints(c.limit(0).drop("turn"))
    last = store.read("checkpoints").groupBy("task_id").agg(F.max("sequence").alias("sequence"), F.max_by("note", "recorded_at").alias("note"))
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("task_id")).agg(F.max_by("role", "turn").alias("status"))
    return last.join(turns, "task_id").select("task_id", "sequence", "status")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS record_id, count(*) AS revision, arg_max(c_name, c_custkey) AS title FROM customer GROUP BY 1")
def personal_notes(spark, d):
    """Customers as revisions of a note a nation, taken in one commit."""
    store = MemoryStore(spark, scratch(spark, "notes"))
    n = table(spark, d, "customer").selectExpr("CAST(c_nationkey AS STRING) AS record_id", "c_name AS title", "'' AS body", "CAST(c_custkey AS BIGINT) AS recorded_at")
    store.take_notes("me", "repo", n)
    store.note("you", "repo", "1", "another", "", at=1)
    return store.notes("me", "repo").select("record_id", "revision", "title")


# --- context


@query("""SELECT 'syntax' AS tier, 'part' || CAST(p_partkey AS VARCHAR) AS identity FROM part UNION ALL SELECT CASE WHEN l_returnflag = 'A' THEN 'structural' ELSE 'references' END, 'order' || CAST(l_orderkey AS VARCHAR) FROM lineitem
UNION ALL SELECT 'precise_overlay', 'doc' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) = 1) UNION ALL SELECT 'memory', 'customer' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0""")
def provider_fan_in(spark, d):
    one = ["1 AS rank", "1L AS units"]
    t = lambda n: table(spark, d, n)
    made = context.fan_in(
        syntax=t("part").selectExpr("concat('part', p_partkey) AS identity", *one),
        graph=t("lineitem").selectExpr("concat('order', l_orderkey) AS identity", "IF(l_returnflag = 'A', 'imports', 'calls') AS edge_kind", *one),
        overlay=t("supplier").selectExpr("concat('doc', s_suppkey) AS identity", "CAST(s_nationkey AS STRING) AS symbol", *one),
        memory=t("customer").selectExpr("concat('customer', c_custkey) AS identity", "IF(c_custkey % 3 = 0, 'current', 'stale') AS state", *one),
    )
    return made.select("tier", "identity")
