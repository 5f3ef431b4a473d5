"""Paths, digests, maps, search: small golden frames."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.functions.digests import artifact_digest, frame_digest
from loomspan.operators import architecture as arch
from loomspan.operators import search
from loomspan.operators.results import bounded, not_produced, within_bytes


def one(spark, col, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(col(F.col("x"))).collect()]


def test_topology_precedence(spark):
    paths = [".github/workflows/ci.yml", "AGENTS.md", "Cargo.toml", "README.md", "config/local.toml", "src/lib.rs", "Makefile", "docs/AGENTS.md", "docs/Makefile", ".github/workflows/a/b.yaml", "x/.gitignore", "requirements/dev.txt"]
    want = ["workflow", "agent_instruction", "package", "documentation", "configuration", "other", "build", "agent_instruction", "documentation", "workflow", "other", "package"]
    assert one(spark, tx.topology_category, *paths) == want
    assert one(spark, tx.language_of, "a.rs", "b.go", "c.ts", "d.tsx", "e.py", "f.txt") == ["rust", "go", "typescript", "tsx", "python", None]


def test_identifiers(spark):
    assert one(spark, tx.container_of, "a::b::c", "c") == ["a::b", ""]
    assert one(spark, tx.strip_turbofish, "f::<T>", "f", "a::f::<A, B<C>>") == ["f", "f", "a::f"]
    assert one(spark, lambda c: tx.path_parts(c)["bare"], "x", "a::b", "crate::x", "a.b", "<T as U>::f", "self::x") == [True, False, True, None, None, None]
    assert one(spark, lambda c: tx.import_parts(c)["alias"], "a::b as c", "a::b", "a::{b, c}") == ["c", "b", None]
    assert one(spark, tx.ascii_lower, "ÀB") == ["Àb"]
    assert one(spark, lambda c: tx.decode_path(tx.encode_path(c)).cast("string"), "a/ü") == ["a/ü"]
    assert one(spark, tx.tokens, "Foo_bar.Baz-ÀÉ 2") == [["foo_bar", "baz", "àé", "2"]]


def test_query_limits():
    assert tx.query_terms("  a  b ") == ["a", "b"]
    for bad in ("", " ", "a " * 9, "x" * 65, "a\x00b", "y" * 257):
        with pytest.raises(ValueError):
            tx.query_terms(bad)
    assert tx.query_digest(["ab", "c"]) != tx.query_digest(["a", "bc"])


def test_digests_ignore_order(spark):
    df = spark.createDataFrame([(i, str(i % 3), None if i % 4 else 1) for i in range(100)], "a int, b string, c int")
    want = frame_digest(df).first()
    assert frame_digest(df.orderBy(F.desc("a")).repartition(7)).first() == want and want["rows"] == 100
    assert frame_digest(df.where("a > 0")).first()["digest"] != want["digest"]
    keys = df.limit(1).select(artifact_digest(F.lit("c"), "p", "x", "s").alias("a"), artifact_digest(F.lit("c"), "p", "y", "s").alias("b")).first()
    assert keys.a != keys.b


def files(spark):
    rows = [("a/x.rs", "rust", 2), ("a/y.go", "go", 1), ("b/z.py", "python", 2), ("c/t.ts", "typescript", 1), ("d/u.tsx", "tsx", 1), ("w.py", "python", 0)]
    return spark.createDataFrame([(p, lang, n, p + "c", p + "a") for p, lang, n in rows], "path string, language string, fact_count long, content_digest string, artifact_digest string")


def test_overview(spark):
    facts = spark.createDataFrame([(f"{d}/m", i, "function", "main", "main", "rust") for i, d in enumerate("abcde")] + [("a/m", 9, "function", "main2", "main2", "rust"), ("a/m", 10, "method", "main", "x::main", "rust")], "path string, ordinal int, kind string, name string, qualified_name string, language string")
    o = arch.architecture_overview(files(spark), facts)
    assert o["entry_points"].rows.count() == 5 and o["roots"].receipt.first()["omitted"] == 0
    assert [tuple(r) for r in o["roots"].rows.collect()] == [(None, 1, 0), ("a", 2, 3), ("b", 1, 2), ("c", 1, 1), ("d", 1, 1)]
    for most, roots, entries in ((400, 5, 1), (323, 4, 0), (10, 0, 0), (10_000, 5, 5)):
        o2 = arch.architecture_overview(files(spark), facts, max_bytes=most)
        assert [(o2[k].rows.count(), *o2[k].receipt.first()[:3]) for k in ("roots", "entry_points")] == [(roots, 5, roots, 5 - roots), (entries, 5, entries, 5 - entries)]
    assert {r["language"]: r["files"] for r in o["languages"].collect()} == {"go": 1, "python": 2, "rust": 1, "tsx": 1, "typescript": 1}
    assert [r["path"] for r in arch.architecture_map(files(spark), 2)[2].rows.collect()] == ["a/x.rs", "a/y.go"]
    arts = files(spark).selectExpr("artifact_digest", "content_digest", "IF(language = 'go', 'staging', 'complete') AS lifecycle_state", "fact_count", "language")
    assert arch.complete_files(files(spark).select("path", "content_digest", "artifact_digest"), arts).count() == 5


def test_bounded(spark):
    df = spark.range(10)
    b = bounded(df, [F.desc("id")], 3)
    assert [r[0] for r in b.rows.collect()] == [9, 8, 7] and tuple(b.receipt.first()) == (10, 3, 7, "available")
    assert not_produced(df).receipt.first()["availability"] == "not_produced"
    assert within_bytes(df, F.lit(10), 35, ["id"]).count() == 3
    with pytest.raises(Exception, match="byte budget"):
        within_bytes(df, F.lit(10), 35, ["id"], fail=True).collect()


def test_search(spark):
    facts = spark.createDataFrame(
        [("a", 0, "function", "parse_url", "net::parse_url", "rust"), ("a", 1, "struct", "Url", "net::Url", "rust"), ("b", 0, "function", "url", "url::url", "go"), ("b", 1, "method", "Über", "net::Über", "rust"), ("c", 0, "function", "x", "a.b", "rust")],
        "path string, ordinal int, kind string, name string, qualified_name string, language string",
    )
    keys = lambda b: [(r["path"], r["ordinal"]) for r in b.rows.collect()]
    assert keys(search.code_search(facts, "url")) == [("b", 0), ("a", 1)]
    assert keys(search.code_search(facts, "NET über")) == [("b", 1)]
    assert keys(search.code_search(facts, "net::url")) == [("a", 1)]
    assert keys(search.code_search(facts, "url::net")) == [] and keys(search.code_search(facts, "--")) == []
    index, stats = search.postings(facts), search.document_stats(facts)
    assert keys(search.code_search(facts, "function url", index=index, stats=stats)) == [("b", 0)]
    assert keys(search.code_search(facts.repartition(5), "net")) == keys(search.code_search(facts, "net"))
    assert keys(search.symbol_search(facts, "Url")) == [("a", 1)] and keys(search.symbol_search(facts, "url", mode="prefix")) == [("b", 0)]
    assert keys(search.symbol_search(facts, "U", mode="prefix", language="rust", kind="struct", path_prefix="a")) == [("a", 1)]
    search.symbol_search(facts, "n" * 1024)
    with pytest.raises(ValueError):
        search.symbol_search(facts, "n" * 1025)
    hits = spark.createDataFrame([("a", 1, -3.0, "x"), ("b", 0, -2.0, "y"), ("b", 1, -1.5, "y"), ("c", 0, -1.0, "z"), ("c", 1, -0.9, "z"), ("c", 2, -0.8, "z")], "path string, ordinal int, rank double, content_digest string")
    assert [tuple(r) for r in search.relevant_paths(hits, 1).collect()] == [("b", 2, 0)]
    with pytest.raises(Exception, match="two contents"):
        search.relevant_paths(hits.withColumn("content_digest", F.col("ordinal").cast("string")), 5).collect()


def test_symbol_get(spark):
    import hashlib

    raw = "fn é() {}\n".encode()
    d = hashlib.sha256(raw).hexdigest()
    held = spark.createDataFrame([("a", d, bytearray(raw))], "path string, content_digest string, content binary")
    fact = spark.createDataFrame([("a", d, 0, 0, 10)], "path string, content_digest string, ordinal int, decl_start long, decl_end long")
    assert bytes(search.symbol_get(fact, held, {"path": "a", "ordinal": 0}).first()["source"]) == "fn é() {}".encode()
    assert search.symbol_get(fact, held, {"content_digest": "old"}).count() == 0
    with pytest.raises(Exception, match="pinned digest"):
        search.symbol_get(fact, held.withColumn("content", F.lit(b"other")), {"path": "a"}).collect()


def test_sites(spark):
    sites = spark.createDataFrame([("f", 0, "call", "g", "rust", "A", 12, 13), ("f", 1, "test_marker", "test", "rust", "A", 2, 6), ("h", 0, "call", "g", "go", "B", 15, 16)], "path string, ordinal int, site_kind string, raw_target string, language string, artifact_digest string, start long, end long")
    assert [r["ordinal"] for r in arch.outbound_sites(sites, {"artifact_digest": "A", "decl_start": 10, "decl_end": 20}).rows.collect()] == [0]
    assert arch.syntax_site_search(sites, "g").receipt.first()["total"] == 2 and arch.syntax_site_search(sites, "G").rows.count() == 0
    assert arch.test_markers(sites, "rust").rows.count() == 1 and arch.test_markers(sites, path_prefix="h").rows.count() == 0
    arts = files(spark).selectExpr("artifact_digest", "IF(language = 'rust', 'supported', 'unsupported') AS test_marker_support", "2 AS test_marker_emitted")
    got = [tuple(r) for r in arch.marker_support(files(spark), arts).collect()]
    assert got == [("rust", 1, 0, 2), ("go", 0, 1, 0), ("typescript", 0, 1, 0), ("tsx", 0, 1, 0), ("python", 0, 2, 0)]
    assert arch.code_graph_query({"kind": "test_markers", "language": "rust"}, sites=sites).rows.count() == 1
    with pytest.raises(ValueError):
        arch.code_graph_query({"kind": "other"})


def test_search_over_repositories(spark):
    facts = lambda *names: spark.createDataFrame([(f"{n}.rs", i, "function", n, n) for i, n in enumerate(names)], "path string, ordinal long, kind string, name string, qualified_name string")
    broken = facts("go").withColumn("name", F.raise_error(F.lit("unreadable")).cast("string"))
    got = search.cross_repository_search({"d": facts("go"), "a": facts("go", "stop"), "b": broken, "c": facts("halt"), "e": facts("go")}, "go", 2)
    assert [(r["repository_id"], r["path"]) for r in got.rows.collect()] == [("a", "go.rs"), ("d", "go.rs")]
    assert [(r["repository_id"], r["outcome"], r["total"], r["returned"]) for r in got.receipts.collect()] == [("a", "complete", 1, 1), ("b", "failed", None, 0), ("c", "empty", 0, 0), ("d", "complete", 1, 1), ("e", "skipped", None, 0)]
    many = spark.range(search.MAX_REPOSITORIES + 1).selectExpr("concat('r', id) AS repository_id", "'f' AS path", "id AS ordinal", "'function' AS kind", "'go' AS name", "'go' AS qualified_name")
    with pytest.raises(ValueError, match="repositories"):
        search.cross_repository_search(many, "go")
    with pytest.raises(Exception, match="byte budget"):
        search.code_search(facts("go", "stop"), "go", max_bytes=10).rows.collect()
    assert search.code_search(facts("go", "stop"), "go", max_bytes=1000).rows.count() == 1
