"""One log over several journals: all of a write or nothing, whoever stops or races; and deletion of intermediate tables."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import shared
from loomspan.plans import commit_log
from loomspan.plans.commit_log import CommitLog, Conflict
from loomspan.plans.memory_store import MemoryStore

RECORD = "record_id string, revision string, schema_version int, kind string, title string, body string, lifecycle string, canonical_json string, parents array<string>, introduced_by array<string>, invalidated_by array<string>"


def records(spark, *revisions):
    return spark.createDataFrame([(r, v, 1, "finding", "t", "b", "active", "{}", [p] if p else [], ["c1"], []) for r, v, p in revisions], RECORD)


@pytest.mark.parametrize("stop", ["versions", "parents", "commits", "audit", "evidence", "entry"])
def test_a_write_that_stops_anywhere_leaves_nothing(spark, tmp_path, stop):
    store = MemoryStore(spark, f"file://{tmp_path}/memory")
    rows = records(spark, ("a", "1", None), ("a", "2", "1"))
    evidence = spark.createDataFrame([("a", "1", 0, "p", "k", "n", "q", "c", "d", "e")], "record_id string, revision string, evidence_ordinal int, path string, kind string, name string, qualified_name string, container string, declaration string, name_elided string")
    write, put = store.log._write, store.log.catalog._put

    def stops(journal, rows):
        if journal == stop:
            raise InterruptedError
        return write(journal, rows)

    def fails(name, value):
        raise InterruptedError

    store.log._write = stops
    if stop == "entry":
        store.log.catalog._put = fails
    with pytest.raises(InterruptedError):
        store.write(rows, evidence, at=1)
    store.log._write, store.log.catalog._put = write, put
    assert not any(store.state().values()) and store.read("versions").count() == 0 and store.log.version() == 0
    assert store.write(rows, evidence, at=1) == {"written": 2, "known": 0}
    assert {j: store.read(j).count() for j in store.state()} == {"versions": 2, "parents": 1, "commits": 2, "evidence": 1, "audit": 2, "reviews": 0}
    assert store.log.version() == 1 and store.log.vacuum() == 0 and store.log.vacuum(older_than_s=0) > 0
    assert store.read("versions").count() == 2 and store.write(rows, at=2) == {"written": 0, "known": 2}


def test_a_lost_race_is_made_anew(spark, tmp_path):
    """Another writer commits between snapshot and entry: numbers are made again from what it left."""
    store = MemoryStore(spark, f"file://{tmp_path}/memory")
    put, raced = store.log.catalog._put, []

    def late(name, value):
        if not raced:
            raced.append(MemoryStore(spark, f"file://{tmp_path}/memory").checkpoint("t", "other", at=1))
        return put(name, value)

    store.log.catalog._put = late
    assert store.checkpoint("t", "mine", at=2) == 2 and raced == [1]
    with pytest.raises(Conflict):
        store.log.commit({}, store.log.snapshot(0))


def test_the_team_fence_holds_at_the_commit(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/memory")
    store.write(records(spark, ("a", "1", None)), at=1)
    put, raced = store.log.catalog._put, []

    def late(name, value):
        if not raced:
            raced.append(True)
            MemoryStore(spark, f"file://{tmp_path}/memory").approve(records(spark, ("a", "1", None)), at=2)
        return put(name, value)

    store.log.catalog._put = late
    with pytest.raises(ValueError, match="head"):  # the head was approved after the fence was looked at first
        store.sync(records(spark, ("a", "9", None)), at=3)
    assert store.read("versions").count() == 1


def test_snapshots_and_whole_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "WHOLE", 3)
    log = CommitLog(spark, f"file://{tmp_path}/log", {"a": "x int", "b": "y string"})
    one = lambda v, t, s: spark.createDataFrame([(v,)], f"{t} {s}")
    for i in range(7):
        log.commit({"a": one(i, "x", "int")} if i % 2 else {"a": one(i, "x", "int"), "b": one(str(i), "y", "string")})
    assert [log.snapshot(v).length("a") for v in range(8)] == list(range(8))
    assert sorted(r["x"] for r in log.snapshot(4).read("a").collect()) == [0, 1, 2, 3] and sorted(r["y"] for r in log.snapshot().read("b").collect()) == ["0", "2", "4", "6"]
    assert log.snapshot(0).read("a").count() == 0 and [set(p) for p in log._entry(6)["all"]] == [{"a", "b"}, {"a"}] * 3
    log.commit({"removed": [log.snapshot().folders("b")[0]]})
    assert log.snapshot().length("a") == 6 and log.snapshot(7).length("a") == 7


def test_intermediate_tables_go(spark):
    shared.release()
    keep = shared.written(spark.range(3).toDF("x"))
    with shared.released():
        shared.written(spark.range(3).toDF("x"))
        assert len(shared._live) == 2
    assert len(shared._live) == 1 and keep.count() == 3 and shared.release() == 1
    with pytest.raises(Exception, match="exist|No such"):
        keep.count()


def test_analyses_are_stored_once_and_swept(spark, tmp_path):
    from loomspan.plans.analysis_store import AnalysisStore

    store = AnalysisStore(spark, f"file://{tmp_path}/analyses")
    files = lambda *ds: spark.createDataFrame([(f"p{i}", d) for i, d in enumerate(ds)], "path string, artifact_digest string")
    rows = lambda df: df.select("artifact_digest").distinct().select("artifact_digest", F.concat(F.lit("fact of "), "artifact_digest").alias("name"))
    g1, g2, g3 = files("a", "b", "b"), files("a", "c"), files("c")
    assert store.read("facts", g1) is None and store.known().count() == 0
    assert [store.add(g, {"facts": rows(g)}) for g in (g1, g2, g3, g1)] == [2, 1, 0, 0]
    log = store.log.snapshot()
    assert [spark.read.parquet(f"{store.log.root}/{f}").count() for f in log.folders("facts")] == [2, 1]  # the second wrote its one new digest
    assert sorted((r["path"], r["name"]) for r in store.read("facts", g1).collect()) == [("p0", "fact of a"), ("p1", "fact of b"), ("p2", "fact of b")]
    assert {tuple(r) for r in store.references([g1, g2]).collect()} == {("a", 2, 2), ("b", 1, 2), ("c", 1, 1)}
    assert store.sweep([g1, g2, g3]) == {"dead": 0, "dropped": 0, "rewritten": 0}
    assert store.sweep([g2, g3]) == {"dead": 1, "dropped": 0, "rewritten": 1} and {r[0] for r in store.known().collect()} == {"a", "c"}
    assert store.read("facts", g2).count() == 2 and store.read("facts", g1).count() == 1
    assert store.add(g1, {"facts": rows(g1)}) == 1  # b comes back
    assert store.sweep([g3])["dead"] == 2 and {r[0] for r in store.known().collect()} == {"c"} and store.sweep([]) == {"dead": 1, "dropped": 1, "rewritten": 0}
