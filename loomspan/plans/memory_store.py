"""Engineering memory as append-only journals and published projections, and the notes and tasks kept beside it.

All journals share one commit log: what a write adds to several of them becomes visible by one entry, or not at all. A
projection is a generation of the catalog that names the source generation it was made for.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import memory
from ..operators.results import Bounded
from ..operators.shared import by_merge, released, written
from ..sources.memory import parents_of, validity_commits
from .catalog import Catalog
from .commit_log import CommitLog, Snapshot

#: The journals and their columns.
JOURNALS = {
    "versions": "record_id string, revision string, schema_version int, kind string, title string, body string, lifecycle string, validity_kind string, source_snapshot string, canonical_json string",
    "parents": "record_id string, revision string, parent string",
    "commits": "record_id string, revision string, side string, commit string",
    "evidence": "record_id string, revision string, evidence_ordinal int, path string, kind string, name string, qualified_name string, container string, declaration string, name_elided string",
    "audit": "event_id long, record_id string, revision string, operation string, recorded_at long, display_revision long",
    "reviews": "record_id string, revision string, evidence_ordinal int, decision string, target_path string, target_ordinal int, recorded_at long",
    "personal": "profile string, repository string, record_id string, revision long, title string, body string, recorded_at long",
    "checkpoints": "task_id string, sequence long, status string, note string, recorded_at long",
    "verifications": "task_id string, sequence long, command string, outcome string, recorded_at long",
}
DECISIONS = ("confirmed", "rejected")


def _numbered(rows: DataFrame, held: DataFrame, key: list[str], number: str, then: list[str]) -> DataFrame:
    """``rows`` with a number on from the last one held of their key, by recorded_at and the columns ``then``."""
    last = held.groupBy(*key).agg(F.max(number).alias("_last"))
    order = F.row_number().over(Window.partitionBy(*key).orderBy("recorded_at", *then))
    return by_merge(rows.withColumn("_n", order), last, key, "left").withColumn(number, F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last")


class MemoryStore:
    """One workspace's memory under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog = spark, Catalog(spark, root)
        self.log = CommitLog(spark, root, JOURNALS)

    # -- journals

    def append(self, journal: str, rows: DataFrame) -> int:
        """Adds rows to one journal; returns the log's version."""
        return self.log.commit({journal: rows})

    def read(self, journal: str) -> DataFrame:
        return self.log.snapshot().read(journal)

    def state(self) -> dict[str, int]:
        """The journals' numbers of parts: what a revalidation is made from, and checks before it publishes."""
        now = self.log.snapshot()
        return {j: now.length(j) for j in ("versions", "parents", "commits", "evidence", "audit", "reviews")}

    @staticmethod
    def _audit(before: DataFrame, rows: DataFrame, operation: str, at: int) -> DataFrame:
        """Audit events, numbered on from the last; a record's approvals get its next display revisions. Numbers are unique, in
        no order within a write, and have gaps."""
        last = before.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
        shown = before.groupBy("record_id").agg(F.max("display_revision").alias("shown"))
        own = Window.partitionBy("record_id").orderBy("revision")
        rows = by_merge(rows.select("record_id", "revision").distinct(), shown, "record_id", "left")
        display = F.coalesce("shown", F.lit(0)) + (F.row_number().over(own) if operation == "locally_approved" else 0)
        rows = rows.withColumn("display_revision", F.when(F.lit(operation == "locally_approved"), display))
        return rows.withColumns({"event_id": F.lit(last) + 1 + F.monotonically_increasing_id(), "operation": F.lit(operation), "recorded_at": F.lit(at)})

    # -- management

    def write(self, records: DataFrame, evidence: DataFrame | None = None, at: int | None = None, check: Callable[[Snapshot], None] = lambda now: None) -> dict:
        """Adds versions as ``sources.memory.read_records`` gives them (with validity_kind and source_snapshot where they have
        them), their parents, validity commits and evidence; those already known are left out. They are observed, not approved.
        One commit: all journals have all of a write or nothing of it. ``check`` raises where the state that it adds to forbids it."""
        r = records
        for c, value in (("validity_kind", F.lit("commits")), ("source_snapshot", F.lit(None).cast("string"))):
            r = r if c in r.columns else r.withColumn(c, value)
        r = r.dropDuplicates(["record_id", "revision"])

        def make(now: Snapshot) -> tuple[dict[str, DataFrame], dict]:
            check(now)
            # Written once: all journals get rows of the same versions, whatever the source returns when it is read again.
            new = written(by_merge(r, now.read("versions").select("record_id", "revision"), ["record_id", "revision"], "left_anti"), "new")
            n = new.count()
            done = {"written": n, "known": r.count() - n}
            if not n:
                return {}, done
            parts = {"versions": new, "parents": parents_of(new), "commits": validity_commits(new), "audit": self._audit(now.read("audit"), new, "observed", at or int(time.time() * 1000))}
            if evidence is not None:
                parts["evidence"] = by_merge(evidence, new.select("record_id", "revision"), ["record_id", "revision"], "left_semi")
            return parts, done

        with released():
            return self.log.transact(make)

    def approve(self, revisions: DataFrame, at: int | None = None) -> dict:
        """Approves (record_id, revision) rows locally; unknown ones are an error, approved ones are left out."""
        asked = revisions.select("record_id", "revision").distinct()

        def make(now: Snapshot) -> tuple[dict[str, DataFrame], dict]:
            if (missing := by_merge(asked, now.read("versions"), ["record_id", "revision"], "left_anti").limit(5).collect()):
                raise ValueError(f"unknown revisions: {[tuple(m) for m in missing]}")
            new = written(by_merge(asked, self.approvals(now), ["record_id", "revision"], "left_anti"), "new")
            n = new.count()
            parts = {"audit": self._audit(now.read("audit"), new, "locally_approved", at or int(time.time() * 1000))} if n else {}
            return parts, {"approved": n, "known": asked.count() - n}

        with released():
            return self.log.transact(make)

    def approvals(self, now: Snapshot | None = None) -> DataFrame:
        return (now or self.log.snapshot()).read("audit").where("operation = 'locally_approved'").select("record_id", "revision").distinct()

    def heads(self) -> DataFrame:
        now = self.log.snapshot()
        return memory.select_heads(now.read("versions").select("record_id", "revision"), self.approvals(now), now.read("parents"))

    def open_heads(self, now: Snapshot | None = None) -> DataFrame:
        """(record_id, head): approved versions that no approved version names as its parent."""
        now = now or self.log.snapshot()
        return memory.open_heads(now.read("versions").select("record_id", "revision"), self.approvals(now), now.read("parents"))

    def sync(self, records: DataFrame, at: int | None = None) -> dict:
        """Takes versions of the team in: each must name every unresolved head of its record as a parent, or none is taken. The
        heads are those of the state that the versions are added to."""
        incoming = records.select("record_id", "revision", "parents")

        def check(now: Snapshot) -> None:
            if (bad := memory.sync_fence(incoming, self.open_heads(now)).limit(5).collect()):
                raise ValueError(f"versions that don't name a head: {[tuple(b) for b in bad]}")

        return self.write(records, at=at, check=check)

    def review(self, record_id: str, revision: str, evidence_ordinal: int, decision: str, target: tuple[str, int] | None = None, at: int | None = None) -> int:
        """Records what a person decided on one evidence item's correspondence."""
        if decision not in DECISIONS:
            raise ValueError(f"one of {DECISIONS}")
        held = self.read("evidence").where((F.col("record_id") == record_id) & (F.col("revision") == revision) & (F.col("evidence_ordinal") == evidence_ordinal))
        if held.isEmpty():
            raise ValueError("no such evidence")
        row = (record_id, revision, evidence_ordinal, decision, *(target or (None, None)), at or int(time.time() * 1000))
        return self.append("reviews", self.spark.createDataFrame([row], JOURNALS["reviews"]))

    def history(self) -> DataFrame:
        """Observations and reviewed correspondences together."""
        now = self.log.snapshot()
        return memory.history_union(now.read("audit").where("operation = 'observed'"), now.read("reviews"))

    # -- projection

    def revalidate(self, facts: DataFrame, moves: DataFrame, checks: DataFrame, generation: str, snapshot: str | None = None, fence: Callable[[], bool] = lambda: True) -> str:
        """Makes the projection of all records against a source generation's facts and publishes it: "published", "changed" (the
        journals or, by ``fence``, the source have changed meanwhile: nothing is published) or "lost"."""
        before, slot, gen, log = self.state(), "memory", uuid.uuid4().hex, self.log.snapshot()
        now = self.catalog.pointer(slot)
        v, approved, parents = log.read("versions"), self.approvals(log), log.read("parents")
        heads = memory.select_heads(v.select("record_id", "revision"), approved, parents)
        chosen = heads.where("outcome = 'selected'").select("record_id", "revision")
        live = by_merge(v, chosen, ["record_id", "revision"], "left_semi")
        subjects = by_merge(log.read("evidence"), chosen, ["record_id", "revision"], "left_semi").drop("revision")
        texts = v.select("record_id", "revision", "title", "body", "kind")
        with released():
            done = memory.revalidate(v.select("record_id", "revision"), approved, parents, live, checks, subjects, facts, moves, snapshot)
            self.catalog.stage(slot, gen, {"projection": by_merge(done, texts, ["record_id", "revision"], "left"), "made_for": self.spark.createDataFrame([(generation,)], "generation string")})
        return self.catalog.publish(slot, gen, base=now["epoch"] if now else 0, fence=lambda: self.state() == before and fence())

    def recall(self, active: str, query: str | None = None, limit: int = 50) -> tuple[Bounded, DataFrame]:
        """Records by words, of the projection that is active; it must have been made for the source generation ``active``."""
        projection = self.catalog.read("memory", "projection")
        if projection is None:
            raise LookupError("no projection was produced")
        made_for = self.catalog.read("memory", "made_for").first()["generation"]
        return memory.memory_recall(projection, query, limit, made_for=made_for, active=active)

    # -- personal notes and tasks

    def note(self, profile: str, repository: str, record_id: str, title: str, body: str, at: int | None = None) -> int:
        """Appends the next revision of a personal note; returns it."""

        def make(now: Snapshot) -> tuple[dict[str, DataFrame], int]:
            own = now.read("personal").where((F.col("profile") == profile) & (F.col("repository") == repository) & (F.col("record_id") == record_id))
            revision = (own.agg(F.max("revision")).first()[0] or 0) + 1
            row = (profile, repository, record_id, revision, title, body, at or int(time.time() * 1000))
            return {"personal": self.spark.createDataFrame([row], JOURNALS["personal"])}, revision

        return self.log.transact(make)

    def take_notes(self, profile: str, repository: str, rows: DataFrame) -> int:
        """Appends revisions of many notes (record_id, title, body, recorded_at) in one commit, numbered on by recorded_at; returns the log's version."""

        def make(now: Snapshot) -> tuple[dict[str, DataFrame], int]:
            own = now.read("personal").where((F.col("profile") == profile) & (F.col("repository") == repository))
            new = _numbered(rows, own, ["record_id"], "revision", ["title", "body"])
            return {"personal": new.withColumns({"profile": F.lit(profile), "repository": F.lit(repository)})}, now.version + 1

        return self.log.transact(make)

    def notes(self, profile: str, repository: str) -> DataFrame:
        return memory.personal_memory(self.read("personal"), profile, repository)

    def checkpoint(self, task_id: str, status: str, note: str = "", at: int | None = None) -> int:
        """Appends a task's next checkpoint; returns its sequence number, which has no gaps."""

        def make(now: Snapshot) -> tuple[dict[str, DataFrame], int]:
            sequence = (now.read("checkpoints").where(F.col("task_id") == task_id).agg(F.max("sequence")).first()[0] or 0) + 1
            return {"checkpoints": self.spark.createDataFrame([(task_id, sequence, status, note, at or int(time.time() * 1000))], JOURNALS["checkpoints"])}, sequence

        return self.log.transact(make)

    def checkpoints(self, rows: DataFrame) -> int:
        """Appends checkpoints of many tasks (task_id, status, note, recorded_at) in one commit; each task's are numbered on by
        recorded_at, without gaps. Returns the log's version."""

        def make(now: Snapshot) -> tuple[dict[str, DataFrame], int]:
            return {"checkpoints": _numbered(rows, now.read("checkpoints"), ["task_id"], "sequence", ["status", "note"])}, now.version + 1

        return self.log.transact(make)

    def verify(self, task_id: str, command: str, outcome: str, at: int | None = None) -> int:
        """Appends a verification of a task's last checkpoint; a task without checkpoints is an error."""

        def make(now: Snapshot) -> tuple[dict[str, DataFrame], int]:
            last = now.read("checkpoints").where(F.col("task_id") == task_id).agg(F.max("sequence")).first()[0]
            if last is None:
                raise ValueError("no such task")
            return {"verifications": self.spark.createDataFrame([(task_id, last, command, outcome, at or int(time.time() * 1000))], JOURNALS["verifications"])}, last

        return self.log.transact(make)

    def tasks(self, limit: int = 100) -> Bounded:
        return memory.latest_checkpoints(self.read("checkpoints"), self.read("verifications"), limit)

    def task(self, task_id: str) -> dict | None:
        mine = lambda j: self.read(j).where(F.col("task_id") == task_id)
        row = memory.latest_checkpoints(mine("checkpoints"), mine("verifications"), 1).rows.first()
        return row and row.asDict()

    def problems(self) -> DataFrame:
        """(check, rows): what must be empty."""
        from ..operators.retention import orphans, repeated_keys, violations

        now = self.log.snapshot()
        v = now.read("versions")
        checks = {
            "versions": repeated_keys(v, ["record_id", "revision"]),
            "approvals": orphans(self.approvals(now), v, ["record_id", "revision"]),
            "events": repeated_keys(now.read("audit"), ["event_id"]),
            "tasks": memory.sequence_gaps(now.read("checkpoints")),
        }
        return violations(**checks)

