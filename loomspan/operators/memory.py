"""Engineering memory: heads, project validity, correspondence, evidence folding, recall, history, tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, query_terms
from .results import Bounded, bounded
from .shared import by_merge, written

MAX_CANDIDATES = 16
#: Fixed values. From strongest to weakest claim on the result: (outcome, effective state, evidence state).
EVIDENCE_ORDER = (
    ("indeterminate", "indeterminate", "indeterminate"),
    ("needs_review", "needs_review", "ambiguous"),
    ("changed", "stale", "changed"),
    ("missing", "stale", "missing"),
    ("corresponded", "current", "corresponded"),
    ("exact", "current", "exact"),
)


def select_heads(versions: DataFrame, approvals: DataFrame, parents: DataFrame) -> DataFrame:
    """(record_id, outcome, revision): one approved version that no approved version refers to as parent is selected.

    More heads conflict; none, or an approved version with a parent that isn't known, is indeterminate.
    ``versions``: record_id, revision. ``approvals``: record_id, revision. ``parents``: record_id, revision, parent."""
    approved = by_merge(versions, approvals.select("record_id", "revision").distinct(), ["record_id", "revision"], "left_semi")
    links = by_merge(parents, approved, ["record_id", "revision"], "left_semi")
    unknown = by_merge(links, versions.select("record_id", F.col("revision").alias("parent")), ["record_id", "parent"], "left_anti").select("record_id").distinct().withColumn("broken", F.lit(True))
    heads = by_merge(approved, links.select("record_id", F.col("parent").alias("revision")).distinct(), ["record_id", "revision"], "left_anti")
    n = heads.groupBy("record_id").agg(F.count("*").alias("heads"), F.min("revision").alias("revision"))
    every = by_merge(by_merge(approved.select("record_id").distinct(), n, "record_id", "left"), unknown, "record_id", "left")
    bad = F.col("broken").isNotNull() | F.col("heads").isNull()
    outcome = F.when(bad, "indeterminate").when(F.col("heads") > 1, "conflicted").otherwise("selected")
    return every.select("record_id", outcome.alias("outcome"), F.when(~bad & (F.col("heads") == 1), F.col("revision")).alias("revision"), F.coalesce("heads", F.lit(0)).alias("heads"))


def open_heads(versions: DataFrame, approvals: DataFrame, parents: DataFrame) -> DataFrame:
    """(record_id, head): approved versions that no approved version refers to as its parent."""
    approved = by_merge(versions, approvals.select("record_id", "revision").distinct(), ["record_id", "revision"], "left_semi")
    named = by_merge(parents, approved, ["record_id", "revision"], "left_semi").select("record_id", F.col("parent").alias("revision")).distinct()
    return by_merge(approved, named, ["record_id", "revision"], "left_anti").select("record_id", F.col("revision").alias("head"))


def ancestry_checks(commits: DataFrame, ancestors: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``ancestry``: ancestor, not_ancestor, or indeterminate for commits that history doesn't hold."""
    c = commits.join(ancestors.select(F.col("ancestor").alias("commit"), F.lit(True).alias("_a")).distinct(), "commit", "left")
    c = c.join(known.select("commit", F.lit(True).alias("_k")).distinct(), "commit", "left")
    return c.withColumn("ancestry", F.when(F.col("_a"), "ancestor").when(F.col("_k"), "not_ancestor").otherwise("indeterminate")).drop("_a", "_k")


def project_validity(records: DataFrame, checks: DataFrame, snapshot: str | None) -> DataFrame:
    """(record_id, validity). A worktree claim is valid for its own snapshot only. A commit claim doesn't apply if an
    invalidating commit is reachable, or no introducing one is; otherwise any unknown is indeterminate.

    ``records``: record_id, validity_kind, source_snapshot. ``checks``: record_id, side (introduced_by, invalidated_by), ancestry."""
    flag = lambda side, what: F.max(F.when((F.col("side") == side) & (F.col("ancestry") == what), 1).otherwise(0))
    by = checks.groupBy("record_id").agg(
        flag("introduced_by", "ancestor").alias("in_yes"), flag("introduced_by", "indeterminate").alias("in_open"), flag("invalidated_by", "ancestor").alias("out_yes"), flag("invalidated_by", "indeterminate").alias("out_open")
    )
    r = by_merge(records, by, "record_id", "left").fillna(0, ["in_yes", "in_open", "out_yes", "out_open"])
    on_commits = (
        F.when(F.col("out_yes") == 1, "not_applicable")
        .when((F.col("in_yes") == 0) & (F.col("in_open") == 0), "not_applicable")
        .when(F.col("in_yes") == 0, "indeterminate")
        .when(F.col("out_open") == 1, "indeterminate")
        .otherwise("valid")
    )
    worktree = F.when(F.col("source_snapshot") == F.lit(snapshot), "valid").otherwise("not_applicable")
    return r.select("record_id", F.when(F.col("validity_kind") == "worktree", worktree).otherwise(on_commits).alias("validity"))


SUBJECT = ["record_id", "evidence_ordinal"]


def correspondence(subjects: DataFrame, facts: DataFrame, moves: DataFrame, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(record_id, evidence_ordinal, outcome, relation, target_path, target_ordinal, candidates) for each evidence item.

    Both sides have path, kind, name, qualified_name, container, declaration, name_elided (null without fingerprint), facts
    also ordinal; ``moves`` (old_path, new_path) are exact moves. Candidates share the kind and one of path, container,
    declaration or name-elided digest, or lie at the moved path. All these are keys of one frame, joined once with the first
    ``max_candidates`` + 1 facts of each key, so a key that many facts and many subjects share is no product: with more facts at a
    key its subjects have more candidates than that in any case, which is all there is to say of them: they meet no target. For the others
    the first of:
    exact; renamed or moved (one automatic target); changed; plausible, for review. Several targets at a step need review;
    over ``max_candidates`` candidates are indeterminate, and are counted as ``max_candidates`` + 1.
    """
    target = F.struct(*[F.col(c).alias(f"t_{c}") for c in ("path", "ordinal", "name", "qualified_name", "container", "declaration", "name_elided")])
    tagged = lambda *pairs: F.explode(F.array(*[F.struct(F.lit(tag).alias("tag"), F.col(c).cast("string").alias("key")) for tag, c in pairs])).alias("_k")
    own = [(c, c) for c in ("path", "container", "declaration", "name_elided")]
    f = facts.select("kind", target.alias("t"), tagged(*own)).select("kind", "t", "_k.tag", "_k.key").where(F.col("key").isNotNull())
    first = Window.partitionBy("kind", "tag", "key").orderBy("t.t_path", "t.t_ordinal")
    f = f.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_candidates + 1).groupBy("kind", "tag", "key").agg(F.collect_list("t").alias("targets"))
    full = F.size(F.array_distinct(F.transform("targets", lambda t: F.struct(t["t_path"], t["t_ordinal"])))) > max_candidates
    f = written(f.select("kind", "tag", "key", full.alias("full"), F.when(~full, F.col("targets")).alias("targets")), "targets")
    s = by_merge(subjects, moves.select(F.col("old_path").alias("path"), F.col("new_path").alias("moved")), "path", "left")
    ask = lambda df, *columns: df.select(*columns, tagged(*own, ("path", "moved"))).select(*columns, "_k.tag", "_k.key").where(F.col("key").isNotNull())
    many = by_merge(ask(s, *SUBJECT, "kind"), f.where("full").select("kind", "tag", "key"), ["kind", "tag", "key"], "left_semi").select(*SUBJECT).distinct()
    many = written(many, "many")
    rest = by_merge(s, many, SUBJECT, "left_anti")
    c = by_merge(ask(rest, *s.columns), f.where("NOT full"), ["kind", "tag", "key"]).select(*s.columns, F.explode("targets").alias("t")).select(*s.columns, "t.*")
    same_path, same_name = F.col("t_path") == F.col("path"), (F.col("t_name") == F.col("name")) & (F.col("t_qualified_name") == F.col("qualified_name"))
    same_text = F.col("t_declaration") == F.col("declaration")
    exact = same_path & same_name & same_text
    renamed = same_path & (F.col("t_container") == F.col("container")) & (F.col("t_name") != F.col("name")) & F.coalesce(F.col("t_name_elided") == F.col("name_elided"), F.lit(False))
    moved = ~same_path & F.coalesce(F.col("t_path") == F.col("moved"), F.lit(False)) & same_name & same_text
    changed = same_path & same_name & ~same_text
    step = F.when(exact, 0).when(renamed | moved, 1).when(changed, 2).otherwise(3)
    c = c.withColumns({"step": step, "relation": F.when(exact, "exact").when(renamed, "renamed").when(moved, "moved").when(changed, "changed").otherwise("plausible")})
    c = c.groupBy(*SUBJECT, "t_path", "t_ordinal").agg(F.min(F.struct("step", "relation")).alias("b")).select(*SUBJECT, "t_path", "t_ordinal", "b.*")
    at = F.array(*[F.count_if(F.col("step") == k) for k in range(4)]).alias("at")
    n = c.groupBy(*SUBJECT).agg(F.count("*").alias("candidates"), F.min("step").alias("first"), at, F.min(F.struct("step", "t_path", "t_ordinal", "relation")).alias("t"))
    n = n.select(*SUBJECT, "candidates", "first", F.element_at("at", F.col("first") + 1).alias("targets"), "t")
    n = n.unionByName(many.withColumn("candidates", F.lit(max_candidates + 1).cast("long")), allowMissingColumns=True)
    r = by_merge(s.select(*SUBJECT, "name_elided").distinct(), n, SUBJECT, "left")
    over = F.col("candidates") > max_candidates
    outcome = (
        F.when(over, "indeterminate")
        .when(F.col("first").isNull(), F.when(F.col("name_elided").isNull(), "indeterminate").otherwise("missing"))
        .when((F.col("targets") > 1) | (F.col("first") == 3), "needs_review")
        .when(F.col("first") == 0, "exact")
        .when(F.col("first") == 1, "corresponded")
        .otherwise("changed")
    )
    one = ~F.coalesce(over, F.lit(False)) & (F.col("targets") == 1) & (F.col("first") < 3)
    return r.select(*SUBJECT, outcome.alias("outcome"), F.when(one, F.col("t.relation")).alias("relation"), F.when(one, F.col("t.t_path")).alias("target_path"), F.when(one, F.col("t.t_ordinal")).alias("target_ordinal"), F.least(F.coalesce("candidates", F.lit(0)), F.lit(max_candidates + 1)).cast("long").alias("candidates"))


def reject_many_to_one(items: DataFrame) -> DataFrame:
    """Within a record, an automatically assured item whose target another item shares needs review, as ``merged``."""
    shared = items.where(F.col("target_path").isNotNull()).groupBy("record_id", "target_path", "target_ordinal").agg(F.count("*").alias("_n"))
    j = by_merge(items, shared, ["record_id", "target_path", "target_ordinal"], "left")
    merged = (F.col("_n") > 1) & F.col("relation").isin("renamed", "moved")
    return j.withColumns({"outcome": F.when(merged, "needs_review").otherwise(F.col("outcome")), "relation": F.when(merged, "merged").otherwise(F.col("relation"))}).drop("_n")


def fold_evidence(records: DataFrame, items: DataFrame) -> DataFrame:
    """(record_id, effective_state, evidence_state, resolved, review, indeterminate).

    A lifecycle other than active passes through; procedures of schema version 2 need review; a record that isn't valid takes
    its state from its validity; else its worst evidence decides. ``records``: record_id, kind, schema_version, lifecycle, validity."""
    rank = reduce(lambda a, kv: a.when(F.col("outcome") == kv[1][0], kv[0]), enumerate(EVIDENCE_ORDER), F.when(F.lit(False), F.lit(0)))
    count = lambda *o: F.sum(F.when(F.col("outcome").isin(*o), 1).otherwise(0))
    by = items.groupBy("record_id").agg(F.min(rank).alias("worst"), count("exact", "corresponded").alias("resolved"), count("needs_review").alias("review"), count("indeterminate").alias("indeterminate"))
    r = by_merge(records, by, "record_id", "left").fillna(0, ["resolved", "review", "indeterminate"]).withColumn("worst", F.coalesce("worst", F.lit(len(EVIDENCE_ORDER) - 1)))
    state = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in EVIDENCE_ORDER]), F.col("worst") + 1)
    active, valid = F.col("lifecycle") == "active", F.col("validity") == "valid"
    gated = (F.col("schema_version") == 2) & (F.col("kind") == "procedure")
    effective = F.when(~active, F.col("lifecycle")).when(gated, "needs_review").when(~valid, F.col("validity")).otherwise(state(1))
    judged = active & ~gated & valid
    zero = lambda c: F.when(judged, F.col(c)).otherwise(0).alias(c)
    return r.select("record_id", effective.alias("effective_state"), F.when(judged, state(2)).otherwise("not_evaluated").alias("evidence_state"), zero("resolved"), zero("review"), zero("indeterminate"))


def revalidate(versions, approvals, parents, records, checks, subjects, facts, moves, snapshot=None) -> DataFrame:
    """The whole projection: heads, validity, correspondence, many-to-one, folding; one row a record. What several steps read
    is written in between, so that no step is planned twice."""
    heads = written(select_heads(versions, approvals, parents), "heads")
    selected = heads.where(F.col("outcome") == "selected").select("record_id", "revision")
    live = by_merge(records, selected, ["record_id", "revision"], "left_semi")
    live = written(by_merge(live, project_validity(live, checks, snapshot), "record_id"), "live")
    judged = written(by_merge(subjects, live.where((F.col("validity") == "valid") & (F.col("lifecycle") == "active")), "record_id", "left_semi"), "subjects")
    items = written(reject_many_to_one(written(correspondence(judged, facts, moves), "items")), "items")
    folded = fold_evidence(live, items)
    state = F.coalesce("effective_state", F.col("outcome"))
    return by_merge(heads, folded, "record_id", "left").select("record_id", "revision", state.alias("effective_state"), F.coalesce("evidence_state", F.lit("not_evaluated")).alias("evidence_state"), "resolved", "review", "indeterminate")


def memory_recall(projection: DataFrame, query: str | None = None, limit: int = 50, *, made_for: object = None, active: object = None) -> tuple[Bounded, DataFrame]:
    """Records whose title or body holds every term (A-Z folded only), in record order; and counts by state. A projection
    ``made_for`` another generation than the ``active`` one is an error: it may not tell what is current."""
    if made_for != active:
        raise LookupError("the projection was made for another generation")
    rows = projection
    for t in query_terms(query) if query else []:
        rows = rows.where(F.instr(ascii_lower(F.concat_ws("\n", "title", "body")), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) > 0)
    return bounded(rows, ["record_id"], limit), rows.groupBy("effective_state").agg(F.count("*").alias("records"))


def known_at(audit: DataFrame, moment: object, limit: int = 100) -> Bounded:
    """What was known at a moment: observations recorded by then whose revision had been approved by then."""
    past = audit.where(F.col("recorded_at") <= F.lit(moment))
    approved = past.where(F.col("operation") == "locally_approved").select("record_id", "revision").distinct()
    return bounded(past.where(F.col("operation") == "observed").join(approved, ["record_id", "revision"], "left_semi"), ["recorded_at", "event_id"], limit)


def history_union(observations: DataFrame, reviews: DataFrame) -> DataFrame:
    return observations.withColumn("entry", F.lit("observation")).unionByName(reviews.withColumn("entry", F.lit("correspondence")), allowMissingColumns=True)


def first_approvals(audit: DataFrame) -> DataFrame:
    """The display revision of each revision's first approval."""
    a = audit.where(F.col("operation") == "locally_approved")
    return a.groupBy("record_id", "revision").agg(F.min_by("display_revision", "event_id").alias("display_revision"))


def sync_fence(incoming: DataFrame, heads: DataFrame) -> DataFrame:
    """Incoming revisions that don't name every unresolved head as parent: must be empty to sync. ``incoming``: record_id,
    revision, parents (array); ``heads``: record_id, head."""
    named = incoming.join(heads, "record_id")
    return named.where(~F.array_contains("parents", F.col("head"))).select("record_id", "revision", "head")


def latest_checkpoints(checkpoints: DataFrame, verifications: DataFrame | None = None, limit: int = 100) -> Bounded:
    """The last checkpoint of each task by its sequence, with how many verifications the task has."""
    last = checkpoints.groupBy("task_id").agg(F.max("sequence").alias("sequence"), F.max_by("status", "sequence").alias("status"))
    if verifications is not None:
        n = verifications.groupBy("task_id").agg(F.count("*").alias("verifications"))
        last = last.join(n, "task_id", "left").fillna(0, ["verifications"])
    return bounded(last, ["task_id"], limit)


def sequence_gaps(checkpoints: DataFrame) -> DataFrame:
    """Tasks whose sequence isn't 1, 2, ...: must be empty."""
    return checkpoints.groupBy("task_id").agg(F.count("*").alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.countDistinct("sequence").alias("d")).where((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("d") != F.col("n")))


def personal_memory(notes: DataFrame, profile: str, repository: str) -> DataFrame:
    w = Window.partitionBy("record_id").orderBy(F.desc("revision"))
    own = notes.where((F.col("profile") == profile) & (F.col("repository") == repository))
    return own.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n").orderBy("recorded_at", "record_id", "revision")
