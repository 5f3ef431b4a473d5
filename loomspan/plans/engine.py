"""Indexing of repositories into generations, and the query catalogue over the active one."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import artifact_digest, frame_digest
from ..operators import architecture, context, graph, graph_delta, manifests, overlay, retention, search, trace
from ..operators.shared import released, written
from ..operators.results import Bounded
from ..sources import extract, files, scip
from .analysis_store import AnalysisStore
from .catalog import Catalog
from .memory_store import MemoryStore

PRODUCER, CONFIGURATION, SCHEMA = "loomspan.extract", "default", "2"


class Engine:
    """One catalog. ``index`` publishes a generation of a slot; every query reads the generation that is active when it starts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog, self.root = spark, Catalog(spark, root), root.rstrip("/")
        self.analyses = AnalysisStore(spark, f"{self.root}/analyses")

    # -- indexing

    def index(self, slot: str, root: str, *, packages: list[str] | None = None, max_bytes: int = 8 << 20, max_attempts: int = 3, revision: str | None = None, ref: str | None = None) -> dict:
        """Reads a tree and publishes it: "published", or "unchanged" if its manifest is the active one's. Analyses are keyed by
        content and kept beside the generations, so only contents that no generation of any slot has analysed are parsed and written; equal
        files are parsed once. If the source
        changes meanwhile, its manifest or its repository's state, the fence refuses and it starts again. ``revision`` or
        ``ref`` name the commit that must be checked out, before and, by the fence, after. ``omitted``: files over ``max_bytes``,
        which the generation lists in its table omitted."""
        local = "://" not in root
        wanted = files.resolve_selector(root, revision=revision, ref=ref) if local else None
        if wanted is not None and files.source_state(root)["head"] != wanted:
            raise ValueError("another commit is checked out")
        for _ in range(max_attempts):
            now, state = self.catalog.pointer(slot), files.source_state(root) if local else None
            tree = files.read_tree(self.spark, root, packages=packages, max_bytes=max_bytes)
            key = artifact_digest(F.concat_ws("/", "content_digest", F.coalesce("language", F.lit("-"))), PRODUCER, CONFIGURATION, SCHEMA)
            tree = tree.withColumn("artifact_digest", key)
            manifest = tree.select("path", "content_digest", "artifact_digest", "language", "size")
            omitted = files.omitted_files(self.spark, root, packages=packages, max_bytes=max_bytes)
            digest = self._digest(manifest, omitted)
            old = self.catalog.read(slot, "snapshot")
            if old is not None and old.first()["digest"] == digest:
                return {"outcome": "unchanged", "digest": digest}
            gen = uuid.uuid4().hex
            with released():
                counts = self._stage(slot, gen, tree, manifest, omitted, digest, now)

            def again() -> bool:
                if local and (files.source_state(root) != state or files.resolve_selector(root, revision=revision, ref=ref) != wanted):  # noqa: B023
                    return False
                tree = files.read_tree(self.spark, root, packages=packages, max_bytes=max_bytes).withColumn("artifact_digest", key)  # noqa: B023
                return self._digest(tree.select(*manifest.columns), omitted) == digest  # noqa: B023

            outcome = self.catalog.publish(slot, gen, base=now["epoch"] if now else 0, fence=again, validators=self._validate)
            if outcome != "changed":
                return {"outcome": outcome, "generation": gen, "digest": digest, "omitted": self.catalog.staged(slot, gen)["omitted"].count()} | counts
        return {"outcome": "changed"}

    @staticmethod
    def _digest(manifest: DataFrame, omitted: DataFrame) -> str:
        """Of what a generation is made from: its files, and those left out."""
        found, out = frame_digest(manifest).first()["digest"], frame_digest(omitted).first()
        return found if not out["rows"] else hashlib.sha256((found + out["digest"]).encode()).hexdigest()

    def _stage(self, slot: str, gen: str, tree: DataFrame, manifest: DataFrame, omitted: DataFrame, digest: str, base: dict | None) -> dict:
        self.catalog.stage(slot, gen, {"files": manifest})
        manifest = self.catalog.staged(slot, gen)["files"]
        plan = written(manifests.reuse_plan(manifest, self.analyses.known().withColumn("lifecycle_state", F.lit("complete"))), "plan")
        todo = manifest.join(plan.where("action = 'analyze'").select("artifact_digest").distinct(), "artifact_digest", "left_semi")
        first = todo.groupBy("artifact_digest").agg(F.min("path").alias("path"))
        source = tree.select("path", "content", "content_digest", "language", "artifact_digest").join(first, ["artifact_digest", "path"], "left_semi")
        digest_of = source.select("path", "artifact_digest")
        done = lambda **tables: self.catalog.stage(slot, gen, tables)
        done(analyses=extract.analyses(source))
        analysed = self.catalog.staged(slot, gen)["analyses"]
        parsed = extract.name_elided_digests(extract.facts(analysed), source)
        new = {
            "facts": parsed.join(digest_of, "path").drop("path"),
            "sites": extract.sites(analysed).join(digest_of, "path").drop("path"),
            "errors": extract.errors(analysed).join(digest_of, "path").select("artifact_digest", F.col("errors").alias("syntax_error_nodes")),
        }
        self.analyses.add(digest_of, new)
        log, m = self.analyses.log.snapshot(), manifest.select("path", "artifact_digest")
        one = m.select("artifact_digest").distinct()
        held = {name: self.analyses.read(name, one, log) for name in new}
        if held["facts"] is None:  # nothing was ever analysed: the tables are there, and empty
            held = {name: df.limit(0) for name, df in new.items()}
            done(facts=held["facts"].join(m, "artifact_digest"), sites=held["sites"].join(m, "artifact_digest"))
        facts, all_sites = held["facts"].join(m, "artifact_digest"), held["sites"].join(m, "artifact_digest")
        counts = held["facts"].groupBy("artifact_digest").agg(F.count("*").alias("fact_count"))
        markers = held["sites"].where("site_kind = 'test_marker'").groupBy("artifact_digest").agg(F.count("*").alias("test_marker_emitted"))
        supported = F.when(F.col("language") == "rust", "supported").otherwise("unsupported")
        arts = manifest.groupBy("artifact_digest").agg(F.min("content_digest").alias("content_digest"), F.min("language").alias("language")).join(counts, "artifact_digest", "left").join(markers, "artifact_digest", "left").join(held["errors"], "artifact_digest", "left")
        arts = arts.fillna(0, ["fact_count", "test_marker_emitted", "syntax_error_nodes"]).withColumns({"lifecycle_state": F.lit("complete"), "test_marker_support": supported})
        done(artifacts=arts, topology=architecture.topology(manifest))
        defs = facts.where("language = 'rust'").select(F.lit(slot).alias("slot"), "path", "ordinal", "kind", "name", "qualified_name")
        sites = all_sites.where("language = 'rust'").select(F.lit(slot).alias("slot"), "path", F.col("ordinal").alias("site_ordinal"), F.col("site_kind").alias("kind"), "raw_target", "enclosing", "enclosing_kind", "evidence")
        with released():
            res, cand, keys = self._resolve(slot, base, manifest, defs, sites)
            done(resolutions=res, candidates=cand, site_keys=keys)
        done(definitions=defs, postings=search.postings(facts).orderBy("term"), document_stats=search.document_stats(facts))
        t = self.catalog.staged(slot, gen)
        edges, open_ = graph.edges_of(sites, t["resolutions"], t["candidates"], defs)
        edges = edges.join(sites.select(*graph.SITE, F.col("evidence").alias("extraction")), graph.SITE)
        text = lambda *c: F.concat_ws("#", *c)
        edges = edges.select(text("path", "source_ordinal").alias("source"), text("target_path", "target_ordinal").alias("target"), text("path", "site_ordinal").alias("site"), "edge_kind", F.col("evidence").alias("resolution_evidence"), F.col("extraction").alias("extraction_evidence"), (F.col("outcome") == "ambiguous").alias("ambiguous"), (F.col("evidence") == "exact_name_heuristic").alias("heuristic"))
        snapshot = self.spark.createDataFrame([(digest, PRODUCER, CONFIGURATION, SCHEMA)], "digest string, producer string, configuration string, schema string")
        done(edges=edges, uncovered=open_, snapshot=snapshot, omitted=omitted)
        by = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
        return {"reused": by.get("reuse", 0), "analyzed": by.get("analyze", 0)}

    def _resolve(self, slot: str, base: dict | None, manifest: DataFrame, defs: DataFrame, sites: DataFrame) -> graph_delta.Graph:
        """The graph, from that of the generation ``base`` where it has one: then only what depends on files that differ is resolved."""
        old = self.catalog.staged(slot, base["generation"]) if base else {}
        if not {"files", "definitions", "resolutions", "candidates", "site_keys"} <= old.keys():
            return graph_delta.resolve_all(defs, sites)
        a, b = (df.select("path", "artifact_digest") for df in (old["files"], manifest))
        differ = a.exceptAll(b).unionAll(b.exceptAll(a)).select(F.lit(slot).alias("slot"), "path")
        previous = graph_delta.Graph(old["resolutions"], old["candidates"], old["site_keys"])
        return graph_delta.resolve_changes(previous, old["definitions"], defs, sites, differ).graph

    def _analysed(self, files: DataFrame, name: str) -> DataFrame | None:
        """Facts or sites of a list of files, from the analyses that all generations share."""
        return self.analyses.read(name, files.drop(*[c for c in files.columns if c not in ("slot", "path", "artifact_digest")]))

    def sweep(self, grace_s: float = 86_400) -> dict[str, int]:
        """Takes analyses out that no generation of any slot lists, unfinished ones included, and deletes the files of
        those that went at least ``grace_s`` ago."""
        lists = [t["files"] for s in self.catalog._names("generations") for g in self.catalog._names(f"generations/{s}") if "files" in (t := self.catalog.staged(s, g))]
        return self.analyses.sweep(lists) | {"deleted": self.analyses.log.vacuum(grace_s)}

    def _validate(self, t: dict[str, DataFrame]) -> DataFrame:
        t = t if "facts" in t else t | {"facts": self._analysed(t["files"], "facts")}
        return retention.violations(
            paths=retention.repeated_keys(t["files"], ["path"]),
            artifacts=retention.orphans(t["files"], t["artifacts"], ["artifact_digest"]),
            facts=retention.repeated_keys(t["facts"], ["path", "ordinal"]),
            resolutions=retention.orphans(t["candidates"], t["resolutions"], graph.SITE),
        )

    # -- queries

    def table(self, slot: str, name: str) -> DataFrame:
        df = self.catalog.read(slot, name)
        if df is None and name in ("facts", "sites") and (listed := self.catalog.read(slot, "files")) is not None:
            df = self._analysed(listed, name)
        if df is None:
            raise LookupError(f"{slot}: {name} was not produced")
        return df

    def _complete(self, slot: str) -> DataFrame:
        return architecture.complete_files(self.table(slot, "files").select("path", "content_digest", "artifact_digest"), self.table(slot, "artifacts"))

    def code_search(self, slot: str, query: str, limit: int = 20) -> Bounded:
        return search.code_search(self.table(slot, "facts"), query, limit, index=self.table(slot, "postings"), stats=self.table(slot, "document_stats"))

    def symbol_search(self, slot: str, name: str, **options) -> Bounded:
        return search.symbol_search(self.table(slot, "facts"), name, **options)

    def relevant_paths(self, slot: str, query: str, max_paths: int = 12) -> DataFrame:
        hits = self.code_search(slot, query, min(100, 4 * max_paths)).rows.join(self.table(slot, "files").select("path", "content_digest"), "path")
        return search.relevant_paths(hits, max_paths)

    def architecture_map(self, slot: str, limit: int = 200):
        return architecture.architecture_map(self._complete(slot), limit)

    def architecture_overview(self, slot: str, **options):
        return architecture.architecture_overview(self._complete(slot), self.table(slot, "facts"), **options)

    def repository_topology(self, slot: str) -> DataFrame:
        return architecture.topology_counts(self.table(slot, "topology"))

    def outbound_sites(self, slot: str, path: str, ordinal: int, limit: int = 100) -> Bounded:
        f = self.table(slot, "facts").where((F.col("path") == path) & (F.col("ordinal") == ordinal)).first()
        if f is None:
            raise LookupError("no such declaration")
        return architecture.outbound_sites(self.table(slot, "sites").where(F.col("path") == path), f.asDict(), limit)

    def syntax_site_search(self, slot: str, raw_target: str, limit: int = 100) -> Bounded:
        return architecture.syntax_site_search(self.table(slot, "sites"), raw_target, limit)

    def test_markers(self, slot: str, **options) -> tuple[Bounded, DataFrame]:
        support = architecture.marker_support(self.table(slot, "files").select("path", "artifact_digest", "language"), self.table(slot, "artifacts").where("language is not null"))
        return architecture.test_markers(self.table(slot, "sites"), **options), support

    def graph_status(self, slot: str) -> Bounded:
        return graph.graph_status(self.table(slot, "snapshot"), self.table(slot, "resolutions"), self.table(slot, "candidates"))

    def graph_search(self, slot: str, query: str, limit: int = 100) -> Bounded:
        return graph.graph_search(self.table(slot, "definitions"), query, limit)

    def graph_evidence(self, slot: str, path: str, site_ordinal: int) -> DataFrame:
        return graph.graph_evidence(self.table(slot, "resolutions"), self.table(slot, "candidates"), {"slot": slot, "path": path, "site_ordinal": site_ordinal})

    def graph_architecture(self, slot: str) -> DataFrame:
        return graph.graph_architecture(self.table(slot, "definitions"), self.table(slot, "edges"))

    def graph_trace(self, slot: str, path: str, ordinal: int, direction: str = "outbound", **options) -> trace.Trace:
        return trace.graph_trace(self.table(slot, "edges"), [f"{path}#{ordinal}"], direction, **options)

    def impact_analyze(self, slot: str, path: str, ordinal: int, **options) -> tuple[DataFrame, bool]:
        return trace.impact_analyze(self.table(slot, "edges"), f"{path}#{ordinal}", **options)

    def diagnostics(self, slot: str) -> DataFrame:
        g = self.spark.createDataFrame([(self.catalog.pointer(slot)["generation"],)], "generation_id string")
        return retention.diagnostics(g, self.table(slot, "files").select("path", "artifact_digest").crossJoin(g), self.table(slot, "artifacts"))

    def changes(self, slot: str, root: str) -> DataFrame:
        """The work tree against the active generation; a new path is added if the repository's index has it, else untracked."""
        now = files.read_tree(self.spark, root).select("path", "content_digest", F.lit("file").alias("file_kind"))
        base = self.table(slot, "files").select("path", "content_digest", F.lit("file").alias("file_kind"))
        tracked = files.git_paths(self.spark, root, cached=True).select("path") if files.is_repository(root) else now.select("path").limit(0)
        return manifests.change_manifest(base, now, tracked)

    def verify(self, slot: str, root: str) -> tuple[DataFrame, DataFrame]:
        """(changes, status) of the work tree against the active generation."""
        of = lambda df: frame_digest(df.select("path", "content_digest")).first()["digest"]
        index = self.catalog.read(slot, "files")
        changes = self.changes(slot, root) if index is not None else files.read_tree(self.spark, root).select("path", F.lit("added").alias("change"))
        return manifests.change_review(changes, index and of(index), of(files.read_tree(self.spark, root)))

    def symbol_get(self, slot: str, root: str, path: str, ordinal: int, **pins) -> DataFrame:
        """One declaration with its source, re-read from the tree; ``pins`` are further columns that must hold, as its
        content_digest."""
        one = self.table(slot, "facts").where(F.col("path") == path).join(self.table(slot, "files").select("path", "content_digest"), "path", "left_semi")
        held = files.read_tree(self.spark, root, glob=path.rsplit("/", 1)[-1]).where(F.col("path") == path)
        return search.symbol_get(one, held, {"path": path, "ordinal": ordinal} | pins)

    def cross_repository_search(self, slots: list[str], query: str, limit: int = 20) -> search.CrossSearch:
        return search.cross_repository_search({s: self.table(s, "facts") for s in slots}, query, limit)

    def code_graph_query(self, slot: str, request: dict):
        return architecture.code_graph_query(request, files=self._complete(slot), facts=self.table(slot, "facts"), sites=self.table(slot, "sites"))

    def uncovered(self, slot: str) -> DataFrame:
        """Candidate edges whose site lies in no declaration: what traces can't cover."""
        return self.table(slot, "uncovered")

    # -- precise indexes

    def scip_import(self, slot: str, index: str, root: str) -> dict:
        """Takes a precise index in for the active generation: its documents must be files of it with the same content, their
        ranges must lie in them; otherwise nothing is published. Derives the enclosed references, stages and activates."""
        p, overlay_slot, gen = self.catalog.pointer(slot), f"{slot}.overlay", uuid.uuid4().hex
        if p is None:
            raise LookupError(f"{slot}: no generation to import for")
        base = self.catalog.pointer(overlay_slot)
        raw, declared = scip.read_index(self.spark, index)
        tree = files.read_tree(self.spark, root).select("path", "content", "content_digest")
        occ = scip.with_spans(raw, tree)
        self.catalog.stage(overlay_slot, gen, {"all_occurrences": occ})
        occ = self.catalog.staged(overlay_slot, gen)["all_occurrences"]
        if bad := occ.where("problem is not null").select("path", "occurrence_ordinal", "problem").limit(5).collect():
            raise ValueError(f"occurrences without a place: {[tuple(b) for b in bad]}")
        docs = occ.select("path", "document_ordinal").unionAll(declared.select("path", "document_ordinal")).distinct().join(tree.select("path", "content_digest"), "path", "left")
        docs = docs.withColumn("overlay_digest", F.lit(gen))
        if bad := overlay.validate_import(docs, self.table(slot, "files")).select("path").limit(5).collect():
            raise ValueError(f"documents that the generation doesn't hold: {[b[0] for b in bad]}")
        key = F.lit(gen).alias("overlay_digest")
        occ = occ.drop("problem").withColumn("overlay_digest", key)
        declared = declared.withColumn("overlay_digest", key)
        derived = overlay.enclosed_reference_edges(occ, overlay.enclosing_functions(occ, self.table(slot, "facts")), declared)
        self.catalog.stage(overlay_slot, gen, {"documents": docs, "occurrences": occ, "relationships": overlay.all_relationships(declared, derived), "made_for": self.spark.createDataFrame([(p["generation"],)], "generation string")})
        outcome = self.catalog.publish(overlay_slot, gen, base=base["epoch"] if base else 0, fence=lambda: self.catalog.pointer(slot)["generation"] == p["generation"])
        t = self.catalog.staged(overlay_slot, gen)
        return {"outcome": outcome, "documents": t["documents"].count(), "occurrences": t["occurrences"].count(), "relationships": t["relationships"].count()}

    def overlay(self, slot: str, name: str) -> DataFrame:
        """A table of the active overlay, which must have been made for the active generation."""
        made_for = self.catalog.read(f"{slot}.overlay", "made_for")
        if made_for is None or made_for.first()["generation"] != self.catalog.pointer(slot)["generation"]:
            raise LookupError(f"{slot}: no overlay for the active generation")
        return self.catalog.read(f"{slot}.overlay", name)

    def scip_evidence(self, slot: str, symbol: str, limit: int = 100) -> tuple[Bounded, Bounded]:
        return overlay.scip_evidence(self.overlay(slot, "occurrences"), self.overlay(slot, "relationships"), symbol, limit)

    def scip_symbol_resolve(self, slot: str, path: str, start: int, end: int) -> DataFrame:
        return overlay.scip_symbol_resolve(self.overlay(slot, "occurrences"), path, start, end)

    def scip_relationship_trace(self, slot: str, symbol: str, **options):
        return overlay.scip_relationship_trace(self.overlay(slot, "relationships"), symbol, **options)

    # -- memory, context, retention, views

    def memory(self, workspace: str = "default") -> MemoryStore:
        return MemoryStore(self.spark, f"{self.root}/memory/{workspace}")

    def memory_revalidate(self, slot: str, checks: DataFrame, moves: DataFrame | None = None, snapshot: str | None = None, workspace: str = "default") -> str:
        """The memory's projection against the active generation's declarations."""
        p = self.catalog.pointer(slot)
        facts = self.table(slot, "facts").withColumn("container", F.regexp_extract("qualified_name", "^(.*)::[^:]*$", 1))
        moves = self.spark.createDataFrame([], "old_path string, new_path string") if moves is None else moves
        return self.memory(workspace).revalidate(facts, moves, checks, p["generation"], snapshot, fence=lambda: self.catalog.pointer(slot)["generation"] == p["generation"])

    def memory_recall(self, slot: str, query: str | None = None, limit: int = 50, workspace: str = "default") -> tuple[Bounded, DataFrame]:
        return self.memory(workspace).recall(self.catalog.pointer(slot)["generation"], query, limit)

    def context(self, slot: str, query: str, budget: int, *, anchor: dict | None = None, max_paths: int = 48, workspace: str = "default") -> tuple[list[dict], dict[str, int], int]:
        """A context for a query within a budget of units (256 bytes of a declaration each): search hits, what their declarations
        are connected with in the graph, and current memory."""
        hits = self.code_search(slot, query, min(100, max_paths)).rows
        span = self.table(slot, "facts").select("path", "ordinal", (F.ceil((F.col("decl_end") - F.col("decl_start")) / 256)).cast("long").alias("units"))
        name = lambda: F.concat_ws("#", "path", "ordinal").alias("identity")
        from pyspark.sql import Window

        order = Window.orderBy("rank", "path", "ordinal")  # at most 100 hits
        syntax = hits.withColumn("place", F.row_number().over(order)).join(span, ["path", "ordinal"]).select(name(), F.col("place").alias("rank"), "units")
        edges = self.table(slot, "edges").join(syntax.select(F.col("identity").alias("source"), "rank"), "source")
        graph_ = edges.select(F.col("target").alias("identity"), "edge_kind", "rank").join(span.select(name(), "units"), "identity").groupBy("identity", "edge_kind", "units").agg(F.min("rank").alias("rank"))
        providers = {"syntax": syntax, "graph": graph_}
        try:
            rows, _ = self.memory_recall(slot, query, workspace=workspace)
            memory = rows.rows.select(F.col("record_id").alias("identity"), F.col("effective_state").alias("state"), F.ceil(F.octet_length("body") / 256).cast("long").alias("units"))
            providers["memory"] = memory.withColumn("rank", F.row_number().over(Window.orderBy("identity")))  # at most 50
        except LookupError:
            pass
        return context.evidence_context(context.fan_in(**providers), budget, anchor)

    def retention_plan(self, slots: list[str], keep: int = 2, pins: list[str] | None = None, budget: int | None = None) -> tuple[DataFrame, str]:
        """(plan, digest): what may go of the slots' retained generations, and the digest by which the plan is approved."""
        g = None
        for s in slots:
            own = self.catalog.generations(s)
            g = own if g is None else g.unionAll(own)
        held = self.spark.createDataFrame([(x,) for x in pins or []], "generation_id string")
        plan = retention.retention_plan(g, [self.catalog.pinned()], held, keep, budget)
        return plan, self.catalog.plan_digest(plan)

    def retention_apply(self, plan: DataFrame, digest: str) -> int:
        return self.catalog.apply_retention(plan, digest)

    def publish_view(self, view: str, slots: list[str], expected: dict[str, int] | None = None) -> str:
        return self.catalog.publish_view(view, slots, expected)

    def view(self, view: str, name: str) -> DataFrame:
        df = self.catalog.read_view(view, name)
        if df is None and name in ("facts", "sites") and (listed := self.catalog.read_view(view, "files")) is not None:
            df = self._analysed(listed, name)
        if df is None:
            raise LookupError(f"{view} was not published")
        return df

    def doctor(self, slot: str) -> DataFrame:
        """(check, rows): what is wrong with a slot, its catalog and the tables of its active generation."""
        found = self.spark.createDataFrame(sorted(self.catalog.doctor(slot).items()), "check string, rows long")
        return found.unionAll(self._validate({n: self.table(slot, n) for n in ("files", "artifacts", "facts", "candidates", "resolutions")}))

    def rebuild_search(self, slot: str) -> str:
        """A new generation with the search projection made again from the same facts, checked against the old, then switched."""
        p, gen = self.catalog.pointer(slot), uuid.uuid4().hex
        for name in p["tables"]:
            if name not in ("postings", "document_stats"):
                self.catalog.stage(slot, gen, {name: self.table(slot, name)})
        facts = self.table(slot, "facts")
        self.catalog.stage(slot, gen, {"postings": search.postings(facts).orderBy("term"), "document_stats": search.document_stats(facts)})
        check = lambda t: retention.violations(stats=retention.orphans(facts, t["document_stats"], ["path", "ordinal"]))
        return self.catalog.publish(slot, gen, validators=check)
