"""Maps, overviews and topology of a generation; syntax sites and test markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_packages, top_directory, topology_category
from .results import Bounded, bounded, within_bytes
from .spans import contained

LANGUAGE_ORDER = ("rust", "go", "typescript", "tsx", "python")


def complete_files(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files of a generation with their complete artifacts (equal content)."""
    a = artifacts.where(F.col("lifecycle_state") == "complete").select("artifact_digest", F.col("content_digest").alias("_c"), "fact_count", "language")
    return files.join(a, "artifact_digest").where(F.col("_c") == F.col("content_digest")).drop("_c")


def architecture_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("fact_count"), F.lit(0)).cast("long").alias("facts"))


def language_map(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("fact_count").cast("long").alias("facts")).orderBy("language")


def architecture_map(files: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame, Bounded]:
    """Totals, counts by language, and the first files by path."""
    if not 1 <= limit <= 1000:
        raise ValueError("1 to 1,000 files")
    return architecture_totals(files), language_map(files), bounded(files.select("path", "language", "fact_count", "content_digest"), ["path"], limit)


def kind_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("language", "kind").agg(F.count("*").alias("facts"))


def source_roots(files: DataFrame, limit: int = 100) -> Bounded:
    """Files and facts by top-level directory; files at the root are the null group, which comes first."""
    by = files.groupBy(top_directory(F.col("path")).alias("root")).agg(F.count("*").alias("files"), F.sum("fact_count").cast("long").alias("facts"))
    return bounded(by, [F.asc_nulls_first("root")], limit)


def entry_points(facts: DataFrame, limit: int = 100) -> Bounded:
    """Functions named exactly main, as candidates."""
    return bounded(facts.where((F.col("kind") == "function") & (F.col("name") == "main")), ["path", "ordinal"], limit)


def architecture_overview(files: DataFrame, facts: DataFrame, roots: int = 100, entries: int = 100, max_bytes: int | None = None) -> dict[str, DataFrame | Bounded]:
    """Totals, counts by language and by kind, source roots and entry points. Roots and entry points share ``max_bytes``:
    roots come first, each list in its order; what no longer fits is left out and counted as omitted."""
    totals, languages, _ = architecture_map(files)
    r, e = source_roots(files, roots), entry_points(facts, entries)
    if max_bytes is not None:
        sizes = lambda b, cols: sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in cols), F.lit(ITEM_BYTES)).cast("long")
        first = within_bytes(r.rows, sizes(r, ["root"]), max_bytes, [F.asc_nulls_first("root")])
        used = first.agg(F.coalesce(F.sum(sizes(r, ["root"])), F.lit(0))).first()[0]
        cut = first.count() < r.receipt.first()["returned"]
        second = within_bytes(e.rows, sizes(e, ["path", "name"]), 0 if cut else max_bytes - used, ["path", "ordinal"])
        r, e = (Bounded(rows, _shorter(b.receipt, rows)) for b, rows in ((r, first), (e, second)))
        r, e = Bounded(r.rows.orderBy(F.asc_nulls_first("root")), r.receipt), Bounded(e.rows.orderBy("path", "ordinal"), e.receipt)
    return {"totals": totals, "languages": languages, "kinds": kind_counts(facts), "roots": r, "entry_points": e}


#: Fixed value: bytes that an item of a list takes beside its texts.
ITEM_BYTES = 64


def _shorter(receipt: DataFrame, rows: DataFrame) -> DataFrame:
    n = rows.agg(F.count("*").alias("n"))
    return receipt.crossJoin(n).select("total", F.col("n").alias("returned"), (F.col("total") - F.col("n")).alias("omitted"), "availability")


def topology(paths: DataFrame, packages: list[str] | None = None) -> DataFrame:
    """(path, category) of every discovered path in scope."""
    return paths.where(in_packages(F.col("path"), packages)).select("path", topology_category(F.col("path")).alias("category"))


def topology_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("category").agg(F.count("*").alias("paths"))


def outbound_sites(sites: DataFrame, declaration: dict[str, object], limit: int = 100) -> Bounded:
    """Raw sites whose occurrence lies inside one exact declaration: artifact_digest, decl_start, decl_end."""
    inside = (F.col("artifact_digest") == declaration["artifact_digest"]) & (F.col("start") >= declaration["decl_start"]) & (F.col("end") <= declaration["decl_end"])
    return bounded(sites.where(inside), ["ordinal"], limit)


def sites_by_declaration(sites: DataFrame, facts: DataFrame) -> DataFrame:
    """Every (declaration, site inside it), by a join on the artifact and cells of spans."""
    f = facts.select("artifact_digest", F.col("ordinal").alias("fact_ordinal"), "decl_start", "decl_end")
    s = sites.select("artifact_digest", F.col("ordinal").alias("site_ordinal"), "site_kind", "raw_target", "start", "end")
    return contained(s, f, ["artifact_digest"], outer=("decl_start", "decl_end"))


def syntax_site_search(sites: DataFrame, raw_target: str, limit: int = 100) -> Bounded:
    """Sites with exactly this target, case-sensitive, in all files."""
    return bounded(sites.where(F.col("raw_target") == raw_target), ["path", "ordinal"], limit)


def marker_support(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """By language: files whose extractor supports test markers, those that don't (not the same as none), markers emitted."""
    a = artifacts.select("artifact_digest", "test_marker_support", "test_marker_emitted")
    on = F.col("test_marker_support") == "supported"
    by = files.join(a, "artifact_digest").groupBy("language").agg(
        F.sum(F.when(on, 1).otherwise(0)).alias("supported"), F.sum(F.when(on, 0).otherwise(1)).alias("unsupported"), F.sum(F.when(on, F.col("test_marker_emitted")).otherwise(0)).cast("long").alias("emitted")
    )
    order = F.array_position(F.array(*map(F.lit, LANGUAGE_ORDER)), F.col("language"))
    return by.orderBy(F.when(order == 0, 99).otherwise(order), "language")


def test_markers(sites: DataFrame, language: str | None = None, path_prefix: str | None = None, limit: int = 100) -> Bounded:
    rows = sites.where(F.col("site_kind") == "test_marker")
    rows = rows if language is None else rows.where(F.col("language") == language)
    rows = rows if not path_prefix else rows.where(F.col("path").startswith(path_prefix))
    return bounded(rows, ["path", "ordinal"], limit)


def code_graph_query(request: dict, **frames: DataFrame):
    """Dispatches one of the tagged requests symbol_search, outbound_sites, syntax_site_search, architecture_overview,
    architecture_map, test_markers, relevant_paths to its operator."""
    from . import search

    kind, args = request["kind"], {k: v for k, v in request.items() if k != "kind"}
    if kind == "symbol_search":
        return search.symbol_search(frames["facts"], **args)
    if kind == "outbound_sites":
        return outbound_sites(frames["sites"], **args)
    if kind == "syntax_site_search":
        return syntax_site_search(frames["sites"], **args)
    if kind == "architecture_overview":
        return architecture_overview(frames["files"], frames["facts"], **args)
    if kind == "architecture_map":
        return architecture_map(frames["files"], **args)
    if kind == "test_markers":
        return test_markers(frames["sites"], **args)
    if kind == "relevant_paths":
        limit = args.pop("max_paths", 12)
        hits = search.code_search(frames["facts"], args["query"], min(100, 4 * limit)).rows.join(frames["files"].select("path", "content_digest"), "path")
        return search.relevant_paths(hits, limit)
    raise ValueError(f"no such query: {kind}")
