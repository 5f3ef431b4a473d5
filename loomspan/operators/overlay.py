"""Precise-index overlays: occurrences and relationships of symbols, and edges derived from enclosure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .results import Bounded, bounded, within_bytes
from .spans import innermost
from .trace import Limits, Trace, graph_trace

#: Bits of an occurrence's roles and of a relationship's kinds.
ROLES = {"definition": 1, "import": 2, "write_access": 4, "read_access": 8, "generated": 16, "test": 32, "forward_definition": 64}
KINDS = {"reference": 1, "implementation": 2, "type_definition": 4, "definition": 8}
DOC = ["overlay_digest", "document_ordinal"]


def decode_bits(c: Column, names: dict[str, int]) -> Column:
    return F.filter(F.array(*[F.when(c.bitwiseAND(F.lit(b)) != 0, n) for n, b in names.items()]), lambda x: x.isNotNull())


def enclosed_reference_edges(occurrences: DataFrame, functions: DataFrame, declared: DataFrame) -> DataFrame:
    """Derived edges: the innermost function around each non-definition occurrence refers to that occurrence's symbol.

    ``functions``: document keys, start, end, symbol. Of the functions around an occurrence, which a join on cells of spans
    finds, the one with the latest start (then the earliest end) is innermost. Edges already declared are dropped, and
    repeats folded, before they are numbered within their document.
    """
    o = occurrences.where((F.col("roles").bitwiseAND(F.lit(1)) == 0) & F.col("symbol").isNotNull()).select(*DOC, "occurrence_ordinal", F.col("symbol").alias("target_symbol"), "start", "end")
    f = functions.select(*DOC, F.col("symbol").alias("source_symbol"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    nearest = innermost(o, f, DOC, ["occurrence_ordinal", "target_symbol"], "source_symbol")
    edges = nearest.select(*DOC, "source_symbol", "target_symbol").distinct()
    kept = edges.join(declared.select(*DOC, "source_symbol", "target_symbol").distinct(), [*DOC, "source_symbol", "target_symbol"], "left_anti")
    w = Window.partitionBy(*DOC).orderBy("source_symbol", "target_symbol")
    return kept.withColumn("relationship_ordinal", F.row_number().over(w) - 1).withColumn("kinds", F.lit(1))


def enclosing_functions(occurrences: DataFrame, facts: DataFrame) -> DataFrame:
    """(document keys, start, end, symbol) of the functions and methods whose name a definition occurrence covers exactly."""
    d = occurrences.where((F.col("roles").bitwiseAND(F.lit(1)) != 0) & F.col("symbol").isNotNull()).select(*DOC, "path", "symbol", F.col("start").alias("name_start"), F.col("end").alias("name_end"))
    f = facts.where(F.col("kind").isin("function", "method")).select("path", "name_start", "name_end", F.col("decl_start").alias("start"), F.col("decl_end").alias("end"))
    return d.join(f, ["path", "name_start", "name_end"]).select(*DOC, "start", "end", "symbol")


def all_relationships(declared: DataFrame, derived: DataFrame) -> DataFrame:
    return declared.withColumn("evidence", F.lit("declared")).unionByName(derived.withColumn("evidence", F.lit("enclosed_reference")), allowMissingColumns=True)


def scip_evidence(occurrences: DataFrame, relationships: DataFrame, symbol: str, limit: int = 100) -> tuple[Bounded, Bounded]:
    """Occurrences of a symbol, and its relationships with direction (outgoing where it is the source)."""
    occ = occurrences.where(F.col("symbol") == symbol).withColumn("role_names", decode_bits(F.col("roles"), ROLES))
    rel = relationships.where((F.col("source_symbol") == symbol) | (F.col("target_symbol") == symbol))
    rel = rel.withColumn("direction", F.when(F.col("source_symbol") == symbol, "outgoing").otherwise("incoming")).withColumn("kind_names", decode_bits(F.col("kinds"), KINDS))
    return bounded(occ, ["document_ordinal", "occurrence_ordinal"], limit), bounded(rel, ["document_ordinal", "relationship_ordinal", "evidence"], limit)


def scip_symbol_resolve(occurrences: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """One row (outcome, symbol): none, exact, or ambiguous; two distinct symbols suffice to tell."""
    two = occurrences.where((F.col("path") == path) & (F.col("start") == start) & (F.col("end") == end) & F.col("symbol").isNotNull()).select("symbol").distinct().limit(2)
    n = two.agg(F.count("*").alias("n"), F.min("symbol").alias("symbol"))
    return n.select(F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "exact").otherwise("ambiguous").alias("outcome"), F.when(F.col("n") == 1, F.col("symbol")).alias("symbol"))


def scip_relationship_trace(relationships: DataFrame, symbol: str, depth: int = 2, max_edges: int = 100, max_nodes: int = 256, max_bytes: int | None = None) -> tuple[Trace, str, int]:
    """(trace, availability, frontier): breadth-first over relationships from a symbol; within a level in order of document,
    ordinal, evidence, which decides what ``max_edges`` cuts: a level is looked at whole. ``max_bytes`` cuts the edges where their symbols' bytes exceed it (flag bytes). frontier counts
    symbols that were reached but not expanded though they have relationships."""
    if not 1 <= depth <= 4 or not 1 <= max_edges <= 256:
        raise ValueError("depth up to 4, edges up to 256")
    e = relationships.select(F.col("source_symbol").alias("source"), F.col("target_symbol").alias("target"), F.format_string("%012d:%012d", "document_ordinal", "relationship_ordinal").alias("edge_kind"), F.col("evidence").alias("resolution_evidence"), F.lit("").alias("site"))
    t = graph_trace(e, [symbol], "outbound", None, Limits(depth=depth, results=max_edges, nodes=max_nodes, edges=1 << 40, frontier=max_nodes))
    found = t.edges.count()  # at most max_edges
    if max_bytes is not None:
        order = ["depth", "edge_kind", "resolution_evidence", "source", "target"]
        kept = within_bytes(t.edges, (F.octet_length("source") + F.octet_length("target") + ITEM_BYTES).cast("long"), max_bytes, order).orderBy(*order)
        if kept.count() < found:
            t.flags.add("bytes")
            t.edges = kept
    expanded = t.edges.select(F.col("source").alias("node")).distinct()
    reached = t.edges.select(F.col("target").alias("node")).distinct().join(expanded, "node", "left_anti")
    frontier = reached.join(e.select(F.col("source").alias("node")).distinct(), "node", "left_semi").count()
    return t, "available" if found else "no_relationships", frontier


#: Fixed value: bytes that an edge takes beside its symbols.
ITEM_BYTES = 64


def validate_import(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents of an overlay that a generation doesn't hold with the same content: must be empty before activation."""
    f = files.select(F.col("path").alias("_p"), F.col("content_digest").alias("_c"))
    return documents.join(f, (F.col("path") == F.col("_p")) & (F.col("content_digest") == F.col("_c")), "left_anti")
