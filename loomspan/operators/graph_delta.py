"""Resolution kept up to date: from the files that changed to the sites whose names they change, which alone are resolved again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import MAX_CANDIDATES, SITE, prepared, resolve_prepared, site_keys
from .shared import by_rows, few, written

FILE = ["slot", "path"]
DEFINITION = ["slot", "path", "ordinal", "kind", "name", "qualified_name"]


class Graph(NamedTuple):
    """What is stored of a resolution: the outcomes, their candidates, and the names that each site depends on (``site_keys``)."""

    resolutions: DataFrame
    candidates: DataFrame
    keys: DataFrame


class Change(NamedTuple):
    graph: Graph
    #: (slot, path, site_ordinal) of the sites that were resolved again.
    again: DataFrame


def resolve_all(definitions: DataFrame, sites: DataFrame, max_candidates: int = MAX_CANDIDATES) -> Graph:
    s = prepared(definitions, sites)
    return Graph(*resolve_prepared(definitions, s, max_candidates), site_keys(s))


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tag, key): the names, qualified (q) and plain (n), of all definitions that one side has and the other hasn't. A definition that only
    moved to another ordinal differs too, since candidates name ordinals."""
    a, b = before.select(*DEFINITION), after.select(*DEFINITION)
    names = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(c).alias("key")) for t, c in (("q", "qualified_name"), ("n", "name"))])
    return a.exceptAll(b).unionAll(b.exceptAll(a)).select(F.explode(names).alias("k")).select("k.*").where(F.col("key").isNotNull()).distinct()


def resolve_changes(previous: Graph, before: DataFrame, after: DataFrame, sites: DataFrame, files: DataFrame, max_candidates: int = MAX_CANDIDATES) -> Change:
    """The graph of ``after`` (all definitions) and ``sites`` (all sites), made from the ``previous`` one of the definitions ``before``.

    ``files`` (slot, path) must name every file whose definitions or sites differ, added and removed ones too; naming more is no
    error. Sites of those files are resolved again, and those elsewhere that depend on a name of a definition that differs. Scopes,
    modules and imports are a file's own, so the stored keys of all other files still hold. What is left keeps its rows.
    Definitions are read once to find those that the names call for; only these are ordered and grouped. Tables that grow with the
    edit are broadcast only while they have few rows; then everything shuffled but the stored keys grows with the edit. Beyond, joins
    are merges. The result equals ``resolve_all(after, sites)``.
    """
    files = by_rows(written(files.select(*FILE).distinct(), "files"))
    inside = lambda df: df.join(files, FILE, "left_semi")
    outside = lambda df: df.join(files, FILE, "left_anti")
    changed = by_rows(written(changed_names(inside(before), inside(after)), "names"))
    depend = outside(previous.keys).join(changed, ["tag", "key"], "left_semi").select(*SITE)
    again = written(inside(sites).select(*SITE).unionAll(depend).distinct(), "again")
    around = by_rows(written(again.select(*FILE).distinct(), "around"))
    asked = by_rows(again).withColumn("again", F.lit(True))
    part = sites.join(asked, SITE, "left").where(F.col("again") | (F.col("kind") == "import"))  # with the imports, for what they bind
    modules = after.where(F.col("kind") == "module").join(around, FILE, "left_semi").select(*DEFINITION)
    every = prepared(modules, part.join(around, FILE, "left_semi"))
    s = every.where("again")
    keys = written(site_keys(s, every), "keys")
    names = lambda tag, name: by_rows(written(keys.where(F.col("tag") == tag).select(F.col("key").alias(name)).distinct(), "asked"))
    named = [after.select(*DEFINITION).join(names(t, n), n, "left_semi").select(*DEFINITION) for t, n in (("q", "qualified_name"), ("n", "name"))]
    needed = written(named[0].unionByName(named[1]).unionByName(modules).distinct().select(*DEFINITION), "definitions")
    res, cand = resolve_prepared(needed, s, max_candidates, every)
    gone = written(again.unionAll(inside(previous.resolutions).select(*SITE)), "gone")
    kept = previous.resolutions.join(by_rows(gone), SITE, "left_anti")
    if few(gone):
        shown = previous.candidates.join(F.broadcast(gone), SITE, "left_anti")
    else:  # candidates are many a site, so what is left of a large edit is sought by its sites
        shown = previous.candidates.join(by_rows(written(kept.where("candidate_count > 0").select(*SITE), "kept")), SITE, "left_semi")
    graph = Graph(kept.unionByName(res), shown.unionByName(cand), outside(previous.keys).unionByName(inside(keys)))
    return Change(graph, again)
