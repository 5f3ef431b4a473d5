"""Lexical search over facts, symbol lookup, and paths relevant to a query."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, tokens
from .results import Bounded, bounded, within_bytes
from .shared import written

#: Ranking parameters and the columns' weights.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
WEIGHTS = {"kind": 1.0, "name": 3.0, "qualified_name": 2.0}
KEY = ["path", "ordinal"]


def postings(facts: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, field, term, position): the inverted index of facts. Written sorted by term, a lookup reads few row groups."""
    fields = [facts.select(*key, F.lit(c).alias("field"), F.posexplode(tokens(F.col(c))).alias("position", "term")) for c in WEIGHTS]
    return reduce(DataFrame.unionAll, fields)


def document_stats(facts: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, size): tokens of each fact in all fields."""
    return facts.select(*key, sum((F.size(tokens(F.col(c))) for c in WEIGHTS), F.lit(0)).cast("long").alias("size"))


def phrase_hits(index: DataFrame, phrase: list[str], key: list[str] = KEY) -> DataFrame:
    """(key, weighted): weighted hits of adjacent tokens in one field."""
    weight = reduce(lambda a, kv: a.when(F.col("field") == kv[0], F.lit(kv[1])), WEIGHTS.items(), F.when(F.lit(False), F.lit(0.0)))
    if len(phrase) == 1:
        hits = index.where(F.col("term") == phrase[0])
    else:
        at = index.where(F.col("term").isin(*set(phrase)))
        starts = F.explode(F.array(*[F.when(F.col("term") == t, F.struct(F.lit(k).alias("k"), (F.col("position") - k).alias("start"))) for k, t in enumerate(phrase)]))
        at = at.select(*key, "field", starts.alias("s")).where(F.col("s").isNotNull()).select(*key, "field", "s.k", "s.start")
        hits = at.groupBy(*key, "field", "start").agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(phrase))
    return hits.groupBy(*key).agg(F.sum(weight).alias("weighted"))


#: Fixed value: bytes that a hit takes beside its texts.
HIT_BYTES = 136


def hit_size(*texts: str) -> Column:
    return sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in texts), F.lit(HIT_BYTES)).cast("long")


def code_search(facts: DataFrame, query: str, limit: int = 20, *, max_bytes: int | None = None, index: DataFrame | None = None, stats: DataFrame | None = None, key: list[str] = KEY) -> Bounded:
    """Facts that hold every term (each a phrase of adjacent tokens), best first: bm25 with weighted fields, then by key.

    ``index`` and ``stats`` are the materialised projections; ranks take their statistics from ``stats``. A term without any
    token matches nothing. Returns key, kind, name, qualified_name and rank (lower is better). Over ``max_bytes`` of them
    are an error, never a shorter result.
    """
    if not 1 <= limit <= 100:
        raise ValueError("1 to 100 results")
    phrases = [_tokens_of(t) for t in query_terms(query)]
    if not all(phrases):
        return bounded(facts.select(*key, *WEIGHTS).withColumn("rank", F.lit(0.0)).limit(0), [F.col(k) for k in key], limit)
    index = postings(facts, key) if index is None else index
    stats = document_stats(facts, key) if stats is None else stats
    each = [phrase_hits(index, p, key).withColumn("term_no", F.lit(i)) for i, p in enumerate(phrases)]
    hits = reduce(DataFrame.unionAll, each)
    whole = stats.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    found = hits.groupBy("term_no").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    terms = found.crossJoin(F.broadcast(whole)).select("term_no", idf.alias("idf"), "mean")  # at most 8 rows, and one
    tf = F.col("weighted") * (K1 + 1) / (F.col("weighted") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = hits.join(F.broadcast(terms), "term_no").join(stats, key)
    ranked = scored.groupBy(*key).agg(F.count("*").alias("terms"), F.sum(F.col("idf") * tf).alias("score")).where(F.col("terms") == len(phrases))
    out = ranked.join(facts.select(*key, *WEIGHTS), key).select(*key, *WEIGHTS, (-F.col("score")).alias("rank"))
    order = [F.col("rank"), *[F.col(k) for k in key]]
    found = bounded(out, order, limit)
    if max_bytes is None:
        return found
    return Bounded(within_bytes(found.rows, hit_size(key[0], *WEIGHTS), max_bytes, order, fail=True).orderBy(*order), found.receipt)


def _tokens_of(term: str) -> list[str]:
    out, now = [], ""
    for c in term.lower() + " ":
        if c.isalnum() or c == "_":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def symbol_search(facts: DataFrame, name: str, *, mode: str = "exact", language: str | None = None, kind: str | None = None, path_prefix: str | None = None, limit: int = 20) -> Bounded:
    """Facts by case-sensitive name, exact or prefix, in order of name, path and ordinal. Filters that aren't given add no
    predicate, so those that are stay pushable. A name without any token can't match."""
    if not name or len(name.encode()) > 1024:
        raise ValueError("a name has 1 to 1,024 bytes")
    if mode not in ("exact", "prefix"):
        raise ValueError("exact or prefix")
    rows = facts.where(F.col("name") == name if mode == "exact" else F.col("name").startswith(name))
    if not _tokens_of(name):
        rows = rows.where(F.lit(False))
    for col, value in (("language", language), ("kind", kind)):
        rows = rows if value is None else rows.where(F.col(col) == value)
    if path_prefix:
        rows = rows.where(F.col("path").startswith(path_prefix))
    return bounded(rows, ["name", "path", "ordinal"], limit)


def symbol_get(facts: DataFrame, contents: DataFrame, pins: dict[str, object], max_bytes: int = 8 << 20) -> DataFrame:
    """One exact occurrence, pinned by every given column, with the bytes of its declaration re-read and checked.

    ``contents`` has path, content_digest and content (binary). A stale pin finds nothing; a changed digest is an error."""
    rows = facts
    for col, value in pins.items():
        rows = rows.where(F.col(col) == F.lit(value))
    held = rows.join(contents.select("path", F.col("content_digest").alias("_d"), "content"), "path")
    sound = (F.col("_d") == F.col("content_digest")) & (F.sha2("content", 256) == F.col("_d")) & (F.octet_length("content") <= max_bytes)
    source = F.substring(F.col("content"), (F.col("decl_start") + 1).cast("int"), (F.col("decl_end") - F.col("decl_start")).cast("int"))
    bad = F.raise_error(F.lit("the content differs from its pinned digest")).cast("binary")
    return held.withColumn("source", F.when(sound, source).otherwise(bad)).drop("_d", "content")


def relevant_paths(hits: DataFrame, max_paths: int = 12, per_path: int = 4) -> DataFrame:
    """Paths of the best ``per_path * max_paths`` hits, those with most hits first. Groups what the search returned, so the
    totals are of those hits. ``hits`` has rank, path, ordinal and content_digest; one path with two contents is an error."""
    if not 1 <= max_paths <= 50:
        raise ValueError("1 to 50 paths")
    top = hits.orderBy("rank", "path", "ordinal").limit(per_path * max_paths)
    by = top.groupBy("path").agg(F.count("*").alias("matches"), F.min("ordinal").alias("first_ordinal"), F.countDistinct("content_digest").alias("contents"))
    sound = F.when(F.col("contents") <= 1, F.col("matches")).otherwise(F.raise_error(F.lit("a path has two contents")).cast("long"))
    return by.select("path", sound.alias("matches"), "first_ordinal").orderBy(F.desc("matches"), "path").limit(max_paths)


@dataclass(frozen=True)
class CrossSearch:
    """``rows``: results in repository and rank order. ``receipts``: a row a repository asked for, with outcome (complete, partial, empty,
    failed, skipped: its turn came when the limit was used up), total, returned and reason."""

    rows: DataFrame
    receipts: DataFrame


MAX_REPOSITORIES = 64


def ranked_by_repository(facts: DataFrame, query: str) -> DataFrame:
    """(repository_id, path, ordinal, kind, name, qualified_name, rank): the hits of ``code_search`` in every repository at once, each ranked
    by the statistics of its own."""
    key = ["repository_id", *KEY]
    phrases = [_tokens_of(t) for t in query_terms(query)]
    if not all(phrases):
        return facts.select(*key, *WEIGHTS).withColumn("rank", F.lit(0.0)).limit(0)
    index, stats = postings(facts, key), document_stats(facts, key)
    hits = reduce(DataFrame.unionAll, [phrase_hits(index, p, key).withColumn("term_no", F.lit(i)) for i, p in enumerate(phrases)])
    whole = stats.groupBy("repository_id").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    found = hits.groupBy("repository_id", "term_no").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    terms = found.join(whole, "repository_id").select("repository_id", "term_no", idf.alias("idf"), "mean")
    tf = F.col("weighted") * (K1 + 1) / (F.col("weighted") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    scored = hits.join(F.broadcast(terms), ["repository_id", "term_no"]).join(stats, key)  # a row a repository and term: 64 times 8 at most
    ranked = scored.groupBy(*key).agg(F.count("*").alias("terms"), F.sum(F.col("idf") * tf).alias("score")).where(F.col("terms") == len(phrases))
    return ranked.join(facts.select(*key, *WEIGHTS), key).select(*key, *WEIGHTS, (-F.col("score")).alias("rank"))


def cross_repository_search(facts: DataFrame | dict[str, DataFrame], query: str, limit: int = 20, **kwargs) -> CrossSearch:
    """The search in each repository, then one shared limit over results in id and rank order.

    ``facts`` has a column repository_id, or is a frame by repository. All repositories are searched by one plan, whose hits are
    written; the driver gets a count a repository. If one of several frames fails, each is searched by itself: the one that fails is
    reported and doesn't hold up the others. Over MAX_REPOSITORIES are an error."""
    if not 1 <= limit <= 100:
        raise ValueError("1 to 100 results")
    if not isinstance(facts, dict):
        ids = sorted(r[0] for r in facts.select("repository_id").distinct().limit(MAX_REPOSITORIES + 1).collect())
        by = {i: facts.where(F.col("repository_id") == i) for i in ids}
    else:
        by = facts
        ids = sorted(by)
    if len(ids) > MAX_REPOSITORIES:
        raise ValueError(f"over {MAX_REPOSITORIES} repositories")
    if not ids:
        raise ValueError("no repositories")
    if kwargs:
        return _one_by_one(by, query, limit, **kwargs)
    try:
        if isinstance(facts, dict):
            facts = reduce(DataFrame.unionByName, [by[i].select(F.lit(i).alias("repository_id"), *KEY, *WEIGHTS) for i in ids])
        hits = written(ranked_by_repository(facts, query), "hits")
    except PySparkException:
        return _one_by_one(by, query, limit)
    totals = {r["repository_id"]: r["count"] for r in hits.groupBy("repository_id").count().collect()}
    receipts, left = [], limit
    for i in ids:
        total = totals.get(i, 0)
        n = min(total, left)
        receipts.append((i, "skipped", None, 0, "the limit is used up") if not left else (i, "empty" if not total else "complete" if n == total else "partial", total, n, None))
        left -= n
    receipts = facts.sparkSession.createDataFrame(receipts, RECEIPT)
    order = Window.partitionBy("repository_id").orderBy("rank", *KEY)
    best = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    rows = best.join(F.broadcast(receipts.select("repository_id", "returned")), "repository_id").where(F.col("_n") <= F.col("returned"))
    return CrossSearch(rows.select(*KEY, *WEIGHTS, "rank", "repository_id").orderBy("repository_id", "rank", *KEY), receipts)


RECEIPT = "repository_id string, outcome string, total long, returned long, reason string"


def _one_by_one(facts: dict[str, DataFrame], query: str, limit: int, **kwargs) -> CrossSearch:
    out, receipts, left, spark = None, [], limit, next(iter(facts.values())).sparkSession
    for i in sorted(facts):
        if not left:
            receipts.append((i, "skipped", None, 0, "the limit is used up"))
            continue
        try:
            found = code_search(facts[i], query, limit, **kwargs)
            total = found.receipt.first()["total"]
            rows = found.rows.limit(left).withColumn("repository_id", F.lit(i))
            n = min(total, left, limit)
        except PySparkException as e:
            receipts.append((i, "failed", None, 0, str(e).split("\n")[0][:200]))
            continue
        receipts.append((i, "empty" if not total else "complete" if n == total else "partial", total, n, None))
        out, left = rows if out is None else out.unionByName(rows), left - n
    if out is None:
        out = spark.createDataFrame([], "path string, ordinal long, kind string, name string, qualified_name string, rank double, repository_id string")
    return CrossSearch(out.orderBy("repository_id", "rank", "path", "ordinal"), spark.createDataFrame(receipts, RECEIPT))
