"""Ranked search that skips: postings in blocks that carry their best score, so that blocks which can't reach the result aren't read."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms, tokens
from .search import B, IDF_FLOOR, K1, KEY, WEIGHTS, _tokens_of
from .shared import written

#: Documents of a block, as a power of two; their offsets take a byte.
BLOCK_BITS = 7
#: Room for the last digits of sums of scores, so that no tie is skipped.
SLACK = 1e-9


#: Postings that a task of an index has on average: some 100 MB where they are sorted as rows.
TASK_POSTINGS = 1 << 19


class BlockIndex(NamedTuple):
    #: term, block, n, best (the highest term score in the block), offsets (bytes from the block's first document), weighted, sizes.
    blocks: DataFrame
    #: doc and the key's columns; doc >> BLOCK_BITS is the block.
    documents: DataFrame
    #: one row: n, mean (documents and their mean size).
    stats: DataFrame


class TopHits(NamedTuple):
    #: key and rank (lower is better), best first, then by key.
    rows: DataFrame
    #: one row: blocks that hold all terms, blocks whose postings were read.
    receipt: DataFrame


def _tf(weighted: Column, size: Column, mean: Column) -> Column:
    return weighted * (K1 + 1) / (weighted + K1 * (1 - B + B * size / mean))


def _summed(hits: Column) -> Column:
    """An array of (term, weighted) as one element a term, with its sum. Each array is bound by a lambda, so that it is made once."""
    bound = lambda value, body: F.transform(F.array(value), body)[0]
    starts = lambda h: F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == 1) | (F.get(h, i - 1)["term"] != F.get(h, i - 2)["term"]))
    end = lambda h, at, k: F.coalesce(F.get(at, k + 1), F.size(h) + 1)
    one = lambda h, at, i, k: F.struct(F.get(h, i - 1)["term"].alias("term"), F.aggregate(F.slice(h, i, end(h, at, k) - i), F.lit(0.0), lambda s, x: s + x["weighted"]).alias("weighted"))
    runs = lambda h: bound(starts(h), lambda at: F.transform(at, lambda i, k: one(h, at, i, k)))
    empty = F.filter(hits, lambda x: F.lit(False))
    return F.when(F.size(hits) > 0, bound(F.sort_array(hits), runs)).otherwise(empty)


def block_index(facts: DataFrame, key: list[str] = KEY, weights: dict[str, float] = WEIGHTS) -> BlockIndex:
    """The index of ``facts``, whose ``key`` is unique; null fields are empty.

    Documents are numbered in order of size, then key, by place in range partitions, so no task numbers all. Neighbours are of like
    size, so a block's best score is near all of its scores. A document's hits of a term are summed in its own row; rows
    are dealt by block, so that one task has all of a block and its postings are grouped where they are. A term's postings are at most 128
    a row, so that a term of every document is as many rows as there are blocks, and no hot key. Blocks are sorted by term and
    number. Each step has as many tasks as the number of postings asks for, so that none grows with the table.
    """
    lists = [tokens(F.coalesce(F.col(c), F.lit(""))) for c in weights]
    size = sum((F.size(t) for t in lists), F.lit(0)).cast("int")
    hit = lambda w: lambda x: F.struct(x.alias("term"), F.lit(w).alias("weighted"))
    every = F.concat(*[F.transform(t, hit(float(w))) for t, w in zip(lists, weights.values(), strict=True)])
    sized = written(facts.select(*key, size.alias("size"), _summed(every).alias("terms")), "sized")
    stats = written(sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.sum(F.size("terms")).alias("postings")), "stats")
    total = stats.first()
    parts, mean = -(-(total["postings"] or 0) // TASK_POSTINGS) or 1, F.lit(total["mean"])
    flat = sized.select(*key, "size", F.col("terms.term").alias("terms"), F.col("terms.weighted").alias("weighted"))
    numbered = flat.repartitionByRange(parts, "size", *key).sortWithinPartitions("size", *key).withColumn("doc", F.monotonically_increasing_id())
    docs = written(numbered, "documents")
    dealt = docs.select("doc", "size", "terms", "weighted", F.shiftright("doc", BLOCK_BITS).alias("block")).repartition(parts, "block")
    hits = dealt.select("block", "doc", "size", F.explode(F.arrays_zip("terms", "weighted")).alias("p")).select("block", "doc", "size", F.col("p.terms").alias("term"), F.col("p.weighted").alias("weighted"))
    posting = F.struct((F.col("doc") - F.shiftleft("block", BLOCK_BITS)).cast("tinyint").alias("offset"), "weighted", "size")
    best = F.max(_tf(F.col("weighted"), F.col("size"), mean)).alias("best")
    grouped = hits.groupBy("term", "block").agg(F.count("*").alias("n"), best, F.sort_array(F.collect_list(posting)).alias("p"))
    blocks = grouped.select("term", "block", "n", "best", F.col("p.offset").alias("offsets"), F.col("p.weighted").alias("weighted"), F.col("p.size").alias("sizes"))
    blocks = blocks.repartitionByRange(parts, "term", "block").sortWithinPartitions("term", "block")
    return BlockIndex(written(blocks, "blocks"), docs.select("doc", *key), stats.select("n", "mean"))


def top_hits(index: BlockIndex, query: str, limit: int = 20, key: list[str] = KEY) -> TopHits:
    """The first ``limit`` documents that hold every term of ``query``, ranked as ``code_search`` ranks them.

    Terms are single tokens; a phrase is an error (``code_search`` has positions). First only the blocks' heads are read: they
    give the terms' frequencies and, summed, a bound of each block that has all terms. The blocks with the highest bounds are scored; the
    score that the last of ``limit`` documents has there is what others must reach. Of the rest, blocks with a lower bound
    are skipped; that each term's best score must make up for what the others can't is a filter on the scan. Ties are never skipped.
    What the driver holds is a row a term, a list of at most 100 blocks and one score. A query without terms finds nothing.
    """
    if not 1 <= limit <= 100:
        raise ValueError("1 to 100 results")
    phrases = [_tokens_of(t) for t in query_terms(query)]
    if any(len(p) > 1 for p in phrases):
        raise ValueError("terms are single tokens here")
    times = Counter(p[0] for p in phrases if p)
    term, wanted = F.col("term"), list(times)
    heads = index.blocks.where(term.isin(wanted)).select("term", "block", "n", "best")
    idf = F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    whole = index.stats.select(F.col("n").alias("total"), "mean")
    terms = heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("best").alias("most")).crossJoin(F.broadcast(whole)).select("term", idf.alias("idf"), "most", "mean").collect()
    none = index.documents.select(*key, F.lit(0.0).alias("rank")).limit(0)
    if not wanted or not all(phrases) or len(terms) < len(wanted):
        return TopHits(none, heads.agg(F.lit(0).cast("long").alias("blocks"), F.lit(0).cast("long").alias("blocks_read")))
    gain = {r["term"]: times[r["term"]] * r["idf"] for r in terms}
    most, mean = {r["term"]: r["most"] * gain[r["term"]] for r in terms}, F.lit(terms[0]["mean"])
    weight = reduce(lambda a, kv: a.when(term == kv[0], F.lit(kv[1])), gain.items(), F.when(F.lit(False), F.lit(0.0)))
    held = heads.groupBy("block").agg(F.count("*").alias("terms"), F.sum(weight * F.col("best")).alias("bound"))
    held = written(held.where(F.col("terms") == len(wanted)).select("block", "bound"), "bounds")
    first = [r["block"] for r in held.orderBy(F.desc("bound"), "block").limit(limit).collect()]

    def scored(some: DataFrame) -> DataFrame:
        p = some.select("term", "block", F.explode(F.arrays_zip("offsets", "weighted", "sizes")).alias("p"))
        p = p.select("term", (F.shiftleft("block", BLOCK_BITS) + F.col("p.offsets")).alias("doc"), (weight * _tf(F.col("p.weighted"), F.col("p.sizes"), mean)).alias("score"))
        return p.groupBy("doc").agg(F.count("*").alias("terms"), F.sum("score").alias("score")).where(F.col("terms") == len(wanted)).select("doc", "score")

    of_query = index.blocks.where(term.isin(wanted))
    found = written(scored(of_query.where(F.col("block").isin(first))), "found")
    best = [r["score"] for r in found.orderBy(F.desc("score")).limit(limit).collect()]
    least = best[-1] * (1 - SLACK) if len(best) == limit else 0.0
    rest = held.where((F.col("bound") >= least) & ~F.col("block").isin(first))
    enough = reduce(Column.__or__, [(term == t) & (F.col("best") >= (least - sum(most.values()) + most[t]) / gain[t] * (1 - SLACK)) for t in wanted])
    more = scored(of_query.where(enough).join(rest, "block", "left_semi"))
    live = found.unionAll(more).where(F.col("score") >= least).join(index.documents, "doc").select(*key, (-F.col("score")).alias("rank"))
    read = F.sum(F.when((F.col("bound") >= least) | F.col("block").isin(first), 1).otherwise(0))
    return TopHits(live.orderBy("rank", *key).limit(limit), held.agg(F.count("*").alias("blocks"), F.coalesce(read, F.lit(0)).cast("long").alias("blocks_read")))
