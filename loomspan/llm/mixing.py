"""Operator 1, mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, carried, quoted, restored

#: A table of sources is broadcast if it and its Poisson steps take at most so many bytes; a larger one is joined by key.
BROADCAST_BYTES = 8 << 20


def last_step(rate: Column) -> Column:
    """The step beyond which a Poisson distribution's rest is below the hash's resolution."""
    return F.when(rate > 0, F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")).otherwise(F.lit(0))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(of, steps): P(N <= k) for k = 0, 1, ... of a Poisson distribution with each source's rate.

    A row a step: its logarithm is a running sum, so large rates don't underflow, and so is the distribution."""
    rate, k = F.col("rate"), F.col("k")
    up = Window.partitionBy("of").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = rates.select("of", "rate", F.explode(F.sequence(F.lit(0), last_step(rate))).alias("k"))
    each = each.withColumn("log", F.sum(F.when(k == 0, -rate).otherwise(F.log(rate / k))).over(up))
    each = each.withColumn("upto", F.sum(F.exp("log")).over(up))
    return each.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "upto"))), lambda x: x["upto"]).alias("steps"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, epochs: float, source: str, text: str) -> DataFrame:
    """(of, size, rate): rate is the mean number of times a document of the source is to appear. One pass over ``docs``."""
    sizes = docs.groupBy(F.col(quoted(source)).alias("of")).agg(F.sum(F.length(F.coalesce(F.col(quoted(text)), F.lit("")))).alias("size"))
    sizes = Table(sizes, "sizes").read()
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        weighed = sizes.withColumn("weight", F.coalesce(given[F.col("of")], F.lit(0.0)))
    total = weighed.agg(F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weights"), F.sum("size").alias("all")).first()
    weights_, all_ = F.lit(total["weights"] or 0.0), F.lit(total["all"] or 0)
    rate = F.when((F.col("size") > 0) & (weights_ > 0), F.col("weight") / weights_ * epochs * all_ / F.col("size")).otherwise(F.lit(0.0 if weights is not None else 1.0))
    return weighed.select("of", "size", F.round(rate, 12).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, alpha: float = 0.7, epochs: float = 1.0, seed: int = 42, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Repeats each document a Poisson number of times so that sources have their target shares of characters.

    ``weights`` gives target shares by source (any scale; sources not named get none). Without it a source's share is its
    size to the power ``alpha``. The mixture has ``epochs`` times the characters of ``docs`` in expectation. A document's
    count inverts its source's Poisson distribution at a uniform number hashed from (seed, doc_id), so it doesn't depend
    on partitions, order or other documents. Returns the columns of ``docs`` and copy (from 0), copies (the count) and
    shuffle_key; rows are dealt to partitions by that hash and sorted by it, which is a uniform global shuffle.

    Sizes are added up in the map tasks first, so a hot source is no hot key; the per-source table (one row a source) is
    broadcast only if its Poisson steps take at most BROADCAST_BYTES, else joined by key with adaptive splitting. Null sources are
    one source of their own (``weights`` can't name it). Null or empty texts have no size; where a source has no characters
    at all, its documents appear once a document on average (never, if ``weights`` are given). Rows that repeat a doc_id get
    the same count; null doc_ids are told apart by their texts. Where a row lies depends on its row number too, so that neither
    null nor repeated ids fill a partition. Texts of any length are moved whole, one row at a time; an empty
    table gives an empty one. Columns named copy, copies or shuffle_key are replaced; others may have any name.
    """
    rates = Table(source_rates(docs, weights, alpha, epochs, source, text), "rates").read()
    bytes_ = rates.agg(F.sum(8 * (last_step(F.col("rate")).cast("long") + 1) + 64 + F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)))).first()[0] or 0
    steps = Table(poisson_steps(rates), "steps").read()
    keep = [c for c in docs.columns if c not in ("copy", "copies", "shuffle_key")]
    id_ = F.coalesce(F.col(quoted(doc_id)).cast("string"), F.concat(F.lit("|"), F.md5(F.coalesce(F.col(quoted(text)), F.lit("")))))
    rows = docs.select(*carried(keep), F.col(quoted(source)).alias("source_"), id_.alias("id_"), F.monotonically_increasing_id().alias("row_"))
    key = F.concat(F.lit(f"{seed}|"), F.col("id_"))
    u = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rows = rows.withColumn("u_", u)
    joined = rows.join(F.broadcast(steps) if bytes_ <= BROADCAST_BYTES else steps, F.col("source_").eqNullSafe(F.col("of")))
    counted = joined.withColumn("copies", F.size(F.filter("steps", lambda c: c <= F.col("u_"))))
    spread = counted.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    spread = spread.withColumn("shuffle_key", F.md5(F.concat(key, F.lit("|"), F.col("copy").cast("string"))))
    dealt = spread.repartition("shuffle_key", "row_").sortWithinPartitions("shuffle_key", "row_")
    return dealt.select(*restored(keep), "copy", "copies", "shuffle_key")


MIX_SQL = """
WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
rates AS (SELECT source, round(pow(size::DOUBLE, 0.7) / (SELECT sum(pow(size::DOUBLE, 0.7)) FROM sizes WHERE size > 0)
          * 1.0 * (SELECT sum(size)::DOUBLE FROM sizes) / size::DOUBLE, 12) AS rate FROM sizes),
steps(source, rate, k, lg, cdf) AS (SELECT source, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, lg + ln(rate / (k + 1)), cdf + exp(lg + ln(rate / (k + 1))) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
cdfs AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY source),
counted AS (SELECT d.doc_id, d.text, d.source, len(list_filter(c.cdf, lambda x: x <= ('0x' || substr(md5('42|' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0)) AS copies
  FROM documents d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, copy::INTEGER AS copy, copies::INTEGER AS copies, md5('42|' || doc_id || '|' || copy) AS shuffle_key, text
FROM (SELECT *, unnest(range(copies)) AS copy FROM counted)
"""
