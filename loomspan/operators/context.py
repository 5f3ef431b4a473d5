"""Budgeted context: candidates from providers, allocated by an order-dependent fold over a bounded set."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tiers in their order, the limit of candidates, and the constant of reciprocal ranks.
TIERS = ("precise_overlay", "syntax", "structural", "references", "memory", "history", "unresolved")
MAX_CANDIDATES, RRF = 10_000, 60


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate an identity: the one of the best tier, then the best rank and the least cost."""
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    cols = [c for c in candidates.columns if c != "identity"]
    best = candidates.groupBy("identity").agg(F.min_by(F.struct(*cols), F.struct(tier, "rank", "units")).alias("b"))
    return best.select("identity", "b.*")


def evidence_context(candidates: DataFrame, budget: int, anchor: dict | None = None) -> tuple[list[dict], dict[str, int], int]:
    """(items, omitted by tier, units used): the anchor first, then rounds that admit one fitting item a tier, in tier order.

    ``candidates``: identity, tier, rank, units. A lane is in order of rank, units, identity; what doesn't fit is dropped and
    counted. The input is limited before the driver folds it.
    """
    rows = [r.asDict() for r in merge_candidates(candidates).limit(MAX_CANDIDATES + 1).collect()]
    if len(rows) > MAX_CANDIDATES:
        raise ValueError(f"over {MAX_CANDIDATES} candidates")
    lanes = {t: sorted((r for r in rows if r["tier"] == t and (not anchor or r["identity"] != anchor["identity"])), key=lambda r: (r["rank"], r["units"], r["identity"]), reverse=True) for t in TIERS}
    items, omitted, used = [], Counter(), 0

    def admit(item: dict, tier: str) -> bool:
        nonlocal used
        if used + item["units"] > budget:
            omitted[tier] += 1
            return False
        used += item["units"]
        items.append({**item, "tier": tier})
        return True

    if anchor:
        admit(anchor, "anchor")
    more = True
    while more:
        more = False
        for t in TIERS:
            while lanes[t]:
                if admit(lanes[t].pop(), t):
                    more = True
                    break
    return items, dict(omitted), used


def context_pack(candidates: DataFrame, budget: int) -> tuple[list[dict], dict[str, int], int]:
    """The first pack form: by (rank, provider, identity), scored 1 / (60 + rank), each taken if it still fits; only current
    memory counts. Omissions are counted by cause. Over ``MAX_CANDIDATES`` candidates are an error."""
    rows = [r.asDict() for r in candidates.orderBy("rank", "provider", "identity").limit(MAX_CANDIDATES + 1).collect()]
    if len(rows) > MAX_CANDIDATES:
        raise ValueError(f"over {MAX_CANDIDATES} candidates")
    items, omitted, used, seen = [], Counter(), 0, set()
    for r in rows:
        if r["provider"] == "memory" and r.get("state", "current") != "current":
            omitted["not_current"] += 1
        elif r["identity"] in seen:
            omitted["duplicate"] += 1
        elif used + r["units"] > budget:
            omitted["budget"] += 1
        else:
            used += r["units"]
            seen.add(r["identity"])
            items.append({**r, "score": 1 / (RRF + r["rank"])})
    return items, dict(omitted), used


def context_packs(candidates: DataFrame, group: str, budget: int) -> DataFrame:
    """``context_pack`` for every value of ``group`` at once: (group, items in order, used, not_current, duplicate, over_budget), an item being
    (identity, provider, rank, units). ``candidates``: group, identity, provider, rank, units and, for memory, state.

    A group's candidates are sorted and folded by higher-order functions in its own row; nothing comes to the driver. A group of
    over ``MAX_CANDIDATES`` is an error, found by a count with map-side sums before any group is brought together."""
    g = F.col(group)
    if (big := candidates.groupBy(g).agg(F.count("*").alias("n")).where(F.col("n") > MAX_CANDIDATES).limit(1).collect()):
        raise ValueError(f"over {MAX_CANDIDATES} candidates for {big[0][0]}")
    state = F.coalesce("state", F.lit("current")) if "state" in candidates.columns else F.lit("current")
    item = "struct<rank:bigint,provider:string,identity:string,units:bigint>"
    rows = candidates.select(g, F.struct("rank", "provider", F.col("identity").cast("string").alias("identity"), "units").cast(item).alias("c"), ((F.col("provider") == "memory") & (state != "current")).alias("_old"))
    by = rows.groupBy(g).agg(F.array_sort(F.collect_list(F.when(~F.coalesce("_old", F.lit(False)), F.col("c")))).alias("lane"), F.count_if("_old").alias("not_current"))
    start = F.expr(f"named_struct('items', cast(array() as array<{item}>), 'used', 0L, 'duplicate', 0L, 'over_budget', 0L)")

    def admit(a: Column, x: Column) -> Column:
        again = F.exists(a["items"], lambda i: i["identity"] == x["identity"])
        fits = ~again & (a["used"] + x["units"] <= budget)
        return F.struct(
            F.when(fits, F.concat(a["items"], F.array(x))).otherwise(a["items"]).alias("items"),
            (a["used"] + F.when(fits, x["units"]).otherwise(0)).alias("used"),
            (a["duplicate"] + again.cast("long")).alias("duplicate"),
            (a["over_budget"] + (~again & ~fits).cast("long")).alias("over_budget"),
        )

    return by.select(g, F.aggregate("lane", start, admit).alias("p"), "not_current").select(g, "p.items", "p.used", "not_current", "p.duplicate", "p.over_budget")


def fan_in(**providers: DataFrame) -> DataFrame:
    """Candidates of all providers. Graph edges are structural if they import, else references; overlay evidence counts only
    as exactly one, untruncated occurrence; memory only where current."""
    out = None
    for name, df in providers.items():
        if name == "graph":
            df = df.withColumn("tier", F.when(F.col("edge_kind") == "imports", "structural").otherwise("references"))
        elif name == "overlay":
            n = df.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") == 1)
            df = df.join(n, "symbol", "left_semi").withColumn("tier", F.lit("precise_overlay"))
        elif name == "memory":
            df = df.where(F.col("state") == "current").withColumn("tier", F.lit("memory"))
        elif name in ("history", "syntax", "unresolved"):
            df = df.withColumn("tier", F.lit(name))
        df = df.select("identity", "tier", "rank", "units", F.lit(name).alias("provider"))
        out = df if out is None else out.unionByName(df)
    return out
