"""Packs of many groups against the fold over one group."""

import random

import pytest

from loomspan.operators import context


def test_packs_of_groups_are_those_of_each(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(g, f"i{rng.randrange(6)}", rng.choice(["memory", "source", "graph"]), r, rng.randrange(1, 9), rng.choice(["current", "stale", None])) for g in ["a", "b", None] for r in range(25)] + [("c", "x", "source", 1, 100, None)]
    df = spark.createDataFrame(rows, "g string, identity string, provider string, rank long, units long, state string").repartition(3)
    got = {r["g"]: r for r in context.context_packs(df, "g", 20).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        mine = df.where(df["g"].eqNullSafe(g)).na.fill({"state": "current"})
        items, omitted, used = context.context_pack(mine, 20)
        assert [(i["identity"], i["provider"], i["rank"], i["units"]) for i in r["items"]] == [(i["identity"], i["provider"], i["rank"], i["units"]) for i in items]
        assert (r["used"], r["not_current"], r["duplicate"], r["over_budget"]) == (used, *(omitted.get(k, 0) for k in ("not_current", "duplicate", "budget")))
    assert context.context_packs(df.limit(0), "g", 20).count() == 0
    monkeypatch.setattr(context, "MAX_CANDIDATES", 24)
    with pytest.raises(ValueError, match="over 24"):
        context.context_packs(df, "g", 20)
