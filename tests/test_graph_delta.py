"""Incremental resolution against a full run, after random edits of files."""

import random

from loomspan.operators import graph_delta as delta
from loomspan.operators.shared import release, written

DEFS = "slot string, path string, ordinal int, kind string, name string, qualified_name string"
SITES = "slot string, path string, site_ordinal int, kind string, raw_target string, enclosing string, enclosing_kind string"


def a_file(rnd, slot, path):
    names, defs, sites = "abcd", [], []
    for i in range(rnd.randrange(5)):
        name, kind, scope = rnd.choice(names), rnd.choice(["function", "function", "method", "struct", "module"]), rnd.choice(["", "m::", "m::k::"])
        defs.append((slot, path, i, kind, name, scope + name))
    if rnd.random() < 0.5:
        defs.append((slot, path, 90, "module", "m", "m"))
    for i in range(rnd.randrange(6)):
        kind = rnd.choice(["call", "call", "reference", "import", "macro_call"])
        name = rnd.choice(names)
        raw = rnd.choice([name, "m::" + name, "crate::m::" + name, "crate::" + name, "x." + name, "z"])
        if kind == "import":
            raw = rnd.choice(["m::", "crate::m::k::"]) + name + rnd.choice(["", " as z", " as " + rnd.choice(names)])
        sites.append((slot, path, i, kind, raw, *rnd.choice([(None, None), ("m", "module"), ("m::f", "function"), ("m::k::f", "function")])))
    return defs, sites


def frames(spark, files):
    return spark.createDataFrame([d for v in files.values() for d in v[0]], DEFS), spark.createDataFrame([s for v in files.values() for s in v[1]], SITES)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def stored(graph):
    return delta.Graph(*[written(t, "graph") for t in graph])


def test_equals_a_full_run(spark):
    rnd = random.Random(0)
    files = {(s, f"f{i}"): a_file(rnd, s, f"f{i}") for s in "st" for i in range(15)}
    d, s = frames(spark, files)
    now = stored(delta.resolve_all(d, s, 3))
    for step in range(2):
        new, touched = dict(files), [*rnd.sample(sorted(files), 3), ("s", f"new{step}")]
        for at in touched:
            if at in new and rnd.random() < 0.3:
                del new[at]
            else:
                new[at] = a_file(rnd, *at)
        d2, s2 = frames(spark, new)
        change = delta.resolve_changes(now, d, d2, s2, spark.createDataFrame(touched + touched[:1], "slot string, path string"), 3)
        now = stored(change.graph)
        for got, want in zip(now, delta.resolve_all(d2, s2, 3), strict=True):
            assert rows(got) == rows(want)
        files, d, s = new, d2, s2
    release()


def test_work_follows_the_edit(spark):
    """1,000 files that call their own function, and 20 that call that of one file: an edit of it touches those and no others."""
    own = [("s", f"f{i}", 0, "function", f"n{i}", f"n{i}") for i in range(1000)]
    sites = [("s", f"f{i}", 1, "call", f"n{i}", None, None) for i in range(1000)] + [("s", f"f{i}", 2, "call", "n7", None, None) for i in range(100, 120)]
    d, s = spark.createDataFrame(own, DEFS), spark.createDataFrame(sites, SITES)
    now = delta.resolve_all(d, s)
    edited = spark.createDataFrame([(*r[:4], "other", "other") if r[1] == "f7" else r for r in own], DEFS)
    change = delta.resolve_changes(now, d, edited, s, spark.createDataFrame([("s", "f7")], "slot string, path string"))
    assert change.again.count() == 21
    assert change.graph.resolutions.where("outcome = 'unresolved'").count() == 21
    same = delta.resolve_changes(now, d, d, s, spark.createDataFrame([], "slot string, path string"))
    assert same.again.count() == 0 and rows(same.graph.candidates) == rows(now.candidates)
    release()
