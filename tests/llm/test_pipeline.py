"""The pipeline against plain Python, stage by stage, and the registered queries on the smallest tables."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import registry
from loomspan.llm.quality import CLASSES, COMMON, REFERENCES, _forms

from .test_text_ops import WORD, brute_fingerprint, brute_lines, brute_quality, check_packing, components, crc, ids_of

DATA = "/root/testdata/sf0.001"


IN = {"space": " \t\n\v\f\r", "digit": "0123456789", "punct": ".,;:!?'\"()-", "symbol": "#*$%&|<>@=+_/\\~^[]{}`"}


def char_class(c):
    for name, chars in IN.items():
        if c in chars:
            return name
    if c.isascii() and c.isalpha():
        return "lower" if c.islower() else "upper"
    n = ord(c)
    if 0xC0 <= n <= 0x24F or 0x1E00 <= n <= 0x1EFF:
        return "accent"
    letters = ((0x370, 0x1DFF), (0x1F00, 0x1FFF), (0x2C00, 0x2DFF), (0x2E80, 0xD7FF), (0xF900, 0xFDFF), (0xFE70, 0xFEFF), (0xFF66, 0xFFDC), (0x10000, 0x1EFFF), (0x20000, 0x3FFFF))
    return "script" if any(a <= n <= b for a, b in letters) else "other"


def brute_kept(rows):
    """Which rows the quality rules keep."""

    def distance(p, q):
        half = lambda a, b: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
        return np.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))

    def good(t):
        base = brute_quality(t)
        if base[5] or base[0] < 50:
            return not base[5]
        t = t.strip(" \t\n\v\f\r")
        chars = Counter(map(char_class, t))
        if 2 * chars["script"] > base[1]:
            return True
        w = WORD.findall(t)
        bare = [x.rstrip(".,").lower() for x in w if any(x in _forms(c) for words in COMMON.values() for c in words)]
        counts = {lang: [sum(x == c for x in bare) for c in words] for lang, words in COMMON.items()}
        lang = max(COMMON, key=lambda x: sum(counts[x]))
        lang = lang if 100 * sum(counts[lang]) >= 8 * len(w) else None
        if distance([chars[c] / len(t) for c in CLASSES], REFERENCES[lang][0]) > 0.17:
            return False
        return lang is None or distance([*[x / len(w) for x in counts[lang]], (len(w) - sum(counts[lang])) / len(w)], REFERENCES[lang][1]) <= 0.35

    return [good(r[1]) for r in rows]


def poisson(rate, i):
    u = int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, c = 0, np.exp(-rate), np.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_pipeline(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = [r for r, k in zip(rows, brute_kept(rows), strict=True) if k]
    assert 0 < len(now) < len(rows)
    lines = defaultdict(list)
    for (i, _, _, t), n in brute_lines(now).items():
        lines[i] += [t] * n
    now = [(r[0], lines[r[0]].pop(), *r[2:]) for r in now]
    fp = [brute_fingerprint(r[1]) for r in now]
    comp = components(len(now), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    low = {c: min(now[i][0] for i in range(len(now)) if comp[i] == c) for c in comp}
    stay = {}
    for r in now:
        if r[0] in low.values():
            stay.setdefault(r[0], r)
    now = list(stay.values())
    size = defaultdict(int)
    for r in now:
        size[r[3]] += len(r[1])
    whole, powers = sum(size.values()), sum(v**0.7 for v in size.values() if v)
    rate = {s: v**0.7 / powers * whole / v for s, v in size.items()}
    now = [r for r in now for _ in range(poisson(rate[r[3]], r[0]))]
    want = Counter()
    for r, ids in zip(now, ids_of("word_bpe_49k.json", now, 1), strict=True):
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[(r[0], p, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096]))] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    assert check_packing(out, 4096) <= -(-sum(r["length"] for r in out) // 4096) + 1


def test_stages_keep_columns(spark, docs, no_docs, clashing):
    """Extra columns keep their names and values, whatever the names."""
    extra, values = clashing.columns[5:], tuple(clashing.first()[5:])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide, plain = stage(spark, clashing, ""), stage(spark, docs, "")
        assert wide.columns == clashing.columns, name
        rows = [tuple(r) for r in wide.collect()]
        assert rows and all(r[5:] == values for r in rows), (name, extra)
        assert Counter(r[:5] for r in rows) == Counter(map(tuple, plain.collect())), name
        assert stage(spark, no_docs, "").count() == 0, name


def test_run_leaves_only_its_result(spark, docs, tmp_path):
    from loomspan.llm import common

    docs.limit(20).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(common._live)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(common._live) - before) == 1 and out.count() >= 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLES[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
