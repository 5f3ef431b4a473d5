"""Pieces that operators share, and the corners of theirs that whole tables don't reach."""

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import common
from loomspan.llm.embedding_dedup import cheapest_bits, embedding_dedup, enough_tables
from loomspan.llm.substring_dedup import Distinct, among, decode_sorted, encode_sorted, in_order, repeated
from loomspan.llm.url_filter import Rule, RuleSet, filter_urls

from .test_text_ops import components


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (170, 2))] + [(500, 500 + k) for k in range(300)] + [(k, k + 1) for k in range(2000, 2040)]
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    linked = set(edges) | {(b, a) for a, b in edges}
    low = components(len(nodes), lambda a, b: (nodes[a], nodes[b]) in linked)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r[0]: r[1] for r in common.connected_components(df).collect()}
    assert got == {x: nodes[low[i]] for i, x in enumerate(nodes)}
    assert common.connected_components(df.limit(0)).count() == 0


def test_stars():
    a, b = np.array([5, 9, 7, 3, 4]), np.array([2, 5, 1, 1, 4])
    assert set(zip(*map(np.ndarray.tolist, common.stars(a, b)), strict=True)) == {(5, 2), (9, 2), (7, 1), (3, 1)}


def test_long_texts_hash_alike():
    """Words and windows of a text hashed in pieces are those of the text hashed at once."""
    rng = np.random.default_rng(6)
    text = " ".join(f"w{x}" for x in rng.integers(0, 3000, 20_000)).encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    (_, _, [whole], n), (_, _, [pieces], m) = next(common.words_of(data, off)), next(common.words_of(data, off, piece=1000))
    assert (whole == pieces).all() and n == m == [20_000]
    s, e = common.word_spans(data, off)
    assert (common.span_hashes(data, s, e) == common.span_hashes(data, s, e, block=64)).all()


def test_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.conf = Conf({"spark.master": "local[4]", "spark.app.id": "x"})
    assert common.shared_dir(Session()).startswith("file:///") and "spark.checkpoint.dir" not in Session.conf
    Session.conf = Conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://a/b/"})
    assert common.shared_dir(Session()) == "hdfs://a/b"


def test_windows_that_collide():
    """Equal hashes with different checks are different windows."""
    h = np.array([7, 3, 7, 7, 9, 3], np.uint64)
    c = np.array([1, 5, 2, 1, 0, 5], np.uint32)
    d = Distinct(h, c, 2)
    pairs = list(zip(d.hashes.tolist(), d.checks.tolist(), strict=True))
    assert pairs == [(3, 5), (7, 1), (7, 2), (9, 0)] and d.once.tolist() == [False, False, True, True]
    assert [pairs[i] for i in d.at] == list(zip(h.tolist(), c.tolist(), strict=True))
    assert in_order(h, c).tolist() == [1, 5, 0, 3, 2, 4]
    twice = repeated([(h, c), (np.array([7], np.uint64), np.array([2], np.uint32))])
    assert list(zip(*map(np.ndarray.tolist, twice), strict=True)) == [(3, 5), (7, 1), (7, 2)]
    own = np.array([3, 7, 7, 9], np.uint64), np.array([4, 2, 3, 0], np.uint32)
    assert among(own, twice).tolist() == [False, True, False, False]
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 62, 1000).astype(np.uint64))
    assert (decode_sorted(*encode_sorted(x, 5), 5) == x).all()


def test_many_rules(spark):
    rng = np.random.default_rng(9)
    hosts = [f"{a}.{b}" if a else b for a in ("", "x", "y", "x.y", "a.x") for b in ("org", "com", "example.org", "x.com", "co.uk")]
    rules = [Rule(f"{h}/{p}", v) for i, h in enumerate(hosts) for p in ("", "a", "a/b/", f"q{i}/") for v in (["block", "allow"][i % 2],)] * 3 + [Rule("*.net/z", "block")]
    urls = [f"http://{'w.' * int(rng.integers(0, 2))}{rng.choice(hosts)}/{rng.choice(['', 'a', 'a/b/c', 'q3/', 'q7/x', 'b'])}" for _ in range(300)] + ["http://a.net/z1", "http:///a", None, "http://uk/", "http://.org/a"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in filter_urls(df, rules).collect()}
    assert len(rules) > 256 and len(RuleSet(rules).groups) > 5
    for host, path, rule in got.values():
        fits = [r.text for r in rules if "*" not in r.text and (host == r.text.split("/")[0] or host.endswith("." + r.text.split("/")[0])) and path.startswith("/" + r.text.split("/", 1)[1])]
        assert rule == (max(fits, key=len) if fits else "*.net/z" if host == "a.net" else None)


def test_vectors_of_any_norm(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(8)
    rows = [(1, x * 1e200, 0), (2, x * 1e-200, 0), (3, x, 0), (4, x * 1e307, 0), (5, -x, 0), (6, x * 5e-324 + 5e-324, 0)]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup(df).collect()}
    assert all(got[i] == (3, 1) for i in (1, 2, 3, 4)) and got[5] == (0, 5)


def test_default_recall(spark):
    """Pairs at exactly the threshold among many other vectors: the share found by the default parameters."""
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 1500, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    near = 0.9801 * a + np.sqrt(1 - 0.9801**2) * b
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate((a, near)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found = embedding_dedup(df).where("vec_id >= 1500 and component_id = vec_id - 1500").count()
    assert found / 1500 >= 0.99
    assert enough_tables(14, 0.98, 0.999) >= 14 and cheapest_bits(10**9, 10**17, 0.98, 0.999) > cheapest_bits(10**4, 10**7, 0.98, 0.999)


def test_small_batches_of_groups():
    batches = [pa.RecordBatch.from_pydict({"k": [i // 3 for i in range(s, s + 4)], "v": list(range(s, s + 4))}) for s in range(0, 40, 4)]
    tables = list(common.whole_groups(batches, "k", 5))
    assert sum(t.num_rows for t in tables) == 40
    ends = [(t.column("k")[0].as_py(), t.column("k")[-1].as_py()) for t in tables]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
