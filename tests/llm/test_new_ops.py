"""Hard negatives, centroid clusters and BPE by automaton against brute force and the plain library."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm.bpe import Automaton, AutomatonEncoder, Gadgets, bpe_decode, bpe_digests, bpe_encode, compiled
from loomspan.llm.centroids import Step, assign, centroid_clusters, squared
from loomspan.llm.hard_negatives import FAR, Balls, Search, hard_negatives, intervals
from loomspan.llm.tokens import tokenizer_path

from .test_text_ops import got

PATH = tokenizer_path("byte_bpe_50k.json")


# --- hard negatives ----------------------------------------------------------------------------------


def mined(rows, positives=5, negatives=10):
    """All pairs, in integers."""
    ok = [(i, v, [int(np.floor(256 * float(np.float32(x)))) for x in e], y) for v, e, y in rows for i in [len(rows)] if v is not None and y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    ok = [(i, *r[1:]) for i, r in enumerate(ok)]
    out = Counter()
    for i, a, q, y in ok:
        if a % 100:
            continue
        scores = sorted((-sum(s * t for s, t in zip(q, p, strict=True)), v, j, z) for j, v, p, z in ok if j != i and len(p) == len(q))
        for s, v, _, _ in [x for x in scores if x[3] == y][:positives]:
            fits = [x for x in scores if x[3] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out.update((a, v, k, x[1], -s, -x[0]) for k, x in enumerate(fits, 1))
    return out


def vector_rows(rng, n, dim=8, labels=4):
    base = rng.standard_normal((6, dim))
    return [[i * 20, (base[rng.integers(6)] + 0.3 * rng.standard_normal(dim)).astype(np.float32).tolist(), int(rng.integers(labels))] for i in range(n)]


@pytest.mark.parametrize("block", [2048, 16])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(2)
    rows = vector_rows(rng, 300)
    rows += [[6000 + i, rows[0][1], i % 2] for i in range(40)]  # copies: ties by vec_id
    rows += [[100, rows[7][1], 1], [200, None, 1], [300, rows[3][1], None], [None, rows[3][1], 1], [500, [float("nan")] * 8, 0], [700, [None] * 8, 0], [900, [], 0], [20, [], 0], [1100, [1.0, 2.0], 1], [1300, [2.0, 1.0], 0], [1301, [2.0, 3.0], 1], [1500, [0.0] * 8, 2]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row int, q int").repartition(3)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert got(hard_negatives(df, F.expr("vec_id % 100 = 0"), block=block, per_slice=2, leaves=8), *names) == mined(rows)
    assert hard_negatives(df.limit(0), F.expr("vec_id % 100 = 0")).count() == 0
    assert hard_negatives(df.where("label = 1"), F.expr("vec_id % 100 = 0")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        hard_negatives(spark.createDataFrame([(100, [1e30], 1)], "vec_id long, embedding array<double>, label int"), F.lit(True)).count()


def test_intervals_hold_all_products_and_prune():
    rng = np.random.default_rng(3)
    x, y = (np.floor(rng.standard_normal((400, 4)) * 50 + rng.choice([-400, 0, 400], (400, 1))) for _ in range(2))
    labels = rng.integers(0, 3, 400)
    a, c = Balls(x, labels, 32), Balls(y, labels, 32)
    for i in range(len(a.start)):
        for j in range(0, len(c.start), 3):
            lo, hi = intervals(a, c, np.array([i]), np.array([j]))
            s = x[a.order[a.start[i] : a.end[i]]] @ y[c.order[c.start[j] : c.end[j]]].T
            assert lo[0] <= s.min() and s.max() <= hi[0]
    rows, slots = np.arange(400), (np.arange(400), np.zeros(400, int), np.full(400, -FAR), np.full(400, FAR))
    s = Search(rows, labels, x.astype(np.int64), slots, 3, True)
    for part in np.array_split(np.argsort(-y.sum(1)), 4):
        s.add(1000 + part, part, labels[part], y[part].astype(np.int64))
    assert s.pruned and s.scored < 400 * 400 // 2  # whole groups of anchors were passed over


# --- centroid clusters --------------------------------------------------------------------------------


def lloyd(rows, k=8, rounds=10, scale=1024, dim=64):
    kept = [(v, [int(np.floor(scale * float(np.float32(x)))) for x in e]) for v, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [q for _, q in order[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents)) for _, q in kept]
        if turn < rounds:
            for j in range(len(cents)):
                mine = [q for (_, q), (_, c) in zip(kept, near, strict=True) if c == j]
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else cents[j]
    of = Counter()
    for d, j in near:
        of[j] += d
    return Counter((v, j, d, of[j], sum(of.values()), sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (v, _), (d, j) in zip(kept, near, strict=True))


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_centroid_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [[i, (rng.integers(-3, 4, 64) / 4).astype(np.float32).tolist()] for i in range(150)]
    rows += [[200 + i, rows[0][1]] for i in range(60)] + [[5, rows[9][1]], [None, rows[4][1]], [301, None], [302, [1.0] * 63], [303, [float("inf")] * 64], [304, [None] * 64], [305, []]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, q int").repartition(3)
    assert got(centroid_clusters(df), *CLUSTER) == lloyd(rows)
    few = df.where("vec_id < 3")
    assert got(centroid_clusters(few), *CLUSTER) == lloyd(rows[:3])
    assert centroid_clusters(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroid_clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).count()


def test_bounds_skip_distances_and_keep_ties():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-3, 4, (300, 5)) + 40 * rng.integers(0, 4, (300, 1)), np.zeros((20, 5), int)]).astype(np.int64)
    cents = np.array([[0] * 5, [1, 0, 0, 0, 0], [-1, 0, 0, 0, 0], [40] * 5, [80] * 5, [120] * 5, [0] * 5])
    own, upper, lower, before, costs = np.zeros(320, np.int32), np.full(320, np.inf), np.zeros((320, 7)), None, []
    for _ in range(6):
        own, upper, lower, best, cost = assign(x, own, upper, lower, Step(cents, before), exact=True)
        all_ = np.array([squared(x, c[None, :]) for c in cents])
        assert (own == all_.argmin(0)).all() and (best == all_.min(0)).all()
        assert (lower**2 <= all_.T * (1 + 1e-12)).all() and (upper**2 >= all_.min(0) * (1 - 1e-12)).all()
        costs.append(cost)
        before, cents = cents, np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c for j, c in enumerate(cents)])
    assert costs[-1] < 320 * 7 // 3


# --- BPE ---------------------------------------------------------------------------------------------


def test_gadgets_are_the_written_out_automaton():
    """The table of arcs built gadget after gadget on a small vocabulary, against the references that are followed back."""
    rng = random.Random(8)
    for _ in range(30):
        names, merges = ["a", "b", "c"], []
        while len(merges) < 14:
            u, v = rng.randrange(len(names)), rng.randrange(len(names))
            if names[u] + names[v] not in names:
                merges.append((u, v, len(names)))
                names.append(names[u] + names[v])
        arc = [[True] * 3 for _ in range(3)]
        for u, v, w in merges:
            for row in arc:
                row.append(row[u])
            arc.append([*arc[v][:-1], arc[v][u]])
            arc[u][v] = False
            if u == v:
                arc[u][w] = False
        g = Gadgets(range(3), merges)
        a, b = np.divmod(np.arange(len(names) ** 2), len(names))
        want = [arc[x][y] for x, y in zip(a, b, strict=True)]
        assert g.arcs(a, b).tolist() == want and [g.arc(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)] == want
    with pytest.raises(ValueError, match="merge 2"):
        Gadgets(range(3), [(0, 1, 3), (4, 1, 5)])


def test_walks_are_the_merges():
    """Random vocabularies over few symbols, with runs: the walk against merging the first pair of lowest rank until none is left."""
    rng = random.Random(9)
    for _ in range(20):
        labels, merges = {i: bytes([i]) for i in range(256)}, []
        pool = [97, 98, 99]
        while len(merges) < 20:
            u, v = rng.choice(pool), rng.choice(pool)
            if labels[u] + labels[v] not in labels.values():
                merges.append((u, v, len(labels)))
                pool.append(len(labels))
                labels[len(labels)] = labels[u] + labels[v]
        auto, rank = Automaton(labels, merges), {(u, v): (i, w) for i, (u, v, w) in enumerate(merges)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
        for few in (1, 1000):
            for word, ids in zip(words, auto.encode(words, few=few), strict=True):
                t = list(word)
                while True:
                    best = min(((rank[p][0], i) for i, p in enumerate(zip(t, t[1:], strict=False)) if p in rank), default=None)
                    if best is None:
                        break
                    i = best[1]
                    t[i : i + 2] = [rank[t[i], t[i + 1]][1]]
                assert ids.tolist() == t
                assert auto.decode(ids, np.array([len(ids)]))[0].tobytes() == word


def odd_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "aa", " ", "the", " the", "\n", "'s", "'S", "ß", "é", " ", "　", "😀", "12", "...", "日本", "\x00", "\r\n", "<|endoftext|>", "<|ENDOFTEXT|>"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    return [*texts, "a" * 20_000, " " * 5000, "=" * 3000 + "x", "word " * 30_000, "x" * 300 + "\n\n" + "y" * 70]


def test_ids_are_the_librarys(spark):
    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)] + [(9000, None, 0), (9001, "", 0)], "doc_id long, text string, ids int").repartition(3)
    coded = bpe_encode(df, PATH)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {**dict(enumerate(want)), 9000: [], 9001: []}
    assert {r["doc_id"]: r["decoded"] for r in bpe_decode(coded, PATH).collect()} == {**dict(enumerate(texts)), 9000: "", 9001: ""}
    sha = lambda b: sha256(b).hexdigest()
    digests = Counter((i, len(w), sha(np.array(w, "<u4").tobytes()), sha(t.encode())) for i, (t, w) in enumerate(zip(texts, want, strict=True)))
    digests.update([(9000, 0, sha(b""), sha(b"")), (9001, 0, sha(b""), sha(b""))])
    assert got(bpe_digests(df, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == digests
    assert bpe_digests(df.limit(0), PATH).count() == 0 and bpe_encode(df.limit(0), PATH).count() == 0


def test_decoding_any_ids(spark):
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(12))] for _ in range(300)] + [[222], [160, 255, 50256]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(900, None), (901, [None, 64])], "k long, ids array<int>")
    back = {r["k"]: r["decoded"] for r in bpe_decode(df, PATH).collect()}
    assert back == {**{i: plain.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}, 900: "", 901: plain.decode([64])}


def test_whole_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = Tokenizer.from_file(PATH).encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    code = compiled(PATH)
    for r, w in zip(rows, want, strict=True):
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        assert code.encode(raw, np.array([0, len(raw)]))[0].tolist() == w.ids


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        AutomatonEncoder(tokenizer_path("word_bpe_49k.json"))
