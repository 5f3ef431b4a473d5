"""Operators on documents against plain Python versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm.line_dedup import line_dedup
from loomspan.llm.mixing import mix_sources
from loomspan.llm.packing import best_fit, pack, pack_documents
from loomspan.llm.quality import REFERENCES, fit_references, jensen_shannon, quality_rules
from loomspan.llm.simhash import embed, embedded, hamming_links, simhash_dedup, simhash_groups
from loomspan.llm.substring_dedup import substring_dedup
from loomspan.llm.token_files import token_files
from loomspan.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def got(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# --- 6, line dedup


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(AZ)
    held = defaultdict(list)
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < 3 or i == max(held[key(x)])]
        out[(i, len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
    return out


def test_line_dedup(docs, rows, clashing, no_docs):
    want = brute_lines(rows)
    assert got(line_dedup(docs), "doc_id", "n_lines", "n_dropped", "text") == want
    assert sum(k[2] > 0 for k in want) >= 3
    assert got(line_dedup(clashing), "doc_id", "n_dropped", "text") == Counter({(k[0], k[2], k[3]): n for k, n in want.items()})
    assert line_dedup(no_docs).count() == 0


# --- 7, substring dedup


def brute_windows(rows, width):
    seen = Counter()
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


@pytest.mark.parametrize("bucket_bytes", [1 << 10, 12 << 20])
def test_substring_dedup(docs, rows, clashing, no_docs, bucket_bytes):
    want = brute_windows(rows, 35)
    assert got(substring_dedup(docs, bucket_bytes=bucket_bytes), "doc_id", "n_words", "n_removed", "text") == want
    assert got(substring_dedup(clashing), "doc_id", "n_removed", "text") == Counter({(k[0], k[2], k[3]): n for k, n in want.items()})
    assert substring_dedup(no_docs).count() == 0


# --- 8, SimHash


def brute_fingerprint(t):
    w = WORD.findall((t or "").translate(AZ))
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash(docs, rows, clashing, no_docs):
    fp = [brute_fingerprint(r[1]) for r in rows]
    comp = components(len(rows), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    low = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in comp}
    want = Counter((r[0], f"{fp[i]:016x}", low[comp[i]]) for i, r in enumerate(rows))
    assert got(simhash_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert got(simhash_groups(clashing), "doc_id", "fingerprint", "component_id") == want
    assert simhash_groups(no_docs).count() == 0
    kept = simhash_dedup(clashing)
    assert kept.columns == clashing.columns
    kept = kept.collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(low.values()))
    assert all(r[c] == v for r in kept for c, v in zip(clashing.columns[5:], clashing.first()[5:], strict=True))


def test_embedding_of_segments(spark):
    """The unary digits: their differing bits are the Manhattan distance of the segments' counts, at most the Hamming distance."""
    fp = np.random.default_rng(2).integers(0, 1 << 63, 300).astype(np.uint64)
    fp[1:150] = fp[0] ^ (np.uint64(1) << np.random.default_rng(3).integers(0, 63, 149).astype(np.uint64))
    count = lambda x: np.array([(int(x) >> s & 3).bit_count() for s in range(0, 64, 2)])
    got_ = embed(fp)
    for a, b in [(0, 5), (1, 2), (3, 200), (250, 299), (0, 160)]:
        manhattan = np.abs(count(fp[a]) - count(fp[b])).sum()
        assert (int(got_[a]) ^ int(got_[b])).bit_count() == manhattan <= (int(fp[a]) ^ int(fp[b])).bit_count()
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in fp], "fp long")
    assert [r[0] for r in df.select(embedded(F.col("fp"))).collect()] == got_.view(np.int64).tolist()


def test_hot_cells(spark):
    """A family whose members lie in the same cells, and random ones, dealt out as blocks or not."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 63))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 63, 50)}
    fps = sorted(fps)
    comp = components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for most, groups in ((8, 7), (1 << 17, None)):
        edges = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in hamming_links(df, 4, groups=groups, max_cell=most).collect()}
        assert all((a ^ b).bit_count() <= 4 or comp[fps.index(a)] == comp[fps.index(b)] for a, b in edges)
        assert components(len(fps), lambda a, b, e=edges: tuple(sorted((fps[a], fps[b]))) in e) == comp


# --- 9, quality rules


def brute_quality(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if seen[x] > 1 for d in range(5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, docs, rows, clashing, no_docs):
    want = Counter((r[0], *brute_quality(r[1])) for r in rows)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(quality_rules(docs), *cols) == want
    assert got(quality_rules(clashing), *cols) == want
    assert quality_rules(no_docs).count() == 0
    common = "the of and to a in is that it for was on with as by be".split()
    good = [(i, " ".join(f"{common[(i + k) % 16]} prose{chr(97 + k % 26)} about thing{chr(97 + k // 26)}{chr(97 + i)}, written" for k in range(40)), "en") for i in range(20)]
    bad = [(100, " ".join(f"THEN{k}!! WORDS{k}!!" for k in range(60)), "en"), (101, " ".join(f"zzz{k}### qqq{k}$$$" for k in range(60)), "en"), (103, " ".join(f"the of and {'to a in is that it for was on with'.split()[k % 10]} x{k}" for k in range(60)), "en")]
    fine = [(102, "short but clean text of the eleven words that is kept", "en"), (104, " ".join(f"każdy{chr(97 + k % 26)} człowiek ma swoje prawo{chr(97 + k // 26)}" for k in range(30)), "pl"), (105, " ".join(f"слово{chr(1072 + k % 30)} и дело{chr(1072 + k // 30)}" for k in range(60)), "ru")]
    judged = quality_rules(spark.createDataFrame(good + bad + fine, "doc_id long, text string, lang string"))
    kept = {r[0] for r in judged.where("kept").collect()}
    assert kept >= {102, 104, 105} and not kept & {100, 101, 103}
    far = {r["doc_id"]: r for r in judged.collect()}
    assert far[101]["char_distance"] > 0.17 and far[103]["word_distance"] > 0.35 and far[104]["word_distance"] is None and far[105]["char_distance"] is None
    own = fit_references(spark.createDataFrame(good, "doc_id long, text string, lang string"))
    assert abs(sum(own["en"][0]) - 1) < 1e-9 and abs(sum(own["en"][1]) - 1) < 1e-9 and own["de"] == REFERENCES["de"]
    again = quality_rules(spark.createDataFrame(good, "doc_id long, text string, lang string"), references=own, max_char_distance=0.1, max_word_distance=0.1)
    assert again.where("kept").count() == len(good) == len(kept & set(range(20)))


def test_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0])], "p array<double>, q array<double>")
    assert [r[0] for r in df.select(jensen_shannon(F.col("p"), F.col("q"))).collect()] == [0.0, 1.0]


# --- 1, mixing


def test_mixing(spark, docs, rows, clashing, no_docs):
    def count(rate, i):
        u = int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, np.exp(-rate), np.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        return k

    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(r[1] or "")
    whole, powers = sum(size.values()), sum(v**0.7 for v in size.values())
    rate = {s: v**0.7 / powers * whole / v for s, v in size.items()}
    want = Counter()
    for r in rows:
        for c in range(n := count(rate[r[3]], r[0])):
            want[(r[0], r[3], c, n, r[1])] += 1
    assert got(mix_sources(docs), "doc_id", "source", "copy", "copies", "text") == want
    assert got(mix_sources(clashing), "doc_id", "source", "copy", "copies", "text") == want
    assert mix_sources(no_docs).count() == 0
    only = mix_sources(docs, {"s1": 2.0})
    assert {r[0] for r in only.select("source").collect()} == {"s1"}
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    shares = {r[0]: r[1] for r in mix_sources(many, {"a": 3, "b": 1}, epochs=2.0).groupBy("source").count().collect()}
    assert abs(shares["a"] / 30_000 - 1) < 0.03 and abs(shares["b"] / 10_000 - 1) < 0.03


# --- 5 and 10, tokens


def ids_of(name, rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [[*t.encode(r[1] or "", add_special_tokens=False).ids, end] for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, rows, clashing, no_docs, tmp_path):
    import pyarrow.parquet as pq

    ids = ids_of("byte_bpe_50k.json", rows, 0)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    start, want = 0, Counter()
    for i in order:
        want[(rows[i][0], start, len(ids[i]), crc(ids[i]))] += 1
        start += len(ids[i])
    path = tokenizer_path("byte_bpe_50k.json")
    where = f"{tmp_path}/tokens"
    assert got(token_files(docs, path, path=where), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert got(token_files(clashing, path), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_files(no_docs, path).count() == 0
    part = sorted((tmp_path / "tokens").glob("part-*.parquet"))[0]
    meta = pq.ParquetFile(part).metadata.row_group(0)
    column = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in column["ids.list.element"].encodings and column["doc_id"].has_column_index
    assert pq.read_table(part, columns=["doc_id", "n_tokens"]).num_columns == 2


def check_packing(out, size):
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(by)


def test_packing(docs, rows, clashing, no_docs):
    ids = ids_of("word_bpe_49k.json", rows, 1)
    want = Counter()
    for r, x in zip(rows, ids, strict=True):
        for p, s in enumerate(range(0, len(x), 4096)):
            part = x[s : s + 4096]
            want[(r[0], p, s, len(part), crc(part))] += 1
    path = tokenizer_path("word_bpe_49k.json")
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    for frame in (docs, clashing):
        out = pack_documents(frame, path)
        assert got(out, *cols) == want
        assert check_packing(out.collect(), 4096) <= -(-sum(map(len, ids)) // 4096) + 1
    assert pack_documents(no_docs, path).count() == 0
    carried = pack_documents(docs, path, with_ids=True).where("piece = 0 and doc_id = 1").first()
    assert list(carried["ids"]) == ids[0][:4096]


def test_packing_rounds_and_capacities(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 3000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long").repartition(5)
    out = pack(df, size=1000, documents=1000, attention=10**6, group=300).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    assert check_packing(out, 1000) <= -(-int(sizes.sum()) // 1000) * 1.01 + 1
    order = np.sort(sizes)[::-1]
    for score in ("norm", "dot"):
        bins = best_fit(order, 1000, 4, 200_000, score=score)
        for b in np.unique(bins):
            own = order[bins == b]
            assert own.sum() <= 1000 and len(own) <= 4 and ((own.astype(int) ** 2).sum() <= 200_000 or len(own) == 1)
        out = pack(df, size=1000, documents=3, attention=120_000, group=300, score=score).collect()
        assert sorted(r["doc_id"] for r in out) == list(range(3000))
        check_packing(out, 1000)
        by = defaultdict(list)
        for r in out:
            by[r["sequence_id"]].append(r["length"])
        assert all(len(x) <= 3 and (sum(n * n for n in x) <= 120_000 or len(x) == 1) for x in by.values())
        assert len(by) <= 1.15 * max(1000, (order.astype(int) ** 2).sum() / 120_000)


def brute_best_fit(lengths, size, weights):
    """The least weighted norm over all bins that fit, by its definition."""
    bins, out = [], []
    for n in lengths:
        need = (n, 1, n * n)
        fits = [b for b, left in enumerate(bins) if all(x >= y for x, y in zip(left, need, strict=True))]
        if not fits:
            bins.append(list(size))
            fits = [len(bins) - 1]
        norm = lambda b, need=need: sum(w * ((x - y) / s) ** 2 for w, x, y, s in zip(weights, bins[b], need, size, strict=True))
        best = min(fits, key=norm)
        bins[best] = [x - y for x, y in zip(bins[best], need, strict=True)]
        out.append(best)
    return out


def test_best_fit_is_the_least_norm():
    rng = np.random.default_rng(8)
    order = np.sort(rng.integers(1, 300, 400))[::-1]
    assert best_fit(order, 1000, 6, 150_000).tolist() == brute_best_fit(order.tolist(), (1000, 6, 150_000), (1.0, 0.25, 0.25))


def test_best_fit_with_the_querys_parameters():
    """Every piece's bin has the least weighted norm of all three residuals, by a look at all bins; a bin is opened only if none fits;
    and the other two capacities change where pieces go though they can't bind."""
    rng = np.random.default_rng(12)
    order = np.sort(np.minimum(4096, rng.lognormal(5.5, 1.3, 3000).astype(int) + 1))[::-1].copy()
    size, weights = (4096, 4096, 4096**2), (1.0, 0.25, 0.25)
    bins, rooms = best_fit(order, *size), []
    for n, b in zip(order.tolist(), bins.tolist(), strict=True):
        need = (n, 1, n * n)
        norm = lambda room, need=need: sum(w * ((x - y) / s) ** 2 for w, x, y, s in zip(weights, room, need, size, strict=True))
        fits = [norm(r) for r in rooms if all(x >= y for x, y in zip(r, need, strict=True))]
        if b == len(rooms):
            assert not fits
            rooms.append(list(size))
        else:
            assert norm(rooms[b]) <= min(fits) + 1e-12
        rooms[b] = [x - y for x, y in zip(rooms[b], need, strict=True)]
        assert min(rooms[b]) >= 0
    assert len(rooms) == -(-int(order.sum()) // 4096)
    assert (best_fit(order, *size, weights=(1.0, 0.0, 0.0)) != bins).any()
