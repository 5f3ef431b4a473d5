"""Operator 7, substring dedup: hashes of all windows of words, counted; repeated windows merge into removed intervals."""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_BASE, _WORD_BASE, CHECK_BASES, Table, buffers, carried, give_back, hashable, output, quoted, restored, sized, window_hashes, words_of


#: The bases of a window's hash (words' bytes, then words) and of its check.
BASES = (_BYTE_BASE, CHECK_BASES[0]), (_WORD_BASE, CHECK_BASES[1])
Hashes = tuple[np.ndarray, np.ndarray]


def bucket_windows(column: pa.Array, width: int) -> tuple[Hashes, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Of all windows of a bucket's texts the hashes (64 bits) and checks (32 bits of an independent hash); and for each run
    of rows (i, j) its words by row and its windows' places."""
    data, off = buffers(column)
    hashes, checks, runs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], []
    for i, j, ids, counts in words_of(data, off, BASES[0]):
        (h, at), (c, _) = (window_hashes(x, counts, width, base) for x, base in zip(ids, BASES[1], strict=True))
        hashes.append(h)
        checks.append((c >> np.uint64(32)).astype(np.uint32))
        runs.append((i, j, counts, at))
    return (np.concatenate(hashes), np.concatenate(checks)), runs


def encode_sorted(values: np.ndarray, base: int) -> tuple[int, bytes]:
    """Ascending 64-bit values as differences of as few bytes as the largest takes."""
    if not len(values):
        return 1, b""
    d = np.diff(values, prepend=np.uint64(base))
    size = max(1, (int(d.max()).bit_length() + 7) // 8)
    return size, d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def decode_sorted(size: int, raw: bytes, base: int) -> np.ndarray:
    d = np.zeros((len(raw) // size, 8), np.uint8)
    d[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return np.cumsum(d.view("<u8").reshape(-1), dtype=np.uint64) + np.uint64(base)


def in_order(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The order by hash, then check. Equal hashes with different checks are rare, so the hashes alone are tried first."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    return np.lexsort((checks, hashes)) if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any() else order


def _new(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (c[1:] != c[:-1])))


class Distinct:
    """A bucket's distinct windows in order: their hashes, checks, which of them it has once, where each range of hashes starts
    and ends, and which of them each window is (``at``)."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, bits: int):
        order = in_order(hashes, checks)
        h, c = hashes[order], checks[order]
        new = _new(h, c)
        first = np.flatnonzero(new)
        self.hashes, self.checks = h[first], c[first]
        self.once = np.diff(np.append(first, len(h))) == 1
        self.starts = np.searchsorted(self.hashes, bounds(bits))
        self.ends = np.append(self.starts[1:], len(first))
        self.at = np.zeros(len(h), np.int64)
        self.at[order] = np.cumsum(new) - 1


def bounds(bits: int) -> np.ndarray:
    return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)


MESSAGE = "bucket int, range int, once_size int, once binary, once_check binary, many_size int, many binary, many_check binary"


def _send(width: int, bits: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        d = Distinct(*bucket_windows(t.column("t"), width)[0], bits)
        out = {k: [] for k in ("range", "once_size", "once", "once_check", "many_size", "many", "many_check")}
        low = bounds(bits)
        for r in np.flatnonzero(d.ends > d.starts).tolist():
            own = slice(d.starts[r], d.ends[r])
            row = [r]
            for which in (d.once[own], ~d.once[own]):
                row += [*encode_sorted(d.hashes[own][which], int(low[r])), d.checks[own][which].astype("<u4").tobytes()]
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        types = {"range": pa.int32(), "once_size": pa.int32(), "many_size": pa.int32()}
        cols = {k: pa.array(v, types.get(k, pa.binary())) for k, v in out.items()}
        give_back()
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(out["range"]), pa.int32())} | cols)

    return run


def repeated(parts: list[Hashes]) -> Hashes:
    """The windows that occur more than once in ``parts``, in order."""
    h, c = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = in_order(h, c)
    h, c = h[order], c[order]
    again = ~_new(h, c)
    h, c = h[again], c[again]
    one = _new(h, c)
    return h[one], c[one]


def among(own: Hashes, known: Hashes) -> np.ndarray:
    """Which of the windows ``own`` are in ``known``, which is in order and not empty."""
    h, c = known
    first = np.searchsorted(h, own[0])
    hit = np.zeros(len(own[0]), bool)
    s = np.flatnonzero(_new(h, np.zeros(len(h), np.uint32)))
    for k in range(int(np.diff(np.append(s, len(h))).max())):  # 1, unless hashes agree by chance
        i = np.minimum(first + k, len(h) - 1)
        hit |= (h[i] == own[0]) & (c[i] == own[1])
    return hit


def _count(bits: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        base = key[0].as_py() << (64 - bits) if bits else 0
        read = lambda what: [(decode_sorted(s, r, base), np.frombuffer(c, "<u4")) for s, r, c in zip(*(t.column(f"{what}{x}").to_pylist() for x in ("_size", "", "_check")), strict=True)]
        once, many = read("once"), read("many")
        twice = repeated([*once, *many, *many])
        out_bucket, out_flags = [], []
        if len(twice[0]):
            for b, own in zip(t.column("bucket").to_pylist(), once, strict=True):
                hit = among(own, twice)
                if hit.any():
                    out_bucket.append(b)
                    out_flags.append(np.packbits(hit).tobytes())
        n = len(out_bucket)
        give_back()
        return pa.table({"bucket": pa.array(out_bucket, pa.int32()), "range": pa.array([key[0].as_py()] * n, pa.int32()), "flags": pa.array(out_flags, pa.binary())})

    return run


def repeated_mask(d: Distinct, flags: dict[int, bytes]) -> np.ndarray:
    """Which windows of a bucket start more than once anywhere, from what the bucket has itself and the ranges' flags."""
    bad = ~d.once
    for r, raw in flags.items():
        at = d.starts[r] + np.flatnonzero(d.once[d.starts[r] : d.ends[r]])
        bad[at[np.unpackbits(np.frombuffer(raw, np.uint8), count=len(at)).astype(bool)]] = True
    return bad[d.at]


def _cut(width: int, bits: int, names: list[str]) -> Callable:
    def run(key: tuple[pa.Scalar, ...], t: pa.Table, marks: pa.Table) -> pa.Table:
        column = t.column("t")
        windows, runs = bucket_windows(column, width)
        bad = repeated_mask(Distinct(*windows, bits), dict(zip(marks.column("range").to_pylist(), marks.column("flags").to_pylist(), strict=True)))
        data, off = buffers(column)
        texts, n_words, n_removed, at = [], [], [], 0
        for i, j, counts, places in runs:
            first = places[bad[at : at + len(places)]]
            at += len(places)
            cover = np.zeros(int(counts.sum()) + 1, np.int32)  # windows are distinct places, and so are their ends
            cover[first] += 1
            cover[first + width] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            ends = np.concatenate(([0], np.cumsum(counts)))
            for r in range(i, j):
                own = keep[ends[r - i] : ends[r - i + 1]]
                words = data[off[r] : off[r + 1]].tobytes().split()
                left = int(own.sum())
                texts.append(b" ".join(words if left == len(words) else compress(words, own.tolist())))
                n_words.append(len(words))
                n_removed.append(len(words) - left)
        cols = {n: t.column(n) for n in names}
        out = pa.table(cols | {"t": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})
        del windows, runs, bad, texts
        give_back()
        return out

    return run


def substring_dedup(docs: DataFrame, *, width: int = 35, bucket_bytes: int = 12 << 20, range_bytes: int = 24 << 20, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Removes every word that a repeated window of ``width`` words covers.

    Returns ``carry`` columns (all but ``text`` by default), text (the kept words joined by a space), n_words, n_removed.
    Texts are dealt by hash into buckets of about ``bucket_bytes``. A bucket's task hashes every window (Rabin-Karp, 96 bits:
    64 and a check of 32 by other bases) and sends its distinct hashes, sorted and packed, to the task of their range, that of about
    ``range_bytes`` of text; that one counts and answers with one bit a hash. A window in any number of texts is one
    entry a bucket, so no window is a hot key. Then each bucket merges its repeated windows into maximal intervals. Two
    passes move the text; between them about ten bytes a word move, in size^2 / (bucket_bytes * range_bytes) messages. Both
    sizes set how many tasks there are, a bucket or range each, whatever the session's number of shuffle partitions.

    All copies of a repeated passage go, the first too, and windows are judged on the input. Hashes stand for word
    sequences: with n windows about n^2 / 2^97 pairs collide by chance, 0.002 in 10^13. Null or blank text: no words, an empty text. Rows
    that repeat a doc_id are texts of their own (so copies remove each other). A very long text is hashed in pieces, in the
    bucket's task. Rows are dealt by all that they carry; only those equal in all of it share a bucket whatever their number.
    An empty table gives an empty one. Columns named n_words or n_removed are replaced; others may have any name.
    """
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (text, "n_words", "n_removed")]
    names = [f"c{i}" for i in range(len(carry))]
    size = docs.agg(F.sum(F.octet_length(F.col(quoted(text))))).first()[0] or 0
    cores = 2 * spark.sparkContext.defaultParallelism
    buckets = max(cores, ceil(size / bucket_bytes))
    bits = max(0, ceil(np.log2(max(cores, size / range_bytes))))
    dealt = [F.col(quoted(c)) for c in dict.fromkeys((doc_id, *carry)) if hashable(docs.schema[c].dataType)]
    key = F.pmod(F.xxhash64(*dealt, F.xxhash64(F.col(quoted(text)))), F.lit(buckets)).cast("int").alias("bucket")
    rows = docs.select(*carried(carry), F.col(quoted(text)).alias("t"), key)
    sent = rows.select("bucket", "t").repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_send(width, bits), MESSAGE)
    marks = sent.repartitionById(1 << bits, F.col("range")).groupBy("range").applyInArrow(_count(bits), "bucket int, range int, flags binary")
    marks = Table(sized(marks, docs), "repeated").read()
    done = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").cogroup(marks.repartitionById(buckets, F.col("bucket")).groupBy("bucket"))
    done = done.applyInArrow(_cut(width, bits, names), output(rows, names, "t string, n_words long, n_removed long"))
    return done.select(*restored(carry), F.col("t").alias(text), "n_words", "n_removed")


WINDOW_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
s AS (SELECT doc_id, pos, ws[pos] AS word, CASE WHEN pos + 34 <= len(ws) THEN md5(array_to_string(ws[pos:pos + 34], ' ')) END AS h FROM p),
r AS (SELECT h FROM s WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
m AS (SELECT s.*, r.h IS NOT NULL AS rep FROM s LEFT JOIN r USING (h)),
c AS (SELECT doc_id, pos, word, max(rep::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM m)
SELECT d.doc_id, count(c.pos) AS n_words, count(c.pos) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
"""
