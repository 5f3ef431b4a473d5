"""Operator 8, SimHash near-dedup: fingerprints, a grid join of their segments' bit counts, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, arrow_batches, buffers, carried, connected_components, hashable, ints, lean, quoted, restored, runs, sized, sql_type, whole_groups

BITS = 64


# --- fingerprints ----------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """The SimHash of a UTF-8 text: bits set in over half of the XXH64 hashes of its word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hash_ = xxhash.xxh64_intdigest
    h = np.fromiter((hash_(joined[a:b], seed) for a, b in pairs), np.uint64, len(words) - k + 1)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, shingle: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """(id, fp) of each row, fp the fingerprint's bits as a long; null text has no words, so fp 0. ``more`` adds long columns."""
    more = more or {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            got = [fingerprint(data[off[i] : off[i + 1]].tobytes(), shingle, seed) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ints(np.array(got, np.uint64)), *batch.columns[2:]], names=["id", "fp", *batch.schema.names[2:]])

    source = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("t"), *[c.alias(k) for k, c in more.items()])
    return source.mapInArrow(lean(run), f"id {sql_type(source, 'id')}, fp long" + "".join(f", {k} long" for k in more))


# --- grid join -------------------------------------------------------------------------------------

#: Segments of two bits: their numbers of bits set are the axes of the embedding.
WIDTH, AXES = 2, BITS // 2
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedded(fp: Column) -> Column:
    """The counts of bits set in each segment, as unary digits: 0, 1 or 2 as 00, 01 or 11. So a point of the grid is one long, and
    the Manhattan distance of two points is the number of bits in which they differ. It is at most the Hamming distance."""
    half, low = F.shiftrightunsigned(fp, 1), F.lit(_LOW)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def embed(fp: np.ndarray) -> np.ndarray:
    """``embedded`` of an array of unsigned longs."""
    half, low = fp >> np.uint64(1), np.uint64(_LOW)
    return ((fp | half) & low) | ((fp & half & low) << np.uint64(1))


def cell_masks(distance: int, groups: int) -> list[int]:
    """The axes of each kind of cell. Axes are dealt into ``groups`` groups; points at Manhattan distance up to ``distance``
    differ on at most that many axes, so for one choice of ``groups - distance`` groups they agree on all axes of it."""
    return [sum(3 << (WIDTH * axis) for g in chosen for axis in range(g, AXES, groups)) for chosen in combinations(range(groups), groups - distance)]


def grid_groups(fps: DataFrame, distance: int) -> int:
    """How many groups of axes cost least: more groups are more cells a point, but cells of more axes, which hold fewer
    points. The number of points in a cell comes from the number of points and each axis' rate of equal pairs."""
    e = embedded(F.col("fp"))
    digit = [F.shiftrightunsigned(e, WIDTH * k).bitwiseAND(F.lit(3)) for k in range(AXES)]
    sums = [F.sum((d == x).cast("long")).alias(f"a{k}_{x}") for k, d in enumerate(digit) for x in (0, 3)]
    row = fps.agg(F.count("*").alias("n"), *sums).first()
    n = max(1, row["n"])
    shares = [((row[f"a{k}_0"] or 0) / n, (row[f"a{k}_3"] or 0) / n) for k in range(AXES)]
    equal = [x * x + y * y + (1 - x - y) ** 2 for x, y in shares]

    def cost(groups: int) -> float:
        chosen = list(combinations([prod(equal[g::groups]) for g in range(groups)], groups - distance))
        return len(chosen) + 0.05 * n * sum(map(prod, chosen))

    return min(range(distance + 1, min(AXES, distance + 10) + 1), key=cost)


def grid_cells(fps: DataFrame, distance: int, groups: int) -> DataFrame:
    """(cell, fp) for every grid cell that a fingerprint's point lies in."""
    cells = F.array(*[F.xxhash64(F.lit(k), F.col("e").bitwiseAND(F.lit(_signed(mask)))) for k, mask in enumerate(cell_masks(distance, groups))])
    return fps.select("fp", embedded(F.col("fp")).alias("e")).select(F.explode(cells).alias("cell"), "fp")


def _near(fp: np.ndarray, at: np.ndarray, i, distance: int, j: np.ndarray) -> np.ndarray:
    """Which of the fingerprints j are within ``distance`` of fingerprints i: those whose points are, then by the bits themselves."""
    near = np.bitwise_count(at[j] ^ at[i]) <= distance
    some = np.flatnonzero(near)
    near[some] = np.bitwise_count(fp[j[some]] ^ (fp[i[some]] if isinstance(i, np.ndarray) else fp[i])) <= distance
    return near


def _forest(fp: np.ndarray, distance: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of a cell connect, one less than a component's members: each member is expanded
    once, against those not yet reached, so that dense families shrink at once. ``side``: only links across count."""
    point, left, a, b = embed(fp), np.arange(len(fp)), [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        root = todo[0]
        while todo and len(left):
            at = todo.pop()
            near = _near(fp, point, at, distance, left)
            if side is not None:
                near &= side[left] != side[at]
            if near.any():
                hit = left[near]
                left = left[~near]
                todo.extend(hit.tolist())
                a.append(np.full(len(hit), fp[root]))
                b.append(fp[hit])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _cell_edges(cells: np.ndarray, fp: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    s, e = runs(cells)
    point, left, right = embed(fp), [], []
    small = (e - s) <= 16
    for d in range(1, 16):  # small cells, all at once: neighbours at each offset
        if not (has := small & (e - s > d)).any():
            break
        i = _offsets(s[has], e[has] - d)
        ok = _near(fp, point, i, distance, i + d) & ((side[i] < 0) | (side[i] != side[i + d]))
        left.append(fp[i[ok]])
        right.append(fp[i[ok] + d])
    for x, y in zip(s[~small].tolist(), e[~small].tolist(), strict=True):
        a, b = _forest(fp[x:y], distance, side[x:y] if side[x] >= 0 else None)
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _offsets(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    n = e - s
    return np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def hamming_links(fps: DataFrame, distance: int = 4, *, groups: int | None = None, max_cell: int = 1 << 17) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that links at ``distance`` connect.

    A range join on the grid of the embedding: points share a cell if they are within Manhattan distance ``distance``. Cells
    come sorted to Python, which drops candidates whose points are farther apart than that, the lower bound, verifies the rest by
    their exact Hamming distance and emits a spanning forest of a cell, not its pairs. A cell over ``max_cell``
    fingerprints is dealt out as pairs of blocks. ``groups`` sets how selective the cells are (``grid_groups`` by default),
    and never changes what is connected.
    """
    groups = groups or grid_groups(fps, distance)
    cells = grid_cells(fps, distance, groups)
    big = Table(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > max_cell).select(F.col("cell").alias("big"), F.ceil(F.col("n") / max_cell).cast("int").alias("blocks")), "cells").read()
    if big.isEmpty():
        dealt = cells.select("cell", "fp", F.lit(-1).alias("side"))
    else:
        j = cells.join(big, F.col("cell") == F.col("big"), "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        block = F.explode(F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1))))
        j = j.select("cell", "fp", F.coalesce(own, F.lit(-1)).alias("own"), block.alias("other"))
        pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
        dealt = j.select(F.when(F.col("own") < 0, F.col("cell")).otherwise(pair).alias("cell"), "fp", F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("side"))

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell"):
            c, f, s = (t.column(i).combine_chunks().to_numpy() for i in range(3))
            a, b = _cell_edges(c, f.view(np.uint64), s, distance)
            if len(a):
                yield from arrow_batches({"a": ints(a), "b": ints(b)})

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(link), "a long, b long")


# --- operator ----------------------------------------------------------------------------------------


def simhash_groups(docs: DataFrame, *, distance: int = 4, shingle: int = 4, seed: int = 42, groups: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links, itself included).

    Copies have one fingerprint and are folded before any join, so a group of copies of any size is one point; text
    never moves. A text's words and shingle hashes live in one Python worker while it is hashed, about 100 bytes a word.

    Null and blank texts have fingerprint 0 and link like any other. Rows that repeat a doc_id are each returned. Null
    doc_ids don't count as a smallest one. An empty table gives an empty one; extra columns don't matter.
    """
    out = _labelled(sized(fingerprints(docs, shingle=shingle, seed=seed, doc_id=doc_id, text=text), docs), distance, groups)
    return out.select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(prints: DataFrame, distance: int, groups: int | None) -> DataFrame:
    """The rows of ``prints`` (id, fp, more), with the label of each one's group and its component_id."""
    kept = Table(prints, "fingerprints").read()
    distinct = Table(sized(kept.groupBy("fp").agg(F.min("id").alias("low")), kept), "distinct").read()
    nodes = connected_components(hamming_links(distinct, distance, groups=groups))
    labelled = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("label"))
    labelled = Table(sized(labelled, distinct), "labels").read()
    lowest = Table(sized(labelled.groupBy("label").agg(F.min("low").alias("component_id")), labelled), "lowest").read()
    by_fp = labelled.join(lowest, "label").select(F.col("fp").alias("of"), "label", "component_id")
    return kept.join(by_fp, F.col("fp") == F.col("of")).drop("of")


def simhash_dedup(docs: DataFrame, *, distance: int = 4, shingle: int = 4, seed: int = 42, groups: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each near-duplicate group stays: that of the smallest
    doc_id; of rows that repeat it in the group, the one with the smallest hash of its text, then of its other columns.

    Rows without doc_id all stay: nothing names them. Null and blank texts are one group. An empty table gives an empty
    one; columns may have any names. Texts move once, to the join that picks the rows that stay.
    """
    names = docs.columns
    whole = F.xxhash64(*[F.col(quoted(f.name)) for f in docs.schema if hashable(f.dataType)])
    prints = fingerprints(docs, shingle=shingle, seed=seed, doc_id=doc_id, text=text, more={"h": F.xxhash64(F.col(quoted(text))), "r": whole})
    first = _labelled(sized(prints, docs), distance, groups).where(F.col("id").isNotNull()).groupBy("label").agg(F.min(F.struct("id", "h", "r")).alias("s"))
    stay = Table(sized(first.select(F.col("s.id").alias("id"), F.col("s.h").alias("h"), F.col("s.r").alias("r")), docs), "stay").read()
    rows = docs.select(*carried(names), F.col(quoted(doc_id)).alias("id"), F.xxhash64(F.col(quoted(text))).alias("h"), whole.alias("r"))
    kept = rows.where(F.col("id").isNotNull()).join(stay, ["id", "h", "r"], "left_semi")
    copy = F.row_number().over(Window.partitionBy("id", "h", "r").orderBy("h"))
    kept = kept.withColumn("copy", copy).where(F.col("copy") == 1).select(*restored(names))
    return kept.unionAll(rows.where(F.col("id").isNull()).select(*restored(names)))
