"""Operator 4, embedding near-dedup: sign hashes in several tables, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, arrow_batches, connected_components, lean, output, quoted, runs, sized, whole_groups


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def enough_tables(bits: int, cosine: float, recall: float) -> int:
    """Tables of ``bits`` signs that find a pair at exactly ``cosine`` with probability ``recall``: two vectors agree on a
    hyperplane's side with probability 1 - angle / pi."""
    same = (1 - acos(cosine) / pi) ** bits
    return max(1, ceil(log(1 - recall) / log(1 - same)))


def cheapest_bits(n: int, squares: int, cosine: float, recall: float) -> int:
    """The signs a table for which work is least: more signs make smaller cells and need more tables. ``n`` vectors, ``squares``
    the sum of the labels' squared numbers of vectors; a comparison counts as a hundredth of a vector's transport."""
    cost = lambda bits: enough_tables(bits, cosine, recall) * (n + 0.01 * squares / 2**bits)
    return min(range(1, 32), key=cost)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision. Norms that overflow or vanish are those of vectors divided by their largest component."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        norm = np.linalg.norm(x, axis=1)
    odd = ~((norm > 1e-100) & (norm < 1e100))
    if odd.any():
        x[odd] /= np.abs(x[odd]).max(1)[:, None]
        norm[odd] = np.linalg.norm(x[odd], axis=1)
    return x / norm[:, None]


def signatures(distinct: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """Adds ``sig``: for each table the ``bits`` signs of the vector at random hyperplanes, as an int."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits)).astype(np.int64)
        for b in batches:
            dims, vec = b.column(b.schema.get_field_index("dim")).to_numpy(), b.column(b.schema.get_field_index("vec"))
            sig = np.zeros((b.num_rows, tables), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = _matrix(vec.take(pa.array(at)), d)
                sig[at] = ((x @ hyperplanes(d, tables, bits, seed)) > 0).reshape(-1, tables, bits) @ weights
            flat = pa.array(sig.astype(np.int32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, tables), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "sig"])

    return distinct.mapInArrow(lean(run), output(distinct, distinct.columns, "sig array<int>"))


def _linked(unit: np.ndarray, sig: np.ndarray, table: int, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a cell link; and which of them no earlier table has found already, so that each counts once."""
    link = unit @ unit.T >= cosine
    np.fill_diagonal(link, False)
    if side[0] >= 0:
        link &= side[:, None] != side[None, :]
    fresh = link.copy()
    for t in range(table):
        if not fresh.any():
            break
        fresh &= sig[:, None, t] != sig[None, :, t]
    return link, fresh


def _tree(link: np.ndarray) -> Iterator[tuple[int, int]]:
    left = np.arange(len(link))
    while len(left) > 1:
        root, todo, left = int(left[0]), [int(left[0])], left[1:]
        while todo and len(left):
            near = link[todo.pop(), left]
            if near.any():
                hit = left[near].tolist()
                left = left[~near]
                todo.extend(hit)
                yield from ((root, h) for h in hit)


def links(signed: DataFrame, *, cosine: float, max_cell: int) -> DataFrame:
    """(h, found, peer), h a distinct vector: numbers of vectors that it links with, in parts to be added up, and edges that
    connect what links connect. A cell is the vectors of one label and dimension that share a table's signs; only cells of
    two and more get vectors sent. A cell over ``max_cell`` is dealt out as pairs of blocks, which keep its pairs whole."""
    keys = signed.select("h", "label", "dim", F.posexplode("sig").alias("tab", "signs")).select("h", "tab", F.xxhash64("label", "dim", "tab", "signs").alias("cell"))
    sizes = keys.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = keys.join(sizes, "cell")
    blocks = F.ceil(F.col("size") / max_cell).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64("h", "cell"), blocks).cast("int")).otherwise(F.lit(-1))
    members = members.select("h", "tab", "cell", own.alias("own"), F.explode(F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(-1)))).alias("other"))
    pair = F.when(F.col("own") < 0, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))
    sent = members.select("h", "tab", pair.alias("cell"), side.alias("side")).join(signed.select("h", "n", "dim", "vec", "sig"), "h")
    sent = sent.select("cell", "h", "tab", "side", "n", "dim", "vec", "sig")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell", 1 << 13):
            t = t.combine_chunks()
            cell, node, tab, side_, n, dims = (t.column(k).to_numpy() for k in ("cell", "h", "tab", "side", "n", "dim"))
            vec, sig = t.column("vec").combine_chunks(), t.column("sig").combine_chunks()
            sig = sig.flatten().to_numpy().reshape(len(cell), -1)
            out: list[tuple[int, int, int | None]] = []
            for s, e in zip(*(x.tolist() for x in runs(cell)), strict=True):
                if e - s < 2:
                    continue
                x = _matrix(vec.slice(s, e - s), int(dims[s]))
                link, fresh = _linked(x, sig[s:e], int(tab[s]), side_[s:e], cosine)
                if not link.any():
                    continue
                found = fresh @ n[s:e]
                out += [(r, f, None) for r, f in zip(node[s:e].tolist(), found.tolist(), strict=True) if f]
                if fresh.any():
                    out += [(int(node[s + a]), 0, int(node[s + b])) for a, b in _tree(link)]
            if out:
                a, b, c = zip(*out, strict=True)
                yield from arrow_batches({"h": pa.array(a, pa.int64()), "found": pa.array(b, pa.int64()), "peer": pa.array(c, pa.int64())})

    return sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(run), "h long, found long, peer long")


def embedding_dedup(vectors: DataFrame, *, cosine: float = 0.98, recall: float = 0.999, tables: int | None = None, bits: int | None = None, seed: int = 42, max_cell: int = 2048, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector: vec_id, n_links (other vectors of its label found at ``cosine`` or more), component_id, kept.

    Equal vectors of a label are folded into one with a count first. Pairs are found if they share the signs at ``bits`` random
    hyperplanes in one of ``tables`` tables, and verified in double precision: of pairs at exactly ``cosine`` a share of
    ``recall`` is found, of closer ones more. By default both numbers come from how many vectors the labels have, so that
    cells stay small at any size. Pairs aren't emitted: a cell yields counts and a spanning forest.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those without label or vec_id, link with
    nothing: n_links 0, component_id their vec_id, kept. Rows that repeat a vec_id count as vectors of their own and
    share its component. Vectors of different dimensions don't link; those of any norm do. An empty table gives an empty
    one; other columns are ignored. Rows find their class by 128 bits of hash over label and vector.
    """
    v = F.col("vec")
    rows = vectors.select(F.col(quoted(vec_id)).cast("long").alias("id"), F.col(quoted(label)).cast("string").alias("label"), F.col(quoted(embedding)).alias("vec"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite, F.lit(False))
    hashed = rows.withColumns({"a": F.when(ok, F.xxhash64("label", "vec")), "b": F.when(ok, F.xxhash64(F.lit(1), "vec", "label"))})
    distinct = hashed.where(F.col("a").isNotNull()).groupBy("a", "b", "label", "vec").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    distinct = Table(sized(distinct.withColumn("h", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), vectors), "distinct").read()
    if bits is None:
        by = distinct.groupBy("label", "dim").agg(F.count("*").alias("m")).agg(F.sum("m").alias("n"), F.sum(F.col("m").cast("double") * F.col("m")).alias("squares")).first()
        bits = cheapest_bits(by["n"] or 1, by["squares"] or 1, cosine, recall)
    tables = tables or enough_tables(bits, cosine, recall)
    signed = Table(signatures(distinct.drop("a", "b"), tables, bits, seed), "signed").read()
    found = Table(sized(links(signed, cosine=cosine, max_cell=max_cell), signed), "links").read()
    parts = found.groupBy("h").agg(F.sum("found").alias("found"))
    nodes = connected_components(found.where(F.col("peer").isNotNull()).select(F.col("h").alias("a"), F.col("peer").alias("b")))
    classes = distinct.select("h", "a", "b", "low", "n").join(parts, "h", "left").join(nodes, F.col("h") == F.col("node"), "left")
    classes = classes.select("a", "b", "low", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "h").alias("class"))
    classes = Table(sized(classes, distinct), "classes").read()
    lowest = Table(sized(classes.groupBy("class").agg(F.min("low").alias("component")), classes), "lowest").read()
    classes = classes.join(lowest, "class").select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), "n_links", "component")
    out = hashed.select("id", "a", "b").join(classes, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")), "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""
