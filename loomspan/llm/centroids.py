"""Operator 12, centroid clustering: rounds of nearest centroids under Elkan's bounds, exact in integers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, give_back, quoted, sized

#: Integer components may be this large: squared distances of up to 2^8 components then fit a long.
MOST = 1 << 26


def up(x: np.ndarray) -> np.ndarray:
    """The next double above: bounds from above stay so after a correctly rounded step."""
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    d = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", d, d)


class Step:
    """What a round needs to know of its centroids: how far each moved since the bounds were made, and half the distances
    between them. All are a few numbers a centroid."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids, k = centroids, len(centroids)
        self.moved = np.zeros(k) if before is None else up(np.sqrt(squared(centroids, before).astype(float)))
        self.moved[(centroids == before).all(1) if before is not None else slice(None)] = 0.0
        self.half = np.array([down(down(np.sqrt(squared(centroids, c[None, :]).astype(float))) / 2) for c in centroids])
        self.nearest = np.where(np.eye(k, dtype=bool), np.inf, self.half).min(1)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Step, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (the smallest number of equals), its bounds, its squared distance where that was
    computed (else -1; of all rows, if ``exact``), and how many distances were computed.

    ``upper`` bounds the distance to the own centroid, ``lower`` those to all, as of the centroids before they moved. A
    centroid is passed over only if it is farther for certain: where the upper bound is strictly below its lower bound or
    below half its distance from the own centroid. Bounds are rounded away from the truth, so a tie is never passed over."""
    k, c = len(step.centroids), step.centroids
    own, lower = own.copy(), np.where(step.moved > 0, down(lower - step.moved), lower)
    upper = np.where(step.moved[own] > 0, up(upper + step.moved[own]), upper)
    best, cost = np.full(len(x), -1, np.int64), 0

    def tighten(rows: np.ndarray) -> None:
        nonlocal cost
        rows = rows[best[rows] < 0]
        if len(rows):
            best[rows] = squared(x[rows], c[own[rows]])
            root = np.sqrt(best[rows].astype(float))
            upper[rows], lower[rows, own[rows]] = up(root), down(root)
            cost += len(rows)

    live = np.flatnonzero(~(upper < step.nearest[own]))
    for j in range(k):
        may = lambda rows: rows[(own[rows] != j) & ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < step.half[own[rows], j])]  # noqa: E731, B023
        rows = may(live)
        tighten(rows)
        rows = may(rows)
        if not len(rows):
            continue
        d = squared(x[rows], c[j])
        cost += len(rows)
        root = np.sqrt(d.astype(float))
        lower[rows, j] = down(root)
        closer = (d < best[rows]) | ((d == best[rows]) & (j < own[rows]))
        won = rows[closer]
        own[won], best[won], upper[won] = j, d[closer], up(root[closer])
    if exact:
        tighten(np.arange(len(x)))
    return own, upper, lower, best, cost


STATE = "id long, q array<int>, cluster int, upper double, lower array<double>, distance long"


def assigned(state: DataFrame, step: Step, exact: bool = False) -> DataFrame:
    """A round over all vectors: the state with clusters and bounds of this round's centroids."""
    k, dim = step.centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
            x = col("q").flatten().to_numpy().reshape(-1, dim)
            lower = col("lower").flatten().to_numpy().reshape(-1, k)
            own, upper, lower, best, _ = assign(x, col("cluster").to_numpy(), col("upper").to_numpy(), lower, step, exact)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, k), pa.int32()), pa.array(lower.reshape(-1)))
            yield pa.RecordBatch.from_arrays([col("id"), col("q"), pa.array(own, pa.int32()), pa.array(upper), lists, pa.array(best, mask=best < 0)], names=["id", "q", "cluster", "upper", "lower", "distance"])
        give_back()

    return state.mapInArrow(run, STATE)


def means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise exact floors of the clusters' means; an empty cluster's centroid stays. The driver gets one row a cluster."""
    dim, out = before.shape[1], before.copy()
    sums = ", ".join(f"sum(cast(q[{i}] as bigint))" for i in range(dim))
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.expr(f"array({sums})").alias("sums")).collect():
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def integer_vectors(vectors: DataFrame, dim: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(id, q): whole vectors of ``dim`` finite components, as integers floor(scale * x)."""
    e = F.col("e")
    whole = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(quoted(vec_id)).cast("long").alias("id"), F.col(quoted(embedding)).cast("array<double>").alias("e")).where(F.coalesce(whole, F.lit(False)))
    scaled = lambda x: F.when(F.abs(x) * scale < MOST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST / scale}"))).cast("int")
    return rows.select("id", F.transform(e, scaled).alias("q"))


def centroid_clusters(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid (its components).

    Vectors of exactly ``dim`` finite components are kept, as integers floor(``scale`` * x); null, shorter, longer and
    non-finite ones are left out. The first centroids are the ``k`` vectors with the smallest sha256 of "<seed>:<vec_id>" (null
    vec_ids last; rows with one vec_id by their components); fewer vectors make fewer clusters. In each round a vector goes
    to the nearest centroid, the smallest number of equals; then centroids become the floors of their means, empty ones stay.
    A last assignment follows. Rounds in which no centroid moves would repeat themselves and are left out.

    Each vector carries an upper bound and ``k`` lower bounds from round to round; distances are computed only where these
    leave a doubt, all in exact integers. A round is one pass without a shuffle and a sum a cluster and component with map-side
    combining; a hot cluster is no hot key. Its state is written, which cuts the lineage; the one before goes. The driver and the
    tasks hold k * dim centroid components, nothing else. Repeated rows are vectors of their own. An empty table gives an
    empty one; other columns are ignored. A component of 2^26 or more after scaling is an error: distances would leave longs.
    """
    if dim < 1 or dim > 256 or k < 1:
        raise ValueError("1 to 256 components and at least one cluster")
    rows = integer_vectors(vectors, dim, scale, vec_id, embedding)
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(start.asc_nulls_last(), "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(len(first), dim)
    blank = rows.select("id", "q", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0), len(first)).alias("lower"))
    if not len(first):
        none = blank.limit(0)
        return none.select(F.col("id").alias(vec_id), "cluster", *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(None).cast("array<long>").alias("centroid"))
    state, before, table = blank, None, None
    for turn in range(rounds + 1):
        last = turn == rounds or (before is not None and (before == centroids).all())
        made = Table(sized(assigned(state, Step(centroids, before), exact=last), vectors), "clusters")
        if table is not None:
            table.drop()
        table, state, before = made, made.read(), centroids
        if last:
            break
        centroids = means(state, centroids)
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    facts = [(j, sums.get(j, 0), sum(sums.values()), sha256(",".join(map(str, c)).encode()).hexdigest(), c) for j, c in enumerate(centroids.tolist())]
    of = vectors.sparkSession.createDataFrame(facts, "j int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    out = state.join(F.broadcast(of), F.col("cluster") == F.col("j"))  # a row a cluster
    return out.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def centroid_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """All rounds one after another: distances of all vectors to all centroids, sums by component."""
    step = [
        f"WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings WHERE len(embedding) = {dim} AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1)::INTEGER AS j, q FROM v QUALIFY j < {k})",
    ]
    for t in range(rounds + 1):
        step.append(f"a{t} AS MATERIALIZED (SELECT r, min((d, j)) AS near FROM (SELECT r, j, list_sum([(x[1] - x[2]) ** 2 FOR x IN list_zip(v.q, c.q)])::BIGINT AS d FROM v, c{t} c) GROUP BY r)")
        if t < rounds:
            step.append(f"m{t} AS MATERIALIZED (SELECT j, list(floor_ ORDER BY i) AS q FROM (SELECT near[2] AS j, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::HUGEINT // count(*) AS floor_ FROM (SELECT near, unnest(q) AS x, unnest(range({dim})) AS i FROM v JOIN a{t} USING (r)) GROUP BY ALL) GROUP BY j)")
            step.append(f"c{t + 1} AS MATERIALIZED (SELECT j, coalesce(m.q, c.q)::BIGINT[] AS q FROM c{t} c LEFT JOIN m{t} m USING (j))")
    return ",\n".join(step) + f"""
SELECT vec_id, near[2]::INTEGER AS cluster, near[1]::BIGINT AS distance, sum(near[1]) OVER (PARTITION BY near[2])::BIGINT AS cluster_inertia, sum(near[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.j = near[2]
"""
