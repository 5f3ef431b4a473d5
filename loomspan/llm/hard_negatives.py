"""Operator 11, hard-negative mining: dual-tree search over trees of anchors and of candidates, exact scores at the leaves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, arrow_batches, lean, quoted, sized

#: Scaled components stay below this; scores of vectors of up to 2,048 components then fit a long.
MOST = 1 << 26
#: No score is as far from zero as this.
FAR = (1 << 63) - 1


class Regions:
    """A tree of balls over the whole table: nodes split by the nearer of two centres, fitted on a bounded sample. Its leaves deal
    the rows out; their radii come from all rows. At most ``leaves`` leaves, so the driver and tasks hold few numbers."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.centers, self.children = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [None]
        own = {0: sample}
        while len(own) < leaves:
            node = max(own, key=lambda i: len(own[i]))
            halves = self._halves(own[node])
            if halves is None:
                break
            del own[node]
            self.children[node] = (len(self.centers), len(self.centers) + 1)
            for part in halves:
                own[len(self.centers)] = part
                self.centers.append(part.mean(0))
                self.children.append(None)
        self.centers = np.array(self.centers)
        self.leaves = sorted(own)

    @staticmethod
    def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if len(x) < 16:
            return None
        a = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
        b = x[np.argmax(((x - a) ** 2).sum(1))]
        for _ in range(6):
            near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
            if near.all() or not near.any():
                return None
            a, b = x[near].mean(0), x[~near].mean(0)
        return x[near], x[~near]

    def distances(self, x: np.ndarray, node: int) -> np.ndarray:
        """Squared distances to a centre, vectors with fewer or more components taken with zeros."""
        c, m = self.centers[node], min(x.shape[1], self.centers.shape[1])
        return np.maximum(((x[:, :m] - c[:m]) ** 2).sum(1) + (x[:, m:] ** 2).sum(1) + (c[m:] ** 2).sum(), 0)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distance from that leaf's centre."""
        leaf, far, todo = np.zeros(len(x), np.int64), np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.children[node] is None:
                leaf[rows], far[rows] = node, np.sqrt(self.distances(x[rows], node))
                continue
            a, b = self.children[node]
            near = self.distances(x[rows], a) <= self.distances(x[rows], b)
            todo += [(a, rows[near]), (b, rows[~near])]
        return leaf, far


class Balls:
    """A tree over one block of rows, sorted so that a node is a run of them: by label at the top, then halved at the median of the
    widest component down to ``least`` rows. A node has a centre, a radius, and its label if it has only one."""

    def __init__(self, x: np.ndarray, label: np.ndarray, least: int = 128):
        order = np.argsort(label, kind="stable")
        nodes, todo = [], [(0, len(x), None)]
        while todo:
            s, e, parent = todo.pop()
            me = len(nodes)
            if parent is not None:
                nodes[parent][2].append(me)
            nodes.append((s, e, []))
            own = label[order[s:e]]
            if own[0] != own[-1] and e - s > 16:
                middle = own[len(own) // 2]
                cut = int(np.searchsorted(own, middle, "left")) or int(np.searchsorted(own, middle, "right"))
            elif e - s <= least or not x.shape[1]:
                continue
            else:
                part = x[order[s:e]]
                widest = int(np.argmax(part.max(0) - part.min(0)))
                order[s:e] = order[s:e][np.argsort(part[:, widest], kind="stable")]
                cut = (e - s) // 2
            todo += [(s, s + cut, me), (s + cut, e, me)]
        self.order, self.start, self.end, self.children = order, *map(np.array, ([n[0] for n in nodes], [n[1] for n in nodes])), [n[2] for n in nodes]
        sorted_ = x[order]
        self.center = np.array([sorted_[s:e].mean(0) for s, e, _ in nodes])
        self.radius = np.array([np.sqrt(((sorted_[s:e] - c) ** 2).sum(1).max()) for (s, e, _), c in zip(nodes, self.center, strict=True)]) * (1 + 1e-9) + 1e-6
        self.norm = np.sqrt((self.center**2).sum(1))
        self.pure = np.array([label[order[s]] == label[order[e - 1]] for s, e, _ in nodes])
        self.label = label[order][self.start]


def intervals(a: Balls, c: Balls, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what all inner products of a row of node i and a row of node j lie, pair by pair, rounding included."""
    middle = np.einsum("ij,ij->i", a.center[i], c.center[j])
    reach = a.radius[i] * c.norm[j] + c.radius[j] * a.norm[i] + a.radius[i] * c.radius[j]
    reach += 1e-9 * (a.norm[i] * c.norm[j] + reach) + 1e-3
    return middle - reach, middle + reach


class Search:
    """The best ``k`` partners of each slot of one block of anchors, over blocks of candidates as they come. A slot is an anchor with
    a range that scores must lie in; partners have the anchor's label (``same``) or another one, and aren't the anchor's row."""

    def __init__(self, row: np.ndarray, label: np.ndarray, q: np.ndarray, slots: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], k: int, same: bool):
        self.tree, self.k, self.same = Balls(q.astype(float), label), k, same
        place = np.argsort(self.tree.order)  # of each anchor in the tree's order
        of, slot, lo, hi = slots
        by = np.argsort(place[of], kind="stable")
        self.of, self.slot, self.lo, self.hi = place[of][by], slot[by], lo[by], hi[by]
        self.row, self.label, self.q = row[self.tree.order], label[self.tree.order], q[self.tree.order]
        self.bounds = np.searchsorted(self.of, self.tree.start), np.searchsorted(self.of, self.tree.end)
        self.least = self.lo.copy()  # a score below it is of no use to the slot
        self.most = np.array([self.hi[s:e].max(initial=-FAR) for s, e in zip(*self.bounds, strict=True)])
        self.kept = [np.zeros(0, np.int64)] * 4
        self.held, self.scored, self.pruned = [], 0, 0

    def add(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, q: np.ndarray) -> None:
        tree = Balls(q.astype(float), label)
        row, ids, label, q = row[tree.order], ids[tree.order], label[tree.order], q[tree.order]
        need = np.array([self.least[s:e].min(initial=FAR) for s, e in zip(*self.bounds, strict=True)])
        i, j, pairs = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(i):
            lo, hi = intervals(self.tree, tree, i, j)
            equal = self.tree.label[i] == tree.label[j]
            out = (hi < need[i]) | (lo > self.most[i]) | (self.tree.pure[i] & tree.pure[j] & (equal != self.same))
            self.pruned += int(out.sum())
            more = []
            for x, y, top in zip(i[~out].tolist(), j[~out].tolist(), hi[~out].tolist(), strict=True):
                a, c = self.tree.children[x], tree.children[y]
                if not a and not c:
                    pairs.append((top, x, y))
                elif not c or (a and self.tree.end[x] - self.tree.start[x] >= tree.end[y] - tree.start[y]):
                    more += [(z, y) for z in a]
                else:
                    more += [(x, z) for z in c]
            i, j = np.array(more, np.int64).reshape(-1, 2).T
        for top, x, y in sorted(pairs, reverse=True):
            s, e = self.bounds[0][x], self.bounds[1][x]
            if s < e and top >= self.least[s:e].min():
                self._leaves(x, int(s), int(e), slice(int(tree.start[y]), int(tree.end[y])), row, ids, label, q)
        self._settle()

    def _leaves(self, x: int, s: int, e: int, c: slice, row: np.ndarray, ids: np.ndarray, label: np.ndarray, q: np.ndarray) -> None:
        first = int(self.tree.start[x])
        a = slice(first, int(self.tree.end[x]))
        size = float(np.abs(self.q[a]).max(initial=0)) * float(np.abs(q[c]).max(initial=0)) * q.shape[1]
        kind = np.float64 if size < 1 << 53 else np.int64  # exact either way
        score = (self.q[a].astype(kind) @ q[c].astype(kind).T).astype(np.int64)
        self.scored += score.size
        may = (self.label[a][:, None] == label[c][None, :]) == self.same
        may &= self.row[a][:, None] != row[c][None, :]
        own = self.of[s:e] - first
        full = score[own]
        hit, at = np.nonzero(may[own] & (full >= self.least[s:e, None]) & (full <= self.hi[s:e, None]))
        if len(hit):
            self.held.append((hit + s, full[hit, at], ids[c][at], row[c][at]))
            if sum(len(h[0]) for h in self.held) > 1 << 17:
                self._settle()

    def _settle(self) -> None:
        if not self.held:
            return
        slot, score, ids, row = (np.concatenate(x) for x in zip(self.kept, *self.held, strict=True))
        order = np.lexsort((row, ids, -score, slot))
        rank = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order])
        best, last = order[rank < self.k], order[rank == self.k - 1]
        self.kept, self.held = [x[best] for x in (slot, score, ids, row)], []
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])

    def found(self) -> dict[str, pa.Array]:
        slot, score, ids, row = self.kept
        return {"row": pa.array(self.row[self.of[slot]]), "slot": pa.array(self.slot[slot], pa.int32()), "score": pa.array(score), "of_id": pa.array(ids), "of_row": pa.array(row)}


FOUND = "row long, slot int, score long, of_id long, of_row long"


def routed(items: DataFrame, regions: Regions) -> DataFrame:
    """Adds ``leaf`` and ``far``, the distance from its centre."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, q = b.column(b.schema.get_field_index("dim")).to_numpy(), b.column(b.schema.get_field_index("q"))
            leaf, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                leaf[at], far[at] = regions.route(q.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32()), pa.array(far)], names=[*b.schema.names, "leaf", "far"])

    schema = T.StructType([*items.schema.fields, *T.StructType.fromDDL("leaf int, far double").fields])
    return items.mapInArrow(lean(run), schema)


def blocks(items: DataFrame, regions: Regions, size: int, extra: str = "") -> DataFrame:
    """Rows of one leaf and dimension in blocks of about ``size``, however many there are: block, leaf, dim, radius, the labels'
    range, and the rows packed (and what ``extra`` aggregates). Counts a leaf and dimension are the only thing broadcast."""
    kept = routed(items, regions)
    sizes = kept.groupBy("leaf", "dim").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    dealt = kept.join(F.broadcast(sizes), ["leaf", "dim"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    rows = F.array_sort(F.collect_list(F.struct("row", "id", "label", "q"))).alias("rows")
    packed = dealt.groupBy("leaf", "dim", "part").agg(F.max("far").alias("radius"), F.min("label").alias("low"), F.max("label").alias("high"), rows, *([F.expr(extra)] if extra else []))
    return packed.withColumn("block", F.monotonically_increasing_id())


def search(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, k: int, same: bool, slices: int) -> DataFrame:
    """The best ``k`` partners of every slot over the given pairs of blocks (a, c, hi): a task gets one block of anchors and, one
    after another, the most promising first, at most a slice of its blocks of candidates."""
    pairs = pairs.withColumn("slice", F.pmod(F.xxhash64("c"), F.lit(slices)))
    none = F.lit(None).cast("double")
    own = pairs.select("a", "slice").distinct().join(anchors.select(F.col("block").alias("a"), "rows", "slots"), "a").select("a", "slice", none.alias("hi"), "rows", "slots")
    other = pairs.join(candidates.select(F.col("block").alias("c"), "rows"), "c").select("a", "slice", "hi", "rows", F.lit(None).cast("array<struct<row:bigint,slot:int,lo:bigint,hi:bigint>>").alias("slots"))
    sent = own.unionAll(other).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("hi").desc_nulls_first())

    def columns(lists: pa.Array, i: int) -> dict[str, np.ndarray]:
        rows = lists.slice(i, 1).flatten()
        out = {name: rows.field(name) for name in (rows.type.field(x).name for x in range(rows.type.num_fields))}
        n = len(rows)
        return {name: c.flatten().to_numpy().reshape(n, len(c.flatten()) // n) if name == "q" else c.to_numpy() for name, c in out.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            rows, slots, hi = b.column("rows"), b.column("slots"), b.column("hi")
            for i in range(b.num_rows):
                r = columns(rows, i)
                if not hi[i].is_valid:
                    if now is not None:
                        yield from arrow_batches(now.found())
                    t = columns(slots, i)
                    by = np.argsort(r["row"])
                    of = by[np.searchsorted(r["row"][by], t["row"])]
                    now = Search(r["row"], r["label"], r["q"], (of, t["slot"], t["lo"], t["hi"]), k, same)
                else:
                    now.add(r["row"], r["id"], r["label"], r["q"])
        if now is not None:
            yield from arrow_batches(now.found())

    return sent.mapInArrow(lean(run), FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot, with their rank from 1; map tasks leave only their own first ``k``."""
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "of_id", "of_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_pairs(anchors: DataFrame, candidates: DataFrame, a: Regions, c: Regions, same: bool) -> DataFrame:
    """Pairs of blocks (a, c, lo, hi) whose labels allow a partner, with the interval of their scores."""
    m = min(a.centers.shape[1], c.centers.shape[1])
    norm = [np.sqrt((t.centers**2).sum(1)).tolist() for t in (a, c)]
    dots = (a.centers[:, :m] @ c.centers[:, :m].T).tolist()
    leaves = candidates.sparkSession.createDataFrame([(i, j, dots[i][j], norm[0][i], norm[1][j]) for i in a.leaves for j in c.leaves], "leaf int, of_leaf int, dot double, na double, nc double")
    left = anchors.select(F.col("block").alias("a"), "leaf", "dim", F.col("radius").alias("ra"), "low", "high")
    right = candidates.select(F.col("block").alias("c"), F.col("leaf").alias("of_leaf"), F.col("dim").alias("of_dim"), F.col("radius").alias("rc"), F.col("low").alias("of_low"), F.col("high").alias("of_high"))
    labels = ((F.col("low") <= F.col("of_high")) & (F.col("of_low") <= F.col("high"))) if same else ~((F.col("low") == F.col("high")) & (F.col("of_low") == F.col("low")) & (F.col("of_high") == F.col("low")))
    joined = left.join(F.broadcast(leaves), "leaf").join(right, "of_leaf").where(F.col("dim") == F.col("of_dim"))
    reach = F.expr("(ra * nc + rc * na + ra * rc) * (1 + 1e-9) + 1e-9 * na * nc + 1e-3")
    return joined.where(labels).select("a", "c", (F.col("dot") - reach).alias("lo"), (F.col("dot") + reach).alias("hi"))


def hard_negatives(vectors: DataFrame, anchor: Column, *, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample: int = 4096, leaves: int = 64, block: int = 2048, per_slice: int = 64, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become integers floor(``scale`` * x); a score is an inner product of these. Rows where ``anchor`` holds are anchors. An
    anchor's positives are its first ``positives`` other rows of its label, higher scores first, then smaller vec_ids; for each, the
    first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Dual-tree search, twice. Rows and anchors are dealt to the leaves of two trees of balls (at most ``leaves`` leaves, fitted on
    ``sample`` rows by hash; every row is in one), leaves are cut into blocks of about ``block`` rows, so a hot region is many
    blocks. Pairs of blocks whose interval of scores can't matter to any anchor of the one are dropped before anything is
    sent; first each block of anchors meets the block that promises most, whose results bound what the others must reach. A task then
    walks down trees over both blocks, drops node pairs by their intervals, and scores pairs of leaves exactly.
    What is dropped is strictly worse, so results are those of a full search, ties included. All anchors meet all rows
    in blocks; nothing is capped. Blocks are written to the shared folder, and so are results of a phase.

    Rows with null vec_id, label or vector, or a null or non-finite component, take no part. Vectors of different lengths don't
    meet. Empty vectors score 0. Rows that repeat a vec_id are rows of their own (each other's partners too; equal rows in no
    particular order). Labels that aren't integers are compared by a 64-bit hash. A negative positive_score has no negatives. An empty table gives
    an empty one; other columns are ignored. A scaled component of 2^26 or more, or more than 2,048 components, is an error.
    """
    e = F.col("e")
    kind = vectors.schema[label].dataType
    as_long = F.col(quoted(label)).cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col(quoted(label)).isNotNull(), F.xxhash64(quoted(label)))
    rows = vectors.select(F.col(quoted(vec_id)).cast("long").alias("id"), as_long.alias("label"), F.col(quoted(embedding)).cast("array<double>").alias("e"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    scaled = lambda x: F.when(F.abs(x) * scale < MOST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST / scale}"))).cast("int")
    dim = F.when(F.size(e) <= 2048, F.size(e)).otherwise(F.raise_error(F.lit("more than 2,048 components")).cast("int"))
    rows = rows.where(whole).select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform(e, scaled).alias("q"), dim.alias("dim"), "anchor")
    items = Table(sized(rows, vectors), "items")
    chosen = items.read().where("anchor")
    counts = items.read().agg(F.count("*").alias("all"), F.count_if("anchor").alias("anchors")).first()

    def fitted(frame: DataFrame, n: int, per: int) -> Regions:
        drawn = frame.select("q").orderBy(F.xxhash64("row")).limit(sample).toArrow().column("q").combine_chunks()
        wide = drawn.value_lengths().to_numpy()
        usual = int(np.bincount(wide).argmax()) if len(wide) else 0  # the trees are fitted on vectors of the commonest length
        x = drawn.take(pa.array(np.flatnonzero(wide == usual))).flatten().to_numpy().reshape(-1, usual).astype(float) if usual else np.zeros((0, 1))
        return Regions(x, max(1, min(leaves, ceil(n / per))))

    fit_c, fit_a = fitted(items.read(), counts["all"], block), fitted(chosen, counts["anchors"], block // 2)
    packed = Table(blocks(items.read().drop("anchor"), fit_c, block), "candidates", records=16)
    candidates, slices = packed.read(), max(1, ceil(counts["all"] / block / per_slice))

    def phase(slots: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """``slots``: row, slots (slot, lo, hi) of the anchors that look for partners."""
        of = chosen.drop("anchor").join(slots, "row")
        lists = "flatten(collect_list(transform(slots, s -> named_struct('row', row, 'slot', s.slot, 'lo', s.lo, 'hi', s.hi)))) as slots"
        made = Table(blocks(of, fit_a, block // 2, lists), "anchors", records=16)
        anchors = made.read()
        of_block = anchors.select("block", F.explode("slots").alias("s")).select("block", "s.*")
        ranges = of_block.groupBy("block").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
        pairs = block_pairs(anchors, candidates, fit_a, fit_c, same).join(ranges, F.col("a") == F.col("block")).where((F.col("hi") >= F.col("least")) & (F.col("lo") <= F.col("most")))
        pairs = Table(pairs.select("a", "c", "hi", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("hi"), "c")).alias("turn")), "pairs").read()
        first = Table(search(anchors, candidates, pairs.where("turn = 1"), k, same, 1), name, records=16).read()
        # What every slot of a block of anchors has reached already; blocks with a slot that isn't full have no bound.
        full = of_block.join(best(first, k).where(F.col("rank") == k).select("row", "slot", "score"), ["row", "slot"], "left")
        bound = full.groupBy("block").agg(F.when(F.count("*") == F.count("score"), F.min(F.greatest("score", "lo"))).alias("reached"))
        rest = pairs.where("turn > 1").join(bound, F.col("a") == F.col("block"), "left").where(F.col("reached").isNull() | (F.col("hi") >= F.col("reached"))).select("a", "c", "hi")
        others = Table(search(anchors, candidates, rest, k, same, slices), name, records=16).read()
        return best(first.unionAll(others), k)

    everything = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi")))
    near = Table(phase(chosen.select("row", everything.alias("slots")), positives, True, "positives"), "positives").read()
    near = near.select("row", F.col("rank").alias("slot"), F.col("of_id").alias("positive_id"), F.col("score").alias("positive_score"))
    at_least = F.expr(f"cast(ceil(cast(positive_score * {low} as decimal(24,0)) / 100) as bigint)")
    at_most = F.expr(f"cast(floor(cast(positive_score * {high} as decimal(24,0)) / 100) as bigint)")
    slots = near.groupBy("row").agg(F.collect_list(F.struct("slot", at_least.alias("lo"), at_most.alias("hi"))).alias("slots"))
    hard = phase(slots, negatives, False, "negatives")
    out = hard.join(near, ["row", "slot"]).join(chosen.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("of_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


NEGATIVE_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, c.r AS of, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r),
positives AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, of) AS n FROM scores WHERE same QUALIFY n <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, n ORDER BY score DESC, vec_id, of)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.r = s.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
