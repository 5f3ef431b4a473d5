"""Operator 10, best-fit packing of documents' token pieces into sequences under several capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, arrow_batches, buffers, chunks, lean, output, quoted, sized
from .tokens import encoder

#: Pieces that one task packs at once, and the fraction of them that it may hand on to the next round.
GROUP, ON = 25_000, 16


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.25, 0.25), score: str = "norm") -> np.ndarray:
    """Bins for pieces, given longest first. A bin has three residual capacities: tokens, documents, and attention cost
    (the sum of squared lengths). Of all bins that a piece fits under every one of them, it goes where the weighted norm of
    the residuals left is least (``score`` "norm"), or the weighted dot product of the piece's needs and the bin's
    residuals is largest ("dot"), in parts of the capacities; the earliest of equals. A piece that exceeds a capacity by
    itself gets a bin to itself."""
    size = np.array([tokens, documents, attention], float)
    weight = np.array(weights, float)
    out, made, live = np.zeros(len(lengths), np.int64), 0, 0
    least = int(lengths[-1]) if len(lengths) else 0
    left, of = np.zeros((3, 1 << 10)), np.zeros(1 << 10, np.int64)  # residuals of the bins that something may still fit, and their numbers
    for i, n in enumerate(lengths.tolist()):
        need = np.array([[n], [1], [n * n]], float)
        room = left[:, :live]
        rest = room - need
        fits = rest.min(0) >= 0
        if fits.any():
            if score == "norm":
                good = -(weight @ (rest / size[:, None]) ** 2)
            else:
                good = (weight * need[:, 0] / size**2) @ room
            good[~fits] = -np.inf
            k = int(good.argmax())
        else:
            if live == len(of):
                left, of = np.concatenate((left, np.zeros_like(left)), 1), np.concatenate((of, np.zeros_like(of)))
            k, live, made = live, live + 1, made + 1
            left[:, k], of[k] = size, made - 1
        out[i] = of[k]
        left[:, k] -= need[:, 0]
        if left[0, k] < least or left[1, k] < 1 or left[2, k] < least * least:  # nothing that is still to come fits
            left[:, k : live - 1], of[k : live - 1] = left[:, k + 1 : live].copy(), of[k + 1 : live].copy()
            live -= 1
    return out


def pieces(docs: DataFrame, path: str, *, end_id: int, size: int, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut every ``size`` tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for whole in batches:
            data, off = buffers(whole.column(1))
            for i, j in chunks(off, 2 << 20):
                ids, n = code.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                at, out = 0, {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
                for r, k in enumerate(n.tolist()):
                    own = np.append(ids[at : at + k], np.int32(end_id)).astype("<u4")
                    at += k
                    for p, s in enumerate(range(0, len(own), size)):
                        part = own[s : s + size]
                        for name, v in zip(out, (r, p, s, len(part), zlib.crc32(part.tobytes()), part), strict=True):
                            out[name].append(v)
                cols = {"doc_id": whole.column(0).slice(i, j - i).take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32())}
                cols |= {k: pa.array(out[v], pa.int64()) for k, v in (("start", "start"), ("length", "length"), ("ids_crc32", "crc"))}
                if with_ids:
                    o = np.concatenate(([0], np.cumsum(out["length"])))
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(np.concatenate([*out["ids"], np.zeros(0, "<u4")]).astype(np.int32)))
                yield from arrow_batches(cols)

    source = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("t"))
    return source.mapInArrow(lean(run), output(source, ["doc_id"], "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids))


def _packer(turn: int, last: bool, size: int, documents: int, attention: int, group: int, score: str):
    """Packs one group: rows of sequences that are final get a sequence_id, the others none."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        length, row = t.column("length").to_numpy(), t.column("_row").to_numpy()
        order = np.lexsort((row, -length))
        bins = best_fit(length[order], size, documents, attention, score=score)
        by = order[np.argsort(bins, kind="stable")]
        bins = np.sort(bins)
        ln = length[by]
        first = np.concatenate(([True], bins[1:] != bins[:-1]))
        before = np.cumsum(ln) - ln
        offset = before - before[np.maximum.accumulate(np.where(first, np.arange(len(bins)), 0))]
        seq = (turn << 56) + (key[0].as_py() << 24) + bins
        final = np.ones(len(bins), bool)
        if not last:
            fill, count = np.bincount(bins, ln), np.bincount(bins)
            worst = np.argsort(fill, kind="stable")
            worst = worst[(np.cumsum(count[worst]) <= max(1, group // ON)) & (fill[worst] < size)]
            final = ~np.isin(bins, worst)
        out = t.take(pa.array(by))
        return out.drop_columns(["_part"]).append_column("sequence_id", pa.array(seq, mask=~final)).append_column("offset", pa.array(offset.astype(np.int64)))

    return run


def pack(items: DataFrame, *, size: int, documents: int, attention: int, group: int = GROUP, score: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to ``items`` (a column ``length`` of at most ``size``; others are carried).

    Hash-dealt groups of about ``group`` pieces are packed by a task each. Sequences that a task leaves emptiest are
    taken apart again, up to 1/16 of its pieces, and packed once more by 1/16 as many tasks, until one is left; so the
    number of half-filled sequences doesn't grow with that of tasks, and no task's input with the table.
    """
    done, held = [], Table(items.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    names, turn, n = items.columns, 0, held.read().count()
    parts = max(1, ceil(n / group))
    schema = output(items, names, "_row long, sequence_id long, offset long")
    while True:
        last = parts == 1
        dealt = held.read().withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(parts)).cast("long"))
        packed = dealt.groupBy("_part").applyInArrow(_packer(turn, last, size, documents, attention, group, score), schema)
        got = Table(sized(packed, dealt), "packed")
        held.drop()
        done.append(got.read().where(F.col("sequence_id").isNotNull()))
        if last:
            break
        held = Table(got.read().where(F.col("sequence_id").isNull()).select(*names, "_row"), "pieces")
        parts, turn = ceil(parts / ON), turn + 1
    return reduce(DataFrame.unionAll, done).drop("_row")


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 1, size: int = 4096, documents: int | None = None, attention: int | None = None, score: str = "norm", with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs documents' tokens into sequences of at most ``size`` tokens, ``documents`` pieces and ``attention`` cost.

    By default the last two can't bind (``size`` pieces, ``size`` squared), but have their weight in the choice of a bin. A piece
    over a capacity by itself has a sequence to itself. Returns one row a piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset (and ids, ``with_ids``). Only documents over ``size`` tokens are cut.

    Null or empty texts are the end id alone. Rows that repeat a doc_id are packed each. Null doc_ids are carried. A text
    of any length is encoded whole by one task. An empty table gives an empty one; other columns are ignored. Tokens are
    made once and written; packing moves only the pieces' lengths unless ``with_ids``.
    """
    made = pieces(docs, tokenizer, end_id=end_id, size=size, with_ids=with_ids, doc_id=doc_id, text=text)
    packed = pack(sized(made, docs), size=size, documents=documents or size, attention=attention or size * size, score=score)
    return packed.withColumnRenamed("doc_id", doc_id)
