"""Operator 6, line dedup: normalised lines by hash, documents counted per hash, frequent lines dropped."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, arrow_batches, buffers, carried, chunks, lean, output, quoted, sized

_STRIP = b" \t\n\x0b\x0c\r"
_TWO = np.dtype([("a", "<i8"), ("b", "<i8")])


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a UTF-8 line: stripped of ASCII white space, A-Z lower-cased; None if it has too few code points."""
    key = line.strip(_STRIP).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


@lru_cache(maxsize=1 << 14)
def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _keys(text: bytes, least: int) -> list[bytes | None]:
    return [None if (k := line_key(x, least)) is None else _hash(k) for x in text.split(b"\n")]


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, off = buffers(column)
    for i in range(len(off) - 1):
        yield data[off[i] : off[i + 1]].tobytes()


def line_dedup(docs: DataFrame, *, least_chars: int = 20, least_docs: int = 3, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Drops lines that many documents share, except in the largest ``doc_id`` that holds them.

    Returns the columns ``carry`` (all by default) with ``text`` replaced by the lines that stay, joined by newlines,
    and n_lines, n_dropped. A line counts once per row of ``docs``; 128-bit hashes stand for keys. Only hashes and ids
    are exploded and counted: map tasks add up first, so a line in all documents is one row per task; the join back is
    one that adaptive execution splits where a line is hot. A text's drops are collected by its id and hash, so that an
    id of any number of rows is no hot key. Text moves once, to the join with its drops.

    Null or empty text is one empty line. Rows with the same ``doc_id`` each count as a document, and all of them keep
    their lines if that id is the largest. A null ``doc_id`` is below all others. A text of any length is split as a whole in a
    Python worker, about 100 bytes a line beside it. An empty table gives an empty one. Columns named n_lines or
    n_dropped are replaced; others may have any name.
    """
    carry = docs.columns if carry is None else carry
    keep = [c for c in carry if c not in ("n_lines", "n_dropped")]
    id_, t = F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("t")
    source = docs.select(id_, t, F.xxhash64(t).alias("th"))

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for i, raw in enumerate(_texts(batch.column(1))):
                own = {k for k in _keys(raw, least_chars) if k is not None}
                found.extend(own)
                rows.append(np.full(len(own), i))
            h = np.frombuffer(b"".join(found), _TWO)
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield from arrow_batches({"id": batch.column(0).take(at), "th": batch.column(2).take(at), "a": pa.array(h["a"].copy()), "b": pa.array(h["b"].copy())})

    lines = Table(sized(source.mapInArrow(lean(keys), output(source, ["id"], "th long, a long, b long")), docs), "lines").read()
    # Written, so that the join below has an exchange on both sides: only then are a hot line's partitions split.
    frequent = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= least_docs).drop("n")
    frequent = Table(sized(frequent, lines), "frequent").read()
    hits = lines.join(frequent, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("last")))
    drops = hits.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("drop"))
    rest = [c for c in keep if c != text]
    held = [f"c{i}" for i in range(len(rest))]
    wide = docs.select(*carried(rest), id_, t, F.xxhash64(t).alias("th"))
    drops = drops.select(F.col("id").alias("d_id"), F.col("th").alias("d_th"), F.transform("drop", lambda x: x["a"]).alias("da"), F.transform("drop", lambda x: x["b"]).alias("db"))
    joined = wide.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th")), "left").select(*held, "t", "da", "db")

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            off = buffers(whole.column(len(held)))[1]
            for i, j in chunks(off, 4 << 20):
                batch = whole.slice(i, j - i)
                da, db = batch.column(len(held) + 1).to_pylist(), batch.column(len(held) + 2).to_pylist()
                out, n, dropped = [], [], []
                for k, raw in enumerate(_texts(batch.column(len(held)))):
                    lines_ = raw.split(b"\n")
                    n.append(len(lines_))
                    if da[k]:
                        h = np.zeros(len(da[k]), _TWO)
                        h["a"], h["b"] = da[k], db[k]
                        gone = {h[x : x + 1].tobytes() for x in range(len(h))}
                        lines_ = [x for x, key in zip(lines_, _keys(raw, least_chars), strict=True) if key is None or key not in gone]
                    dropped.append(n[-1] - len(lines_))
                    out.append(b"\n".join(lines_))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(held)], pa.array(out, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())],
                    names=[*held, "t", "n_lines", "n_dropped"],
                )

    done = joined.mapInArrow(lean(rebuild), output(joined, held, "t string, n_lines long, n_dropped long"))
    at = {c: F.col(h) for c, h in zip(rest, held, strict=True)} | {text: F.col("t")}
    return done.select(*[at[c].alias(c) for c in [*keep, *([] if text in keep else [text])]], "n_lines", "n_dropped")


LINE_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
