"""Operator 5, token ids in Parquet files that allow selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import EAGER, Table, arrow_batches, buffers, carried, chunks, lean, new_path, output, quoted, session_conf, sized
from .tokens import encoder


#: The files' own columns.
COLUMNS = ("doc_id", "n_tokens", "ids", "file", "row")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, dictionary: bool = False, doc_id: str = "doc_id", text: str = "text", meta: list[str] | None = None) -> None:
    """Writes doc_id, n_tokens, ids (a list column), file (the number of the file's range), row (the place in it) and ``meta`` columns.

    Files hold ascending ranges of doc_id and are sorted by it. Row groups and pages have the given sizes; the writer
    adds column and offset indexes, so a filter on doc_id reads only some pages, and metadata are read without ids. Ids
    are bit-packed deltas (format version 2), or dictionary-coded with ``dictionary``. Null or empty texts have only the
    end id; rows that repeat a doc_id stay, by their texts' hash; null doc_ids come first. A text of any length is encoded
    whole, one list a row. An empty table gives files without rows. A ``meta`` column with a name of the files' own is
    written as ``meta_`` and its name; two of one name are an error.
    """
    meta = meta or []
    names = [f"meta_{m}" if m.lower() in COLUMNS else m for m in meta]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("meta columns with one name")
    source = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("t"), *carried(meta))
    # Rows' numbers deal out copies too, of which a range could otherwise hold any number.
    source = source.repartitionByRange("doc_id", F.xxhash64("t"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", F.xxhash64("t"))
    source = source.withColumn("file", F.spark_partition_id())
    held = [f"c{i}" for i in range(len(meta))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at = encoder(tokenizer), 0
        for whole in batches:
            data, off = buffers(whole.column(1))
            for i, j in chunks(off, 2 << 20):
                ids, n = code.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, np.int32(end_id))
                o = np.concatenate(([0], ends + np.arange(1, j - i + 1)))
                part = whole.slice(i, j - i)
                lists = pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(ids, pa.int32()))
                row = pa.array(np.arange(at, at + j - i))
                at += j - i
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(n + 1), lists, row], names=["doc_id", *held, "file", "n_tokens", "ids", "row"])

    rows = source.mapInArrow(lean(run), output(source, ["doc_id", *held, "file"], "n_tokens long, ids array<int>, row long"))
    rows = rows.select(*COLUMNS, *[F.col(h).alias(n) for h, n in zip(held, names, strict=True)])
    options = {
        "compression": "zstd",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(dictionary).lower(),
    }
    with session_conf(docs.sparkSession, **EAGER):
        rows.write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; select only doc_id and n_tokens to leave the ids unread."""
    return spark.read.parquet(path)


def token_digests(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it in the files' order), n_tokens, ids_crc32.

    The ids are read for the checksums, in a narrow row a document. Sums by file (one row a file) give the files' starts;
    inside a file a window adds up in order of its rows, which no key but the file's range number deals out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            o = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield from arrow_batches({"doc_id": b.column(0), "n": pa.array(np.diff(o).astype(np.int64)), "crc": pa.array(crc, pa.int64()), "file": b.column(2), "row": b.column(3)})

    source = files.select("doc_id", "ids", "file", "row")
    rows = source.mapInArrow(lean(run), output(source, ["doc_id"], "n long, crc long, file int, row long"))
    rows = Table(sized(rows, files), "token-digests").read()
    sums = rows.groupBy("file").agg(F.sum("n").alias("n"))
    before = sums.select(F.col("file").alias("of"), (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    own = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("upto", F.sum("n").over(own)).join(before, F.col("file") == F.col("of"))
    return out.select("doc_id", (F.col("base") + F.col("upto") - F.col("n")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def token_files(docs: DataFrame, tokenizer: str, *, path: str | None = None, **options) -> DataFrame:
    """Writes the files (to the shared folder unless ``path`` is given) and returns ``token_digests`` of what it reads back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return token_digests(read_token_files(spark, path))
