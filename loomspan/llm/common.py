"""Shared pieces of the training-data operators: tables in the shared folder, text buffers, grouped streams."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the contracts: space, \t, \n, \v, \f, \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"


# --- shared folder -------------------------------------------------------------------------------


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every machine sees: ``spark.checkpoint.dir``. Where it is unset, a temporary folder if the whole session
    runs on this machine (as in tests); on a cluster that is an error, as machines wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.conf.get("spark.app.id", "")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="loomspan-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        found = "file://" + _local[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomspan/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Tables that aren't dropped yet: returned frames still read them.
_live: dict[str, SparkSession] = {}


def release() -> None:
    """Deletes all intermediate tables of this process. Frames that operators returned must have been written or counted."""
    while _live:
        path, spark = _live.popitem()
        delete(spark, path)


@contextlib.contextmanager
def released():
    """Deletes, at its end, the tables made inside but for those whose paths are added to what it yields: for steps that write
    what operators return."""
    before, keep = set(_live), set()
    try:
        yield keep
    finally:
        for path in set(_live) - before - keep:
            delete(_live.pop(path), path)


#: While a table is written: shuffle files go once it is, and Python gets batches that stay small for long texts too.
EAGER = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true", "spark__sql__execution__arrow__maxRecordsPerBatch": "2000"}


class Table:
    """A written intermediate result. Reading it needs no executor's local files, so lost executors do no harm."""

    def __init__(self, df: DataFrame, name: str, records: int = 2000, **options):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        _live[self.path] = self.spark
        with session_conf(self.spark, **(EAGER | {"spark__sql__execution__arrow__maxRecordsPerBatch": str(records)})):
            df.write.options(**({"compression": "zstd"} | options)).parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files, once nothing that is still to run reads them."""
        _live.pop(self.path, None)
        delete(self.spark, self.path)


@contextlib.contextmanager
def session_conf(spark: SparkSession, **settings: str):
    """Sets ``a__b`` as ``a.b`` while an eager step runs."""
    before = {}
    for k, v in settings.items():
        key = k.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, v)
    try:
        yield
    finally:
        for key, v in before.items():
            spark.conf.unset(key) if v is None else spark.conf.set(key, v)


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it: dots and backticks in it are part of the name."""
    return "`" + name.replace("`", "``") + "`"


def hashable(kind: T.DataType) -> bool:
    """Whether ``xxhash64`` takes a type."""
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def sql_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def output(df: DataFrame, names: list[str], made: str) -> T.StructType:
    """The schema of a function's result: columns of ``df`` passed on, then those of the DDL ``made``."""
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names] + T.StructType.fromDDL(made).fields)


def carried(names: list[str]) -> list:
    """The named columns as c0, c1, ...: no name of a caller's can clash with an operator's own."""
    return [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]


def restored(names: list[str]) -> list:
    """What ``carried`` renamed, under its own names again."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]


# --- sizes ---------------------------------------------------------------------------------------


def sized(df: DataFrame, source: DataFrame, part_bytes: int = 4 << 20) -> DataFrame:
    """``df`` in no more partitions than leave ``part_bytes`` of ``source`` for each on average, and two a core at least: a small
    table becomes a few files and not one a shuffle partition. Where partitions are larger nothing changes."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))
    return df.coalesce(most) if most < 1 << 24 else df


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def lean(run: Callable) -> Callable:
    """``run`` over batches, after which a Python worker, which stays for the next task, gives freed memory back."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


# --- text buffers --------------------------------------------------------------------------------


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n + 1 offsets of rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes together; a longer row is a run by itself."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def ints(values: np.ndarray) -> pa.Array:
    """64-bit patterns as longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


# --- 64-bit hashes of all words of a buffer --------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in ASCII_SPACE]] = True
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: A second pair of bases, for hashes that are to agree by chance with neither.
CHECK_BASES = (0xBF58476D1CE4E5B9, 0xDA942042E4DD58B5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least; the base is odd, so it has an inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space; rows' bounds also end a run."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[off] = True
    fresh[0] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | fresh[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | fresh[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BYTE_BASE, block: int = 1 << 19) -> np.ndarray:
    """A hash of the bytes of each span (in order, apart), by prefix sums of a polynomial modulo 2^64. A block of bytes at a
    time, so that powers and sums stay small; a longer span is a block by itself."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + block, "right")))
        b = int(ends[j - 1])
        up, down = powers(base, b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s])
        i = j
    return out


def words_of(data: np.ndarray, off: np.ndarray, bases: tuple[int, ...] = (_BYTE_BASE,), piece: int = 1 << 19) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """Runs of rows (i, j) with hashes of their words in order, by each base, and the words of each row; temporaries stay
    bounded for very long rows too, which are hashed in pieces cut at white space."""
    for i, j in chunks(off, piece):
        a, b = int(off[i]), int(off[j])
        if b - a <= 2 * piece:
            s, e = word_spans(data[a:b], off[i : j + 1] - a)
            yield i, j, [span_hashes(data[a:b], s, e, base) for base in bases], np.diff(np.searchsorted(s, off[i : j + 1] - a))
            continue
        parts, at = [[np.zeros(0, np.uint64)] for _ in bases], a
        while at < b:
            to = min(at + piece, b)
            while to < b and not _SPACE[data[to]]:
                to += 1
            part = data[at:to]
            s, e = word_spans(part, np.array([0, len(part)]))
            for own, base in zip(parts, bases, strict=True):
                own.append(span_hashes(part, s, e, base))
            at = to
        h = [np.concatenate(own) for own in parts]
        yield i, j, h, np.array([len(h[0])])


def window_hashes(ids: np.ndarray, counts: np.ndarray, width: int, base: int = _WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``width`` words inside rows, and the index of each window's first word."""
    n = len(ids)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(ids * up[:n], out=sums[1:])
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words to the end of the row, this one included
    at = np.flatnonzero(left >= width)
    return mix((sums[at + width] - sums[at]) * down[at]), at


# --- grouped streams -------------------------------------------------------------------------------


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by ``key``. A table has about ``least`` rows, or one group."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(held).combine_chunks()
        keys = table.column(key).combine_chunks().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)
        cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        if cut:
            yield table.slice(0, cut)
        held, rows = [table.slice(cut)], table.num_rows - cut
    if held:
        table = pa.concat_tables(held).combine_chunks()
        if table.num_rows:
            yield table


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return s, np.append(s[1:], len(keys))


def arrow_batches(table: pa.Table | dict) -> Iterator[pa.RecordBatch]:
    table = pa.table(table) if isinstance(table, dict) else table
    yield from table.to_batches(max_chunksize=1 << 16)


# --- connected components --------------------------------------------------------------------------


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component), one a node beside the smallest, that connect what the edges connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        if (lx == ly).all():
            break
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while (label[label] != label).any():
            label = label[label]
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _contracted(edges: DataFrame, chunk: int = 1 << 18) -> DataFrame:
    """Edges of longs (u, v), v < u, with those of each chunk of a task replaced by its stars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                u, v = stars(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
                held.clear()
                yield from arrow_batches({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            rows += b.num_rows
            if rows >= chunk:
                yield from flush()
                rows = 0
        yield from flush()

    return edges.mapInArrow(lean(run), "u long, v long")


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Components of an edge list of longs: (node, component), component the smallest node of it; no isolated nodes.

    Tasks first contract their own edges to stars. Then large-star and small-star rounds alternate until only stars are
    left. A round is a grouped minimum, which map tasks aggregate first, and a join back. The minima are written, so that
    the join has an exchange of its own on both sides and adaptive execution splits the partitions of a hub. Edges of a
    round are written to the shared folder too, which cuts the lineage. The driver gets one yes or no a round.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    first = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    now = Table(sized(_contracted(first).distinct(), edges), "edges")
    while True:
        e = now.read()
        ends = e.select(u.alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select(v.alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        held = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if held.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty():
            break
        both = e.unionAll(e.select(v.alias("u"), u.alias("v")))
        low = Table(sized(both.groupBy("u").agg(F.least(F.min("v"), u).alias("m")), e), "low")
        large = both.where(v > u).join(low.read(), "u").select(v.alias("u"), m.alias("v"))
        large = Table(sized(large.unionAll(low.read().select("u", m.alias("v"))).where(u != v).distinct(), e), "edges")
        low2 = Table(sized(large.read().groupBy("u").agg(F.min("v").alias("m")), e), "low")
        small = large.read().join(low2.read(), "u").where(v != m).select(v.alias("u"), m.alias("v"))
        after = Table(sized(_contracted(small.unionAll(low2.read().select("u", m.alias("v")))).distinct(), e), "edges")
        for done in (now, low, large, low2):
            done.drop()
        now = after
    return e.select(u.alias("node"), v.alias("component")).unionAll(e.select(v.alias("node"), v.alias("component")).distinct())
