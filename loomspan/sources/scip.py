"""Precise-index files: a reader of their protobuf wire format, and spans from line ranges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCCURRENCES = "path string, document_ordinal int, occurrence_ordinal int, symbol string, roles int, range array<int>, position_encoding int"
RELATIONSHIPS = "path string, document_ordinal int, relationship_ordinal int, source_symbol string, target_symbol string, kinds int"


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise ValueError("truncated or overlong varint")
        byte = b[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields in order; groups are errors."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(b, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if wire == 2:
                size, at = _varint(b, at)
            if size is None or at + size > len(b):
                raise ValueError("truncated message or unknown wire type")
            value, at = b[at : at + size], at + size
        yield number, value


def _packed(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = _varint(value, at)
        out.append(x)
    return out


def documents(index: bytes) -> Iterator[dict]:
    """Documents (field 2) of an index: path 1, occurrences 2, symbols 3 with relationships 4, position encoding 6."""
    for number, raw in fields(index):
        if number != 2:
            continue
        doc: dict = {"path": "", "occurrences": [], "relationships": [], "encoding": 0}
        for n, v in fields(raw):
            if n == 1:
                doc["path"] = v.decode()
            elif n == 2:
                occ: dict = {"range": [], "symbol": None, "roles": 0}
                for k, x in fields(v):
                    if k == 1:
                        occ["range"] += _packed(x)
                    elif k == 2:
                        occ["symbol"] = x.decode()
                    elif k == 3:
                        occ["roles"] = x
                doc["occurrences"].append(occ)
            elif n == 3:
                name, rel = "", []
                for k, x in fields(v):
                    if k == 1:
                        name = x.decode()
                    elif k == 4:
                        r: dict = {"symbol": "", "kinds": 0}
                        for f, y in fields(x):
                            if f == 1:
                                r["symbol"] = y.decode()
                            elif 2 <= f <= 5 and y:
                                r["kinds"] |= 1 << (f - 2)
                        rel.append(r)
                doc["relationships"] += [(name, r["symbol"], r["kinds"]) for r in rel]
            elif n == 6:
                doc["encoding"] = v
        yield doc


class Lines:
    """A document's lines, for ranges [line, start, (end line,) end] as byte spans. ``encoding`` says in what columns count: 1 UTF-8
    bytes, 2 UTF-16 units, 3 code points (0, unspecified, is an error). Each line is decoded once."""

    def __init__(self, content: bytes, encoding: int):
        if encoding not in (1, 2, 3):
            raise ValueError("unknown position encoding")
        self.lines, self.encoding, self.columns = content.split(b"\n"), encoding, {}
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)

    def place(self, line: int, column: int) -> int:
        if not 0 <= line < len(self.lines) or column < 0:
            raise ValueError("a line or column outside of the document")
        if self.encoding == 1:
            used = column
            if used > len(self.lines[line]):
                raise ValueError("a column outside its line")
            if self.lines[line][used : used + 1] and self.lines[line][used] & 0xC0 == 0x80:
                raise ValueError("a column inside a character")
            return self.starts[line] + used
        if line not in self.columns:
            at, used, units = {0: 0}, 0, 0
            for ch in self.lines[line].decode():
                units += 2 if self.encoding == 2 and ord(ch) > 0xFFFF else 1
                used += len(ch.encode())
                at[units] = used
            self.columns[line] = at
        if column not in self.columns[line]:
            raise ValueError("a column outside its line or inside a character")
        return self.starts[line] + self.columns[line][column]

    def span(self, range_: list[int]) -> tuple[int, int]:
        if len(range_) not in (3, 4):
            raise ValueError("a range has 3 or 4 numbers")
        a, b, c, d = range_ if len(range_) == 4 else (range_[0], range_[1], range_[0], range_[2])
        s, e = self.place(a, b), self.place(c, d)
        if e < s:
            raise ValueError("a range ends before it starts")
        return s, e


def span_of(content: bytes, range_: list[int], encoding: int = 1) -> tuple[int, int]:
    """The byte span of one range."""
    return Lines(content, encoding).span(range_)


SPANS = "path string, document_ordinal int, occurrence_ordinal int, symbol string, roles int, start long, end long, problem string"


def with_spans(occurrences: DataFrame, contents: DataFrame) -> DataFrame:
    """Occurrences with byte spans in place of ranges, by the documents' contents (path, content); ``problem`` says why one has none.
    A document and its occurrences are one row, decoded once; a batch of rows is one call, not each document."""
    found = occurrences.groupBy("path").agg(F.collect_list(F.struct("document_ordinal", "occurrence_ordinal", "symbol", "roles", "range", "position_encoding")).alias("found"))
    held = contents.groupBy(F.col("path").alias("_p")).agg(F.count("*").alias("n"), F.first("content").alias("content"))
    both = found.join(held, F.col("path").eqNullSafe(F.col("_p")), "left").select("path", "found", "n", "content")
    names = [c.split()[0] for c in SPANS.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in SPANS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                rows = []
                for path, occurrences_, n, content in zip(*(c.to_pylist() for c in whole.slice(i, 64).columns), strict=True):
                    by = {}
                    for r in occurrences_:
                        start = end = problem = None
                        try:
                            if n != 1:
                                raise ValueError("no content of the document")
                            if r["position_encoding"] not in by:
                                by[r["position_encoding"]] = Lines(bytes(content), r["position_encoding"])
                            start, end = by[r["position_encoding"]].span(r["range"])
                        except ValueError as e:
                            problem = str(e)[:200]
                        rows.append((path, r["document_ordinal"], r["occurrence_ordinal"], r["symbol"], r["roles"], start, end, problem))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return both.mapInArrow(run, SPANS)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, relationships) of index files; decoded where they are read, a file a row."""
    return decode(spark.read.format("binaryFile").load(path).select("content"))


def decode(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, relationships) of the bytes of index files (content)."""

    def occurrences(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d["path"], i, k, o["symbol"], o["roles"], o["range"], d["encoding"]) for b in f["content"] for i, d in enumerate(documents(b)) for k, o in enumerate(d["occurrences"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OCCURRENCES.split(", ")])

    def relationships(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d["path"], i, k, *r) for b in f["content"] for i, d in enumerate(documents(b)) for k, r in enumerate(d["relationships"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RELATIONSHIPS.split(", ")])

    return raw.mapInPandas(occurrences, OCCURRENCES), raw.mapInPandas(relationships, RELATIONSHIPS)
