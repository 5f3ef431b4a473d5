"""Memory records in a strict subset of YAML: block mappings and lists, plain and quoted scalars, and nothing else."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import RECORD, checked

MAX_BYTES, MAX_DEPTH, MAX_LINES = 64 << 10, 8, 2_000
_KEY = re.compile(r"([A-Za-z_][A-Za-z0-9_]*):(?: +(.*))?$")
#: Names of the written form that differ from those of ``RECORD``.
NAMES = {"parent_revision_digests": "parents", "authored_lifecycle": "lifecycle"}


def _scalar(text: str) -> object:
    """A plain scalar, a double-quoted one with JSON's escapes, or a single-quoted one; empty flow collections."""
    if text in ("[]", "{}"):
        return [] if text == "[]" else {}
    if text[:1] == '"':
        value = json.loads(text)
        if not isinstance(value, str):
            raise ValueError("a quoted scalar is a string")
        return value
    if text[:1] == "'":
        if len(text) < 2 or text[-1] != "'" or re.search(r"(?<!')(?:'')*'(?!')", text[1:-1]):
            raise ValueError("an unbalanced quote")
        return text[1:-1].replace("''", "'")
    if re.fullmatch(r"-?(?:0|[1-9][0-9]{0,17})", text):
        return int(text)
    if text[:1] in "&*!|>%@`{}[],?-#" or ": " in text or " #" in text or text.endswith(":"):
        raise ValueError(f"not a plain scalar: {text[:40]}")
    if text in ("null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    return text


def parse(text: str) -> dict:
    """The mapping of a document; ValueError for everything outside of the subset, repeated keys too."""
    if len(text.encode()) > MAX_BYTES or "\t" in text or "\r" in text or "\0" in text:
        raise ValueError("too long, or with tabs or control characters")
    lines = [(len(x) - len(x.lstrip(" ")), x.strip(" ")) for x in text.split("\n") if x.strip(" ") and not x.lstrip(" ").startswith("#")]
    if len(lines) > MAX_LINES:
        raise ValueError("too many lines")
    value, at = _block(lines, 0, 0, 0)
    if at != len(lines) or not isinstance(value, dict):
        raise ValueError("not one mapping")
    return value


def _block(lines: list[tuple[int, str]], at: int, indent: int, depth: int) -> tuple[object, int]:
    if depth > MAX_DEPTH:
        raise ValueError("too deep")
    out: dict | list | None = None
    while at < len(lines) and lines[at][0] == indent:
        text = lines[at][1]
        if text == "-" or text.startswith("- "):
            out = [] if out is None else out
            if not isinstance(out, list):
                raise ValueError("a list in a mapping")
            rest = text[2:].strip(" ")
            if _KEY.match(rest) and not rest.startswith(('"', "'")):  # a mapping that begins on the dash's line
                lines[at] = (indent + 2, rest)
                value, at = _block(lines, at, indent + 2, depth + 1)
            elif rest:
                value, at = _scalar(rest), at + 1
            else:
                value, at = _nested(lines, at, indent, depth)
            out.append(value)
            continue
        m = _KEY.match(text)
        out = {} if out is None else out
        if m is None or not isinstance(out, dict) or m[1] in out:
            raise ValueError(f"no key, or a repeated one: {text[:40]}")
        if m[2]:
            out[m[1]], at = _scalar(m[2].strip(" ")), at + 1
        else:
            out[m[1]], at = _nested(lines, at, indent, depth)
    if out is None or (at < len(lines) and lines[at][0] > indent):
        raise ValueError("an unexpected indentation")
    return out, at


def _nested(lines: list[tuple[int, str]], at: int, indent: int, depth: int) -> tuple[object, int]:
    if at + 1 >= len(lines) or lines[at + 1][0] <= indent:
        raise ValueError("a key without a value")
    return _block(lines, at + 1, lines[at + 1][0], depth + 1)


def write(record: dict) -> str:
    """A record in the subset: its fields in their order, strings quoted."""
    out = []
    for f in RECORD:
        v = record.get(f.name)
        if isinstance(v, list):
            out += [f"{f.name}: []"] if not v else [f"{f.name}:", *(f"  - {json.dumps(x, ensure_ascii=False)}" for x in v)]
        elif v is not None:
            out.append(f"{f.name}: {json.dumps(v, ensure_ascii=False)}")
    return "\n".join(out) + "\n"


def parsed(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of documents (value), as ``read_records`` gives them; what doesn't parse is rejected as yaml."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                try:
                    out.append(json.dumps({NAMES.get(k, k): v for k, v in parse(text).items()}, ensure_ascii=False))
                except (ValueError, RecursionError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["value", "json"])

    done = texts.select("value").mapInArrow(run, "value string, json string")
    good, bad = checked(done.where("json is not null").select(F.col("json").alias("value")))
    return good, bad.unionAll(done.where("json is null").select("value", F.lit("yaml").alias("reason")))


def read_yaml_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of files, a record a file."""
    return parsed(spark.read.text(path, wholetext=True))
