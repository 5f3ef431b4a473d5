"""Operator 2, URL filters: all glob rules at once over each canonical URL, by a multiword Shift-And automaton."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, carried, chunks, lean, output, quoted, restored, runs

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and a path prefix, as in ``example.org/es/``; ``verdict`` is allow or block."""

    text: str
    verdict: str

    def glob(self) -> str:
        """Over ``.host/path``: ``*`` is any run without a slash, ``**`` any run."""
        return f"*.{self.text}**"


class Globs:
    """States of all patterns in shared 64-bit words: state i of a pattern is "i literals matched". A step by byte c is
    ``((D << 1) & B[c]) | (D & L[c])``: B has the states that c leads to, L the states a wildcard lets stay on c."""

    def __init__(self, patterns: list[str]):
        parsed = [self._parse(p) for p in patterns]
        bits = sum(len(lit) + 1 for lit, _ in parsed)
        self.words = max(1, -(-bits // 64))
        step, stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start, self.finals, at = np.zeros(self.words, np.uint64), [], 0
        put = lambda mask, bit: np.bitwise_or.at(mask, bit // 64, np.uint64(1 << bit % 64))
        for lit, loops in parsed:
            put(self.start, at)
            for i, c in enumerate(lit):
                put(step[c], at + i + 1)
            for i, kind in loops.items():
                for c in range(256):
                    if kind == 2 or c != ord("/"):
                        put(stay[c], at + i)
            at += len(lit) + 1
            self.finals.append(at - 1)
        self.step, self.stay = step, stay

    @staticmethod
    def _parse(pattern: str) -> tuple[bytes, dict[int, int]]:
        lit, loops = bytearray(), {}
        for part in pattern.replace("**", "\0").replace("*", "\1").encode():
            if part < 2:
                loops[len(lit)] = max(loops.get(len(lit), 0), 2 - part)
            else:
                lit.append(part)
        return bytes(lit), loops

    def match(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each row of bytes, which patterns match all of it: (rows, patterns)."""
        out = np.zeros((len(off) - 1, len(self.finals)), bool)
        most = max(1, (1 << 20) // self.words)
        for i in range(0, len(out), most):
            out[i : i + most] = self._match(data, off[i : i + most + 1])
        return out

    def _match(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")  # longest first: those still running are a prefix
        size, at = size[order], off[:-1][order]
        d = np.tile(self.start, (len(size), 1))
        ends = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for k, n in enumerate(ends.tolist()):
            c, own = data[at[:n] + k], d[:n]
            moved = own << np.uint64(1)
            moved[:, 1:] |= own[:, :-1] >> np.uint64(63)
            d[:n] = (moved & self.step[c]) | (own & self.stay[c])
        f = np.array(self.finals, np.int64)
        hit = (d[:, f // 64] >> (f % 64).astype(np.uint64)) & np.uint64(1) if len(f) else np.zeros((len(d), 0))
        out = np.zeros(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


class RuleSet:
    """Rules, the longest first. Few are one automaton. Many are dealt by the last two labels of their host (by its only one, if
    it has no more): a URL can only fit rules dealt by the end of its own host, so each automaton stays small and is built when
    a URL asks for it; the last ``held`` are kept."""

    def __init__(self, rules: list[Rule], together: int = 256, held: int = 4096):
        self.rules = sorted(rules, key=lambda r: -len(r.text))
        self.held, self.built, self.groups = held, OrderedDict(), {}
        for i, r in enumerate(self.rules):
            host = r.text.partition("/")[0]
            key = None if len(rules) <= together or "*" in host else ".".join(host.split(".")[-2:])
            self.groups.setdefault(key, []).append(i)

    def automaton(self, key: str | None) -> Globs:
        if key in self.built:
            self.built.move_to_end(key)
        else:
            self.built[key] = Globs([self.rules[i].glob() for i in self.groups[key]])
            if len(self.built) > self.held:
                self.built.popitem(last=False)
        return self.built[key]

    def best(self, hosts: pa.Array, canonical: pa.Array) -> np.ndarray:
        """For each row the number of the rule that wins, or -1."""
        none = len(self.rules)
        out = np.full(len(canonical), none)
        by: dict[str | None, np.ndarray] = {None: np.arange(len(canonical))} if None in self.groups else {}
        if len(self.groups) > (None in self.groups):
            labels = [h.split(".") for h in hosts.to_pylist()]
            for n in (1, 2):
                keys = np.array([".".join(x[-n:]) if len(x) >= n else "" for x in labels], object)
                order = np.argsort(keys, kind="stable")
                s, e = runs(keys[order])
                by |= {k: order[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True) if (k := keys[order[x]]) in self.groups}
        for key, rows in by.items():
            hit = self.automaton(key).match(*buffers(canonical.take(pa.array(rows))))
            found = np.array(self.groups[key])[hit.argmax(1)]
            out[rows] = np.minimum(out[rows], np.where(hit.any(1), found, none))
        return np.where(out < none, out, -1)


def filter_urls(pages: DataFrame, rules: list[Rule], *, default: str = "allow", url: str = "url", carry: list[str] | None = None) -> DataFrame:
    """Judges each row's URL: ``carry`` columns (all by default), host, path, rule (null if none fits) and verdict.

    A rule fits its host and all subdomains if the path starts with its path; the longest fitting rule wins, the earlier of
    equally long ones. Without a fitting rule the verdict is ``default``. A null URL or one without ``://`` has an empty host
    and path, which no rule fits. No shuffle; URLs of any length are stepped over in a batch, a state a URL; repeated rows are
    judged alike; an empty table gives an empty one; columns of ``pages`` named as a result column are replaced, others may
    have any name. The rules are a parameter shipped with the tasks, not data of the tables; memory for them is bounded (``RuleSet``).
    """
    carry = [c for c in (pages.columns if carry is None else carry) if c not in ("host", "path", "rule", "verdict")]
    rule_set = RuleSet(rules)
    texts = pa.array([r.text for r in rule_set.rules] or [""], pa.string())
    verdicts = pa.array([r.verdict for r in rule_set.rules] or [""], pa.string())
    host, path = host_and_path(F.col(quoted(url)))
    rows = pages.select(*carried(carry), host.alias("h"), path.alias("p")).withColumn("canonical", F.concat(F.lit("."), "h", "p"))
    kept = rows.columns[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in chunks(buffers(whole.column(whole.num_columns - 1))[1], 4 << 20):
                b = whole.slice(i, j - i)
                best = rule_set.best(b.column(b.num_columns - 3), b.column(b.num_columns - 1))
                at = pa.array(best, pa.int64(), mask=best < 0)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts.take(at), verdicts.take(at).fill_null(default)], names=[*kept, "rule", "verdict"])

    done = rows.mapInArrow(lean(run), output(rows, kept, "rule string, verdict string"))
    return done.select(*restored(carry), F.col("h").alias("host"), F.col("p").alias("path"), "rule", "verdict")


#: The rules of the query.
RULES = [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block")]

URL_SQL = r"""
WITH split AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM split),
rules(rule, rhost, rpath, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fits AS (SELECT p.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
"""
