"""Operator 13, BPE encoding and decoding: merges compiled into a deterministic automaton over tokens, walked by tables."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, buffers, carried, chunks, lean, output, quoted, restored
from .tokens import _ALPHABET, _LETTERS, Encoder

_BYTES = str.maketrans({c: chr(b) for b, c in _ALPHABET.items()})
#: Words of up to so many bytes are walked many at a time; a longer one is walked by itself.
SIDE_BY_SIDE = 64


def raw(shown: str) -> bytes:
    """The bytes that a byte-level tokenizer's printable characters stand for."""
    return shown.translate(_BYTES).encode("latin-1")


class Gadgets:
    """The deterministic automaton whose paths are the token sequences that the merges make.

    At first one state accepts every sequence of single symbols. The gadget of a merge (u, v) in its turn: wherever an arc u is followed
    by an arc v there is now also an arc uv, to where v leads; and the state that u leads to loses its arc v. The state
    that an arc leads to depends on its token only, so a state is named by the token read last. A gadget of uv hence says:
    the state of uv is what the state of v was just before (but for the arcs that later gadgets take from either), uv may
    follow where u might at that time, and v no longer follows u. (Where u is v, uu can't follow u either: equal symbols pair
    up from the left.) A gadget is kept as these references, with its turn: the written-out table of a
    vocabulary of 50,000 would have 2.5 thousand million arcs. ``arcs`` follows them back, at most once a gadget of either token,
    and ``allowed`` keeps what it has found in a table of arcs, cleared at ``most`` entries.
    """

    def __init__(self, symbols: Iterable[int], merges: list[tuple[int, int, int]], most: int = 1 << 18):
        """``merges``: (u, v, uv) in their order. Each must join tokens that are there by then into a new one."""
        n = 1 + max([*symbols, *[m[2] for m in merges]])
        self.turn, self.u, self.v = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.turn[list(symbols)] = 0
        for i, (u, v, uv) in enumerate(merges, 1):
            if min(u, v) < 0 or self.turn[u] < 0 or self.turn[v] < 0 or self.turn[uv] >= 0:
                raise ValueError(f"merge {i} doesn't make a new token of two that earlier merges made")
            self.turn[uv], self.u[uv], self.v[uv] = i, u, v
        pairs = np.array([(u << 32 | v, i) for i, (u, v, _) in enumerate(merges, 1)], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pairs, self.taken = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], 0)
        self.table, self.most = {}, most
        self.lists = self.turn.tolist(), self.u.tolist(), self.v.tolist(), dict(pairs.tolist())
        # Tokens that some text has: at its turn a merge needs an arc v from the state of u, and both need to be such tokens.
        self.alive = self.turn == 0
        if merges:
            u, v, uv = np.array(merges, np.int64).T
            for x, y, z, met in zip(u.tolist(), v.tolist(), uv.tolist(), self.arcs(u, v, self.turn[uv]).tolist(), strict=True):
                self.alive[z] = met and self.alive[x] and self.alive[y]

    def arcs(self, a: np.ndarray, b: np.ndarray, now: np.ndarray | None = None) -> np.ndarray:
        """Whether the automaton has an arc b from the state of a: the finished one, or as it is before turn ``now``."""
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        a, b, now = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max) if now is None else now
        while len(at):
            key = a << 32 | b
            k = np.searchsorted(self.pairs, key)
            gone = (self.pairs[k] == key) & (self.taken[k] < now)
            ta, tb = self.turn[a], self.turn[b]
            gone |= (tb > ta) & (self.u[b] == a) & (self.v[b] == a)
            ok[at[gone]] = False
            on = ~gone & ((ta > 0) | (tb > 0))
            at, a, b, ta, tb = at[on], a[on], b[on], ta[on], tb[on]
            now = np.maximum(ta, tb)
            a, b = np.where(ta == now, self.v[a], a), np.where(tb == now, self.u[b], b)
        return ok

    def arc(self, a: int, b: int) -> bool:
        """As ``arcs``, of one arc, from the table where it has the answer."""
        hit = self.table.get(a << 32 | b)
        if hit is None:
            turn, u, v, taken = self.lists
            x, y, now, hit = a, b, len(turn), 1
            while hit and now:
                tx, ty = turn[x], turn[y]
                if taken.get(x << 32 | y, now) < now or (ty > tx and u[y] == v[y] == x):
                    hit = 0
                now = max(tx, ty)
                x, y = v[x] if tx == now else x, u[y] if ty == now else y
            if len(self.table) >= self.most:
                self.table.clear()
            self.table[a << 32 | b] = hit
        return hit == 1

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``arcs``, from the table where it has the answer."""
        keys, back = np.unique(a << 32 | b, return_inverse=True)
        got = np.fromiter(map(self.table.get, keys.tolist(), [-1] * len(keys)), np.int8, len(keys))
        new = np.flatnonzero(got < 0)
        if len(new):
            got[new] = self.arcs(keys[new] >> 32, keys[new] & 0xFFFFFFFF)
            if len(self.table) + len(new) > self.most:
                self.table.clear()
            self.table.update(zip(keys[new].tolist(), got[new].tolist(), strict=True))
        return got[back] == 1


class Automaton:
    """Encodes byte strings by walking ``Gadgets``, and decodes ids by the labels of their arcs.

    A walk has read the first i bytes of a word for i = 1, 2, ...; exactly one path of the automaton spells them, and its last
    arc is kept. The tokens that end at a place come from a table of byte transitions over all tokens' prefixes (with the longest
    proper suffix to fall back to); of these the one that is an arc from the state at its own beginning is right."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.gadgets = Gadgets([t for t, x in labels.items() if len(x) == 1], merges)
        known = {t: x for t, x in labels.items() if t < len(self.gadgets.turn) and self.gadgets.alive[t]}
        if {x[0] for x in known.values() if len(x) == 1} != set(range(256)):
            raise ValueError("every byte must be a token")
        n = 1 + max(labels)
        self.size = np.zeros(n, np.int64)
        self.size[list(labels)] = [len(x) for x in labels.values()]
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(labels.get(t, b"") for t in range(n)), np.uint8)
        self._prefixes(known)

    def _prefixes(self, labels: dict[int, bytes]) -> None:
        edge: dict[int, int] = {}
        ends, states = {}, 1
        for t, x in labels.items():
            s = 0
            for c in x:
                to = edge.get(s << 8 | c)
                if to is None:
                    to = edge[s << 8 | c] = states
                    states += 1
                s = to
            ends[s] = t
        below: list[list[tuple[int, int]]] = [[] for _ in range(states)]
        for k, to in edge.items():
            below[k >> 8].append((k & 255, to))
        fail, longest, shorter = [0] * states, [-1] * states, np.full(len(self.size), -1, np.int64)
        todo = deque([0])
        while todo:
            s = todo.popleft()
            for c, to in below[s]:
                f = fail[s]
                while f and f << 8 | c not in edge:
                    f = fail[f]
                fail[to] = edge.get(f << 8 | c, 0) if s else 0
                longest[to] = ends.get(to, longest[fail[to]])
                if to in ends:
                    shorter[ends[to]] = longest[fail[to]]
                todo.append(to)
        self.edge, self.fail, self.longest, self.shorter = edge, np.array(fail), np.array(longest), shorter
        self.lists = fail, longest, shorter.tolist(), self.size.tolist()
        keys = np.fromiter(edge, np.int64, len(edge))
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.fromiter(edge.values(), np.int64, len(edge))[order], 0)

    def _step(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        out, at, s = np.zeros(len(s), np.int64), np.arange(len(s)), s.copy()
        while len(at):
            key = s << 8 | c[at]
            k = np.searchsorted(self.keys, key)
            hit = self.keys[k] == key
            out[at[hit]] = self.to[k[hit]]
            on = ~hit & (s > 0)
            at, s = at[on], self.fail[s[on]]
        return out

    def _walk(self, words: list[bytes]) -> list[np.ndarray]:
        """Words side by side, longest first; row i of ``last`` has the arcs of paths that spell the first i bytes."""
        n, wide = len(words), len(words[0])
        size = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(n, wide).astype(np.int64)
        last, state = np.full((wide + 1, n), -1, np.int64), np.zeros(n, np.int64)
        for i in range(1, wide + 1):
            m = int(np.searchsorted(-size, -i, "right"))
            state = self._step(state[:m], text[:m, i - 1])
            rows, t = np.arange(m), self.longest[state]
            while len(rows):
                before = i - self.size[t]
                prev = last[before, rows]
                ok = before == 0
                ok[~ok] = self.gadgets.allowed(prev[~ok], t[~ok])
                last[i, rows[ok]] = t[ok]
                rows, t = rows[~ok], self.shorter[t[~ok]]
        at, rows, turns = size.copy(), np.arange(n), []
        while len(rows):
            t = last[at[rows], rows]
            turns.append((rows, t))
            at[rows] -= self.size[t]
            rows = rows[at[rows] > 0]
        who, what = (np.concatenate(x) for x in zip(*turns[::-1], strict=True))
        order = np.argsort(who, kind="stable")
        return np.split(what[order].astype(np.int32), np.cumsum(np.bincount(who, minlength=n))[:-1])

    def _alone(self, word: bytes) -> np.ndarray:
        """One word of any length, byte by byte, by the same tables."""
        edge, arc, (fail, longest, shorter, size) = self.edge, self.gadgets.arc, self.lists
        last, s = [-1] * (len(word) + 1), 0
        for i, c in enumerate(word, 1):
            while s and s << 8 | c not in edge:
                s = fail[s]
            s = edge.get(s << 8 | c, 0)
            t = longest[s]
            while i > size[t] and not arc(last[i - size[t]], t):
                t = shorter[t]
            last[i] = t
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= size[last[i]]
        return np.array(out[::-1], np.int32)

    def encode(self, words: list[bytes], block: int = 1 << 14, few: int = 200) -> list[np.ndarray]:
        """The ids of each word; equal words are walked once. Fewer than ``few`` words aren't worth walking side by side."""
        distinct = sorted({w for w in words if w}, key=len, reverse=True)
        of = {b"": np.zeros(0, np.int32)}
        short = next((i for i, w in enumerate(distinct) if len(w) <= SIDE_BY_SIDE), len(distinct)) if len(distinct) >= few else len(distinct)
        of |= {w: self._alone(w) for w in distinct[:short]}
        for i in range(short, len(distinct), block):
            of |= zip(distinct[i : i + block], self._walk(distinct[i : i + block]), strict=True)
        return [of[w] for w in words]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels of all rows' ids one after another, and the offsets of rows in them. Unknown ids have no label."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, 0).astype(np.int64) if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)) else ids.astype(np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        data = self.pool[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return data, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]


class AutomatonEncoder(Encoder):
    """Ids as the tokenizers library's, of which only the splitting into words is used here; each distinct word goes through the
    automaton. Texts are cut into units, and units remembered, as ``Encoder`` says."""

    def __init__(self, path: str, capacity: int = 1 << 19):
        with open(path) as f:
            parsed = json.load(f)
        model, split, added = parsed["model"], parsed["pre_tokenizer"] or {}, parsed.get("added_tokens") or []
        odd = parsed["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model["type"] != "BPE"
        odd = odd or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added) or (parsed["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        labels = {i: raw(x) for x, i in vocab.items()}
        self.automaton = Automaton(labels | {t["id"]: t["content"].encode() for t in added}, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs])
        self.special = {t["content"]: np.array([t["id"]], np.int32) for t in added}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        super().__init__(path, capacity)

    def _words(self, text: str) -> list[bytes]:
        return [raw(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def _ids(self, text: str) -> np.ndarray:
        parts = self.apart.split(text) if self.apart else [text]
        got = [[self.special[p]] if k % 2 else self.automaton.encode(self._words(p)) for k, p in enumerate(parts)]
        return np.concatenate([np.zeros(0, np.int32), *[x for g in got for x in g]])

    def _encode_units(self, units: list[bytes]) -> list[np.ndarray]:
        words = [[u] if len(u) < 256 and _LETTERS.fullmatch(u) else self._words(u.decode()) for u in units]
        ids = self.automaton.encode([w for own in words for w in own])
        ends = np.cumsum([0, *map(len, words)]).tolist()
        return [ids[a] if b - a == 1 else np.concatenate([np.zeros(0, np.int32), *ids[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]


_made: dict[str, AutomatonEncoder] = {}


def compiled(path: str) -> AutomatonEncoder:
    """One automaton a process and file: it is compiled once a worker."""
    if path not in _made:
        _made[path] = AutomatonEncoder(path)
    return _made[path]


def bpe_encode(docs: DataFrame, tokenizer: str, *, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and ids (array of ints): each whole text's ids, as the tokenizers library gives them without
    special tokens, truncation and padding. Strings of added tokens in a text become those tokens, as there.

    Null and empty texts have no ids (an empty list). Rows are independent: repeated rows have equal ids, an empty table gives
    an empty one, columns may have any names (one called ids is replaced). A text of any length is encoded by one task, in
    time that grows with the length. A tokenizer file that is no plain byte-level BPE, or whose merges don't build on each
    other, is an error.
    """
    keep = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = compiled(tokenizer)
        for b in batches:
            data, off = buffers(b.column(0))
            for i, j in chunks(off, 2 << 20):
                ids, n = code.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[1:]], lists], names=[*b.schema.names[1:], "ids"])

    source = docs.select(F.col(quoted(text)).cast("string").alias("t"), *carried(keep))
    return source.mapInArrow(lean(run), output(source, source.columns[1:], "ids array<int>")).select(*restored(keep), "ids")


def bpe_decode(rows: DataFrame, tokenizer: str, *, ids: str = "ids") -> DataFrame:
    """The columns of ``rows`` and decoded: the text of each row's ids, special tokens included; bytes that are no UTF-8 become
    U+FFFD, and ids the vocabulary hasn't got are left out. Null lists and null ids in lists have no text."""
    keep = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(tokenizer).automaton
        for b in batches:
            lists = b.column(0)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = automaton.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            text = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text, pa.string())], names=[*b.schema.names[1:], "decoded"])

    known = F.transform(F.filter(F.col(quoted(ids)), lambda x: x.isNotNull()), lambda x: x.cast("int"))
    source = rows.select(F.coalesce(known, F.array().cast("array<int>")).alias("i"), *carried(keep))
    return source.mapInArrow(lean(run), output(source, source.columns[1:], "decoded string")).select(*restored(keep), "decoded")


def bpe_digests(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of its ids as little-endian unsigned 32-bit integers), decoded_sha256 (of what
    its ids decode to). Encoding and decoding in one pass, without a shuffle; texts and ids don't leave the task. Otherwise as ``bpe_encode``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = compiled(tokenizer)
        for b in batches:
            data, off = buffers(b.column(1))
            for i, j in chunks(off, 2 << 20):
                ids, n = code.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                back, ends = code.automaton.decode(ids, n)
                at = np.concatenate(([0], np.cumsum(n))).tolist()
                raw_ids, ends = memoryview(ids.astype("<u4")).cast("B"), ends.tolist()
                a = [sha256(raw_ids[4 * x : 4 * y]).hexdigest() for x, y in zip(at, at[1:], strict=False)]
                c = [sha256(back[x:y].tobytes().decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(ends, ends[1:], strict=False)]
                yield from arrow_batches({"doc_id": b.column(0).slice(i, j - i), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(c, pa.string())})

    source = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("t"))
    made = source.mapInArrow(lean(run), output(source, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string"))
    return made.withColumnRenamed("doc_id", doc_id)
