"""Token ids by the tokenizers library, with a memo of units in front of it."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import _SPACE, chunks, span_hashes, word_spans

#: White space beyond ASCII, as UTF-8: rows with it are encoded whole by byte-level tokenizers.
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MAYBE_ODD = np.zeros(256, bool)
_MAYBE_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Units that are one run of letters, which need no splitting by the tokenizer.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The usual byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SEPARATOR = {"byte": "\n", "word": " \x01 "}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    A text is cut where the tokenizer's own splitting surely cuts: at white space, and before a full stop or comma that
    follows a letter or digit. Such units are encoded alike wherever they stand, so each distinct unit goes to the library
    once; a vectorised lookup by 64-bit hash (with length and first bytes compared) serves its repeats. ``capacity``
    bounds the memo: beyond so many units it is cleared and begins anew. Texts that hold one of the tokenizer's added tokens
    (``<|endoftext|>``), which it finds before any splitting, go to the library whole.
    """

    def __init__(self, path: str, capacity: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            parsed = json.load(f)
        self.kind = "byte" if parsed["pre_tokenizer"]["type"] == "ByteLevel" else "word"
        added = [t["content"] for t in parsed.get("added_tokens") or []]
        # Without regard to case, as some normalise a text before they look for them.
        self.added = re.compile("|".join(map(re.escape, added)).encode() or b"(?!)", re.IGNORECASE)
        self.first = np.unique(np.frombuffer("".join(x[0] for x in added).encode(), np.uint8))
        self.separator = self._ids(_SEPARATOR[self.kind])
        if len(self.separator) != 1:
            raise ValueError(f"{path}: no single id separates units")
        self.capacity = capacity
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = word_spans(data, off)
        stop = (data == 46) | (data == 44)
        before = np.zeros(len(data), bool)
        before[1:] = _ALNUM[data[:-1]]
        before[2:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = stop & before
        cut[s] = True
        if self.kind == "word":
            starts = np.flatnonzero(cut[:-1])
            ends = np.append(starts[1:], len(data))
            return starts, np.minimum(ends, e[np.searchsorted(s, starts, "right") - 1]) if len(s) else ends
        spaced = np.zeros(len(data) + 1, bool)
        spaced[1:-1] = _SPACE[data[:-1]] & ~_SPACE[data[1:]]
        spaced[off] = False
        at = np.flatnonzero(spaced)  # words after white space of the same row
        blank = data[at - 1] == 32
        cut[at[blank]] = False  # one space before a word belongs to it
        cut[at - 1] = True
        cut[e] = True
        cut[off] = True
        starts = np.flatnonzero(cut[:-1])
        return starts, np.append(starts[1:], len(data))

    def _checks(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        out = (e - s).astype(np.uint64) << np.uint64(48)
        for k in range(8):
            out ^= np.where(s + k < e, padded[s + k], 0).astype(np.uint64) << np.uint64(8 * k)
        return out

    def _encode_units(self, units: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(units)
        joined, model = [], self.tokenizer.model
        for i, u in enumerate(units):
            if len(u) < 256 and _LETTERS.fullmatch(u):
                u = u.decode().lower().encode() if self.kind == "word" else u
                out[i] = np.array([t.id for t in model.tokenize(u.decode("latin-1").translate(_ALPHABET))], np.int32)
            elif u.strip() and b"\x01" not in u and b"\n" not in u:
                joined.append(i)
        for k in range(0, len(joined), 2000):
            part = joined[k : k + 2000]
            ids = self._ids(_SEPARATOR[self.kind].join(units[i].decode() for i in part))
            for i, got in zip(part, np.split(ids, np.flatnonzero(ids == self.separator[0])), strict=True):
                out[i] = got if i == part[0] else got[1:]
        return [self._ids(units[i].decode()) if x is None else x for i, x in enumerate(out)]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self._encode_units(units)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        starts = len(self.pool) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.pool = np.concatenate([self.pool, *got])
        keys, checks = np.concatenate((self.keys, keys)), np.concatenate((self.checks, checks))
        starts, sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))
        order = np.argsort(keys, kind="stable")
        self.keys, self.checks, self.starts, self.sizes = keys[order], checks[order], starts[order], sizes[order]

    def _whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [self._ids(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")) for i in range(len(off) - 1)]
        return np.concatenate([*got, np.zeros(0, np.int32)]), np.fromiter(map(len, got), np.int64, len(got))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each row has."""
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i, j in chunks(off, 2 << 20):
            a, b = int(off[i]), int(off[j])
            part, own = data[a:b], off[i : j + 1] - a
            odd = [m.start() for m in self.added.finditer(part.tobytes())] if any((part == x).any() for x in self.first) else []
            if self.kind == "byte" and _MAYBE_ODD[part].any():
                odd += [m.start() for m in _ODD_SPACE.finditer(part.tobytes())]
            if odd:
                rows = np.unique(np.searchsorted(own, odd, "right") - 1)
                at = 0
                for r in rows.tolist():
                    for x, y, f in ((at, r, self._memo), (r, r + 1, self._whole)):
                        ids, n = f(part[own[x] : own[y]], own[x : y + 1] - own[x])
                        flat.append(ids)
                        counts.append(n)
                    at = r + 1
                ids, n = self._memo(part[own[at] :], own[at:] - own[at])
            else:
                ids, n = self._memo(part, own)
            flat.append(ids)
            counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def _memo(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        seen = _LOWER[data] if self.kind == "word" else data
        s, e = self._units(seen, off)
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        keys, first, back = np.unique(span_hashes(seen, s, e), return_index=True, return_inverse=True)
        us, ue = s[first], e[first]
        checks = self._checks(seen, us, ue)
        if len(self.keys) > self.capacity:
            self.keys = self.checks = np.zeros(0, np.uint64)
            self.starts = self.sizes = np.zeros(0, np.int64)
            self.pool = np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            raw = seen.tobytes()
            self._learn(keys[new], checks[new], [raw[x:y] for x, y in zip(us[new].tolist(), ue[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        if (self.checks[at] != checks).any() or ((e - s) != (ue - us)[back]).any():
            return self._whole(data, off)  # two units with one hash
        sizes, starts = self.sizes[at][back], self.starts[at][back]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]
        bound = np.concatenate(([0], ends))[np.searchsorted(s, off)]
        return ids, np.diff(bound)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, capacity: int = 1 << 19) -> Encoder:
    """One encoder a process and file, so that its memo serves all tasks of a worker."""
    key = (path, capacity)
    if key not in _encoders:
        _encoders[key] = Encoder(path, capacity)
    return _encoders[key]
