"""Whole-text tokenisation with the tokenizers library and a bounded memo of words.

For the two pre-tokenizer layouts that are recognised, no token spans a plain
space, so a text's ids are those of its space-separated pieces in a row; nor
does one span the border of a run of Latin letters and a run of plain ASCII
others, so a piece's ids are those of its runs. Pieces are cut into such units
a slice of a column at a time, on its bytes. Each distinct unit is encoded by
the library once while the memo holds it; where the normalizer lower-cases, units
are lower-cased first, so that words that differ in case are one. Pieces that the argument does not
cover are units as they are; texts that it does not cover, texts that hold an
added token's spelling, and any other tokenizer, are encoded whole.

Units are looked up in sorted arrays of their 64-bit hashes; a memo holds a few
million of them, so that two of its units share a hash with a chance below one
in a million.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa

from corpuslake.llm import bytewords as bw
from corpuslake.llm.lean import at_end

#: Entries that the memo of one worker may hold, and ids of its units.
MOST_UNITS, MOST_IDS = 1_000_000, 4_000_000
#: UTF-8 bytes that are looked up at once.
SLICE = 1 << 20
U = np.uint64
_LEAD = U(0xA0761D6478BD642F)
#: Classes of bytes: others of ASCII, Latin letters, and those that may join their neighbours (an apostrophe, a second white space, all else outside ASCII).
_OTHER, _LETTER, _JOINS = 0, 1, 2
_CLASS = np.full(256, _JOINS, np.uint8)
_CLASS[:0x80] = _OTHER
_CLASS[0x27] = _JOINS
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_WHITE = np.zeros(256, bool)  # without the plain space, which no piece holds
_WHITE[0x09:0x0E] = _WHITE[0x1C:0x20] = True


def _classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of a letter from \u00c0 to \u00ff are letters."""
    out = _CLASS[raw]
    at = np.flatnonzero(raw[:-1] == 0xC3)
    at = at[(raw[at + 1] != 0x97) & (raw[at + 1] != 0xB7)]
    out[at] = out[at + 1] = _LETTER
    white = _WHITE[raw]
    out[1:][white[1:] & white[:-1]] = _JOINS
    return out



class Encoder:
    """``column(texts)`` gives the ids of whole texts, ``encode`` those of a list."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        added = layout.get("added_tokens") or []
        self.added = [x["content"].encode() for x in added if x["content"]]
        # an added token that is looked for in normalised text has no one spelling in bytes
        self.mode = "whole" if layout.get("normalizer") and any(x.get("normalized") for x in added) else self._mode(layout)
        self.lower = self.mode == "dropped" and self._lowers(layout)
        self.job: str | None = None
        self.forget()

    @staticmethod
    def _mode(layout: dict) -> str:
        pre, norm = layout.get("pre_tokenizer") or {}, layout.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "leading"  # a single space between words belongs to the second
        steps = pre.get("pretokenizers") or [{}]
        if pre.get("type") == "Sequence" and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and " " not in steps[0]["pattern"].get("Regex", " ") and all(x["type"] in ("NFC", "Replace", "Lowercase") for x in (norm or {}).get("normalizers", [])):
            return "dropped"  # white space reaches no token
        return "whole"

    @staticmethod
    def _lowers(layout: dict) -> bool:
        """Whether the normalizer lower-cases ASCII letters whatever stands around them, and does nothing else to ASCII but white space."""
        steps = (layout.get("normalizer") or {}).get("normalizers", [])
        return any(x["type"] == "Lowercase" for x in steps) and all(x["type"] != "Replace" or x["pattern"] == {"Regex": "\\s+"} for x in steps)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in a row, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())), count

    def forget(self) -> None:
        """Empty the memo."""
        self.keys, self.at, self.count = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _store(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Append ids to the pool: where each text's begin and how many."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(count) - count
        self.used += len(flat)
        return at, count

    def _learn(self, keys: np.ndarray, units: list[str], lead: np.ndarray) -> None:
        """Take new units into the memo; a count of -1 says that a unit's text must be encoded whole."""
        at, count = self._store(*self._ids([" " + x if space and x else x for x, space in zip(units, lead.tolist())]))
        if self.mode == "leading":  # white space outside ASCII; the rest shows in the bytes
            odd = [i for i, x in enumerate(units) if not x.isascii() and (x[-1].isspace() or (lead[i] and x[0].isspace()))]
            count[odd] = -1
        keys, at, count = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.count, count)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.count = keys[order], at[order], count[order]

    def column(self, texts: pa.Array, end_id: int | None = None):
        """Slices (first row, last row + 1, ids, bounds) of a string column; null is empty, each text ends with ``end_id`` if given."""
        data, off = bw.buffers(texts)
        for lo, hi in bw.slices(off, SLICE):
            raw, edges = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            if len(self.keys) > MOST_UNITS or self.used > MOST_IDS:
                self.forget()
            yield lo, hi, *self._slice(raw, edges, end_id)

    def _slice(self, raw: np.ndarray, edges: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        docs = len(edges) - 1
        used = self.used
        if self.mode == "whole":
            at, count = self._store(*self._ids([raw[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:])]))
            first = np.arange(docs + 1)
        else:
            text, start, end, lead, first, odd = self._units(raw, edges)
            key = bw.span_hashes(text, start, end)
            if self.mode == "leading":
                key = np.where(lead, bw.mix(key ^ _LEAD), key)
            unique, index, inverse = np.unique(key, return_index=True, return_inverse=True)
            place, absent = self._find(unique)
            new = np.flatnonzero(absent)
            if len(new):
                rows = index[new]
                flat = text.tobytes()
                self._learn(unique[new], [flat[a:b].decode() for a, b in zip(start[rows].tolist(), end[rows].tolist())], lead[rows])
                used = self.used
                place, _ = self._find(unique)
            at, count = self.at[place][inverse], self.count[place][inverse]
            odd |= self._special(raw, edges)
            if self.mode == "leading":
                odd |= np.add.reduceat(count < 0, first[:-1]) > 0
            odd &= edges[1:] > edges[:-1]
            count = np.maximum(count, 0)
            whole = np.flatnonzero(odd)
            if len(whole):
                count[np.repeat(odd, np.diff(first))] = 0
                at[first[whole]], count[first[whole]] = self._store(*self._ids([raw[edges[d] : edges[d + 1]].tobytes().decode() for d in whole]))
        if end_id is not None:
            e, _ = self._store(np.array([end_id], np.uint32), np.ones(1, np.int64))
            at, count = np.insert(at, first[1:], e[0]), np.insert(count, first[1:], 1)
            first = first + np.arange(docs + 1)
        through = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(at - through[:-1], count) + np.arange(through[-1])]
        self.used = used  # what was stored for whole texts and ends is not kept
        return ids, through[first]

    def _units(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """The bytes that units are taken from, and units of texts: start, end, whether a space stands before one and belongs to it; each text's first unit (one more than texts), and whether it must be encoded whole."""
        spaces = np.flatnonzero(raw == 32)
        first = np.arange(len(edges)) + np.searchsorted(spaces, edges)
        start, end = np.sort(np.concatenate([edges[:-1], spaces + 1])), np.sort(np.concatenate([spaces, edges[1:]]))
        space = np.ones(len(start), bool)
        space[first[:-1]] = False
        odd = np.zeros(len(edges) - 1, bool)
        if self.mode == "leading":  # a space belongs to the piece behind it only if neither side of it is white space
            filled = np.flatnonzero(end > start)
            strange = end == start
            strange[filled] = _WHITE[raw[end[filled] - 1]] | (space[filled] & _WHITE[raw[start[filled]]])
            odd = np.logical_or.reduceat(strange, first[:-1])
        kind = _classes(raw)
        joins = np.flatnonzero(kind == _JOINS)
        whole = np.searchsorted(joins, end) > np.searchsorted(joins, start)
        border = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        border = border[(raw[border] != 32) & (raw[border - 1] != 32)]
        piece = np.searchsorted(start, border, "right") - 1
        border = border[(border > start[piece]) & ~whole[piece]]
        # a piece's units: its start and the borders within
        at = np.arange(len(start)) + np.searchsorted(border, start)
        n = len(start) + len(border)
        inner = np.ones(n, bool)
        inner[at] = False
        unit, lead = np.empty(n, np.int64), np.zeros(n, bool)
        unit[at], unit[inner] = start, border
        lead[at] = space if self.mode == "leading" else False
        stop = np.append(unit[1:], 0)
        stop[np.append(at[1:], n) - 1] = end
        text = raw
        if self.lower:  # what joins its neighbours may change by its case (a mark that composes with one case alone)
            step = np.zeros(len(raw) + 1, np.int8)
            step[start[whole]] += 1
            step[end[whole]] -= 1
            text = np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, raw, bw.LOWER[raw])
        return text, unit, stop, lead, np.append(at, n)[first], odd

    def _special(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The texts that hold an added token's spelling, which the library takes out of a text before it cuts it into pieces."""
        out, flat = np.zeros(len(edges) - 1, bool), raw.tobytes()
        for token in self.added:
            at = flat.find(token)
            while at >= 0:
                doc = int(np.searchsorted(edges, at, "right")) - 1
                out[doc] = True
                at = flat.find(token, int(edges[doc + 1]))
        return out

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys in the memo, and which are not there."""
        place = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return place, np.ones(len(keys), bool)
        place = np.minimum(place, len(self.keys) - 1)
        return place, self.keys[place] != keys

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as uint32 bytes."""
        out: list[bytes] = []
        for _, _, ids, bounds in self.column(pa.array(texts, pa.string())):
            flat = ids.tobytes()
            out += [flat[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out


_encoders: dict[str, Encoder] = {}


@at_end
def _forget_all() -> None:
    for x in _encoders.values():
        if x.job is None:
            x.forget()


def encoder(path: str, job: str | None = None) -> Encoder:
    """One encoder for each file and worker process. Its memo goes when a task ends, or, for tasks that name the same ``job``, when another job's begins."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    found = _encoders[path]
    if found.job != job:
        found.forget()
        found.job = job
    return found
