"""Burrows-Wheeler transform and common prefixes of many short strings, column by column through sequential files.

Round j inserts one symbol of every string, the one before its last j: the suffixes of length j of all strings are already
in order, and that order with the symbols before them gives the places of the suffixes of length j + 1. Two files hold
one byte for each suffix: the symbol before it, and the prefix it has in common with the suffix above it (cut at ``most``).
A round reads both files once, in pieces of ``PIECE`` suffixes, and writes both anew with the insertions merged in. In
memory are a piece, one entry for each string, and for each symbol how often it came and the least common prefix since.

A new suffix c + s stands below c + t, where t is the last suffix above s that also has c before it; what these have in
common is one more than the least common prefix on the way from t to s. The suffix after it is corrected likewise.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 19
UNSEEN = 255


class _Least:
    """Least value of any stretch of an array, by tables of doubling width."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a:b], each stretch not empty."""
        out = np.empty(len(a), np.uint8)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            table = self.tables[k]
            out[at] = np.minimum(table[a[at]], table[b[at] - (1 << int(k))])
        return out


def _read(file, n: int) -> np.ndarray:
    """The next n bytes of an unbuffered file."""
    out = np.empty(n, np.uint8)
    view, have = memoryview(out), 0
    while have < n:
        have += file.readinto(view[have:])
    return out


def _append(file, values: np.ndarray) -> None:
    view = memoryview(values)
    while len(view):
        view = view[file.write(view):]


class Collection:
    """The transform of ``strings`` (bytes without 0xff), each shorter than 255, in files under ``folder``."""

    def __init__(self, strings: list[bytes], folder: str, most: int, piece: int = PIECE):
        self.n, self.most, self.piece, self.folder = len(strings), most, piece, folder
        self.files, self.turn, self.size = [[open(os.path.join(folder, f"{name}-{i}"), "w+b", buffering=0) for name in ("symbol", "common")] for i in range(2)], 0, 0
        self.length = np.array([len(s) for s in strings], np.int64)
        text = np.frombuffer(b"".join(strings), np.uint8)
        end = np.cumsum(self.length)
        self.count = np.zeros(256, np.int64)  # suffixes by the symbol before them; 0: nothing before
        place, who = np.arange(self.n), np.arange(self.n)
        symbol = np.zeros(self.n, np.uint8)
        symbol[self.length > 0] = text[end[self.length > 0] - 1] + 1
        self._write(place, symbol, np.zeros(self.n, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        self.count += np.bincount(symbol, minlength=256)
        for j in range(1, int(self.length.max()) + 1 if self.n else 0):
            place, who, common, old, patch = self._places(place, who)
            left = self.length[who] > j
            symbol = np.zeros(len(who), np.uint8)
            symbol[left] = text[end[who[left]] - 1 - j] + 1
            self._write(place, symbol, common, old, patch)
            self.count += np.bincount(symbol, minlength=256)

    def _heads(self) -> np.ndarray:
        """Where the suffixes that begin with each symbol start."""
        heads = np.zeros(256, np.int64)
        heads[1] = self.n
        np.cumsum(self.count[1:-1], out=heads[2:])
        heads[2:] += self.n
        return heads

    def _pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        one, other = self.files[self.turn % 2]
        one.seek(0), other.seek(0)
        for start in range(0, self.size, self.piece):
            n = min(self.piece, self.size - start)
            yield start, _read(one, n), _read(other, n)

    def _places(self, place: np.ndarray, who: np.ndarray):
        """Places, strings and common prefixes of the suffixes that are one longer, in order; and the corrections of others."""
        heads, seen = self._heads(), np.zeros(256, np.int64)
        least, fresh = np.full(256, UNSEEN, np.uint8), np.zeros(256, bool)
        out = []
        for start, symbol, common in self._pieces():
            n = len(symbol)
            a, b = np.searchsorted(place, (start, start + n))
            new = np.zeros(n, bool)
            new[place[a:b] - start] = True
            order = np.argsort(symbol, kind="stable")
            sorted_, isnew = symbol[order], new[order]
            cut = np.searchsorted(sorted_, np.arange(257))
            first = np.zeros(n, bool)
            present = np.flatnonzero(np.diff(cut))
            first[cut[present]] = True
            after_new = np.empty(n, bool)
            after_new[1:] = isnew[:-1]
            after_new[cut[present]] = fresh[present]
            want = np.flatnonzero((isnew | after_new) & (sorted_ > 0))
            c = sorted_[want]
            at = order[want]
            before = np.where(first[want], -1, order[np.maximum(want - 1, 0)])
            minimum = _Least(common)
            value = minimum(before + 1, at + 1)
            opening = first[want]
            unseen = opening & (seen[c] == 0)
            value = np.where(opening, np.minimum(value, least[c]), value)
            value = np.where(unseen, 0, np.minimum(value.astype(np.int64) + 1, self.most)).astype(np.uint8)
            string = np.full(len(want), -1, np.int64)
            mine = isnew[want]
            string[mine] = who[np.searchsorted(place, at[mine] + start)]
            out.append((heads[c] + seen[c] + want - cut[c], string, value))
            # what later pieces need of this one
            lowest = common.min()
            absent = np.ones(256, bool)
            absent[present] = False
            least[absent] = np.minimum(least[absent], lowest)
            last = order[cut[present + 1] - 1]
            inner = last + 1 < n
            least[present] = UNSEEN
            least[present[inner]] = minimum(last[inner] + 1, np.full(inner.sum(), n))
            fresh[present] = new[last]
            seen[present] += np.diff(cut)[present]
        where, string, value = (np.concatenate([o[i] for o in out]) for i in range(3))
        order = np.argsort(where)
        where, string, value = where[order], string[order], value[order]
        new = string >= 0
        return where[new], string[new], value[new], where[~new], value[~new]

    def _write(self, place: np.ndarray, symbol: np.ndarray, common: np.ndarray, old: np.ndarray, patch: np.ndarray) -> None:
        """Both files with new suffixes at ``place`` (of the new files); ``old`` ones get the common prefix ``patch``."""
        size = self.size + len(place)
        before, after = self.files[self.turn % 2], self.files[(self.turn + 1) % 2]
        for file in (*before, *after):
            file.seek(0)
        for start in range(0, size, self.piece):
            n = min(self.piece, size - start)
            a, b = np.searchsorted(place, (start, start + n))
            rest = np.ones(n, bool)
            rest[place[a:b] - start] = False
            for source, target, values in zip(before, after, (symbol, common)):
                made = np.empty(n, np.uint8)
                made[~rest] = values[a:b]
                made[rest] = _read(source, n - (b - a))
                if values is common:
                    c, d = np.searchsorted(old, (start, start + n))
                    made[old[c:d] - start] = patch[c:d]
                _append(target, made)
        self.turn, self.size = self.turn + 1, size

    def close(self) -> None:
        for file in (*self.files[0], *self.files[1]):
            file.close()

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, start, group) of every suffix of ``most`` bytes and more; equal groups have their first ``most`` bytes in common."""
        heads, seen, groups = self._heads(), np.zeros(256, np.int64), 0
        step = np.memmap(os.path.join(self.folder, "step"), np.int64, "w+", shape=max(1, self.size))
        group = np.memmap(os.path.join(self.folder, "group"), np.int64, "w+", shape=max(1, self.size))
        for start, symbol, common in self._pieces():
            order = np.argsort(symbol, kind="stable")
            sorted_ = symbol[order]
            cut = np.searchsorted(sorted_, np.arange(257))
            step[start + order] = heads[sorted_] + seen[sorted_] + np.arange(len(order)) - cut[sorted_]
            seen += np.diff(cut)
            named = groups + np.cumsum(common < self.most)
            group[start:start + len(named)] = named
            groups = int(named[-1])
        strings, starts, found = [], [], []
        who, at = np.arange(self.n), np.arange(self.n)
        for j in range(int(self.length.max()) + 1 if self.n else 0):
            if j >= self.most:
                strings.append(who)
                starts.append(self.length[who] - j)
                found.append(group[at])
            go = self.length[who] > j
            who, at = who[go], step[at[go]]
        del step, group
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else empty for x in (strings, starts, found))
