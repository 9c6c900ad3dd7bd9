"""Blocks of texts as arrays of code points, with words, sentences and character n-grams of all of them at once."""

from __future__ import annotations

import functools

import numpy as np
import regex
import sys

from roadsift.llm.pretokens import LETTER, NUMBER, classes, powers

SPACE_POINT = 32


@functools.cache
def lower() -> np.ndarray:
    """Lower-case code point of each code point (those whose lower case is one character)."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in regex.findall(r"[\p{Lu}\p{Lt}]", "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))):
        if len(small := c.lower()) == 1:
            out[ord(c)] = ord(small)
    return out


def points(texts: list[str], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with ``gap`` zeros after each, and where each text starts and ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + gap) - gap
    return np.frombuffer((("\0" * gap).join([*texts, ""])).encode("utf-32-le"), np.uint32), ends - sizes, ends


def mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return values ^ (values >> np.uint64(29))


class Words:
    """Runs of letters and digits in lower case, and the sentences they stand in.

    A sentence reaches to an ender or the end of its text; sentences that start within the same ``least`` words of a
    text count as one. ``sentence`` numbers those of all texts, ``opens`` and ``closes`` are their places in the block.
    """

    def __init__(self, texts: list[str], enders: str = ".!?\n", least: int = 5):
        raw, self.begin, self.finish = points(texts, 1)
        kind = classes()[raw]
        inside = (kind == LETTER) | (kind == NUMBER)
        inside[self.finish] = False
        change = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        self.start, self.end = change[::2], change[1::2]
        point = lower()[raw].astype(np.uint64) + np.uint64(1)
        up, self._down = powers(1 << max(1, len(point)).bit_length())
        self._sum = np.zeros(len(point) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(point * up[:len(point)], out=self._sum[1:])
        self.row = np.searchsorted(self.finish, self.start)
        stop = np.isin(raw, [ord(c) for c in enders])
        stop[self.finish] = True
        stops = np.flatnonzero(stop)
        names, first, inverse = np.unique(np.searchsorted(stops, self.start), return_index=True, return_inverse=True)
        row = self.row[first]
        place = (first - np.searchsorted(self.row, row)) // least
        new = np.ones(len(names), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
        self.sentence = (np.cumsum(new) - 1)[inverse]
        heads, self.owner = names[new], row[new]
        self.opens = np.maximum(self.begin[self.owner], np.where(heads > 0, stops[heads - 1] + 1, 0))
        self.closes = stops[names[np.append(np.flatnonzero(new)[1:], len(names)) - 1]] if len(names) else names

    def keys(self, size: int | None = None) -> np.ndarray:
        """64-bit key of each word, or of its first ``size`` characters (0 where it has no more)."""
        end = self.end if size is None else np.minimum(self.start + size, self.end)
        with np.errstate(over="ignore"):
            key = mixed((self._sum[end] - self._sum[self.start]) * self._down[self.start] + np.uint64(size or 0) * np.uint64(0x9E3779B97F4A7C15))
        return key if size is None else np.where(self.end - self.start > size, key, np.uint64(0))
