"""Periodic runs of words, by a sparse dynamic program over diagonals.

A diagonal is a lag: the words at i and i - lag are equal along it. For each word its earlier occurrences name the lags
whose match length grows there; only these are looked at, no table over all lags is kept. When a diagonal ends, its
match length m and lag q are a stretch of m + q words with period q, and it is emitted at once if that is long enough.

A run that counts matches over at least ``gram_size`` consecutive words (16 for the defaults), so "earlier occurrences"
are those of that many words together: almost every lag of common words is never opened. Grams are named by doubling
(pairs of names), which compares words themselves and no hashes. A diagonal is opened only where it can't be extended to
the left; from there its match length grows by vectors of doubling size up to the first mismatch. A diagonal whose lag is
a multiple of a run's period, with the run's start, is that run again and isn't followed; so every run comes out once,
with its smallest period, and a text of one word repeated a million times costs one diagonal.

Null and empty texts have no runs and collapse to an empty text. Repeated rows are rows of their own, null ids stay,
other columns are ignored, no rows give no rows. A text is the largest unit that a task holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from roadsift.llm.common import map_rows, slim

LEAST, TIMES = 24, 3
#: Most openings that are held at once.
OPENINGS = 1 << 20


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8").split()


def gram_size(least: int = LEAST, times: int = TIMES) -> int:
    """Consecutive matches that every run of enough length has on its diagonal."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def grams(ids: np.ndarray, size: int) -> np.ndarray | None:
    """Name of the ``size`` words from each position on; None if no two are equal."""
    def pairs(left, right):
        found, inverse = np.unique(left.astype(np.int64) * (int(right.max()) + 1) + right, return_inverse=True)
        return None if len(found) == len(inverse) else inverse

    name, have = ids, 1
    while have < size:
        step = min(have, size - have)
        name = pairs(name[:-step], name[step:])
        if name is None:
            return None
        have += step
    return name


def extent(ids: np.ndarray, x: int, y: int) -> int:
    """How many words from x and from y on are equal (x < y)."""
    m, step, room = 0, 64, len(ids) - y
    while m < room:
        one, other = ids[x + m:x + min(m + step, room)], ids[y + m:y + min(m + step, room)]
        apart = one != other
        if apart.any():
            return m + int(apart.argmax())
        m, step = m + len(one), step * 2
    return m


def openings(ids: np.ndarray, name: np.ndarray, times: int):
    """(x, y) arrays: equal grams at x < y whose words before differ, with room for a run; x in whole, lags ascending."""
    n = len(ids)
    before = np.concatenate([[-1], ids[:len(name) - 1]])
    order = np.lexsort((np.arange(len(name)), before, name))
    named, left = name[order], before[order]
    group = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
    part = np.append(True, (named[1:] != named[:-1]) | (left[1:] != left[:-1]))
    parts = np.add.reduceat(part, group)
    ends = np.append(group[1:], len(order))
    for a, b in zip(group[parts > 1].tolist(), ends[parts > 1].tolist()):
        places = order[a:b]
        cuts = np.append(np.flatnonzero(part[a:b]), b - a)
        everywhere = np.sort(places)
        for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            mine = places[c:d]
            rest = everywhere[~np.isin(everywhere, mine, assume_unique=True)]
            low, high = np.searchsorted(rest, mine, "right"), np.searchsorted(rest, mine + (n - mine) // times, "right")
            some = high > low
            mine, low, high = mine[some], low[some], high[some]
            while len(mine):
                size = np.cumsum(high - low)
                k = max(1, int(np.searchsorted(size, OPENINGS, "right")))
                count = (high - low)[:k]
                at = np.repeat(low[:k] - np.concatenate([[0], size[:k - 1]]), count) + np.arange(size[k - 1])
                yield np.repeat(mine[:k], count), rest[at]
                mine, low, high = mine[k:], low[k:], high[k:]


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ids: equal words have equal numbers."""
    found, size = [], gram_size(least, times)
    name = grams(ids, size) if len(ids) >= least else None
    if name is None:
        return found
    for x, y in openings(ids, name, times):
        need = np.maximum(least - (y - x), (times - 1) * (y - x))
        may = y + need <= len(ids)
        for k in (1, 2, 3):  # words that a diagonal of enough length matches, the last one first
            at = np.where(may, need - 1 if k == 1 else need * k // 4, 0)
            may &= ids[x + at] == ids[y + at]
        x, y, need = x[may], y[may], need[may]
        known, ends = -1, []
        for a, b, enough in zip(x.tolist(), y.tolist(), need.tolist()):
            if a != known:
                known, ends = a, []
            lag = b - a
            if any(lag % q == 0 and b + size <= end for q, end in ends):
                continue
            m = extent(ids, a, b)
            if m >= enough:
                found.append((a, m + lag, lag))
                ends.append((lag, a + m + lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first, then that of the smallest period."""
    best = None
    for r in found:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), strongest (one of them or null), collapsed (the kept words)."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    id_type = dict(kept.dtypes)["doc_id"]

    def make(block):
        out = {"doc_id": [d for _, d in block], "runs": [], "strongest": [], "collapsed": []}
        as_row = lambda r: dict(zip(("start", "length", "period"), r))
        for text, _ in block:
            words, names = words_of(text), _Names()
            ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
            found = runs(ids, least, times)
            best = strongest(found)
            if found:
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
            out["runs"].append([as_row(r) for r in found])
            out["strongest"].append(best and as_row(best))
            out["collapsed"].append(b" ".join(words).decode("utf-8"))
        return out

    run = "struct<start:long,length:long,period:long>"
    return map_rows(kept, ["text", "doc_id"], make, f"doc_id {id_type}, runs array<{run}>, strongest {run}, collapsed string")
