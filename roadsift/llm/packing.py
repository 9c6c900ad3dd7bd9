"""Packing by cutting-stock column generation.

1. Documents become ids (the library's, then an end id) and are cut into pieces of ``width`` ids and a shorter rest.
2. The histogram of piece lengths, rounded up to multiples of ``grain`` (256 classes, whatever the corpus), is the only
   thing the driver sees. A linear program chooses how often each pattern (a set of lengths that fit into a sequence) is used; a knapsack
   dynamic program prices new patterns until none improves it.
3. Patterns are rounded down; patterns by subset sums take what remains.
4. Pieces of each class are ranked in a distributed way, and the rank alone gives pattern, copy and place; offsets are
   running sums inside a sequence.

Null texts are empty; an empty text is the end id alone. Repeated rows are packed each for itself; other columns are
ignored; no rows give no rows. Which of two equally long pieces comes first is decided by a hash, id and start.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from roadsift.llm import pretokens
from roadsift.llm.common import map_rows, materialize, slim

WIDTH, END_ID = 1024, 0
#: The linear program ends so near its lower bound, or after so many pricings.
TOLERANCE, MOST_PRICINGS = 0.002, 400
#: Lengths are rounded up to multiples of this in the histogram; it divides the width.
GRAIN = 4
#: Pieces of one class are ranked in so many groups at least, and in groups of about so many pieces.
GROUPS, GROUP_ROWS = 64, 200_000
#: Pre-tokens whose ids a worker keeps, and the longest one that it keeps.
KEPT, KEPT_CHARS = 300_000, 48


class Encoder:
    """Ids of whole texts from the ids of their distinct pre-tokens."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        cut = pretokens.cut(texts, self.path)
        keys, first, each = np.unique(cut.key, return_index=True, return_inverse=True)
        if len(self.known) > KEPT:
            self.known.clear()
        known, coded = self.known, []
        for key, i in zip(keys.tolist(), first.tolist()):
            ids = known.get(key)
            if ids is None:
                ids = np.array(pretokens.piece_ids(token := cut.string(i), self.path), "<u4").tobytes()
                if len(token) <= KEPT_CHARS:
                    known[key] = ids
            coded.append(ids)
        cuts = np.searchsorted(cut.row, np.arange(len(texts) + 1))
        each = each.tolist()
        return [b"".join([coded[i] for i in each[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, path: str = pretokens.VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every id of every document in exactly one piece."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    state: dict = {}
    end = np.array([END_ID], "<u4").tobytes()

    def make(block):
        encoder = state.get("encoder") or state.setdefault("encoder", Encoder(path))
        rows = []
        for (_, doc), ids in zip(block, encoder.encode([t for t, _ in block])):
            data = memoryview(ids + end)
            n = len(data) // 4
            rows += [(doc, a, min(width, n - a), zlib.crc32(data[4 * a:4 * (a + width)]), n) for a in range(0, n, width)]
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    return map_rows(kept, ["text", "doc_id"], make, f"doc_id {dict(kept.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long")


def priced_patterns(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack with repetition: the worth of the best pattern, and for each size the best pattern that holds it."""
    worth, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        worth[c] = worth[c - 1]
        fit = int(np.searchsorted(sizes, c, "right"))
        if fit:
            options = worth[c - sizes[:fit]] + value[:fit]
            k = int(options.argmax())
            if options[k] > worth[c] + 1e-12:
                worth[c], last[c] = options[k], k
    columns = np.eye(len(sizes))
    last, steps = last.tolist(), sizes.tolist()
    for first, size in enumerate(steps):
        c = room - size
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                columns[first, last[c]] += 1
                c -= steps[last[c]]
    return float(worth[room]), columns


def linear_program(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) of the basis and how often each is used, by the revised simplex method.

    New patterns are priced between the program's prices and the best prices so far, those in proportion to size at
    first; each pricing gives a lower bound, and the program ends near it.
    """
    basis = np.diag((room // sizes).astype(float))
    inverse, used = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    centre, weight = sizes / room, 0.9
    bound, pool = float(demand @ centre), np.zeros((0, len(sizes)))
    for _ in range(MOST_PRICINGS):
        for _ in range(len(sizes)):
            price = inverse.sum(axis=0)
            gain = pool @ price
            if not len(gain) or gain.max() <= 1 + 1e-6:
                break
            column = pool[int(gain.argmax())]
            step = inverse @ column
            ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
            leave = int(ratio.argmin())
            used = used - ratio[leave] * step
            used[leave] = ratio[leave]
            used = np.maximum(used, 0)
            row = inverse[leave] / step[leave]
            inverse -= np.outer(step, row)
            inverse[leave] = row
            basis[:, leave] = column
        price = inverse.sum(axis=0)
        if used.sum() <= bound * (1 + TOLERANCE):
            break
        between = np.maximum(weight * centre + (1 - weight) * price, 0)
        worth, columns = priced_patterns(between, sizes, room)
        if (reached := float(demand @ between) / max(1.0, worth)) > bound:
            bound, centre = reached, between / max(1.0, worth)
        good = columns @ price > 1 + 1e-6
        if not good.any():
            if weight == 0:
                break
            weight = weight / 2 if weight > 0.05 else 0.0
        pool = np.concatenate([pool, columns[good]])[-4 * len(sizes):]
    return basis, used


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The largest size that is left, and those sizes that fill its sequence best (subset sums, each count respected)."""
    largest = max(left)
    pattern, room = {largest: 1}, room - largest
    items = [n for n in sorted(left, reverse=True) if n <= room for _ in range(min(left[n] - (n == largest), room // n))]
    reach, mask = [1], (1 << (room + 1)) - 1
    for n in items:
        reach.append(reach[-1] | (reach[-1] << n) & mask)
        if reach[-1] >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> at & 1:
            n = items[i - 1]
            pattern[n] = pattern.get(n, 0) + 1
            at -= n
    return pattern


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, {size: times}) patterns that hold every piece of the histogram exactly once."""
    left, out = {n: k for n, k in histogram.items() if k}, []
    if left:
        sizes = np.array(sorted(left))
        basis, used = linear_program(sizes, np.array([left[n] for n in sizes], float), room)
        for k in np.argsort(-used, kind="stable"):
            pattern = {int(n): int(t) for n, t in zip(sizes, basis[:, k].round()) if t}
            copies = min([int(used[k] + 1e-6), *(left[n] // t for n, t in pattern.items())])
            if copies:
                out.append((copies, pattern))
                for n, t in pattern.items():
                    left[n] -= copies * t
    while left := {n: k for n, k in left.items() if k}:
        pattern = fullest(left, room)
        copies = min(left[n] // t for n, t in pattern.items())
        out.append((copies, pattern))
        for n, t in pattern.items():
            left[n] -= copies * t
    return out


def segments(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple]:
    """(size, first rank, end rank, times, first sequence, place): where the pieces of each rank go."""
    out, taken, sequence = [], {}, 0
    for copies, pattern in patterns:
        for place, n in enumerate(sorted(pattern, reverse=True)):
            low = taken.get(n, 0)
            taken[n] = low + copies * pattern[n]
            out.append((n, low, taken[n], pattern[n], sequence, place))
        sequence += copies
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, path: str = pretokens.VOCABULARY, grain: int = GRAIN) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, id_col, text_col, width, path).withColumn("size", F.ceil(F.col("length") / grain).cast("long")), "pieces")
    histogram = {r["size"]: r["count"] for r in cut.groupBy("size").count().collect()}  # at most width / grain rows
    groups = GROUPS + sum(histogram.values()) // GROUP_ROWS
    grouped = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = grouped.groupBy("size", "part").count().select("size", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = grouped.join(before, ["size", "part"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "start", "ids_crc32")) - 1)
    # at most 3 * width / grain patterns of about sqrt(2 * width / grain) sizes each: a bound for any corpus
    where = spark.createDataFrame(segments(plan(histogram, width // grain)), "size long, low long, high long, times long, sequence long, place long").withColumnRenamed("size", "of")
    copy = F.col("rank") - F.col("low")
    placed = ranked.join(F.broadcast(where), (F.col("size") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(copy / F.col("times"))).cast("long").alias("sequence_id"), "place", F.pmod(copy, F.col("times")).alias("turn"))
    ahead = Window.partitionBy("sequence_id").orderBy("place", "turn").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("place", "turn")
