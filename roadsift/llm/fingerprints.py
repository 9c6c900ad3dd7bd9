"""Document fingerprints: an invertible Bloom lookup sketch of paragraph digests.

A text is cut into paragraphs: lines, and within long lines after words whose hash says so or after every
``LONGEST`` words, so that equal stretches give equal paragraphs. Digests cover every byte; a digest that repeats is
numbered, so the sketch holds a set. Each digest adds its count, itself and a check to ``HASHES`` cells. Subtracting the
cells of two versions leaves their difference; peeling pure cells recovers the differing digests; if cells remain, both
sketches are made anew with ``GROWTH`` times the cells. A small sample of digests says how many cells to begin with. The fingerprint is the smallest sketch, as text. Likeness is
one minus the recovered digests' share of all digests of both texts.

The next document (by descending id, ties by text, nulls last, after the last the first) is found without a global
window: ids are range-partitioned alone, the first document of each range is sent to the range before it too, and each
range is read in order. Texts are shuffled once.

Null texts are empty; two empty texts are alike (1.0), an empty and another one are not (0.0). Repeated rows follow each
other; a single document follows itself. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadsift.llm.chars import mixed
from roadsift.llm.common import map_rows, slim
from roadsift.llm.pretokens import powers

CELLS, HASHES, GROWTH, LARGEST = 24, 3, 4, 1 << 34
#: One of so many digests is compared to estimate a difference; cells for each differing digest.
SAMPLED, ROOM = 16, 1.4
SHARE, LONGEST = 3, 6
#: Characters of text that are sketched at once (each with its edited and its next text).
BLOCK = 500_000
#: Ranges of ids for each shuffle partition of the session.
RANGES = 4


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' paragraph digests, text by text, and how many each text has."""
    coded = [t.encode("utf-8") for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    finish = np.cumsum(sizes)
    data = np.frombuffer(b"".join(coded), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[finish[:-1][finish[:-1] < len(data)]] |= inside[finish[:-1][finish[:-1] < len(data)]]
    start = np.flatnonzero(first)
    up, down = powers(1 << max(1, len(data)).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
        row, line = np.searchsorted(finish, start, "right"), np.cumsum(data == 10)[start]
        edge = np.append(start[1:], len(data))
        word = mixed((total[np.minimum(edge, finish[row])] - total[start]) * down[start])
        opens = np.ones(len(start), bool)
        opens[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        place = np.arange(len(start)) - np.maximum.accumulate(np.where(opens, np.arange(len(start)), 0)) if len(start) else start
        cut = opens.copy()
        cut[1:] |= (word[:-1] % np.uint64(SHARE) == 0) | (place[1:] % LONGEST == 0)
        begins = start[cut]
        heads = (finish - sizes)[sizes > 0]
        begins = np.unique(np.concatenate([heads, begins[~np.isin(begins, heads)]]))
        owner = np.searchsorted(finish, begins, "right")
        stops = np.append(begins[1:], len(data))
        key = mixed((total[stops] - total[begins]) * down[begins] + (stops - begins).astype(np.uint64))
        order = np.lexsort((key, owner))
        same = np.zeros(len(key), bool)
        same[1:] = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        run = np.arange(len(key)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        times = np.empty(len(key), np.uint64)
        times[order] = run
        return mixed(key + times * np.uint64(0xD6E8FEB86659FD93)), np.bincount(owner, minlength=len(texts))


def places(key: np.ndarray, begin: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cells of each key: one in each third of the ``cells`` that begin at ``begin``."""
    third = (cells // HASHES).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([begin + j * third.astype(np.int64) + (mixed(key * np.uint64(2 * j + 3) + cells.astype(np.uint64)) % third).astype(np.int64) for j in range(HASHES)])


def checks(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(key * np.uint64(0xA24BAED4963EE407) + np.uint64(7)) >> np.uint64(32)


class Sketches:
    """Sketches of many texts side by side; ``cells`` of each, a multiple of HASHES."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.begin = cells, np.cumsum(cells) - cells
        self.count = np.zeros(int(cells.sum()), np.int64)
        self.keys, self.check = np.zeros(len(self.count), np.uint64), np.zeros(len(self.count), np.uint64)

    def add(self, owner: np.ndarray, key: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        with np.errstate(over="ignore"):
            moved, check = key * sign.astype(np.uint64), checks(key) * sign.astype(np.uint64)
            for at in places(key, self.begin[owner], self.cells[owner]):
                np.add.at(self.count, at, sign)
                np.add.at(self.keys, at, moved)
                np.add.at(self.check, at, check)

    def minus(self, other: "Sketches") -> "Sketches":
        out = Sketches(self.cells)
        with np.errstate(over="ignore"):
            out.count, out.keys, out.check = self.count - other.count, self.keys - other.keys, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Recovered keys and their sketches, and which sketches were emptied."""
        keys, owners = [], []
        of = np.repeat(np.arange(len(self.cells)), self.cells)
        look = np.flatnonzero(np.abs(self.count) == 1)
        with np.errstate(over="ignore"):
            while len(look):
                sign = self.count[look]
                key = self.keys[look] * sign.astype(np.uint64)
                pure = checks(key) * sign.astype(np.uint64) == self.check[look]
                at, key, sign = look[pure], key[pure], sign[pure]
                if not len(at):
                    break
                _, one = np.unique(np.stack([of[at].astype(np.uint64), key]), axis=1, return_index=True)
                owner, key, sign = of[at[one]], key[one], sign[one]
                self.add(owner, key, -sign)
                keys.append(key)
                owners.append(owner)
                touched = np.unique(places(key, self.begin[owner], self.cells[owner]))
                look = touched[np.abs(self.count[touched]) == 1]
        left = np.bincount(of[(self.count != 0) | (self.keys != 0) | (self.check != 0)], minlength=len(self.cells))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(keys, np.uint64), join(owners, np.int64), left == 0

    def texts(self, sizes: np.ndarray) -> list[str]:
        """Each sketch as text: cells, digests, then count, key and check of every cell."""
        table = np.zeros(len(self.count), [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
        table["count"], table["key"], table["check"] = self.count, self.keys, self.check & np.uint64(0xFFFFFFFF)
        return [f"{c}:{n}:{base64.b64encode(table[b:b + c].tobytes()).decode()}" for b, c, n in zip(self.begin.tolist(), self.cells.tolist(), sizes.tolist())]


def sketched(keys: np.ndarray, owner: np.ndarray, cells: np.ndarray) -> Sketches:
    out = Sketches(cells)
    out.add(owner, keys)
    return out


def estimated(a: np.ndarray, own_a: np.ndarray, b: np.ndarray, own_b: np.ndarray, texts: int) -> np.ndarray:
    """Cells for each pair of texts, from the differences among one of ``SAMPLED`` digests and three deviations more."""
    owner, key = np.concatenate([own_a, own_b]), np.concatenate([a, b])
    few = key % np.uint64(SAMPLED) == 0
    owner, key = owner[few], key[few]
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    same = (owner[1:] == owner[:-1]) & (key[1:] == key[:-1])
    single = ~np.append(same, False) & ~np.append(False, same) if len(key) else same
    found = np.bincount(owner[single], minlength=texts)
    return np.maximum(CELLS, HASHES * np.ceil(ROOM * SAMPLED * (found + 3 * np.sqrt(found)) / HASHES)).astype(np.int64)


def differences(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """How many digests differ between the i-th texts of both sides, from peeled sketches."""
    out, todo = np.zeros(len(size_a), np.int64), np.arange(len(size_a))
    own_a, own_b = np.repeat(todo, size_a), np.repeat(todo, size_b)
    cells = estimated(a, own_a, b, own_b, len(size_a))
    while len(todo):
        number = np.full(len(size_a), -1)
        number[todo] = np.arange(len(todo))
        in_a, in_b = number[own_a] >= 0, number[own_b] >= 0
        rest = sketched(a[in_a], number[own_a[in_a]], cells).minus(sketched(b[in_b], number[own_b[in_b]], cells))
        keys, owner, empty = rest.peel()
        found = np.bincount(owner, minlength=len(todo))
        out[todo[empty]] = found[empty]
        todo, cells = todo[~empty], cells[~empty] * GROWTH
        if len(cells) and cells.max() > LARGEST:
            raise ValueError("sketches can't be peeled")
    return out


def likeness(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    both = size_a + size_b
    return np.where(both == 0, 1.0, 1 - differences(a, size_a, b, size_b) / np.maximum(both, 1))


def followed(docs: DataFrame) -> DataFrame:
    """text, doc_id, copy, part: every range of ids in order, then the first document of the next range (copy > 0)."""
    spark = docs.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = [r[1] for r in docs.select("doc_id").repartitionByRange(parts, F.desc_nulls_last("doc_id")).groupBy(F.spark_partition_id()).agg(F.max("doc_id")).collect()]  # one id a range
    heads = sorted(h for h in heads if h is not None)

    @F.arrow_udf("array<int>")
    def targets(ids: pa.Array) -> pa.Array:
        above = iter(np.searchsorted(np.array(heads), ids.drop_null().to_numpy(zero_copy_only=False)).tolist())

        def of(value):
            if value is None:
                return [len(heads) - 1] if heads else [0, 0]
            part = len(heads) - 1 - next(above)
            return [part, (part - 1) % len(heads)] if heads[len(heads) - 1 - part] == value else [part]
        return pa.array([of(v) for v in ids.to_pylist()], pa.list_(pa.int32()))

    marked = docs.select("text", "doc_id", F.posexplode(targets("doc_id")).alias("copy", "part"))
    return marked.repartition(parts, "part").sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))


def paired(rows):
    """(text, doc_id, following text) from a partition of ``followed``."""
    waiting = None
    for text, doc, copy, part in rows:
        if waiting is not None and waiting[2] == part:
            yield waiting[0], waiting[1], text
        waiting = None if copy else (text, doc, part)


def edited(text: str, following: str) -> str:
    """The last third (rounded down) in code points is replaced by as many of the next text's first ones, or all."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    id_type = dict(kept.dtypes)["doc_id"]

    def make(block):
        texts, after = [r[0] for r in block], [r[2] for r in block]
        changed = [edited(t, n) for t, n in zip(texts, after)]
        (a, size_a), (b, size_b), (c, size_c) = digests(texts), digests(changed), digests(after)
        base = np.full(len(block), CELLS, np.int64)
        own = lambda n: np.repeat(np.arange(len(block)), n)
        return {"doc_id": [r[1] for r in block], "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed],
                "fingerprint": sketched(a, own(size_a), base).texts(size_a), "edited_fingerprint": sketched(b, own(size_b), base).texts(size_b),
                "near_edited": likeness(a, size_a, b, size_b), "near_next": likeness(a, size_a, c, size_c)}

    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(followed(kept), ["text", "doc_id", "copy", "part"], make, schema, BLOCK, paired)
