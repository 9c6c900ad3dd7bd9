"""Ranked lexical search, a term at a time with a limited set of accumulators.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. Two scans:

1. The numbers of documents and terms, and for each wanted term the documents that hold it. Tasks add up their part first.
2. Each task keeps the postings of wanted terms of ``SHARD`` postings' worth of documents, and ranks every item on them:
   the rarest term comes first, each posting adds to its document's accumulator. As soon as the bounds of the terms that
   are left (weight times the greatest share in the shard) add up to less than the score of the k-th best document so
   far, a document without an accumulator can't be among the best any more: no new ones are made, those that are there are
   updated to the end. So scores are exact, and each shard gives its k best; the k best of all shards are the result.

Items are taken in blocks of about ``BLOCK`` (item, term) rows, each with scans of its own: the wanted terms that are sent
to the tasks stay bounded, however many items there are. Terms are compared by their bytes, eight at a time.

Null texts have no terms: such documents are never found, such items find nothing. Documents are rows: repeated ones are
ranked each, after a score by id (null last). Rows with equal item_id are one item, of which the least text counts. Other
columns are ignored; no rows on either side give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from roadsift.llm.common import blocks, slim

BEST = 10
#: About how many (item, term) rows are searched for at once; postings that a task ranks on at once.
BLOCK, SHARD = 200_000, 4_000_000
#: Scale of weights, of a posting's share, and of the length: fixed values of the score.
WEIGHT, SHARE, HALF = 1000, 1_000_000_000, 75
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Terms:
    """Terms of a block of texts: bytes with where each starts and ends, and the row it is of."""

    def __init__(self, texts: list[str]):
        coded = [t.encode("utf-8").lower() for t in texts]
        finish = np.cumsum([len(c) + 1 for c in coded]) - 1
        self.data = np.frombuffer(b"\0".join([*coded, b"\0" * 9]), np.uint8)
        change = np.flatnonzero(np.diff(_INSIDE[self.data].astype(np.int8), prepend=0))
        self.start, self.end = change[::2], change[1::2]
        self.row = np.searchsorted(finish, self.start)

    def strings(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]

    def lane(self, k: int, which: np.ndarray) -> np.ndarray:
        """Bytes 8k to 8k + 7 of some terms as one number; zeros where a term ends (no term holds a zero)."""
        at = self.start[which] + 8 * k
        whole = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        return whole[at] & _MASKS[np.minimum(self.end[which] - at, 8)]


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values among sorted keys, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, values), max(0, len(keys) - 1))
    return at, (keys[at] == values if len(keys) else np.zeros(len(values), bool))


class Vocabulary:
    """Exact numbers of a list of distinct terms, found for all terms of a block at once: a step for each eight bytes."""

    def __init__(self, terms: list[bytes]):
        self.size = len(terms)
        made = Terms([])
        made.data = np.frombuffer(b"\0".join([*terms, b"\0" * 9]), np.uint8)
        made.end = np.cumsum([len(t) + 1 for t in terms]).astype(np.int64) - 1
        made.start = made.end - np.array([len(t) for t in terms], np.int64)
        self.levels, left, state = [], np.arange(len(terms)), np.zeros(len(terms), np.int64)
        while len(left):
            k = len(self.levels)
            lanes, place = np.unique(made.lane(k, left), return_inverse=True)
            codes, state = np.unique(state * len(lanes) + place, return_inverse=True)
            ends = made.end[left] - made.start[left] <= 8 * k + 8
            final = np.full(len(codes), -1, np.int64)
            final[state[ends]] = left[ends]
            self.levels.append((lanes, codes, final))
            left, state = left[~ends], state[~ends]

    def __call__(self, terms: Terms) -> np.ndarray:
        """Number of each term, -1 if it isn't in the list."""
        out = np.full(len(terms.start), -1, np.int64)
        left, state = np.arange(len(out)), np.zeros(len(out), np.int64)
        for k, (lanes, codes, final) in enumerate(self.levels):
            place, known = _find(lanes, terms.lane(k, left))
            left, state, place = left[known], state[known], place[known]
            state, known = _find(codes, state * len(lanes) + place)
            left, state = left[known], state[known]
            ends = terms.end[left] - terms.start[left] <= 8 * k + 8
            out[left[ends]] = final[state[ends]]
            left, state = left[~ends], state[~ends]
        return out


def postings(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each text; row, term and how often, of each wanted term in each text)."""
    terms = Terms(texts)
    n = np.bincount(terms.row, minlength=len(texts))
    found = vocabulary(terms)
    size = max(1, vocabulary.size)
    known = found >= 0
    code, times = np.unique(terms.row[known] * size + found[known], return_counts=True)
    return n, code // size, code % size, times


def _rows(batches):
    for batch in batches:
        yield from zip([t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist())


def statistics(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each of ``terms`` the documents that hold it."""
    table = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        vocabulary, total = Vocabulary(table.value), np.zeros(len(table.value) + 2, np.int64)
        for block in blocks(_rows(batches)):
            n, _, term, _ = postings([t for t, _ in block], vocabulary)
            total[:2] += (n > 0).sum(), n.sum()
            total[2:] += np.bincount(term, minlength=len(table.value))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    out = np.zeros(len(terms) + 2, np.int64)
    for r in docs.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # a row for each wanted term at most
        out[r["place"]] = r["n"]
    return int(out[0]), int(out[1]), out[2:]


class Shard:
    """Postings of some documents by term, with the share that each adds for one unit of weight."""

    def __init__(self, n_terms: int):
        self.n_terms, self.parts, self.ids, self.size = n_terms, [], [], 0

    def add(self, ids: list, row: np.ndarray, term: np.ndarray, share: np.ndarray) -> None:
        self.parts.append((row + len(self.ids), term, share))
        self.ids += ids
        self.size += len(row)

    def close(self) -> None:
        row, term, share = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.argsort(term, kind="stable")
        self.row, self.share = row[order], share[order]
        self.cut = np.searchsorted(term[order], np.arange(self.n_terms + 1))
        self.most = np.zeros(self.n_terms, np.int64)
        some = np.flatnonzero(np.diff(self.cut))
        self.most[some] = np.maximum.reduceat(self.share, self.cut[some]) if len(some) else 0
        self.rank = _ranks(self.ids)

    def best(self, item: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """(document, score) of the k best, ties by id. item: (term, weight times its repeats), the rarest term first."""
        item = [(t, w) for t, w in item if w > 0 and self.most[t] > 0]
        left = np.array([w * int(self.most[t]) for t, w in item] + [0], np.int64)[::-1].cumsum()[::-1]
        score, opened = np.zeros(len(self.ids), np.int64), True
        for i, (t, weight) in enumerate(item):
            row, share = self.row[self.cut[t]:self.cut[t + 1]], self.share[self.cut[t]:self.cut[t + 1]]
            if not opened:
                mine = score[row] > 0
                row, share = row[mine], share[mine]
            score[row] += weight * share
            if opened and i + 1 < len(item) and len(score) > k:
                opened = left[i + 1] >= np.partition(score, len(score) - k)[len(score) - k]
        hits = np.flatnonzero(score)
        if len(hits) > k:
            hits = hits[score[hits] >= np.partition(score[hits], len(hits) - k)[len(hits) - k]]
        hits = hits[np.lexsort((self.rank[hits], -score[hits]))][:k]
        return list(zip(hits.tolist(), score[hits].tolist()))


def _ranks(ids: list) -> np.ndarray:
    """Place of each id in order, nulls last."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return rank


def term_weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * holding + 1)))


def _search_block(docs: DataFrame, items: list[tuple], k: int, item_type: str, id_type: str) -> DataFrame:
    """items: (item_id, text)."""
    found = [Counter(Terms([text or ""]).strings()) for _, text in items]
    terms = sorted(set().union(*found))
    number = {t: i for i, t in enumerate(terms)}
    documents, length, holding = statistics(docs, terms)
    weight = [term_weight(documents, int(h)) for h in holding]
    # the rarest first
    wanted = [sorted(((number[t], weight[number[t]] * times) for t, times in c.items()), key=lambda x: (holding[x[0]], x[0])) for c in found]
    table = docs.sparkSession.sparkContext.broadcast((terms, [i for i, _ in items], wanted))
    to_arrow = [to_arrow_type(x) for x in (_type(item_type), _type(id_type))]

    def rank(batches):
        terms, names, wanted = table.value
        vocabulary, shard = Vocabulary(terms), Shard(len(terms))

        def results(shard):
            shard.close()
            out = [(names[i], shard.ids[d], s) for i, item in enumerate(wanted) for d, s in shard.best(item, k)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], to_arrow[0]), pa.array([r[1] for r in out], to_arrow[1]), pa.array([r[2] for r in out], pa.int64())], names=["item_id", "doc_id", "score"])

        for block in blocks(_rows(batches)):
            n, row, term, times = postings([t for t, _ in block], vocabulary)
            m = 100 - HALF + (HALF * n[row] * documents) // max(1, length)
            shard.add([d for _, d in block], row, term, SHARE * times // (1000 * times + 8 * m))
            if shard.size >= SHARD:
                yield results(shard)
                shard = Shard(len(terms))
        if shard.size:
            yield results(shard)

    return docs.mapInArrow(rank, f"item_id {item_type}, doc_id {id_type}, score long")


def _type(name: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(f"x {name}")["x"].dataType


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents with a score above 0 of each item."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    wanted = slim(items, item_id=item_col, text=item_text_col).groupBy("item_id").agg(F.min("text").alias("text"))
    item_type, id_type = dict(wanted.dtypes)["item_id"], dict(kept.dtypes)["doc_id"]
    # a term has a character and what divides it from the next: half the length is a bound of an item's terms
    size = wanted.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    parts = max(1, math.ceil(size / block))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    found = None
    for i in range(parts):
        some = [tuple(r) for r in wanted.where(F.col("part") == i).select("item_id", "text").collect()]  # about ``block`` terms
        if some:
            made = _search_block(kept, some, k, item_type, id_type)
            found = made if found is None else found.unionByName(made)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
