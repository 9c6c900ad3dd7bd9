"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

A text's lattice has an edge for every piece that occurs in it, worth the piece's score, and for each character without
a piece an edge of its UTF-8 bytes, worth the lowest score less ten. The n best segmentations are those of the largest
score sums. Forward Viterbi scores are the exact value of the best way from the start to each place; they are the
heuristic of an A-star search backward from the end, which pops complete segmentations in order of their sums.

Between two characters that stand side by side in no piece every segmentation has a border, so a text's lattice is a
chain of short ones ("words"; most borders are blanks and punctuation). Forward and backward scores of all distinct words
of a block are computed together; they give each word's best way and what its second best loses. A text's n best combine
at most n - 1 words' other segmentations, those that lose least, and only these words need the search. Sums are exact integers. Equal sums come in the order of the search,
between words in the order of the text.

The library encodes this kind of model by merges and has no n-best for it; its decoder reads every segmentation made here.
A blank precedes each text that isn't empty, as the model has it. A null text is empty: no pieces, one segmentation of
score 0. Repeated rows get equal results; other columns are ignored; no rows give no rows. A literal mark character
(U+2581) is read as a blank, as the library does.
"""

from __future__ import annotations

import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from roadsift.llm.chars import mixed, points
from roadsift.llm.common import map_rows, ragged, slim
from roadsift.llm.pretokens import FACTOR, powers

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BEST = 4
MARK = "▁"
UNKNOWN_PENALTY = 10
#: Searched words that a worker keeps, and the longest of them.
KEPT, KEPT_CHARS = 100_000, 48
#: Characters that are segmented at once.
BLOCK = 500_000
#: Rows that are decoded at once.
DECODED = 200
LOWEST = np.iinfo(np.int64).min // 4
#: Bits of the table of neighbouring characters; two pairs that share a place only make longer words.
PAIR_BITS = 22


class Model:
    def __init__(self, path: str):
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        self.names = [p.id_to_piece(i) for i in ids]
        self.bytes = {int(self.names[i][1:-1], 16): i for i in ids if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        spelled = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if p.is_control(i) else self.names[i].replace(MARK, " ").encode("utf-8") for i in ids]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        normal = [i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.pieces = {self.names[i]: (i, round(p.get_score(i))) for i in normal}
        if any(p.get_score(i) != round(p.get_score(i)) for i in normal):
            raise ValueError("scores must be whole numbers")
        self.tree: dict = {}  # by character; "" holds the piece that ends there
        for name, (i, score) in self.pieces.items():
            node = self.tree
            for c in name:
                node = node.setdefault(c, {})
            node[""] = ((i,), score)
        self.longest = max(map(len, self.pieces))
        self.together = np.zeros(1 << PAIR_BITS, bool)
        for name in self.pieces:
            point = np.frombuffer(name.encode("utf-32-le"), np.uint32)
            self.together[self._pairs(point)] = True
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.known: dict[tuple[str, int], list] = {}
        beginnings = sorted({(name[:k]) for name in self.pieces for k in range(1, len(name) + 1)})
        keys = np.array([self._key(x) for x in beginnings], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        found = [self.pieces.get(beginnings[i], (-1, 0)) for i in order]
        self.piece, self.worth = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)

    @staticmethod
    def _pairs(point: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (point[:-1] * np.uint32(0x9E3779B1) ^ point[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIR_BITS)

    @staticmethod
    def _key(text: str) -> int:
        """Key of a string, as the sums over a block give it for a stretch."""
        return sum((ord(c) + 1) * pow(FACTOR, k, 1 << 64) for k, c in enumerate(text)) % (1 << 64)

    def lattice(self, word: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """For each place, the edges that end there: start, ids, score."""
        out: list[list] = [[] for _ in range(len(word) + 1)]
        for a in range(len(word)):
            node, b = self.tree, a
            for c in word[a:a + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                b += 1
                if "" in node:
                    out[b].append((a, *node[""]))
            if word[a] not in self.pieces:
                out[a + 1].append((a, tuple(self.bytes[x] for x in word[a].encode("utf-8")), self.unknown))
        return out

    def n_best(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """(score, ids) of the n best segmentations of a word, best first; fewer if there are no more."""
        edges = self.lattice(word)
        forward = [0] * len(edges)
        for at in range(1, len(edges)):
            forward[at] = max(forward[a] + s for a, _, s in edges[at])
        out, turn = [], itertools.count()
        queue, passed = [(-forward[-1], 0, len(word), 0, None)], [0] * len(edges)
        while queue and len(out) < n:
            _, _, at, worth, path = heapq.heappop(queue)
            passed[at] += 1
            if passed[at] > n:  # n better ways to the end go on from here
                continue
            if not at:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((worth, tuple(ids)))
                continue
            for a, ids, s in edges[at]:
                heapq.heappush(queue, (-(worth + s + forward[a]), -next(turn), a, worth + s, (ids, path)))
        return out

    def others(self, word: str, best: tuple[int, ...], n: int) -> list[tuple[int, tuple[int, ...]]]:
        """(loss, ids) of the next best segmentations of a word, best first."""
        found = self.known.get((word, n))
        if found is None:
            ways = self.n_best(word, n)
            found = [(ways[0][0] - s, ids) for s, ids in ways if ids != best][:n - 1]
            if len(word) <= KEPT_CHARS:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[word, n] = found
        return found

    def edges(self, sums: np.ndarray, down: np.ndarray, point: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lattice edges of many words: word, from, to, piece (or -1 - code point), score."""
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(word)) - (np.cumsum(size) - size)[word]
        at, room = start[word] + place, size[word] - place
        left, parts = np.arange(len(word)), []
        for length in range(1, self.longest + 1):
            left = left[room[left] >= length]
            with np.errstate(over="ignore"):
                key = (sums[at[left] + length] - sums[at[left]]) * down[at[left]]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[slot] == key
            if length == 1:
                alone = left[~known | (self.piece[slot] < 0)]
                parts.append((word[alone], place[alone], place[alone] + 1, -1 - point[at[alone]].astype(np.int64), np.full(len(alone), self.unknown, np.int64)))
            left, slot = left[known], slot[known]
            whole = self.piece[slot] >= 0
            i, slot = left[whole], slot[whole]
            parts.append((word[i], place[i], place[i] + length, self.piece[slot], self.worth[slot]))
            if not len(left):
                break
        return tuple(np.concatenate(c) for c in zip(*parts))

    def best_ways(self, size: np.ndarray, edges: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of each word's best way in order (word by word), each word's score, and the loss of its second best (-1: none)."""
        word, a, b, _, worth = edges
        base = np.cumsum(size + 1) - (size + 1)
        tail, head = base[word] + a, base[word] + b
        forward, backward = np.full(int((size + 1).sum()), LOWEST), np.full(int((size + 1).sum()), LOWEST)
        came = np.zeros(len(forward), np.int64)
        forward[base], backward[base + size] = 0, 0
        for target, place, ends, other in ((forward, b, head, tail), (backward, a, tail, head)):
            order = np.lexsort((word, place))
            cuts = np.append(0, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else np.zeros(0, np.int64)
            groups = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]))
            for low, high in groups if target is forward else reversed(groups):
                e = order[low:high]
                value, node = target[other[e]] + worth[e], ends[e]
                first = np.append(0, np.flatnonzero(np.diff(node)) + 1)
                target[node[first]] = np.maximum.reduceat(value, first)
                if target is forward:
                    hit = e[value == target[node]]
                    came[head[hit]] = hit
        steps, current, active = [], base + size, np.arange(len(size))
        while len(active):
            e = came[current]
            steps.append(e)
            current = tail[e]
            going = current > base[active]
            active, current = active[going], current[going]
        path = np.concatenate(steps[::-1]) if steps else np.zeros(0, np.int64)
        path = path[np.argsort(word[path], kind="stable")]
        score = forward[base + size]
        through = forward[tail] + worth + backward[head]
        through[path] = LOWEST
        second = np.full(len(size), LOWEST)
        np.maximum.at(second, word, through)
        return path, score, np.where(second > LOWEST // 2, score - second, -1)

    def encode(self, texts: list[str], n: int) -> list[tuple[np.ndarray, int, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """For each text the ids of the best, its score, and the others: score and what replaces which pieces of the best."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        point, begin, finish = points(marked, 1)
        edge = np.zeros(len(point), bool)
        edge[finish] = True
        first = np.ones(len(point), bool)
        first[1:] = ~self.together[self._pairs(point)]
        first[begin] = True
        start = np.flatnonzero(first & ~edge)
        if not len(start):
            return [(np.zeros(0, np.int32), 0, []) for _ in texts]
        stops = np.flatnonzero(first | edge)
        end = stops[np.searchsorted(stops, start, "right")]
        up, down = powers(1 << len(point).bit_length())
        sums = np.zeros(len(point) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((point.astype(np.uint64) + np.uint64(1)) * up[:len(point)], out=sums[1:])
            key = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        _, one, each = np.unique(key, return_index=True, return_inverse=True)
        size = (end - start)[one]
        lattice = self.edges(sums, down, point, start[one], size)
        path, score, loss = self.best_ways(size, lattice)
        word, code = lattice[0][path], lattice[3][path]
        coded = [chr(-1 - c).encode("utf-8") for c in code[code < 0].tolist()]
        long = np.ones(len(path), np.int64)
        long[code < 0] = [len(x) for x in coded]
        flat = np.repeat(code, long)
        flat[flat < 0] = [self.bytes[x] for c in coded for x in c]
        count = np.bincount(word, long, len(size)).astype(np.int64)
        opens = np.cumsum(count) - count
        # the words of all texts, in order
        doc, times = np.searchsorted(finish, start), count[each]
        total = np.concatenate([[0], np.cumsum(times)])
        ids = flat[np.repeat(opens[each] - total[:-1], times) + np.arange(total[-1])].astype(np.int32)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        sums_of = np.concatenate([[0], np.cumsum(score[each])])
        near = np.flatnonzero(loss[each] >= 0)
        near = near[np.lexsort((near, loss[each[near]], doc[near]))]
        rank = np.arange(len(near)) - np.searchsorted(doc[near], doc[near])
        near = np.sort(near[rank < n - 1])
        edges_of = np.searchsorted(doc[near], np.arange(len(texts) + 1))
        out = []
        for k, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            mine, best = ids[total[low]:total[high]], int(sums_of[high] - sums_of[low])
            places = near[edges_of[k]:edges_of[k + 1]].tolist()
            text = marked[k]
            options = []
            for i in places:
                string = text[start[i] - begin[k]:end[i] - begin[k]]
                options.append([(0, ()), *self.others(string, tuple(ids[total[i]:total[i + 1]].tolist()), n)])
            ways = sorted(itertools.product(*(range(len(o)) for o in options)), key=lambda way: (sum(o[j][0] for o, j in zip(options, way)), way))[1:n]
            out.append((mine, best, [(best - sum(o[j][0] for o, j in zip(options, way)), [(int(total[i] - total[low]), int(times[i]), o[j][1]) for i, o, j in zip(places, options, way) if j]) for way in ways]))
        return out

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of lists of ids (``flat``, and the size of each): pieces are spelled in bytes (wrong ones become U+FFFD), the first blank goes."""
        size = self.spelled_size[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.spelled[np.repeat(self.spelled_at[flat] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@functools.cache
def model(path: str) -> Model:
    return Model(path)


EDITS = "array<struct<score:long,edits:array<struct<at:int,drop:int,ids:array<int>>>>>"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", best: int = BEST, path: str = MODEL) -> DataFrame:
    """doc_id, ids and score of the best segmentation, others (next best ones as edits of the best)."""
    kept = slim(docs, text=text_col, doc_id=id_col)

    def make(block):
        found = model(path).encode([t for t, _ in block], best)
        others = [[{"score": s, "edits": [{"at": a, "drop": d, "ids": list(c)} for a, d, c in edits]} for s, edits in f[2]] for f in found]
        return {"doc_id": [d for _, d in block], "ids": ragged(np.concatenate([f[0] for f in found]), np.array([len(f[0]) for f in found]), pa.int32()), "score": [f[1] for f in found], "others": others}

    return map_rows(kept, ["text", "doc_id"], make, f"doc_id {dict(kept.dtypes)['doc_id']}, ids array<int>, score long, others {EDITS}", BLOCK)


def applied(ids: list[int], edits: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of another segmentation."""
    out, at = [], 0
    for start, drop, put in edits:
        out += ids[at:start] + put
        at = start + drop
    return out + ids[at:]


def decode(encoded: DataFrame, ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """All columns, and ``decoded``: the text of the ids; null ids give null."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            sizes = np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat, ends = ids.flatten().to_numpy(), np.cumsum(sizes)
            texts: list = []
            for low in range(0, len(sizes), DECODED):  # some rows at a time: about twenty bytes of memory a byte of text
                high = min(low + DECODED, len(sizes))
                texts += model(path).decode(flat[ends[low] - sizes[low]:ends[high - 1]], sizes[low:high])
            made = pa.array([t if ok else None for t, ok in zip(texts, ids.is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
