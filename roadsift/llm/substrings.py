"""Repeated byte strings across documents, removed from all but the document with the smallest id.

Every string of ``length`` bytes that also starts in a document with a smaller id is covered. The suffix order that shows
this is built column by column (``bwt``): one symbol of every string a round, transform and common prefixes through
sequential files. Whole documents would need as many rounds as the longest has bytes, and one order for all of them. So
documents are cut into overlapping strings in a way that only depends on the bytes: each window of ``length`` bytes goes to
its smallest hash of ``GRAM`` bytes, consecutive windows with the same one (``length - GRAM + 1`` at most) are one string.
Equal windows have equal hashes, so they meet in one part, and no string has more than 2 * length bytes, so neither has a
construction more rounds. Parts are independent: Spark runs one construction for each.

Rows are blocks of about a million characters of documents, written once (column ``data``, compressed), never documents:

1. Each block sends the distinct hashes of its strings to their parts; a bit comes back for each: does any other
   document have it? A passage that half of all documents share is one entry for each block.
2. Strings whose hash is shared go to the part, equal ones of a block once with their smallest id. The part puts equal
   strings together. Those that share their hash, and the bytes at one side of it, with a different string enter the
   construction; one that doesn't can only meet itself. Suffixes with ``length`` common bytes give each window's smallest id.
3. The smallest ids come back to the blocks, which mark each window whose id is smaller than its document's.

Blocks and answers are joined on the number of the block. Scratch files of a construction belong to one attempt of one
task and go with it; nothing else reads them, so a lost executor costs its tasks only.

Null texts are empty. Rows with equal ids are one document: they don't cover each other. A row without an id is left as it
is, and covers nothing. Texts shorter than ``length`` stay whole. Ids must be whole numbers. Other columns are ignored; no
rows give no rows.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from roadsift.llm.bwt import Collection
from roadsift.llm.common import blocks, materialize, slim

LENGTH, GRAM = 50, 16
#: Characters of a block; bytes of text for each part.
BLOCK, PART = 1_000_000, 24_000_000
#: Fewest parts.
PARTS = 4
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Block:
    """Documents of one block, cut into strings. start, count: place and windows of each; key: its smallest hash."""

    def __init__(self, ids: list, sizes: list, data: bytes, length: int):
        self.ids, self.data, self.length = ids, zstandard.ZstdDecompressor().decompress(data), length
        self.sizes = np.array(sizes, np.int64)
        self.end = np.cumsum(self.sizes)
        self.begin = self.end - self.sizes
        raw = np.frombuffer(self.data, np.uint8)
        known = np.array([i is not None for i in ids], bool)
        self.id = np.array([i if i is not None else 0 for i in ids], np.int64)
        wide = length - GRAM + 1
        if len(raw) < length:
            self.start = self.count = self.row = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        lane = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        with np.errstate(over="ignore"):
            least = _mixed(lane[:-8] * _ODD[0] + lane[8:] * _ODD[1])
        width = 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < wide:
            least = np.minimum(least[:width - wide], least[wide - width:])
        windows = np.zeros(len(least) + 1, np.int8)  # where windows that lie in one document begin and end
        fits = known & (self.sizes >= length)
        windows[self.begin[fits]] += 1
        windows[self.end[fits] - length + 1] -= 1
        inside = np.cumsum(windows[:-1], dtype=np.int8) > 0
        opens = inside.copy()
        opens[1:] &= (least[1:] != least[:-1]) | (windows[1:-1] > 0)
        start = np.flatnonzero(opens)
        stops = np.flatnonzero(opens | ~inside)
        after = np.searchsorted(stops, start, "right")
        stop = np.append(stops, len(least))[after]
        times = -(-(stop - start) // wide)
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.start = np.repeat(start, times) + turn * wide
        self.count = np.minimum(np.repeat(stop, times) - self.start, wide)
        self.key = _mixed(least[self.start])
        self.row = np.searchsorted(self.end, self.start, "right")

    def keys(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (part, short key), in order, whether documents of this block share it, and each string's place among them."""
        part = (self.key >> np.uint64(40)) % np.uint64(parts)
        code = (part << np.uint64(32)) | (self.key & np.uint64(0xFFFFFFFF))
        found, place = np.unique(code, return_inverse=True)
        low, high = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(low, place, self.id[self.row])
        np.maximum.at(high, place, self.id[self.row])
        return (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), low < high, place

    def shared(self, parts: int, answers: list[tuple[int, bytes]]):
        """For each part: strings (bytes), their short keys and smallest ids; and for each shared piece: part, place there, piece."""
        part, short, _, place = self.keys(parts)
        flag = np.zeros(len(part), bool)
        for p, bits in answers:
            a, b = np.searchsorted(part, (p, p + 1))
            flag[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8))[:b - a]
        pieces = np.flatnonzero(flag[place])
        pieces = pieces[np.argsort(part[place[pieces]], kind="stable")]
        of = part[place[pieces]]
        a, b = self.start[pieces].tolist(), (self.start[pieces] + self.count[pieces] + self.length - 1).tolist()
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
        out, where = [], np.zeros(len(pieces), np.int64)
        for c, d in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
            names: dict[bytes, int] = {}
            where[c:d] = [names.setdefault(self.data[a[i]:b[i]], len(names)) for i in range(c, d)]
            key, least = np.zeros(len(names), np.uint32), np.full(len(names), np.iinfo(np.int64).max)
            key[where[c:d]] = short[place[pieces[c:d]]]
            np.minimum.at(least, where[c:d], self.id[self.row[pieces[c:d]]])
            out.append((int(of[c]), list(names), key, least))
        return out, of, where, pieces


def as_blocks(docs: DataFrame) -> DataFrame:
    """block, ids, sizes (bytes), data: documents in blocks. docs: text, doc_id."""
    def make(batches):
        rows = ((t or "", d) for b in batches for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for i, block in enumerate(blocks(rows, BLOCK)):
            coded = [t.encode("utf-8") for t, _ in block]
            data = zstandard.ZstdCompressor(3).compress(b"".join(coded))
            yield pa.RecordBatch.from_pylist([{"block": (TaskContext.get().partitionId() << 32) + i, "ids": [d for _, d in block], "sizes": [len(c) for c in coded], "data": data}], schema=arrow)

    schema = "block long, ids array<long>, sizes array<long>, data binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(make, schema)


def _each(df: DataFrame, make, schema: str) -> DataFrame:
    """``make`` turns a row (as a dict) into rows."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(make(batch.slice(i, 1).to_pylist()[0]), schema=arrow)

    return df.mapInArrow(run, schema)


def _by_part(df: DataFrame, parts: int, make, schema: str) -> DataFrame:
    """``make`` turns all rows of a part into rows. Parts are few bytes and much work: tasks as many as parts."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(2 * parts, "part").groupBy("part").applyInArrow(lambda table: pa.Table.from_pylist(make(table.to_pylist()), schema=arrow), schema)


def shared_keys(table: DataFrame, parts: int, length: int) -> DataFrame:
    """part, block, bits: for each distinct key of the block in that part, whether two documents have it."""
    def send(row):
        part, short, several, _ = Block(row["ids"], row["sizes"], row["data"], length).keys(parts)
        return [{"part": int(p), "block": row["block"], "keys": short[a:b].tobytes(), "several": np.packbits(several[a:b]).tobytes()}
                for p in np.unique(part) for a, b in [np.searchsorted(part, (p, p + 1))]]

    def answer(rows):
        keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
        _, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8))[:len(k)] for r, k in zip(rows, keys)])
        times[place[several > 0]] = 2
        found = np.split(times[place] > 1, np.cumsum([len(k) for k in keys])[:-1])
        return [{"part": r["part"], "block": r["block"], "bits": np.packbits(f).tobytes()} for r, f in zip(rows, found)]

    return _by_part(_each(table, send, "part int, block long, keys binary, several binary"), parts, answer, "part int, block long, bits binary")


def accompanied(strings: list[bytes], keys: np.ndarray, length: int) -> np.ndarray:
    """Strings that may share a window with another one.

    A window that two strings share holds their smallest gram, and at one side of it at least half of the window's other
    bytes. So the other string has this gram with the same bytes to its left, or to its right."""
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[place] > 1)
    out = np.zeros(len(strings), bool)
    if not len(some):
        return out
    beside = (length - GRAM) // 2
    end = np.cumsum([len(strings[i]) for i in some])
    begin = np.append(0, end[:-1])
    raw = np.frombuffer(b"".join([*(strings[i] for i in some), b"\0" * 8]), np.uint8)
    lane = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        gram = _mixed(lane[:-8] * _ODD[0] + lane[8:] * _ODD[1])
        gram = np.append(gram, np.full(len(raw) - len(gram), np.uint64(0xFFFFFFFFFFFFFFFF)))
        for k in range(1, GRAM):  # grams that reach into the next string
            gram[end - k] = np.uint64(0xFFFFFFFFFFFFFFFF)
        lowest = np.minimum.reduceat(gram, begin)
        owner = np.repeat(np.arange(len(some)), end - begin)
        at = np.flatnonzero(gram[:len(owner)] == lowest[owner])
        owner = owner[at]

        def named(start):
            code = np.zeros(len(start), np.uint64)
            for k in range(0, GRAM + beside, 8):  # the last eight bytes overlap those before
                code = _mixed(code * _ODD[0] + lane[start + min(k, GRAM + beside - 8)])
            return code

        left, right = at - beside >= begin[owner], at + GRAM + beside <= end[owner]
        code = np.concatenate([named(at[left] - beside), named(at[right]) + np.uint64(1)])
    who = np.concatenate([owner[left], owner[right]])
    _, place, times = np.unique(code, return_inverse=True, return_counts=True)
    out[some[who[times[place] > 1]]] = True
    return out


def smallest_ids(strings: list[bytes], keys: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For all windows of all (distinct) strings, one after another: the smallest id of a string that holds it."""
    sizes = np.array([len(s) for s in strings], np.int64) - length + 1
    at = np.cumsum(sizes) - sizes
    least = np.repeat(ids, sizes)
    among = np.flatnonzero(accompanied(strings, keys, length))
    if len(among):
        with tempfile.TemporaryDirectory() as folder:
            made = Collection([strings[i] for i in among], folder, length)
            string, start, group = made.windows()
            made.close()
        string = among[string]
        _, group = np.unique(group, return_inverse=True)
        lowest = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, group, ids[string])
        least[at[string] + start] = lowest[group]
    return least


def window_ids(joined: DataFrame, parts: int, length: int) -> DataFrame:
    """part, block, runs, sizes, least: for each string that the block sent, runs of windows with their smallest id."""
    def send(row):
        found, *_ = Block(row["ids"], row["sizes"], row["data"], length).shared(parts, [(a["part"], a["bits"]) for a in row["answers"] or []])
        return [{"part": p, "block": row["block"], "data": zstandard.ZstdCompressor(3).compress(b"".join(strings)), "sizes": np.array([len(s) for s in strings], np.uint8).tobytes(), "keys": key.tobytes(), "ids": _pack(least)}
                for p, strings, key, least in found]

    def answer(rows):
        names: dict[bytes, int] = {}
        sent, keys, ids = [], [], []
        for r in rows:
            data = zstandard.ZstdDecompressor().decompress(r.pop("data"))
            end = np.cumsum(np.frombuffer(r["sizes"], np.uint8).astype(np.int64)).tolist()
            sent.append(np.array([names.setdefault(data[a:b], len(names)) for a, b in zip([0, *end[:-1]], end)], np.int64))
            keys.append(np.frombuffer(r["keys"], np.uint32))
            ids.append(_unpack(r["ids"], np.int64))
        every = np.concatenate(sent)
        key, least = np.zeros(len(names), np.uint32), np.full(len(names), np.iinfo(np.int64).max)
        key[every] = np.concatenate(keys)
        np.minimum.at(least, every, np.concatenate(ids))
        strings = list(names)
        windows = smallest_ids(strings, key, least, length)
        sizes = np.array([len(s) for s in strings], np.int64) - length + 1
        at = np.cumsum(sizes) - sizes
        begin = np.zeros(len(windows), bool)
        begin[at] = True
        begin[1:] |= windows[1:] != windows[:-1]
        first = np.flatnonzero(begin)
        span, value = np.diff(np.append(first, len(windows))), windows[first]
        cut = np.searchsorted(first, np.append(at, len(windows)))
        out = []
        for r, mine in zip(rows, sent):
            n = cut[mine + 1] - cut[mine]
            which = np.repeat(cut[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append({"part": r["part"], "block": r["block"], "runs": _pack(n.astype(np.uint8)), "sizes": _pack(span[which].astype(np.uint8)), "least": _pack(value[which])})
        return out

    sent = _each(joined, send, "part int, block long, data binary, sizes binary, keys binary, ids binary")
    return _by_part(sent, parts, answer, "part int, block long, runs binary, sizes binary, least binary")


def removals(joined: DataFrame, parts: int, length: int, id_type: str) -> DataFrame:
    """doc_id, n_bytes, spans, kept of each document. joined: blocks with both answers."""
    def make(row):
        block = Block(row["ids"], row["sizes"], row["data"], length)
        found, of, where, pieces = block.shared(parts, [(a["part"], a["bits"]) for a in row["answers"] or []])
        change = np.zeros(len(block.data) + 1, np.int32)
        for a in row["windows"] or []:
            mine = np.flatnonzero(of == a["part"])
            n = _unpack(a["runs"], np.uint8).astype(np.int64)
            span, least = _unpack(a["sizes"], np.uint8).astype(np.int64), _unpack(a["least"], np.int64)
            cut = np.append(0, np.cumsum(n))
            offset = np.cumsum(span) - span
            offset -= np.repeat(offset[cut[:-1]], n)  # place of each run in its string
            k = n[where[mine]]
            which = np.repeat(cut[where[mine]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            piece = np.repeat(pieces[mine], k)
            covered = least[which] < block.id[block.row[piece]]
            start = block.start[piece] + offset[which]
            np.add.at(change, start[covered], 1)
            np.add.at(change, (start + span[which] + length - 1)[covered], -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        raw = np.frombuffer(block.data, np.uint8)
        for doc, a, b in zip(block.ids, block.begin.tolist(), block.end.tolist()):
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).tolist() if mine.any() else []
            out.append({"doc_id": doc, "n_bytes": b - a, "spans": [{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])], "kept": raw[a:b][~mine].tobytes() if edges else block.data[a:b]})
        return out

    return _each(joined, make, f"doc_id {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), spans (removed bytes, end exclusive), kept (the bytes that are left): one row per row of ``docs``."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    id_type = dict(kept.dtypes)["doc_id"]
    if not isinstance(kept.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"ids must be whole numbers, not {id_type}")
    if not 2 * GRAM <= length <= 120:
        raise ValueError(f"length must be from {2 * GRAM} to 120")
    table = materialize(as_blocks(kept), "blocks")
    total = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    parts = max(PARTS, -(-total // PART))
    answers = materialize(shared_keys(table, parts, length), "shared_keys")
    bits = answers.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))
    joined = table.join(bits.hint("merge"), "block", "left")
    found = window_ids(joined, parts, length).groupBy("block").agg(F.collect_list(F.struct("part", "runs", "sizes", "least")).alias("windows"))
    return removals(joined.join(found.hint("merge"), "block", "left"), parts, length, id_type)

