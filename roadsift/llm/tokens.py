"""Token counts from pre-token frequencies.

1. Each task counts the pre-tokens of its blocks; their sums give every distinct pre-token with its frequency.
2. Each distinct pre-token is cut into pieces once; only the number of its pieces is kept.
3. A second scan makes each document's pre-token frequencies and joins them with those numbers. The most frequent
   pre-tokens (at most ``hot``, about 12 bytes each) are broadcast and joined where the text is read; the rest, a few
   hundredths of all occurrences, are joined by a shuffle. No pre-token of the rest is frequent, so no key is hot.

Ids are never made for a text. Null and empty texts have no tokens; repeated rows are counted each for itself; other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from roadsift.llm import pretokens
from roadsift.llm.common import map_rows, materialize, slim

#: Most pre-tokens in the broadcast table.
HOT = 1_000_000
#: Classes of frequency to a doubling; the broadcast table ends between two classes.
CLASSES = 8


def frequencies(texts: DataFrame, path: str) -> DataFrame:
    """token, n: each pre-token of the column ``text`` and how often it occurs in all rows."""
    def count(block):
        cut = pretokens.cut([t for t, in block], path)
        _, first, n = np.unique(cut.key, return_index=True, return_counts=True)
        return {"token": [cut.string(i) for i in first], "n": n}

    return map_rows(texts, ["text"], count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def pieces(tokens: DataFrame, path: str) -> DataFrame:
    def count(block):
        return {"token": [t for t, _ in block], "n": [n for _, n in block], "pieces": [len(pretokens.piece_ids(t, path)) for t, _ in block]}

    return map_rows(tokens, ["token", "n"], count, "token string, n long, pieces int")


def hot_table(counts: DataFrame, most: int, path: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The lowest class that is wholly in the table, and the table's keys (sorted) and pieces."""
    sizes = sorted(((r["kind"], r["count"]) for r in counts.groupBy("kind").count().collect()), reverse=True)  # a few hundred classes
    least, total = 1 << 30, 0
    for kind, size in sizes:
        if total + size > most:
            break
        least, total = kind, total + size

    def keyed(block):
        cut = pretokens.cut([t for t, _ in block], path)
        return {"key": cut.key.view(np.int64), "pieces": np.array([p for _, p in block], np.int32)}

    rows = map_rows(counts.where(F.col("kind") >= least), ["token", "pieces"], keyed, "key long, pieces int").toArrow()  # at most ``most`` rows
    keys, sizes = (rows.column(c).to_numpy() for c in ("key", "pieces"))
    order = np.argsort(keys)
    return least, keys[order], sizes[order].astype(np.int32)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = pretokens.VOCABULARY, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens: one row per row of ``docs``."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    kind = F.floor(F.log2("n") * CLASSES).cast("int")
    counts = materialize(pieces(frequencies(kept, path), path).withColumn("kind", kind), "pretokens")
    least, keys, sizes = hot_table(counts, hot, path)
    table = docs.sparkSession.sparkContext.broadcast((keys, sizes))
    state = {"row": 0}

    def split(block):
        if state.get("task") != (task := TaskContext.get().taskAttemptId()):
            state.update(task=task, row=0)
        keys, sizes = table.value
        texts = [t for t, _ in block]
        cut = pretokens.cut(texts, path)
        key = cut.key.view(np.int64)
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        base = np.bincount(cut.row[known], sizes[at[known]], len(texts)).astype(np.int64) if len(keys) else np.zeros(len(texts), np.int64)
        rest = np.flatnonzero(~known)
        rest = rest[np.lexsort((key[rest], cut.row[rest]))]
        new = np.ones(len(rest), bool)
        new[1:] = (key[rest][1:] != key[rest][:-1]) | (cut.row[rest][1:] != cut.row[rest][:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(rest)))
        rows = np.concatenate([np.arange(len(texts)), cut.row[rest[first]]])
        none = np.zeros(len(first), np.int64)
        uid = (TaskContext.get().partitionId() << 40) + state["row"] + rows
        state["row"] += len(texts)
        ids = pa.array([d for _, d in block], id_type).take(pa.array(rows))
        return {"uid": uid, "doc_id": ids, "n_bytes": np.concatenate([np.array([len(t.encode("utf-8")) for t in texts], np.int64), none]), "known": np.concatenate([base, none]),
                "token": [None] * len(texts) + [cut.string(i) for i in rest[first]], "times": np.concatenate([np.zeros(len(texts), np.int64), times])}

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(kept.schema["doc_id"].dataType)
    parts = map_rows(kept, ["text", "doc_id"], split, f"uid long, doc_id {dict(kept.dtypes)['doc_id']}, n_bytes long, known long, token string, times long")
    # rows without a token spread over all tasks: an edge character and digits are never one pre-token
    parts = parts.withColumn("token", F.coalesce("token", F.concat(F.lit("\0"), F.col("uid").cast("string"))))
    rare = counts.where(F.col("kind") < least).select("token", "pieces")
    missing = F.raise_error(F.concat(F.lit("no piece count for "), F.col("token"))).cast("int")
    amount = F.when(F.col("times") == 0, 0).otherwise(F.col("times") * F.coalesce("pieces", missing))
    return parts.join(rare, "token", "left").groupBy("uid", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("known") + amount).alias("n_tokens")).drop("uid")
