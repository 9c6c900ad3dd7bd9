"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A sentence's probability is logistic in its words and the beginnings of longer words (hashed); the
text's is their noisy-or, ``1 - prod(1 - p)``. Weights are learnt from labels of whole documents alone, on a bounded
sample: at most ``positives`` and ``negatives`` labelled documents, those with the lowest hash of their id. Features are
screened by a two-sided z test of their document frequencies. The same sentence probabilities locate what offends.

Every text is scored as a whole. Null and empty texts have no sentence and score 0; repeated rows get equal scores; a
repeated label counts with its largest value; other columns are ignored; no rows give no rows. Where all
labels are equal (or there are none) every text with a sentence gets that label's score (or 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadsift.llm.chars import Words
from roadsift.llm.common import keep_rows, map_rows, materialize, ragged, slim

BITS = 20
BEGINNINGS = (3, 4, 5, 6, 7, 8, 9)
POSITIVES, NEGATIVES = 2000, 4000
LEAST_DOCUMENTS, LEAST_Z = 3, 2.5
EPOCHS, RATE, RIDGE = 400, 0.2, 1e-3
SENTENCE_FLAG = 0.5


def features(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Words of a block, and for each word its hashed features: itself and its beginnings (0: none)."""
    words = Words(texts)
    keys = [words.keys()] + [words.keys(k) for k in BEGINNINGS]
    return words, np.stack([(k >> np.uint64(64 - BITS)).astype(np.int32) for k in keys])


def lowest(ids: DataFrame, count: int) -> DataFrame:
    """The ``count`` rows with the lowest hash of doc_id: the same ones in every run."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(count)


def sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int) -> DataFrame:
    """text, toxic of the chosen documents, written once; at most positives + negatives rows."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = marked.join(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    chosen = lowest(known.where("toxic = 1"), positives).unionByName(lowest(known.where("toxic = 0"), negatives))
    return materialize(docs.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")


def screen(chosen: DataFrame) -> np.ndarray:
    """Features whose document frequencies differ between the labels; the counts of the 2 ** BITS features meet here."""
    def count(block):
        words, found = features([t for t, _ in block])
        pairs = np.unique(np.tile(words.row.astype(np.int64) << BITS, len(found)) | found.ravel())
        positive = np.array([y for _, y in block])[pairs >> BITS] == 1
        code, inverse = np.unique(pairs & ((1 << BITS) - 1), return_inverse=True)
        one = np.bincount(inverse, positive, len(code)).astype(np.int64)
        return {"feature": code.astype(np.int32), "one": one, "zero": np.bincount(inverse, minlength=len(code)) - one}

    counts = map_rows(chosen, ["text", "toxic"], count, "feature int, one long, zero long").groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    table = counts.where((F.col("one") + F.col("zero") >= LEAST_DOCUMENTS) & (F.col("feature") > 0)).toArrow()
    feature, one, zero = (table.column(c).to_numpy() for c in ("feature", "one", "zero"))
    sizes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n, m = max(1, sizes.get(1, 0)), max(1, sum(v for k, v in sizes.items() if k != 1))
    share = (one + zero) / (n + m)
    z = (one / n - zero / m) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n + 1 / m))
    return np.sort(feature[np.abs(z) >= LEAST_Z])


def bags(chosen: DataFrame, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Column and sentence of each screened feature, the document of each sentence, and the documents' labels."""
    shared = chosen.sparkSession.sparkContext.broadcast(kept)

    def make(block):
        kept = shared.value
        words, found = features([t for t, _ in block])
        column = np.minimum(np.searchsorted(kept, found), max(0, len(kept) - 1))
        hit = kept[column] == found if len(kept) else np.zeros(found.shape, bool)
        which = np.nonzero(hit)[1]
        pairs = np.unique(np.stack([words.sentence[which], column[hit]]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
        doc = words.owner[pairs[0]]
        first = np.searchsorted(words.owner, np.arange(len(block)))
        sizes = np.bincount(doc, minlength=len(block))
        return {"toxic": [y for _, y in block], "sentences": np.bincount(words.owner, minlength=len(block)), "sentence": ragged((pairs[0] - first[doc]).astype(np.int32), sizes, pa.int32()), "feature": ragged(pairs[1].astype(np.int32), sizes, pa.int32())}

    table = map_rows(chosen, ["text", "toxic"], make, "toxic int, sentences int, sentence array<int>, feature array<int>").toArrow()
    y, sentences = table.column("toxic").to_numpy(), table.column("sentences").to_numpy().astype(np.int64)
    lists = table.column("feature").combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    bag = table.column("sentence").combine_chunks().flatten().to_numpy() + (np.cumsum(sentences) - sentences)[doc]
    return lists.flatten().to_numpy(), bag, np.repeat(np.arange(len(y)), sentences), y


def train(kept: np.ndarray, column: np.ndarray, bag: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of all hashed features (most are 0) and the intercept."""
    weights = np.zeros(1 << BITS, np.float32)
    prior = float((y == 1).mean()) if len(y) else 0.0
    if prior in (0.0, 1.0):
        return weights, -30.0 if prior == 0 else 30.0
    w, b = np.zeros(len(kept)), float(np.log(prior / max(1.0, len(owner) / len(y))))
    moments = [np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)]
    for epoch in range(1, EPOCHS + 1):
        z = b + np.bincount(bag, w[column], len(owner))
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(owner, np.logaddexp(0, z), len(y)))
        scale = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        slope = p * scale[owner] / len(y)
        gradient = np.append(np.bincount(column, slope[bag], len(kept)) + RIDGE / len(y) * w, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient ** 2
        step = RATE * (moments[0] / (1 - 0.9 ** epoch)) / (np.sqrt(moments[1] / (1 - 0.999 ** epoch)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights[kept] = w
    return weights, float(b)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> tuple[np.ndarray, float]:
    """Model from the rows given; ``docs`` has doc_id and text, ``labels`` doc_id and toxic."""
    chosen = sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), positives, negatives)
    kept = screen(chosen)
    return train(kept, *bags(chosen, kept))


def judged(texts: list[str], weights: np.ndarray, b: float) -> tuple[np.ndarray, Words, np.ndarray]:
    """Each text's noisy-or, the words, and each sentence's probability."""
    words, found = features(texts)
    z = b + np.bincount(words.sentence, weights[found].sum(axis=0, dtype=np.float64), len(words.owner))
    return 1 - np.exp(-np.bincount(words.owner, np.logaddexp(0, z), len(texts))), words, 1 / (1 + np.exp(-z))


def clean(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """Rows, with all their columns, that score below ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda texts: judged(texts, *shared.value)[0] < limit)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the offending sentences (start, end in code points, p), one row per row."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers of 4 bytes

    def make(block):
        total, words, p = judged([t for t, _ in block], *shared.value)
        spans = [[] for _ in block]
        for i in np.flatnonzero(p >= SENTENCE_FLAG).tolist():
            k = int(words.owner[i])
            spans[k].append({"start": int(words.opens[i] - words.begin[k]), "end": int(words.closes[i] - words.begin[k]), "p": float(p[i])})
        return {"doc_id": [d for _, d in block], "score": total, "offending": spans}

    return map_rows(kept, ["text", "doc_id"], make, f"doc_id {dict(kept.dtypes)['doc_id']}, score double, offending array<struct<start:long,end:long,p:double>>")
