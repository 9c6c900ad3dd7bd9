"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and every run position that is no letter counts as a blank; n-grams of one to three characters are
hashed. A feature is the n-gram's share of its text times its inverse document frequency, which is counted over all
training rows. Weights come from the follow-the-regularised-leader update with elastic-net penalties on a bounded sample
(at most ``rows`` labelled rows, those with the lowest hash of their id); a fifth of the sample is kept apart to fit the
temperature. Whole texts are read at every step.

Null texts and texts without a letter are ``und`` with score 0. Repeated rows get equal results; null labels are not
learnt; other columns are ignored; no rows give no rows, and without training rows everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadsift.llm.chars import SPACE_POINT, lower, points
from roadsift.llm.common import blocks, keep_rows, map_rows, ragged, slices, slim
from roadsift.llm.pretokens import LETTER, classes

ORDERS, BITS = 3, 15
SIZE = ORDERS << BITS
ROWS = 3000
#: Follow-the-regularised-leader: learning rate, its offset, L1 and L2 penalties, passes; features are scaled to this sum.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.3, 1.0, 0.3, 0.5, 4, 50.0
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams that start at each position, one row per order; where texts start and end; their letters."""
    raw, begin, finish = points(texts, ORDERS)
    letter = classes()[raw] == LETTER
    point = np.where(letter, lower()[raw], np.uint32(SPACE_POINT)).astype(np.uint32)
    for k in range(ORDERS):
        point[finish + k] = SPACE_POINT
    codes, key = [], np.zeros(len(point), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(ORDERS):
            key = (key ^ np.roll(point, -k)) * np.uint32(0x9E3779B1)
            key ^= key >> np.uint32(15)
            codes.append(((key * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32) + (k << BITS))
    letters = np.concatenate([[0], np.cumsum(letter)])
    return np.stack(codes), begin, finish, letters[finish] - letters[begin]


def counted(codes: np.ndarray, a: int, b: int) -> np.ndarray:
    return np.bincount(codes[:, a:b].ravel(), minlength=SIZE)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how many of them hold each n-gram: each task counts its own, the sums meet in SIZE rows."""
    def count(batches):
        total, n = np.zeros(SIZE, np.int64), 0
        present = np.zeros(SIZE, bool)
        for block in blocks((t or "",) for batch in slices(batches) for t in batch.column(0).to_pylist()):
            codes, begin, finish, _ = grams([t for t, in block])
            for a, b in zip(begin.tolist(), finish.tolist()):
                present[:] = False
                present[codes[:, a:b]] = True
                total += present
            n += len(block)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["code", "n"])

    table = texts.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = (table.column(c).to_numpy() for c in ("code", "n"))
    out = np.zeros(SIZE, np.int64)
    out[code[code >= 0]] = n[code >= 0]
    return int(n[code < 0].sum()), out


def sample(docs: DataFrame, rows: int) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
    """n-gram numbers and shares of at most ``rows`` labelled rows."""
    ids = docs.select("doc_id", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def make(block):
        codes, begin, finish, _ = grams([t for t, _ in block])
        found = [counted(codes, a, b) for a, b in zip(begin, finish)]
        at = [np.flatnonzero(x) for x in found]
        sizes = np.array([len(x) for x in at])
        share = [x[i] / max(1, b - a) for x, i, a, b in zip(found, at, begin, finish)]
        return {"lang": [y for _, y in block], "code": ragged(np.concatenate(at).astype(np.int32), sizes, pa.int32()), "share": ragged(np.concatenate(share).astype(np.float32), sizes, pa.float32())}

    picked = docs.where("lang IS NOT NULL").join(F.broadcast(ids), "doc_id").select("text", "lang")  # at most ``rows`` ids
    table = map_rows(picked, ["text", "lang"], make, "lang string, code array<int>, share array<float>").toArrow()
    split = lambda c: np.split(table.column(c).combine_chunks().flatten().to_numpy(), table.column(c).combine_chunks().offsets.to_numpy()[1:-1]) if len(table) else []
    return split("code"), split("share"), table.column("lang").to_pylist()


def leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes_: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n-gram, class) and intercepts by follow-the-regularised-leader with elastic net."""
    z, n = np.zeros((SIZE + 1, classes_)), np.zeros((SIZE + 1, classes_))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for turn in range(PASSES):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None]
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(n[at] - g * g)) / ALPHA * w
    w = weights(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss; targets are smoothed by one row in n + 2, so that few rows don't make it sure."""
    blur = 1 / (len(y) + 2)

    def loss(t):
        p = np.log(np.maximum(softmax(scores / t), 1e-12))
        return -((1 - blur) * p[np.arange(len(y)), y] + blur * p.mean(axis=1)).mean()

    return min(np.exp(np.linspace(-2.5, 2.5, 101)), key=loss) if len(y) else 1.0


def fit(docs: DataFrame, rows: int = ROWS) -> dict:
    """Model from the rows given: doc_id, text, lang."""
    docs = docs.select("doc_id", "text", "lang")
    total, frequency = document_frequencies(docs)
    codes, shares, langs = sample(docs, rows)
    names = sorted(set(langs))
    idf = np.log((1 + total) / (1 + frequency)) + 1
    ready = [(np.append(c, SIZE), np.append(SCALE * s * idf[c], 1.0), names.index(y)) for c, s, y in zip(codes, shares, langs)]
    apart = [k % 5 == 0 for k in range(len(ready))] if len(ready) >= 50 else [False] * len(ready)
    w, b = leader([r for r, a in zip(ready, apart) if not a], len(names)) if names else (np.zeros((SIZE, 0)), np.zeros(0))
    full = np.vstack([w, b[None]])
    held = [r for r, a in zip(ready, apart) if a]
    t = temperature(np.array([x @ full[at] for at, x, _ in held]), np.array([y for *_, y in held])) if held else 1.0
    return {"names": names, "table": np.ascontiguousarray((SCALE * idf[:, None] * w / t).T.astype(np.float32)), "intercept": b / t}


def predicted(texts: list[str], m: dict) -> tuple[list[str], np.ndarray]:
    codes, begin, finish, letters = grams(texts)
    cuts = np.stack([begin, finish], axis=1).ravel()
    logits = np.zeros((len(texts), len(m["names"])))
    for k, table in enumerate(m["table"]):
        value = table[codes].sum(axis=0, dtype=np.float64)
        logits[:, k] = np.add.reduceat(value, cuts)[::2] / np.maximum(finish - begin, 1) + m["intercept"][k]
    known = (letters > 0) & (len(m["names"]) > 0)
    p = softmax(logits) if m["names"] else np.zeros((len(texts), 1))
    return [m["names"][i] if ok else UNKNOWN for i, ok in zip(p.argmax(axis=1), known)], np.where(known, p.max(axis=1), 0.0)


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row per row."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers of 4 bytes a language

    def make(block):
        names, score = predicted([t for t, _ in block], shared.value)
        return {"doc_id": [d for _, d in block], "lang_pred": names, "score": score}

    return map_rows(kept, ["text", "doc_id"], make, f"doc_id {dict(kept.dtypes)['doc_id']}, lang_pred string, score double")


def recognised(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """Rows, with all their columns, whose language is known with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda texts: predicted(texts, shared.value)[1] >= least)
