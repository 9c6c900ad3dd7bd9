"""Near duplicates by min-max hashing.

A document's set is that of its distinct five-word shingles (64-bit hashes of its words). Under each of ``PERMUTATIONS``
permutations the smallest and the largest value are both kept: twice as many signature values as hash evaluations, each
unbiased for the similarity, min and max together with lower variance. ``BANDS`` bands of ``ROWS`` values make buckets: a pair
at the threshold misses all of them with probability (1 - 0.85^6)^40 = 6e-9.

Documents with equal sets are one class from the start, so copies cost one row. Buckets are never expanded into all
pairs: in each of the ``STARS`` first rounds the members of a bucket are compared with two members of it, after which
most buckets lie in one component and need nothing more. The centre of the first round is the member that meets most
others in its buckets: the text that a family of near copies goes back to.

What remains, buckets of several components, is decided by differences to a common centre C. Of the differences between
x and C, d(x) are shingles that no other class with this centre has, and r(x) are the rest. Two sets differ in at least
d(x) + d(y) + |r(x) - r(y)| shingles, whatever C is, which refutes the pairs of a family that lie under the threshold.
Classes with equal numbers of shingles, d and r form one cell of a bucket; cells are joined, not classes, and only cells
that may hold a link between two components are expanded, so no link between components is lost. Pairs left are screened by one bit
of each signature value (a pair at the threshold falls below ``AGREEMENT`` with probability 4.4e-6) and then confirmed
on the full sets made from their texts.

Without words, or with a null text, a document is linked with nothing. Documents of fewer than five words have their
whole sequence as one shingle. Rows with equal ids are rows of their own with the same decision. A null id counts as no
id: it is never a component's smallest. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from roadsift.llm.chars import mixed
from roadsift.llm.common import map_rows, materialize, ragged, slim
from roadsift.llm.components import components
from roadsift.llm.pretokens import powers

WIDTH, THRESHOLD = 5, 85
PERMUTATIONS, BANDS, ROWS = 120, 40, 6
AGREEMENT = 0.84
#: Rounds of stars, and how many of its stars a class is compared with in one of them.
STARS, TRIES = 2, 4
#: Texts that are hashed, and compared, at once, in characters; shingles that get a signature at once.
BLOCK, PAIR_CHARS, CHUNK = 400_000, 200_000, 4096
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
PLACES = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64))


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Words: runs without ASCII white space, A-Z in lower case."""
    coded = [t.encode("utf-8").lower() for t in texts]
    finish = np.cumsum([len(c) + 1 for c in coded]) - 1
    data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    change = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    start, end = change[::2], change[1::2]
    up, down = powers(1 << max(1, len(data)).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
        word = mixed((total[end] - total[start]) * down[start])
        cuts = np.append(0, np.searchsorted(start, finish, "right"))
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            n = b - a
            if n >= width:
                key = sum(word[a + k:b - width + 1 + k] * PLACES[k] for k in range(width))
                out.append(np.unique(mixed(key)))
            else:
                out.append(mixed(np.array([(word[a:b] * PLACES[:n]).sum() + np.uint64(n)], np.uint64)) if n else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest values under all permutations, then the largest ones."""
    low, high = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(PERMUTATIONS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), CHUNK):
            values = shingles[i:i + CHUNK, None] * FACTORS + ADDENDS
            low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
    return np.concatenate([low, high])


def similar(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_type: str) -> DataFrame:
    """doc_id, n, node (digest of the set; null if empty), buckets, bits."""
    bit = np.uint64(40)

    def make(block):
        sets = shingle_sets([t for t, _ in block])
        nodes, buckets, bits = [], np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), 4), np.int64)
        with np.errstate(over="ignore"):
            for i, s in enumerate(sets):
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    values = mixed(signature(s))
                    key = np.arange(BANDS, dtype=np.uint64)
                    for column in values.reshape(BANDS, ROWS).T:
                        key = mixed((key ^ column) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                    buckets[i] = key.view(np.int64)
                    flags = np.zeros(256, np.uint8)
                    flags[:len(values)] = (values >> bit) & np.uint64(1)
                    bits[i] = np.packbits(flags).view(np.int64)
        return {"doc_id": [d for _, d in block], "n": [len(s) for s in sets], "node": nodes,
                "buckets": ragged(buckets.ravel(), np.where([len(s) > 0 for s in sets], BANDS, BANDS), pa.int64()), "bits": ragged(bits.ravel(), np.full(len(sets), 4), pa.int64())}

    return map_rows(docs, ["text", "doc_id"], make, f"doc_id {id_type}, n long, node binary, buckets array<long>, bits array<long>", BLOCK)


def class_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame, id_type: str) -> DataFrame:
    """node, text of one document of each class that shares a bucket. Other documents don't reach Python again."""
    def make(block):
        return {"text": [t for t, _ in block], "doc_id": [d for _, d in block], "node": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingle_sets([t for t, _ in block])]}

    wanted = nodes.distinct().join(classes.select("node", F.col("first_id").alias("id")), "node")
    # an id may have several rows, so the digest is made again, for the rows of the wanted ids
    ids = wanted.select("id").distinct()
    named = map_rows(docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi"), ["text", "doc_id"], make, f"text string, doc_id {id_type}, node binary", BLOCK)
    found = named.join(wanted, (named["node"] == wanted["node"]) & named["doc_id"].eqNullSafe(wanted["id"])).select(named["node"], "text")
    return found.groupBy("node").agg(F.min("text").alias("text"))


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int, measure: bool = False) -> DataFrame:
    """a, b, linked: each pair compared on its full sets. ``measure`` adds n_a, n_b, common and gained (the shingles of a alone)."""
    left = pairs.join(texts.withColumnRenamed("node", "b").withColumnRenamed("text", "text_b"), "b")
    whole = left.join(texts.withColumnRenamed("node", "a").withColumnRenamed("text", "text_a"), "a").sortWithinPartitions("a")

    def make(block):
        names = {}
        for text_a, text_b, a, b in block:
            names.setdefault(a, text_a)
            names.setdefault(b, text_b)
        sets = dict(zip(names, shingle_sets(list(names.values()))))
        out = {"a": [r[2] for r in block], "b": [r[3] for r in block], "linked": [similar(sets[r[2]], sets[r[3]], threshold) for r in block]}
        if measure:
            gained = [np.setdiff1d(sets[r[2]], sets[r[3]], assume_unique=True) for r in block]
            sizes = np.array([len(g) for g in gained])
            out |= {"n_a": [len(sets[r[2]]) for r in block], "n_b": [len(sets[r[3]]) for r in block], "gained": ragged(np.concatenate(gained).view(np.int64), sizes, pa.int64())}
            out["common"] = (np.array(out["n_a"]) - sizes).tolist()
        return out

    extra = ", n_a long, n_b long, common long, gained array<long>" if measure else ""
    return map_rows(whole.withColumn("text_b", F.coalesce("text_b", F.lit(""))), ["text_a", "text_b", "a", "b"], make, f"a binary, b binary, linked boolean{extra}", PAIR_CHARS)


def differences(spokes: DataFrame) -> DataFrame:
    """node, centre, n, own (shingles that no other class with this centre has), rest (other differences to the centre)."""
    once = spokes.select("a", "b", F.explode("gained").alias("shingle")).groupBy("b", "shingle").agg(F.count("*").alias("times"), F.any_value("a").alias("a")).where("times = 1")
    own = once.groupBy("a", "b").agg(F.count("*").alias("own"))
    apart = F.col("n_a") + F.col("n_b") - 2 * F.col("common")
    found = spokes.join(own, ["a", "b"], "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("centre"), F.col("n_a").alias("n"), "own", (apart - F.col("own")).alias("rest"))


def open_pairs(members: DataFrame, centres: DataFrame, measured: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """a, b, bucket: pairs of different labels in a bucket whose differences to the bucket's centre don't refute a link.

    members: bucket, node, label. centres: bucket, centre. sizes: node, n of the centres.
    """
    around = members.join(centres, "bucket")
    hub = around.where("node = centre").join(sizes, "node").select("bucket", "node", "label", "n", F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("rest"))
    rows = around.where("node <> centre").join(measured, ["node", "centre"]).select("bucket", "node", "label", "n", "own", "rest").unionByName(hub)
    rows = materialize(rows.withColumn("cell", F.struct("n", "own", "rest")), "cells")
    cells = rows.groupBy("bucket", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    one, other = (cells.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("cell", "low", "high")]) for x in "xy")
    least = F.col("cell_x.own") + F.col("cell_y.own") + F.abs(F.col("cell_x.rest") - F.col("cell_y.rest"))
    possible = (100 - threshold) * (F.col("cell_x.n") + F.col("cell_y.n")) >= (100 + threshold) * least
    several = F.least("low_x", "low_y") != F.greatest("high_x", "high_y")
    left = one.join(other, "bucket").where((F.col("cell_x") <= F.col("cell_y")) & possible & several).select("bucket", "cell_x", "cell_y")
    a, b = (rows.select("bucket", F.col("cell").alias(c), F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x, c in (("a", "cell_x"), ("b", "cell_y")))
    return left.join(a, ["bucket", "cell_x"]).join(b, ["bucket", "cell_y"]).where("label_a <> label_b").select("a", "b", "bucket")


def agreeing(left: str, right: str) -> F.Column:
    """Whether the signature bits agree often enough to be worth a comparison."""
    apart = sum(F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(4))
    return apart <= int((1 - AGREEMENT) * 2 * PERMUTATIONS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    kept = slim(docs, text=text_col, doc_id=id_col)
    id_type = dict(kept.dtypes)["doc_id"]
    rows = materialize(signatures(kept, id_type), "signatures")
    classes = materialize(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("buckets").alias("buckets"), F.any_value("bits").alias("bits")), "classes")
    bands = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    bands = materialize(bands.join(shared, "bucket"), "bands")
    # the class that meets most others in its buckets is the middle of its family
    weights = bands.groupBy("node").agg(F.sum("members").alias("weight"))
    bands = materialize(bands.drop("members").join(weights, "node"), "weighted")
    bits = classes.select("node", "bits")
    texts = materialize(class_texts(kept, classes, bands.select("node"), id_type), "texts")
    tested = links = labels = None

    def labelled() -> DataFrame:
        if labels is None:
            return bands.withColumn("label", F.col("node"))
        joined = bands.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        mixed_buckets = joined.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
        return joined.join(mixed_buckets, "bucket")

    def screened(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        return (pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a")
                .join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b").where(agreeing("bits_a", "bits_b")).select("a", "b"))

    def settle(results: DataFrame) -> None:
        nonlocal tested, links, labels
        tested = results if tested is None else tested.unionByName(results)
        links = tested.where("linked").select("a", "b")
        labels = materialize(components(links), "components")

    heavy = F.struct((-F.col("weight")).alias("weight"), F.xxhash64("node").alias("order"), "node", "label")
    for turn in range(STARS):
        members = labelled()
        order = F.struct(F.lit(0).alias("weight"), F.xxhash64("node", F.lit(turn)).alias("order"), "node", "label")
        centres = members.groupBy("bucket").agg(F.min(order if turn else heavy).alias("first"), F.max(order).alias("last"))
        stars = members.join(centres, "bucket").select("node", "label", F.explode(F.array(*[F.struct(f"{c}.node", f"{c}.label") for c in ("first", "last")])).alias("centre")).where("label <> centre.label")
        # the centres that share most buckets with a class come first; picked before anything else is joined
        times = stars.select(F.col("node").alias("a"), F.col("centre.node").alias("b")).groupBy("a", "b").count()
        best = Window.partitionBy("a").orderBy(F.desc("count"), "b")
        pairs = materialize(screened(times.withColumn("try", F.row_number().over(best)).where(F.col("try") <= TRIES).select("a", "b")), "pairs")
        if not pairs.isEmpty():
            settle(materialize(confirm(pairs, texts, threshold), "confirmed"))

    members = materialize(labelled().select("bucket", "node", "label", "weight"), "members")
    middle = members.groupBy("bucket").agg(F.min(heavy).alias("middle"), F.count("*").alias("members"))
    centres = middle.where("members > 2").select("bucket", F.col("middle.node").alias("centre"))
    spokes = members.join(centres, "bucket").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    spokes = materialize(confirm(spokes, texts, threshold, measure=True), "spokes")
    two = members.join(middle.where("members = 2").select("bucket"), "bucket").groupBy("bucket").agg(F.max("node").alias("a"), F.min("node").alias("b")).select("a", "b")
    if not spokes.isEmpty():
        settle(spokes.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "linked").distinct())
        sizes = spokes.groupBy(F.col("b").alias("node")).agg(F.max("n_b").alias("n"))
        relabelled = labelled().select("bucket", "node", "label")
        two = two.unionByName(open_pairs(relabelled, centres, materialize(differences(spokes), "differences"), sizes, threshold).select("a", "b"))
    pairs = materialize(screened(two), "pairs")
    if not pairs.isEmpty():
        settle(materialize(confirm(pairs, texts, threshold), "confirmed"))

    classes = classes.select("node", "first_id")
    if labels is None:
        found = classes.withColumn("component", F.col("node"))
    else:
        found = classes.join(labels, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    smallest = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = found.join(smallest, "component").select("node", "component_id")
    out = rows.select("doc_id", "n", "node").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, of one document of each component.

    An id goes if none of its rows is kept; of rows with equal id and text one stays; rows without an id stay.
    """
    gone = near_duplicates(docs, id_col, text_col).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone"))
    left = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    before = F.lag(F.coalesce(F.xxhash64(text_col), F.lit(0))).over(Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(id_col))
    return left.withColumn("_before", F.col(id_col).isNotNull() & before.isNotNull()).where("NOT _before").drop("_before")
