"""Ranked search, repeated substrings and periodic runs against brute force, on edge cases and small tables."""

import hashlib
import math
import random
import re
import tempfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadsift.llm import lexical, periods, queries, substrings
from roadsift.llm.bwt import Collection

#: Null, empty, blank, repeated, tied and odd texts; an id is there twice, one is null, two are beyond 2 ** 53.
PASSAGE = "this passage is shared by several documents and is longer than fifty bytes, é中🚀 "
EDGE = [
    (1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, PASSAGE + "tail"), (6, "head " + PASSAGE), (7, PASSAGE * 3), (7, PASSAGE), (None, PASSAGE + "without an id"), (8, "é中🚀 \x00 İ It's \x7f A1b2 ÀB"),
    ((1 << 60) + 1, "x" * 3000), ((1 << 60) + 3, "x" * 200 + "end " + PASSAGE[:49]), (9, "word " * 20_000), (10, "a b c d e f g h " * 9), (11, "ONE Two three-four one"), (12, "one two"),
]
SCHEMA = "doc_id long, text string, score double, rank int, item_id long, n string, key string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 0.5, 1, 3, "z", "k") for i, t in EDGE], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k=10):
    found = [(d, Counter(plain_terms(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in found:
            m = 25 + 75 * sum(c.values()) * n // max(1, length)
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(plain_terms(text)).items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, edge, none):
    items = [(1, "one TWO one"), (2, None), (3, PASSAGE), (4, ""), (5, "word x" + "x" * 2999), (6, "unknown"), (7, "é中🚀 İ a"), (8, "ON one TW two t")]
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    for block in (lexical.BLOCK, 800):
        mine = lexical.search(edge, table, block=block)
        assert mine.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, mine.collect()), key=repr) == plain_search(EDGE, items)
    assert lexical.search(none, table).count() == 0 and lexical.search(edge, table.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "one TWO one", ""), (1, "zzz", ""), (1, None, "")], table.schema)
    assert sorted(map(tuple, lexical.search(edge, twice).collect()), key=repr) == plain_search(EDGE, items[:1])


def test_search_in_many_shards(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "w%d" % min(int(rng.expovariate(0.05)), 300)
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 80)))) for i in range(900)] + [(i, "w1 w2 w3") for i in range(900, 940)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    mine = lexical.search(table, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, mine.collect()), key=repr) == plain_search(docs, items)
    # no accumulators are made once the bounds that are left can't reach the k-th best: survivors stay exact
    for size in (1, 7, 300):
        vocabulary = lexical.Vocabulary([b"a", b"b" * 8, b"b" * 9, b"c" * 17, b"zz"])
        texts = [" ".join(rng.choice(["a", "b" * 8, "b" * 9, "c" * 17, "zz", "no", "b" * 7, "c" * 16]) for _ in range(30)) for _ in range(size)]
        n, row, term, times = lexical.postings(texts, vocabulary)
        expect = {(i, j): c for i, t in enumerate(texts) for j, w in enumerate(["a", "b" * 8, "b" * 9, "c" * 17, "zz"]) if (c := t.split().count(w))}
        assert dict(zip(zip(row.tolist(), term.tolist()), times.tolist())) == expect and n.tolist() == [30] * size


def test_limited_accumulators_are_exact():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n, terms = int(rng.integers(5, 400)), int(rng.integers(1, 12))
        shard, total = lexical.Shard(terms), np.zeros(n, np.int64)
        weight = rng.integers(0, 5000, terms)
        row, term, share = [], [], []
        for t in range(terms):
            some = np.flatnonzero(rng.random(n) < rng.random())
            s = rng.integers(1, 1_000_000, len(some))
            total[some] += weight[t] * s
            row.append(some), term.append(np.full(len(some), t)), share.append(s)
        shard.add(list(range(n)), np.concatenate(row), np.concatenate(term), np.concatenate(share))
        shard.close()
        holding = [len(r) for r in row]
        item = sorted(((t, int(weight[t])) for t in range(terms)), key=lambda x: holding[x[0]])
        assert shard.best(item, 10) == [(int(d), int(total[d])) for d in sorted(range(n), key=lambda d: (-total[d], d))[:10] if total[d]]


def test_column_wise_transform():
    rng = random.Random(2)
    for _ in range(25):
        symbols = bytes([0, 65, 66, 200][:rng.randint(1, 4)])
        base = bytes(rng.choice(symbols) for _ in range(200))
        some = [base[a:a + rng.randint(0, 30)] if rng.random() < 0.7 else bytes(rng.choice(symbols) for _ in range(rng.randint(0, 30))) for a in (rng.randint(0, 170) for _ in range(rng.randint(1, 40)))]
        most = rng.randint(1, 12)
        with tempfile.TemporaryDirectory() as folder:
            made = Collection(some, folder, most, piece=rng.choice([3, 7, 50, 1000]))
            ordered = sorted((s[i:], k) for k, s in enumerate(some) for i in range(len(s) + 1))
            before = [some[k][len(some[k]) - len(x) - 1] + 1 if len(x) < len(some[k]) else 0 for x, k in ordered]
            common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert np.concatenate([s for _, s, _ in made._pieces()]).tolist() == before
            assert np.concatenate([c for *_, c in made._pieces()]).tolist() == [0] + [min(most, common(a, b)) for (a, _), (b, _) in zip(ordered, ordered[1:])]
            groups = {}
            for k, start, group in zip(*made.windows()):
                groups.setdefault(some[k][start:start + most], set()).add(int(group))
            made.close()
            assert len(set().union(*groups.values())) == len(groups) == sum(map(len, groups.values()))


def plain_removal(docs, length=50):
    least = {}
    coded = [(d, (t or "").encode()) for d, t in docs]
    for d, t in coded:
        if d is not None:
            for i in range(len(t) - length + 1):
                least[t[i:i + length]] = min(d, least.get(t[i:i + length], d))
    out = []
    for d, t in coded:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - length + 1):
                if least[t[i:i + length]] < d:
                    gone[i:i + length] = b"\1" * length
        edges = [i for i in range(len(t) + 1) if (gone[i] if i < len(t) else 0) != (gone[i - 1] if i else 0)]
        out.append((d, len(t), tuple(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


def test_repeats_equal_brute_force(spark, edge, none, monkeypatch):
    assert removed(substrings.remove_repeats(edge)) == plain_removal(EDGE)
    assert substrings.remove_repeats(none).count() == 0
    rng = random.Random(11)
    base = "".join(rng.choice("ab é") for _ in range(3000))
    docs = [(i, "".join(base[a:a + rng.randint(20, 120)] if rng.random() < 0.8 else rng.choice("xyz") * rng.randint(1, 70) for a in (rng.randrange(2900) for _ in range(rng.randint(0, 12))))) for i in range(150)]
    monkeypatch.setattr(substrings, "BLOCK", 3000)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert removed(substrings.remove_repeats(table)) == plain_removal(docs)
    assert removed(substrings.remove_repeats(table, length=32)) == plain_removal(docs, 32)
    assert dict(substrings.remove_repeats(table.withColumn("doc_id", F.col("doc_id").cast("int"))).dtypes)["doc_id"] == "int"
    with pytest.raises(TypeError):
        substrings.remove_repeats(table.withColumn("doc_id", F.col("doc_id").cast("string")))


def plain_runs(words, least=24, times=3):
    found, n = {}, len(words)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force(spark, edge, none):
    rng = random.Random(1)
    for _ in range(800):
        kinds, words = rng.choice([1, 2, 3, 5]), []
        while len(words) < rng.randint(0, 150):
            stretch = [rng.randrange(kinds) for _ in range(rng.randint(1, 20))]
            words += (stretch * rng.randint(1, 8))[:rng.randint(1, 80)] if rng.random() < 0.5 else [rng.randrange(kinds * 5) for _ in range(rng.randint(1, 20))]
        for least, times in ((24, 3), (5, 2)):
            assert periods.runs(np.array(words, np.int64), least, times) == plain_runs(words, least, times)
    assert periods.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periods.strongest([(0, 24, 8), (5, 30, 10), (9, 48, 16)]) == (0, 24, 8) and periods.strongest([]) is None
    rows = periods.periodic_runs(edge).collect()
    assert len(rows) == len(EDGE) and periods.periodic_runs(none).count() == 0
    expect = []
    for d, t in EDGE:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        expect.append((d, runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in rows), key=repr) == sorted(expect, key=repr)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_repeated_substrings", "op13_periodic_runs"])
def test_queries_equal_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = c.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    theirs = sorted(repr(tuple(row[names.index(x)] for x in cols)) for row in rel.fetchall())
    assert sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == theirs and cols == sorted(names)


def test_large_ids_beside_a_null_keep_their_rows(spark):
    """Ids beyond 2 ** 53 fall into their own range although a null is in their batch."""
    from roadsift.llm import fingerprints
    rows = [(None, "no id here\nsecond line")] + [((1 << 60) + 2 * i + 1, f"text {i}\nline of {i}") for i in range(40)]
    for parts in (1, 3):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((r.doc_id or 0) for r in fingerprints.fingerprints(table).collect()) == sorted((d or 0) for d, _ in rows)


def test_a_repeated_query_is_searched_once(spark):
    from roadsift.llm import neighbours
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)]
    table = spark.createDataFrame([*rows, rows[0]], "vec_id long, vector array<double>")
    found = neighbours.nearest(table, F.col("vec_id") == 0, vector_col="vector").orderBy("rank").collect()
    best = sorted(((sum(a * b for a, b in zip(rows[0][1], v)), -i) for i, v in rows[1:]), reverse=True)[:20]
    assert [r.vec_id for r in found] == [-i for _, i in best] and [r["rank"] for r in found] == list(range(1, 21))


def test_other_ways_of_a_word_depend_on_their_number():
    from roadsift.llm import segmentation
    one, other = segmentation.Model(segmentation.MODEL), segmentation.Model(segmentation.MODEL)
    two = one.others("▁international", (), 2)
    assert len(two) == 1 and one.others("▁international", (), 8) == other.others("▁international", (), 8) and len(other.others("▁international", (), 8)) == 7
