"""Each operator against brute force, the library or held-out labels, on edge cases and small tables."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

from roadsift.llm import chat, components, dedup, fingerprints, language, neighbours, packing, pretokens, secrets, segmentation, tokens, toxicity  # noqa: E402

#: Null, empty, blank, repeated, tied and odd texts; doc_id 7 is there twice, one id is null.
EDGE = [
    (1, None), (2, ""), (3, "   \n"), (4, "one two"), (5, "a b c d e f g h"), (6, "A B c d e\tf g h"), (7, "same row here again and again"), (7, "same row here again and again"),
    (None, "no id at all but words"), (8, "é中🚀 \x00 <|endoftext|> it's  we'll x "), (9, "AKIA" + "Z9" * 10 + " password: \"abc-123\" token=12345 " + "0123456789abcdef" * 2 + " API_KEY = x.y/z+w=="),
    (10, "word " * 30_000), (11, "x" * 50_000), (12, "."), (13, "The cat sat. The dog ran!\nNew line? Yes"),
]
SCHEMA = "doc_id long, text string, score double, n long, node string, p double"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 0.5, 1, "z", 1.0) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(pretokens.VOCABULARY)


def test_pretokens_equal_the_library(library):
    rng = random.Random(3)
    parts = ["a", "'s", "'", "ll", "'re", "'t ", " ", "  ", "\n", "\t", " ", "1", "²", "!", "<|endoftext|>", "é", "中", "\0", "'d'm", "՘", "Ᲊ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(0, 0x30000, 97) if not 0xD800 <= c < 0xE000]
    cut = pretokens.cut(texts)
    mine = [[] for _ in texts]
    for i, row in enumerate(cut.row):
        mine[row] += pretokens.piece_ids(cut.string(i))
    assert mine == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(edge, none, docs, library):
    for table in (edge, docs.limit(60)):
        for hot in (tokens.HOT, 20):
            found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.count_tokens(table, hot=hot).collect())
            assert found == sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect())
    assert tokens.count_tokens(none).collect() == []


def test_packing(edge, none, docs, library):
    for table in (edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), docs):
        texts = {r.doc_id: np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in table.collect()}
        rows = packing.pack(table).collect()
        assert all(zlib.crc32(texts[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(texts[r.doc_id]) for r in rows)
        assert sorted((r.doc_id, r.start + k) for r in rows for k in range(r.length)) == [(d, k) for d in sorted(texts) for k in range(len(texts[d]))]
        end = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == end.get(r.sequence_id, 0)
            end[r.sequence_id] = r.offset + r.length
        assert max(end.values()) <= 1024
        total = sum(map(len, texts.values()))
        assert len(end) <= total / 1024 * 1.02 + 2
    assert len(packing.pack(edge).collect()) == len(packing.pack(edge.where("doc_id <> 7 OR doc_id IS NULL")).collect()) + 2
    assert packing.pack(none).collect() == []


def test_packing_plan_holds_everything_near_the_bound():
    rng = np.random.default_rng(5)
    for counts in (rng.integers(0, 400, 256), rng.integers(0, 2, 256), np.eye(256, dtype=int)[200] * 9):
        histogram = {n + 1: int(k) for n, k in enumerate(counts)}
        plan, held = packing.plan(histogram, 256), {}
        for copies, pattern in plan:
            assert sum(n * t for n, t in pattern.items()) <= 256
            for n, t in pattern.items():
                held[n] = held.get(n, 0) + copies * t
        assert held == {n: k for n, k in histogram.items() if k}
    assert sum(c for c, _ in packing.plan({n: 300 for n in range(1, 257)}, 256)) <= 1.01 * sum(300 * n for n in range(1, 257)) / 256 + 2


def test_secret_spans(edge, none):
    def brute(text):
        out = []
        for order, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.pattern, text, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)):
                if len(m[rule.group]) >= rule.least:
                    out.append((m.start(), order, m.end(), rule.kind))
        return [(k, a, b) for a, _, b, k in sorted(out)]

    found = secrets.find_secrets(edge).collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in found) == sorted((str(i), brute(t or "")) for i, t in EDGE)
    assert {k for r in found for k, _, _ in map(tuple, r.spans)} >= {"assign", "access", "hex"}
    assert secrets.find_secrets(none).collect() == []
    hidden = {r.doc_id: r for r in secrets.redact(edge).collect()}
    assert hidden[1].text is None and "AKIA" not in hidden[9].text and "abc-123" not in hidden[9].text and hidden[5].text == "a b c d e f g h" and hidden[9].node == "z"


def test_trigram_queries_hold_in_every_match():
    assert secrets.trigram_query("[0-9a-f]+") is None and leaves_of("abcd|xyz") == {"abc", "bcd", "xyz"}
    holds = lambda q, t: True if q is None else q in t if isinstance(q, str) else (any if q[0] == "or" else all)(holds(x, t) for x in q[1:])
    for pattern, text in (("ab?cde+", "acdeee"), ("(foo|bar)baz", "barbaz"), ("x{2,3}yz", "xxyz"), ("a.c[0-9]end", "abc5end")):
        assert re.fullmatch(pattern, text) and holds(secrets.trigram_query(pattern), text)
    assert not holds(secrets.trigram_query("(foo|bar)baz"), "bazfoo bar")
    texts = ["has a Token here", "none", "pass word", "TOKEN and token"]
    assert secrets.postings(texts, {"tok": 0}, _table("tok"))["tok"].tolist() == [0, 3]


def leaves_of(pattern):
    return secrets.leaves(secrets.trigram_query(pattern))


def _table(name):
    table = np.zeros(1 << 24, np.uint8)
    a, b, c = name.encode()
    table[a << 16 | b << 8 | c] = 1
    return table


def test_chat_round_trip(spark):
    odd = ["", "plain", "### user: x </turn>\n", r"\### Assistant: </turn> ok", r"a\lb \h \b \\", "<", "#", "</turn>", ": :\n", "\n### ", "é🚀"]
    rows = [(1, i, r, t, 0) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "sys: #1\nx") for t in odd)]
    rows += [(2, None, None, None, 0), (2, 1, "assistant", "b", 0), (2, 1, "assistant", "b", 0), (2, 1, "assistant", "a", 0), (None, 0, "user", "z" * 200_000, 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int")
    found = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert [tuple(t) for t in found[1].turns] == [(r, t) for _, _, r, t, _ in rows[:len(odd) * 3]]
    assert [tuple(t) for t in found[2].turns] == [("", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")]
    assert len(found[None].turns[0].text) == 200_000
    learnt = [found[1].formatted[s.start:s.start + s.length] for s in found[1].loss_spans]
    plain = lambda x: x.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")
    assert [plain(x) for x in learnt] == odd
    assert found[1].formatted.count("</turn>") == len(odd) * 3
    assert chat.format_conversations(table.limit(0)).collect() == []


def _sets(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def _components(rows, threshold=85):
    sets = [_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = doc if not sets[i] else min(ids, default=None)
        out.append((str(doc), len(sets[i]), str(least), doc is not None and doc == least))
    return sorted(out)


def test_near_duplicates(spark, edge, none):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(500)]
    rows, text = list(EDGE), [rng.choice(vocabulary) for _ in range(120)]
    for i in range(100, 180):  # one family in which about half of all pairs are linked
        changed = list(text)
        for _ in range(rng.randint(0, 3)):
            changed[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((i, " ".join(changed)))
    for i in range(200, 230):  # a chain
        text[(i - 200) * 2] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    rows += [(i, "tiny copy") for i in range(300, 320)]
    found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == _components(rows)
    assert dedup.near_duplicates(none).collect() == []
    left = dedup.deduplicated(edge).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "10", "11", "12", "13", "2", "3", "4", "5", "7", "8", "9", "None"] and left[0].node == "z"


def test_minimum_and_maximum_estimate_the_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[500:])
    x, y = dedup.signature(a), dedup.signature(b)
    half = dedup.PERMUTATIONS
    for part in (slice(0, half), slice(half, None), slice(None)):
        assert abs((x[part] == y[part]).mean() - 1 / 3) < 0.13


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (3, 4), (4, 3)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints(spark, edge, none, docs):
    def keys(text):
        return set(fingerprints.digests([text])[0].tolist())

    def alike(a, b):
        return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))

    for table in (edge, docs.limit(80), edge.where("doc_id = 13")):
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
        want = []
        for i, r in enumerate(rows):
            own, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
            changed = own[:len(own) - len(own) // 3] + after[:len(own) // 3]
            want.append((str(r.doc_id), len(own), hashlib.sha256(changed.encode()).hexdigest(), round(alike(keys(own), keys(changed)), 9), round(alike(keys(own), keys(after)), 9)))
        found = fingerprints.fingerprints(table).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == sorted(want)
    assert len({r.fingerprint for r in fingerprints.fingerprints(edge).collect() if r.doc_id == 7}) == 1
    assert fingerprints.fingerprints(none).collect() == []


def test_peeling_recovers_the_difference():
    a, b = np.arange(1, 4000, dtype=np.uint64), np.arange(30, 4010, dtype=np.uint64)
    one = np.zeros(len(a), int), np.zeros(len(b), int)
    cells = np.array([96])
    keys, owners, empty = fingerprints.sketched(a, one[0], cells).minus(fingerprints.sketched(b, one[1], cells)).peel()
    assert empty.all() and set(keys.tolist()) == set(a.tolist()) ^ set(b.tolist()) and (owners == 0).all()
    assert fingerprints.differences(a, np.array([len(a)]), b, np.array([len(b)])).tolist() == [39]


def test_language(spark, edge, none, docs):
    from roadsift.llm.common import fold
    model = language.fit(docs.where((fold("doc_id") != 0) & F.col("lang").isNotNull()))
    found = language.identify(docs.where(fold("doc_id") == 0), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) and all(0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r for r in language.identify(edge, model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3, 12)] == ["und"] * 4 and odd[10].lang_pred != "und" and odd[1].score == 0
    assert language.identify(none, model).collect() == []
    nothing = language.fit(none.withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in language.identify(edge, nothing).collect()} == {"und"}
    assert {r.doc_id for r in language.recognised(edge, model, least=0.0001).collect()} == {4, 5, 6, 7, None, 8, 9, 10, 11, 13}


def test_leader_gives_sparse_weights_and_temperature_lowers_loss():
    rows = [(np.array([i % 2, 5, language.SIZE]), np.array([5.0, 0.01, 1.0]), i % 2) for i in range(60)]
    w, b = language.leader(rows, 2)
    assert (w != 0).any(axis=1).sum() == 2 and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    scores, y = np.array([[9.0, 0], [9.0, 0], [0, 9.0], [0, 9.0]] * 20), np.array([0, 1, 1, 1] * 20)
    assert language.temperature(scores, y) > 3


def test_toxicity(spark, edge, none, sf_dir):
    rng = random.Random(4)
    clean = ["the", "a", "cat", "ran", "home", "blue", "sky", "over", "hill", "far"]
    rows, labels = [], []
    for i in range(400):
        sentences = [[rng.choice(clean) for _ in range(8)] for _ in range(rng.randint(3, 30))]
        if toxic := i % 3 == 0:
            sentences[rng.randrange(len(sentences))][2] = rng.choice(["idiot", "moron", "scum"])
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + "."))
        labels.append((i, int(toxic)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + labels[:5] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table.where("doc_id < 300"), marks.where("doc_id < 300 OR doc_id > 9000 OR doc_id IS NULL"))
    found = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert all((found[i].score >= 0.5) == (i % 3 == 0) for i in range(300, 400))
    text = rows[300][1]
    assert [re.search("idiot|moron|scum", text[s.start:s.end]) is not None for s in found[300].offending] == [True]
    assert sorted(r.doc_id for r in toxicity.clean(table, model).collect()) == [i for i in range(400) if found[i].score < 0.5]
    odd = {r.doc_id: r for r in toxicity.score(edge, model).collect()}
    assert odd[1].score == odd[2].score == odd[3].score == 0 and all(0 <= r.score <= 1 for r in odd.values())
    assert toxicity.score(none, model).collect() == []
    for some in (marks.where("toxic = 0"), marks.limit(0)):
        assert all(r.score < 0.5 for r in toxicity.score(edge, toxicity.fit(table, some)).collect())


def test_nearest(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((3000, 16)).astype(np.float32)
    v[100:160] = v[7]
    rows = [(i, x.tolist(), 0.0) for i, x in enumerate(v)]
    bad = [(5000, None, 0.0), (5020, [], 0.0), (5040, [0.0] * 16, 0.0), (5060, [float("nan")] * 16, 0.0), (5080, [1.0] * 8, 0.0), (5100, [float("inf")] * 16, 0.0), (5120, [None] + [1.0] * 15, 0.0), (None, [1.0] * 16, 0.0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score double")
    import unittest.mock as mock
    with mock.patch.object(neighbours, "BLOCK", 200):
        found = neighbours.nearest(table, F.pmod("vec_id", F.lit(20)) == 0).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 3000, 20)) and all(len(x) == 20 for x in by.values())
    hits = 0
    for q, mine in by.items():
        s = sum(v[:, k].astype(float) * float(v[q, k]) for k in range(16))
        order = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:20]
        hits += len({i for i, _ in mine} & set(order))
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0])) and all(x == s[i] for i, x in mine)
    assert hits >= 0.95 * 20 * len(by)
    few = neighbours.nearest(table.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in sorted(few)] == [1, 2, 3, 4] and neighbours.nearest(table.limit(0), F.lit(True)).collect() == []


def test_segmentation(spark, edge, none):
    import sentencepiece
    lib, model = sentencepiece.SentencePieceProcessor(model_file=segmentation.MODEL), segmentation.model(segmentation.MODEL)

    def every(word):
        edges = model.lattice(word)

        def back(at):
            if not at:
                yield 0, ()
            for a, ids, s in edges[at]:
                for t, x in back(a):
                    yield t + s, x + ids
        return list(back(len(word)))

    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "th", "e", " ", "  ", "é", "中", "🚀", "\n", "er", ".", "n't"]) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    found = segmentation.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        text, ways = texts[r.doc_id], every("▁" + texts[r.doc_id].replace(" ", "▁"))
        paths = [tuple(r.ids)] + [tuple(segmentation.applied(r.ids, [(e.at, e.drop, e.ids) for e in o.edits])) for o in r.others]
        scores = [r.score] + [o.score for o in r.others]
        assert scores == sorted((s for s, _ in ways), reverse=True)[:segmentation.BEST]
        assert len(set(paths)) == len(paths) and all(x in ways for x in zip(scores, paths))
        assert all(lib.decode(list(p)) == model.decode(np.array(p), np.array([len(p)]))[0] == text for p in paths)
    back = {str(r.doc_id): r for r in segmentation.decode(segmentation.encode(edge)).collect()}
    assert all(back[str(i)].decoded == (t or "") for i, t in EDGE)
    assert segmentation.encode(none).collect() == []
