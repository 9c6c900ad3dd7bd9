"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadsift.llm import chat, dedup, fingerprints, language, lexical, neighbours, packing, periods, secrets, segmentation, substrings, tokens, toxicity
from roadsift.llm.common import documents, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def spans_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: One kind's spans: the pieces between its matches and the matches give the positions.
def _sql_kind(order: int, kind: str, pattern: str, least: str) -> str:
    return f"""SELECT r, {order} AS k, '{kind}' AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS n
      FROM (SELECT r, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM d)) WHERE {least}"""


_ASSIGN = "".join(["(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])", """["'']?\\x20*[:=]\\x20*["'']?"""])
_VALUE = "[A-Za-z0-9+/_.=-]+"
SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_sql_kind(0, 'assign', _ASSIGN + _VALUE, f"length(regexp_extract(m[i], '^{_ASSIGN}({_VALUE})', 1)) >= 6")}
  UNION ALL {_sql_kind(1, 'access', 'AKIA[A-Z0-9]+', 'length(m[i]) >= 20')}
  UNION ALL {_sql_kind(2, 'hex', '[0-9a-f]+', 'length(m[i]) >= 24')}
  UNION ALL {_sql_kind(3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 'true')}
  UNION ALL {_sql_kind(4, 'jwt', 'eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+', 'length(m[i]) >= 30')}
  UNION ALL {_sql_kind(5, 'forge', 'gh[pousr]_[A-Za-z0-9]+', 'length(m[i]) >= 40')}),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, k) FILTER (k < 3) AS base,
        string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""


@query("op1_secret_scan", SECRETS_SQL)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


EXTRA_CONVERSATION = r"\### Assistant: </turn> ok"
CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') AS coded,
  contains(text, '###') OR contains(text, '</turn>') OR replace(replace(replace(text, '\l', '<'), '\h', '#'), '\b', '\') <> text AS clash FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(CASE WHEN clash THEN coded ELSE text END) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op8_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_CONVERSATION).alias("text"))
    made = chat.format_conversations(rows.unionByName(extra))
    cut = lambda s: F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))
    learnt = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(cut(s))), "")
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
                       F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op2_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op10_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 512)


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where((fold("doc_id") != 0) & F.col("lang").isNotNull()))
    return language.identify(docs, model).withColumn("held_out", fold("doc_id") == 0)


@query("op9_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id") != 0)
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


@query("op4_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(documents(spark, sf_dir))


@query("op5_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


@query("op7_nearest")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("vec_id", F.lit(20)) == 0)


@query("op3_segmentation")
def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segmentation.decode(segmentation.encode(documents(spark, sf_dir)))
    scores = F.concat(F.array("score"), F.transform("others", lambda o: o["score"]))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.col("score").alias("best_score"), F.array_join(scores.cast("array<string>"), ",").alias("scores"),
                        F.crc32(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("ids_crc32"), F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


SEARCH_SQL = r"""
WITH w AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS r, * FROM documents)),
  p AS (SELECT r, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
  d AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY r),
  s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
  i AS (SELECT item_id, unnest(regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark GROUP BY item_id),
  q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
  t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
  c AS (SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
    FROM q JOIN t USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY item_id, r, doc_id),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""


@query("op11_ranked_search", SEARCH_SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
  b AS (SELECT r, doc_id, a, substring(h, 2 * a + 1, 2 * 249) AS part FROM (SELECT r, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 200)) AS a FROM d)),
  x AS (SELECT r, doc_id, a + j AS i, substring(part, 2 * j + 1, 100) AS s FROM (SELECT r, doc_id, a, part, unnest(range(0, length(part) // 2 - 49)) AS j FROM b)),
  m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s HAVING min(doc_id) < max(doc_id)),
  c AS (SELECT r, i FROM x JOIN m USING (s) WHERE least < doc_id),
  e AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM c),
  g AS (SELECT r, i, count(*) FILTER (gap IS NULL OR gap > 50) OVER (PARTITION BY r ORDER BY i) AS k FROM e),
  u AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY r, k),
  v AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM u GROUP BY r),
  z AS (SELECT d.*, removed, spans, list_transform(range(0, len(starts) + 1), lambda j: substring(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1, 2 * ((CASE WHEN j = len(starts) THEN length(h) // 2 ELSE starts[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE ends[j] END)))) AS rest FROM d LEFT JOIN v USING (r))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN rest IS NULL THEN h ELSE array_to_string(rest, '') END)) AS kept_sha256 FROM z"""


@query("op12_repeated_substrings", REPEATS_SQL)
def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: crc32 of the id's digits: one step for each of their bits, the first one of a digit takes its code in.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""
PERIODS_SQL = f"""
WITH w0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents),
  w1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM w0),
  w2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM w1),
  w3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w2),
  d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM w3),
  x AS (SELECT r, i, array_to_string(w[i + 1:i + 16], ' ') AS gram FROM (SELECT r, w, unnest(range(0, greatest(n - 15, 0))) AS i FROM d)),
  y AS (SELECT r, i, dense_rank() OVER (ORDER BY gram) AS k FROM x),
  l AS (SELECT s.r, s.i, t.i - s.i AS q FROM y s JOIN y t ON s.r = t.r AND s.k = t.k AND t.i > s.i),
  o AS (SELECT r, q, min(i) AS start, count(*) + 15 + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS grp FROM l) GROUP BY r, q, grp),
  u AS (SELECT r, start, length, min(q) AS period FROM o WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
  s AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY r),
  b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
  gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
  kept AS (SELECT v.r, string_agg(word, ' ' ORDER BY v.i) AS words FROM (SELECT r, unnest(w) AS word, unnest(range(0, n)) AS i FROM d WHERE r IN (SELECT r FROM u)) v LEFT JOIN gone ON gone.r = v.r AND gone.i = v.i WHERE gone.r IS NULL GROUP BY v.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, CAST(floor(1000 * b.length / b.period) AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, array_to_string(w, ' '))) AS collapsed_sha256
FROM d LEFT JOIN s USING (r) LEFT JOIN b USING (r) LEFT JOIN kept USING (r)"""


def with_periods(docs: DataFrame) -> DataFrame:
    """Texts of which a tenth (by crc32 of the id) repeat their words from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    named = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("w"), g.alias("g"))
    n, a = F.size("w"), F.pmod("g", F.size("w"))
    placed = named.withColumn("a", F.when(n > 0, a)).withColumn("p", F.floor(1 + (n - F.col("a")) / (3 + F.pmod("g", F.lit(8)))))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")
    made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i))), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs", PERIODS_SQL)
def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(with_periods(documents(spark, sf_dir)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
