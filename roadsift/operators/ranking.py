"""Ranks, quantiles and round-robin orders that never put a whole group into one task.

A group is cut into ordered buckets by a fixed monotone function of the ordering key.
Bucket sizes (few rows) give each bucket its offset, and the exact rank is computed
inside the bucket only.  Top-k ranks need none of this: Spark limits every window group
before the shuffle when a rank is filtered by a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

UNIT = "\\u001f"


def digest(*parts: str) -> str:
    """SHA-256 over the parts joined by the unit separator (hex order equals byte order)."""
    return f"sha2(concat_ws('{UNIT}', {', '.join(parts)}), 256)"


def hash_unit(hex_digest: str, start: int = 1) -> str:
    """First 16 hex digits (from ``start``) as a number in [0, 1)."""
    return f"(CAST(conv(substr({hex_digest}, {start}, 16), 16, 10) AS DECIMAL(20, 0)) / 18446744073709551616)"


def value_bin(value: str) -> str:
    """Monotone bucket number: about half a per cent wide, for any magnitude and sign."""
    return f"CAST(signum({value}) * floor(ln(1 + abs({value}) * 1e6) * 200) AS BIGINT)"


def _offsets(sizes: DataFrame, groups: list[str], bucket: str, n: str) -> DataFrame:
    """Rows before each bucket and rows in the whole group (one row per bucket)."""
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum(n).over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select(*groups, bucket, before.alias("before_bucket"), F.sum(n).over(w).alias("total"))


def hash_rank(df: DataFrame, groups: list[str], hex_digest: str, ties: list[str], width: int = 3) -> DataFrame:
    """Exact 1-based ``rank`` and group ``total`` in digest order; digest prefixes are even buckets."""
    d = df.withColumn("_d", F.expr(hex_digest)).withColumn("_b", F.expr(f"substr(_d, 1, {width})"))
    off = _offsets(d.groupBy(*groups, "_b").agg(F.count("*").alias("_n")), groups, "_b", "_n")
    w = Window.partitionBy(*groups, "_b").orderBy("_d", *ties)
    ranked = d.withColumn("_r", F.row_number().over(w)).join(off, [*groups, "_b"])
    return ranked.withColumn("rank", F.col("before_bucket") + F.col("_r")).drop("_d", "_b", "_r", "before_bucket")


def value_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per distinct value: its count ``n``, rows with a smaller value ``before``, rows of the group ``total``."""
    counts = df.where(f"{value} IS NOT NULL").groupBy(*groups, value).agg(F.count("*").alias("n")).withColumn("_b", F.expr(value_bin(value)))
    off = _offsets(counts.groupBy(*groups, "_b").agg(F.sum("n").alias("_n")), groups, "_b", "_n")
    w = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_i", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return inside.join(off, [*groups, "_b"]).withColumn("before", F.col("before_bucket") + F.col("_i")).drop("_b", "_i", "before_bucket")


def quantiles(df: DataFrame, groups: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per name."""
    ranks = value_ranks(df, groups, value)
    out = []
    for name, p in probabilities.items():
        pos = f"({p}D * (total - 1))"
        lo, hi = f"floor({pos})", f"ceil({pos})"
        pick = lambda k: f"max({value}) FILTER (WHERE before <= {k} AND {k} < before + n)"
        out.append(F.expr(f"{pick(lo)} + ({pick(hi)} - {pick(lo)}) * max({pos} - {lo})").alias(name))
    return ranks.groupBy(*groups).agg(*out)


def round_robin_index(df: DataFrame, group: str, rank: str, rows: DataFrame | None = None) -> DataFrame:
    """Position in the order (rank within group, group) without a global sort. ``rows``: those that ``df`` ranks, to count them unranked.

    The groups are rule names (a catalog of at most some dozens), so their sizes fit one small row.
    """
    sizes = (df if rows is None else rows).groupBy(group).agg(F.count("*").alias("n")).agg(F.expr(f"collect_list(struct({group} AS g, n))").alias("sizes"))
    position = (f"aggregate(sizes, 0L, (a, s) -> a + least(s.n, {rank} - 1)) + size(filter(sizes, s -> s.n >= {rank} AND s.g <= {group}))")
    return df.join(F.broadcast(sizes)).withColumn("position", F.expr(position)).drop("sizes")
