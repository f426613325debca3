"""Superlatives with ties, ratios, totals, paging and fusion of rank lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def superlative(df: DataFrame, value: str, greatest: bool = True) -> DataFrame:
    """All rows that have the greatest (or least) value; nulls never do.  One aggregate and a join on its one row."""
    top = df.agg((F.max if greatest else F.min)(value).alias("_top"))
    return df.join(F.broadcast(top), F.col(value) == F.col("_top")).drop("_top")


def ratio(df: DataFrame, keys: Sequence[str], numerator: Column, denominator: Column) -> DataFrame:
    """Numerator, denominator and their ratio (null where the denominator is 0) of each group."""
    return df.groupBy(*keys).agg(numerator.alias("numerator"), denominator.alias("denominator")).withColumn("ratio", F.col("numerator") / F.nullif("denominator", F.lit(0)))


def with_total(df: DataFrame, keys: Sequence[str], label: str = "TOTAL", **aggregates: Column) -> DataFrame:
    """Groups and one total row, whose keys all read ``label``; ratios of the result are ratios of sums."""
    named = [a.alias(n) for n, a in aggregates.items()]
    parts = df.groupBy(*keys).agg(*named)
    total = df.agg(*named).select(*[F.lit(label).alias(k) for k in keys], *aggregates)
    return parts.select(*[F.col(k).cast("string").alias(k) for k in keys], *aggregates).unionByName(total)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def ranked(df: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    """The ``limit`` best rows with ``rank`` from 1; ties go by key.  The window sees ``limit`` rows."""
    best = df.orderBy(F.desc(score), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def rrf(lists: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (key, rank): key, rrf_score.

    ``k`` must be positive, and a key may be in a list once: one that repeats is an
    error when the rows are computed.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def once(ranked: DataFrame, name: str) -> DataFrame:
        repeated = F.raise_error(F.concat(F.lit("a list of ranks repeats "), F.col(key).cast("string"))).cast("long")
        return ranked.groupBy(key).agg(F.min("rank").alias(name), F.count("*").alias("_n")).select(key, F.when(F.col("_n") > 1, repeated).otherwise(F.col(name)).alias(name))

    joined = once(lists[0], "rank_0")
    for i, other in enumerate(lists[1:], 1):
        joined = joined.join(once(other, f"rank_{i}"), key, "full_outer")
    terms = [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(f"rank_{i}")), F.lit(0.0)) for i in range(len(lists))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return joined.select(key, total.alias("rrf_score"))
