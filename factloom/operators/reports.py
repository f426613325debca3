"""Business reports: ratios of sums with totals, averages with a mark for no data, targets, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.ranking import with_total


def money(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def ratio_of_sums(left: DataFrame, right: DataFrame, keys: Sequence[str], base: Column, part: Column) -> DataFrame:
    """Sum of ``part`` over sum of ``base`` for each key in either side, and of all in a TOTAL row."""
    a = left.groupBy(*keys).agg(base.alias("base"))
    b = right.groupBy(*keys).agg(part.alias("part"))
    zero = F.lit(0)
    both = a.join(b, list(keys), "full_outer").select(*keys, F.coalesce("base", zero).alias("base"), F.coalesce("part", zero).alias("part"))
    out = with_total(both, keys, base=F.sum("base"), part=F.sum("part"))
    return out.withColumn("ratio", F.round(F.col("part").cast("double") / F.nullif(F.col("base").cast("double"), F.lit(0.0)), 6))


def average_or_mark(df: DataFrame, key: str, value: Column, mark: str = "N/A") -> DataFrame:
    """Count and average (two places, half up) of the values that exist; ``mark`` where there is none."""
    mean = F.round(F.sum(value).cast("decimal(28,6)") / F.nullif(F.count(value), F.lit(0)), 2).cast("decimal(18,2)")
    return df.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(mean.cast("string"), F.lit(mark)).alias("average"))


def targets(df: DataFrame, key: str, value: Column, basis_points: int) -> DataFrame:
    """Count and sum of each group raised by basis points, half up, with a TOTAL row."""
    up = F.lit(10_000 + basis_points)
    parts = df.groupBy(key).agg(F.round(F.count("*") * up / 10_000, 0).cast("long").alias("target_count"), F.round(F.sum(money(value)) * up / 10_000, 2).cast("decimal(18,2)").alias("target_amount"))
    return with_total(parts, [key], target_count=F.sum("target_count"), target_amount=F.sum("target_amount"))


def compliance(df: DataFrame, key: str, basis_points: int) -> DataFrame:
    """Scheduled (a sixth, in tens), completed (a share of it, whole) and their rate for each group."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    scheduled = n.withColumn("scheduled", F.expr("((n + 30) div 60) * 10"))
    done = scheduled.withColumn("completed", F.expr(f"(scheduled * {basis_points}) div 10000"))
    return done.withColumn("rate", F.round(F.col("completed") / F.nullif("scheduled", F.lit(0)), 6)).drop("n")


def renewals(df: DataFrame, keys: Sequence[str], due: Column, renewed: Column) -> DataFrame:
    """Due, renewed and their rate for each group, with a TOTAL row."""
    out = with_total(df, keys, due=F.count_if(due), renewed=F.count_if(due & renewed))
    return out.withColumn("rate", F.round(F.col("renewed") / F.nullif("due", F.lit(0)), 6))
