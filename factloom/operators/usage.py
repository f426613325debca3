"""Logs of calls: sliding limits, daily quotas, running spend, ledgers, replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType


def calls_in_window(calls: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Adds n_recent: calls of the same key in (ts - seconds, ts], itself and ties included.

    Time is cut in slices of ``seconds``.  A window reaches into the slice before at most, so each call is counted in its own slice and,
    as what came before, in the next one; a key is spread over as many tasks as it has slices, whatever share of the calls it
    has.  Calls without a time are one slice of a key.
    """
    width = seconds * 1_000_000
    slice_of = F.floor(F.col("_at") / width)
    both = F.when(F.col("_at").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(slice_of, slice_of + 1))
    placed = calls.withColumn("_at", F.unix_micros(F.col(ts).cast(TimestampType()))).withColumn("_slice", F.explode(both))
    frame = Window.partitionBy(key, "_slice").orderBy("_at").rangeBetween(-(width - 1), 0)
    counted = placed.withColumn("n_recent", F.count("*").over(frame))
    return counted.where(F.col("_slice").eqNullSafe(slice_of)).drop("_at", "_slice")


def limited(calls: DataFrame, key: str, ts: str, per_window: int, seconds: int = 60) -> DataFrame:
    """Adds over_limit: whether the window already held ``per_window`` calls before this one."""
    return calls_in_window(calls, key, ts, seconds).withColumn("over_limit", F.col("n_recent") > per_window)


def pacific_day(ts):
    """The calendar day in Los Angeles of a UTC time without zone."""
    return F.to_date(F.from_utc_timestamp(F.col(ts).cast(TimestampType()), "America/Los_Angeles"))


def daily_quota(calls: DataFrame, key: str, ts: str, order: str, quota: int) -> DataFrame:
    """Adds day, nth (call of the key on that day) and over_quota."""
    day = calls.withColumn("day", pacific_day(ts))
    nth = F.row_number().over(Window.partitionBy(key, "day").orderBy(ts, order))
    return day.withColumn("nth", nth).withColumn("over_quota", F.col("nth") > quota)


def running_spend(calls: DataFrame, key: str, ts: str, order: str, cost: str, ceiling: float, slice_seconds: int = 86_400) -> DataFrame:
    """Adds spent_before (cost of the key's earlier calls) and blocked (checked before the call; a ceiling of 0 or less is none).

    In two levels: sums within slices of time of a key, and the sums of all earlier slices carried over, of which there is one row for
    each slice.  So a key's calls are spread over tasks by time, and no window holds them all.
    """
    kind = "decimal(18,2)"
    paid = F.coalesce(F.col(cost).cast(kind), F.lit(0).cast(kind))
    slice_of = F.coalesce(F.floor(F.unix_micros(F.col(ts).cast(TimestampType())) / (slice_seconds * 1_000_000)), F.lit(-(1 << 62)))
    placed = calls.withColumn("_slice", slice_of).withColumn("_paid", paid)
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(key, "_slice").agg(F.sum("_paid").alias("_sum"))
    carried = totals.select(F.col(key).alias("_key"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    within = Window.partitionBy(key, "_slice").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_within", F.coalesce(F.sum("_paid").over(within), F.lit(0)))
    both = summed.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of")))
    spent = (F.col("_carried") + F.col("_within")).cast(kind)
    return both.withColumn("spent_before", spent).withColumn("blocked", F.lit(ceiling > 0) & (F.col("spent_before") >= F.lit(ceiling))).drop("_slice", "_paid", "_within", "_key", "_of", "_carried")


def ledger(calls: DataFrame, key: str, ts: str, cost: str) -> DataFrame:
    """Calls, cost, first and last time of each key."""
    return calls.groupBy(key).agg(F.count("*").alias("calls"), F.sum(F.col(cost).cast("decimal(18,2)")).alias("cost"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def varied_fields(runs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields that differ between the recorded runs of one key: key, field, n_forms."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("v"))).alias("form")) for f in fields]))
    forms = runs.select(key, pairs.alias("p")).select(key, "p.*").distinct().groupBy(key, "field").agg(F.count("*").alias("n_forms"))
    return forms.where("n_forms > 1")


def ndjson(rows: DataFrame) -> DataFrame:
    """One JSON text per row, in the column value."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def deltas(states: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """Adds delta: what each state of an accumulating run adds to the one before it."""
    before = F.lag(total, 1, 0).over(Window.partitionBy(key).orderBy(order))
    return states.withColumn("delta", F.col(total) - before)


def first_spellings(mentions: DataFrame, value: str, order: str) -> DataFrame:
    """One row per mention whatever its case, in its first spelling: value, n."""
    return mentions.groupBy(F.lower(value).alias("k")).agg(F.min_by(value, order).alias(value), F.count("*").alias("n")).drop("k")


def answer_clusters(answers: DataFrame, candidate: str, question: str, row_columns: Sequence[str]) -> DataFrame:
    """Groups of candidates with equal answers: question, answer_key, candidates, shortest.

    ``answers`` has one row per candidate and result row; an answer is its rows whatever
    their order, so its key combines the hashes of its rows, and no answer is gathered.
    """
    row = F.xxhash64(*[F.col(c).cast("string") for c in row_columns]).cast("decimal(38,0)")
    other = F.hash(*[F.col(c).cast("string") for c in row_columns]).cast("decimal(38,0)")
    keys = answers.groupBy(question, candidate).agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(row).cast("string"), F.sum(other).cast("string")).alias("answer_key"))
    return keys.groupBy(question, "answer_key").agg(F.count("*").alias("candidates"), F.min_by(candidate, F.struct(F.length(candidate), candidate)).alias("shortest"))
