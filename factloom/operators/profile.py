"""Column profiles, value catalogues and documented-against-observed columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text column with fewer distinct values has a value set; this many values are shown as samples.
VALUE_SET_BELOW = 20
SAMPLES = 8
#: A column with more distinct values isn't catalogued at all.
CATALOGUE_BOUND = 1000
VALUE_CHARS = 120
_RANGED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
_NOT_VOCABULARY = re.compile(r"(^|_)(id|key|email|description|notes|text|comment)$")
_REFERENCE = re.compile(r"(^|_)(number|no|ref|reference|code|name)$")


def as_text(column: str, kind: T.DataType):
    """A value as text that doesn't depend on how an engine prints doubles."""
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(c, 2).cast("decimal(20,2)").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: column_name, total, n_distinct, n_null, min_value, max_value, samples, value_set.

    Rows are first brought down to distinct (column, value) pairs with their counts -
    a partial aggregate on the map side - so no column's values gather in one task;
    min and max come from a second plain aggregate.  Samples are the first values in
    the order of their texts.
    """
    fields = df.schema.fields
    kinds = {f.name: f.dataType for f in fields}
    pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), as_text(f.name, f.dataType).alias("v")) for f in fields]))
    values = df.select(pairs.alias("p")).select("p.*").groupBy("column_name", "v").agg(F.count("*").alias("n"))
    counts = values.groupBy("column_name").agg(F.sum("n").alias("total"), F.count("v").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    kept = _least_values(values.where("v is not null"), VALUE_SET_BELOW)
    bounds = [(f.name, as_text(f.name, f.dataType)) for f in fields if isinstance(f.dataType, _RANGED)]
    edge = df.agg(*[x for f, _ in bounds for x in (F.min(f"`{f}`").alias(f"min_{f}"), F.max(f"`{f}`").alias(f"max_{f}"))]) if bounds else None
    out = counts.join(kept, "column_name", "left")
    if edge is not None:
        shown = edge.select(
            F.explode(
                F.array(*[F.struct(F.lit(f).alias("column_name"), as_text(f"min_{f}", kinds[f]).alias("min_value"), as_text(f"max_{f}", kinds[f]).alias("max_value")) for f, _ in bounds])
            ).alias("e")
        ).select("e.*")
        out = out.join(shown, "column_name", "left")
    else:
        out = out.withColumns({"min_value": F.lit(None).cast("string"), "max_value": F.lit(None).cast("string")})
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    vocabulary = F.col("column_name").isin(texts) & (F.col("n_distinct") < VALUE_SET_BELOW) if texts else F.lit(False)
    return out.select(
        "column_name", "total", "n_distinct", "n_null", "min_value", "max_value",
        F.array_join(F.slice(F.coalesce("least", F.array().cast("array<string>")), 1, SAMPLES), "|").alias("samples"),
        F.when(vocabulary, F.array_join(F.coalesce("least", F.array().cast("array<string>")), "|")).alias("value_set"),
    )


def _least_values(values: DataFrame, n: int) -> DataFrame:
    """The ``n`` least texts of each column, found in two steps so that no task sees all values of a column."""
    salted = values.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(256)))
    part = salted.groupBy("column_name", "salt").agg(F.slice(F.array_sort(F.collect_set("v")), 1, n).alias("part"))
    return part.groupBy("column_name").agg(F.slice(F.array_sort(F.flatten(F.collect_list("part"))), 1, n).alias("least"))


def vocabulary_columns(df: DataFrame) -> list[str]:
    """Text columns whose stored spellings are worth cataloguing, by name and type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not _NOT_VOCABULARY.search(f.name.lower())]


def reference_columns(df: DataFrame) -> list[str]:
    """Text columns that hold references, by the end of their names."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and _REFERENCE.search(f.name.lower())]


def value_catalogue(df: DataFrame, columns: list[str], bound: int = CATALOGUE_BOUND) -> DataFrame:
    """Stored values and comma-separated parts of them: column_name, value, stored, match_kind.

    A column with more than ``bound`` distinct values is left out whole.  A part that
    is itself a stored value counts as 'equals', other parts as 'contains'.  Blank values
    and those over VALUE_CHARS are left out.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("stored")) for c in columns]))
    stored = df.select(pairs.alias("p")).select("p.*").where("stored is not null").distinct()
    fits = stored.groupBy("column_name").agg(F.count("*").alias("n")).where(F.col("n") <= bound).select("column_name")
    stored = stored.join(fits, "column_name", "left_semi")
    whole = stored.select("column_name", F.trim("stored").alias("value"), "stored", F.lit("equals").alias("match_kind"))
    parts = stored.where(F.contains("stored", F.lit(","))).select("column_name", F.explode(F.split("stored", ",")).alias("value"), "stored").select("column_name", F.trim("value").alias("value"), "stored", F.lit("contains").alias("match_kind"))
    every = whole.unionByName(parts).where((F.col("value") != "") & (F.length("value") <= VALUE_CHARS))
    return every.groupBy("column_name", "value").agg(F.max("match_kind").alias("match_kind"), F.min("stored").alias("stored"))


def reference_key(column):
    """A reference in lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]+", "")


def reference_lookup(df: DataFrame, column: str, reference: str) -> DataFrame:
    """Rows whose reference has the key of ``reference``."""
    key = re.sub(r"[^a-z0-9]+", "", reference.lower())
    return df.where(reference_key(F.col(column)) == key)


def column_drift(documented: DataFrame, observed: DataFrame) -> DataFrame:
    """Columns that only one of two lists (column_name) has: column_name, side."""
    only = lambda a, b, side: a.select("column_name").join(b.select("column_name"), "column_name", "left_anti").distinct().withColumn("side", F.lit(side))
    return only(documented, observed, "documented").unionByName(only(observed, documented, "observed"))
