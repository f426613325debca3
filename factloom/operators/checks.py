"""Invariants of data and of query results, and referential checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.01


@dataclass(frozen=True)
class Invariant:
    """What must hold in every row; operands that are null skip the check."""

    name: str
    columns: tuple[str, ...]

    def broken(self) -> Column:
        raise NotImplementedError

    def violations(self, df: DataFrame) -> DataFrame:
        return df.where(F.coalesce(self.broken(), F.lit(False)))


class SumOf(Invariant):
    """columns[0] is the sum of the others, within TOLERANCE."""

    def broken(self) -> Column:
        total, *parts = [F.col(c) for c in self.columns]
        difference = total
        for p in parts:
            difference = difference - p
        return F.abs(difference) > TOLERANCE


class NonNegative(Invariant):
    def broken(self) -> Column:
        return F.col(self.columns[0]) < 0


class Ordered(Invariant):
    """columns[0] is at most columns[1]."""

    def broken(self) -> Column:
        return F.col(self.columns[0]) > F.col(self.columns[1])


def violation_counts(df: DataFrame, invariants: Sequence[Invariant]) -> DataFrame:
    """One pass over ``df``: invariant, violations."""
    counts = df.agg(*[F.count_if(F.coalesce(i.broken(), F.lit(False))).alias(i.name) for i in invariants])
    rows = F.array(*[F.struct(F.lit(i.name).alias("invariant"), F.col(i.name).alias("violations")) for i in invariants])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key isn't null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def outside_vocabulary(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


# The rules across sources, in the order in which they are reported.
RULES = ("source_incomplete", "policy_document_missing", "scanned_filename_unkeyed", "scanned_claim_unknown", "workbook_missing", "workbook_undeclared", "workbook_region_unknown", "ops_invariant_violated", "sheet_invariant_violated")


def cross_source_findings(
    sources: DataFrame, files: DataFrame, products: DataFrame, claims: DataFrame, workbooks: DataFrame, sheet_rows: DataFrame, regions: DataFrame,
    ops: Sequence[tuple[str, DataFrame, str, Sequence[Invariant]]] = (), sheets: Sequence[tuple[str, DataFrame, str, Sequence[Invariant]]] = (), claim_pattern: str = r"CLM-[0-9]{3,}",
) -> DataFrame:
    """What doesn't fit together in a corpus of several sources: place (the rule's number), rule, detail.  No rows: everything fits.

    ``sources`` has source and expected (number of files), ``files`` source (policy, scanned or workbook) and name; ``products`` product and policy_document; ``claims``
    claim_number; ``workbooks`` workbook (those that contexts declare); ``sheet_rows`` workbook and region; ``regions`` region_name.  ``ops`` and ``sheets`` name
    tables with their invariants: (table, frame, key, invariants).  A source without files would pass every other rule, so its
    files are counted first.  Keys are compared in both directions where both can be wrong.
    """
    out = []

    def add(rule: str, rows: DataFrame, detail: Column) -> None:
        out.append(rows.select(F.lit(RULES.index(rule)).alias("place"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))

    counts = files.groupBy("source").agg(F.count("*").alias("present"))
    held = sources.join(counts, "source", "left").withColumn("present", F.coalesce("present", F.lit(0)))
    add("source_incomplete", held.where("present <> expected"), F.format_string("%s: %d of %d files", "source", F.col("present").cast("long"), F.col("expected").cast("long")))
    of = lambda kind: files.where(F.col("source") == kind).select("name")
    add("policy_document_missing", orphans(products, "policy_document", of("policy"), "name"), F.concat_ws(": ", "product", "policy_document"))
    scans = of("scanned").withColumn("claim_number", F.nullif(F.regexp_extract("name", claim_pattern, 0), F.lit("")))
    add("scanned_filename_unkeyed", scans.where("claim_number is null"), F.col("name"))
    add("scanned_claim_unknown", orphans(scans, "claim_number", claims, "claim_number"), F.col("name"))
    add("workbook_missing", orphans(workbooks.select("workbook").distinct(), "workbook", of("workbook"), "name"), F.col("workbook"))
    add("workbook_undeclared", orphans(of("workbook"), "name", workbooks, "workbook"), F.col("name"))
    named = sheet_rows.where(F.trim("region") != "").select("workbook", "region").distinct()
    add("workbook_region_unknown", orphans(named, "region", regions, "region_name"), F.concat_ws(": ", "workbook", "region"))
    for rule, tables in (("ops_invariant_violated", ops), ("sheet_invariant_violated", sheets)):
        for table, df, key, invariants in tables:
            for invariant in invariants:
                add(rule, invariant.violations(df), F.concat_ws(": ", F.lit(table), F.lit(invariant.name), F.col(key).cast("string")))
    result = out[0]
    for rows in out[1:]:
        result = result.unionByName(rows)
    return result
