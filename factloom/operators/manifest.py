"""Incremental indexing: what changed since the last run, and how stored chunks follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(previous: DataFrame, current: DataFrame, stored: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """State of every document: key, state.

    ``previous`` has key, content_hash and chunk_count, ``current`` key and content_hash,
    ``stored`` key and n_chunks as they are in the store.  States: added, updated,
    skipped (same hash), removed, and inconsistent (the store has another number of
    chunks than the manifest says).
    """
    old = previous.select(key, F.col("content_hash").alias("old_hash"), F.col("chunk_count").alias("old_chunks"))
    both = old.join(current.select(key, F.col("content_hash").alias("new_hash")), key, "full_outer")
    wrong = F.lit(False)
    if stored is not None:
        both = both.join(stored.select(key, "n_chunks"), key, "left")
        wrong = F.col("old_hash").isNotNull() & (F.col("old_chunks") > 0) & (F.coalesce("n_chunks", F.lit(0)) != F.col("old_chunks"))
    state = (
        F.when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash").isNull(), "added")
        .when(wrong, "inconsistent")
        .when(F.col("old_hash") == F.col("new_hash"), "skipped")
        .otherwise("updated")
    )
    return both.select(key, state.alias("state"))


def changed_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("state").agg(F.count("*").alias("n"))


def upserted(store: DataFrame, fresh: DataFrame, diff: DataFrame, key: str = "doc_id") -> DataFrame:
    """The store after a run: chunks of changed and removed documents go, fresh ones come."""
    touched = diff.where(F.col("state").isin("updated", "removed", "inconsistent")).select(key)
    return store.join(touched, key, "left_anti").unionByName(fresh.select(*store.columns))


def without_chunks(fresh: DataFrame, diff: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents to be indexed that gave no chunk: an error of the run."""
    return diff.where(F.col("state").isin("added", "updated", "inconsistent")).select(key).join(fresh.select(key).distinct(), key, "left_anti")


def chunk_page(chunks: DataFrame, doc: object, limit: int, offset: int, key: str = "doc_id") -> DataFrame:
    """Chunks of one document in the order of the number at the end of chunk_id; ids without one come last."""
    number = F.expr("try_cast(regexp_extract(chunk_id, ':([0-9]+)$', 1) as int)")
    return chunks.where(F.col(key) == F.lit(doc)).orderBy(number.isNull(), number, "chunk_id").offset(offset).limit(limit)


def furniture(lines: DataFrame, edge: int = 5) -> DataFrame:
    """Signatures of repeated page lines: doc_id, signature, n_pages.

    ``lines`` has doc_id, page, line_no and line (not blank).  Among the first and last
    ``edge`` lines of each page, a signature on at least half of a document's pages
    (three or more) is furniture.
    """
    from pyspark.sql import Window

    from factloom.functions.text import line_signature

    page = Window.partitionBy("doc_id", "page")
    placed = lines.withColumn("signature", line_signature(F.col("line"))).withColumn("from_top", F.row_number().over(page.orderBy("line_no"))).withColumn("from_end", F.row_number().over(page.orderBy(F.desc("line_no"))))
    pages = lines.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 3")
    edges = placed.where((F.col("from_top") <= edge) | (F.col("from_end") <= edge)).select("doc_id", "page", "signature").distinct()
    seen = edges.groupBy("doc_id", "signature").agg(F.count("*").alias("n_pages"))
    return seen.join(pages, "doc_id").where("2 * n_pages >= pages").select("doc_id", "signature", "n_pages")


def page_stamps(lines: DataFrame, edge: int = 5) -> DataFrame:
    """Signatures that stand in one slot of three pages or more and read differently on each: doc_id, signature."""
    from pyspark.sql import Window

    from factloom.functions.text import line_signature

    page = Window.partitionBy("doc_id", "page")
    placed = lines.withColumn("signature", line_signature(F.col("line"))).withColumn("t", F.row_number().over(page.orderBy("line_no"))).withColumn("e", F.row_number().over(page.orderBy(F.desc("line_no"))))
    slots = F.filter(F.array(F.when(F.col("t") <= edge, F.col("t") - 1), F.when(F.col("e") <= edge, -F.col("e"))), lambda x: x.isNotNull())
    at = placed.select("doc_id", "page", "signature", "line", F.explode(slots).alias("slot"))
    seen = at.groupBy("doc_id", "signature").agg(F.countDistinct("slot").alias("slots"), F.countDistinct("page").alias("pages"), F.countDistinct("line").alias("forms"))
    return seen.where("slots = 1 and pages >= 3 and forms = pages").select("doc_id", "signature")
