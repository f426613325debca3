"""Structure of documents as DataFrame operations: blocks under nested headings, and their chunks.

The stack of open headings is a scan: of each depth the last heading counts, unless one that
is less deep came after it.  Both are running maxima of (place, label, clause), so they are
taken in segments of lines and the maxima of all earlier segments are carried in; a document of any
length spans as many tasks as it has segments.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.chunks import CHARS, split_text
from factloom.functions.text import LABEL_CHARS, UNREADABLE, heading, unmerged_clauses

#: Depths of headings: marks of markdown have 1 to 6, the forms of policies 2 to 4.
DEPTHS = range(1, 7)
#: Lines of a segment.
SEGMENT = 2000
# Fixed patterns: a list mark before a heading, what a recognised page has in place of a picture, marks of markdown.
_LIST_MARK = r"^[-*o•]\s+"
_PLACEHOLDER = r"^<!--.*-->$"
_MARKDOWN = r"^#{1,6}\s+(.+)$"
#: Behind each of these a line ends, as it does behind a carriage return without a line feed.
_LINE_END = "(?<=[\n\u000b\u000c\u001c-\u001e\u0085  ])|(?<=\r)(?!\n)"


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|(?U)\s+$", "")


def _lines(pages: DataFrame, text: Column, *more: str) -> DataFrame:
    """A row for each line with its end: doc_id, page, i (from 0), line."""
    kept = F.filter(F.split(text, _LINE_END), lambda x: x != "")
    return pages.select("doc_id", "page", *more, F.posexplode(kept).alias("i", "line"))


def _scanned_maxima(lines: DataFrame, values: dict[str, Column], segment: int) -> DataFrame:
    """Adds running maxima of ``values`` over the lines of a document in order of page and i, in segments."""
    cut = lines.withColumn("_seg", F.floor(F.col("i") / segment))
    inside = Window.partitionBy("doc_id", "page", "_seg").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("page", "_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("doc_id", "page", "_seg").agg(*[F.max(v).alias(f"_sum_{n}") for n, v in values.items()])
    carried = totals.select("doc_id", "page", "_seg", *[F.max(f"_sum_{n}").over(before).alias(f"_in_{n}") for n in values])
    both = cut.join(carried, ["doc_id", "page", "_seg"]).select("*", *[F.max(v).over(inside).alias(f"_own_{n}") for n, v in values.items()])
    return both.select(*lines.columns, *[F.greatest(f"_in_{n}", f"_own_{n}").alias(n) for n in values])


def policy_blocks(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Blocks of documents: doc_id, page, block (its first line), labels (of the headings it stands under, outer first), clause_id, text.

    ``pages`` has doc_id, page and text.  Inline clauses get lines of their own first.  A heading ends the block before it and opens the next one (its list mark
    goes); a page ends a block, but headings stay open.  Blank blocks are left out; a null text is empty.
    """
    lines = _lines(pages, unmerged_clauses(F.coalesce("text", F.lit(""))))
    marked = lines.withColumn("h", heading(_stripped(F.col("line"))))
    opened = marked.withColumn("at", F.struct("page", "i"))
    last = {f"_d{d}": F.when(F.col("h.depth") == d, F.struct("at", F.col("h.label").alias("label"), F.col("h.clause_id").alias("clause_id"))) for d in DEPTHS}
    starts = F.when(F.col("h").isNotNull() | (F.col("i") == 0), F.struct("at"))
    scanned = _scanned_maxima(opened, {**last, "_start": starts}, segment)
    # a heading is open if no less deep one came after it
    shallower, opens = F.lit(None).cast("struct<page:long,i:int>"), []
    for d in DEPTHS:
        at = F.col(f"_d{d}.at").cast("struct<page:long,i:int>")
        opens.append(F.when(at.isNotNull() & (shallower.isNull() | (at > shallower)), F.col(f"_d{d}")))
        shallower = F.greatest(shallower, at)
    stack = F.filter(F.array(*opens), lambda x: x.isNotNull())
    line = F.when(F.col("h").isNotNull(), F.regexp_replace("line", _LIST_MARK, "")).otherwise(F.col("line"))
    first = F.col("i") == F.col("_start.at.i")
    placed = scanned.select("doc_id", "page", F.col("_start.at.i").alias("block"), "i", line.alias("line"), F.when(first, stack).alias("stack"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "")
    blocks = placed.groupBy("doc_id", "page", "block").agg(F.first("stack", ignorenulls=True).alias("stack"), text.alias("text")).where(_stripped(F.col("text")) != "")
    clauses = F.filter(F.transform("stack", lambda x: x["clause_id"]), lambda x: x.isNotNull())
    return blocks.select("doc_id", "page", "block", F.transform("stack", lambda x: x["label"]).alias("labels"), F.try_element_at(clauses, F.lit(-1)).alias("clause_id"), "text")


def _chunked(blocks: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_no (from 0 in each document), page, chunk_text and the other columns; a longer block is split."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap))

    parts = F.when(F.length("text") > size * CHARS, split("text")).otherwise(F.array("text"))
    exploded = blocks.select("*", F.posexplode(parts).alias("part", "chunk_text")).drop("text")
    # numbers: those of earlier pages carried in, so that no window holds a document
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    bases = exploded.groupBy("doc_id", "page").agg(F.count("*").alias("n")).select("doc_id", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block", "part")) - 1
    numbered = exploded.withColumn("nth", nth).join(bases, ["doc_id", "page"])
    return numbered.withColumn("chunk_no", F.col("base") + F.col("nth")).drop("block", "part", "nth", "base")


def policy_chunks(pages: DataFrame, size: int = 400, overlap: int = 60) -> DataFrame:
    """Chunks of policy documents (doc_id, doc_name, page, text): doc_id, chunk_no, page, section, clause_id, chunk_text, content_hash.

    The section is the document's name and the open headings, null under none; the clause is the innermost one that has an id.
    """
    names = pages.groupBy("doc_id").agg(F.min("doc_name").alias("doc_name"))
    chunks = _chunked(policy_blocks(pages), size, overlap).join(names, "doc_id")
    section = F.when(F.size("labels") > 0, F.array_join(F.concat(F.array(F.coalesce("doc_name", F.lit(""))), "labels"), " > "))
    return chunks.select("doc_id", "chunk_no", "page", section.alias("section"), "clause_id", "chunk_text", F.sha2("chunk_text", 256).alias("content_hash"))


def scanned_chunks(pages: DataFrame, size: int = 400, overlap: int = 60, segment: int = SEGMENT) -> DataFrame:
    """Chunks of recognised pages (doc_id, doc_name, page, text, confidence): doc_id, chunk_no, page, section, clause_id, chunk_text, confidence, content_hash.

    Only marks of markdown are headings, and none outlasts its page; there are no clauses.  Blank lines, pictures' placeholders and
    marks go.  The section is the name, the page and the heading.  A page without text is one chunk that says so, at confidence 0.
    """
    page_text = F.coalesce("text", F.lit(""))
    raw = _lines(pages, page_text).withColumn("line", _stripped(F.col("line"))).where((F.col("line") != "") & ~F.col("line").rlike(_PLACEHOLDER))
    marked = raw.withColumn("h", F.when(F.col("line").rlike(_MARKDOWN), F.substring(F.trim(F.regexp_extract("line", _MARKDOWN, 1)), 1, LABEL_CHARS)))
    opened = marked.withColumn("at", F.struct("page", "i"))
    scanned = _scanned_maxima(opened, {"_h": F.when(F.col("h").isNotNull(), F.struct("at", "h"))}, segment)
    own = F.col("_h.at.page") == F.col("page")
    clean = F.when(F.col("h").isNotNull(), F.trim(F.regexp_extract("line", _MARKDOWN, 1))).otherwise(F.regexp_replace("line", _LIST_MARK, ""))
    placed = scanned.select("doc_id", "page", F.when(own, F.col("_h.at.i")).otherwise(-1).alias("block"), "i", clean.alias("line"), F.when(own, F.col("_h.h")).alias("heading"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    blocks = placed.groupBy("doc_id", "page", "block").agg(F.first("heading").alias("heading"), _stripped(text).alias("text")).where("text <> ''")
    empty = pages.select("doc_id", "page").distinct().join(blocks.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    unread = empty.select("doc_id", "page", F.lit(-1).alias("block"), F.lit(None).cast("string").alias("heading"), F.lit(UNREADABLE).alias("text"), F.lit(True).alias("unread"))
    every = _chunked(blocks.withColumn("unread", F.lit(False)).unionByName(unread), size, overlap)
    of_page = pages.groupBy("doc_id", "page").agg(F.min("doc_name").alias("doc_name"), F.min("confidence").alias("confidence"))
    section = F.concat_ws(" > ", F.coalesce("doc_name", F.lit("")), F.concat(F.lit("p."), F.col("page").cast("string")), "heading")
    return every.join(of_page, ["doc_id", "page"]).select(
        "doc_id", "chunk_no", "page", section.alias("section"), F.lit(None).cast("string").alias("clause_id"), "chunk_text", F.when(F.col("unread"), 0.0).otherwise(F.col("confidence")).alias("confidence"), F.sha2("chunk_text", 256).alias("content_hash")
    )
