"""Evidence rows, their identity, the account of gaps and the citations of an answer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import citations, content_hash, malformed_citations

SOURCE_TYPES = ("policy", "sql", "spreadsheet", "scanned")
LOW_CONFIDENCE = 0.60


def rejected(column_source: str = "source_type") -> Column:
    """Why a row can't be evidence, or null: unknown source, blank content, confidence out of [0, 1]."""
    c = F.col("confidence")
    return (
        F.when(F.col(column_source).isNull() | ~F.col(column_source).isin(*SOURCE_TYPES), "unknown source")
        .when(F.col("content").isNull() | (F.trim("content") == ""), "blank content")
        .when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1), "confidence out of range")
    )


def dedup_key() -> Column:
    """Source, its id, the place and the content; counts and scores don't distinguish evidence."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\x1f", part("source_type"), part("source_id"), part("locator"), content_hash(part("content"))), 256)


def deduplicated(rows: DataFrame, order: str = "ord") -> DataFrame:
    """The first row of every key.

    ``rows`` may have its dedup_key already, and then needs no content: keys are digests
    of fixed size, contents are whole texts.
    """
    keyed = rows if "dedup_key" in rows.columns else rows.withColumn("dedup_key", dedup_key())
    first = keyed.groupBy("dedup_key").agg(F.min_by(F.struct(*[c for c in keyed.columns if c != "dedup_key"]), order).alias("r"))
    return first.select("dedup_key", "r.*")


def canonical(rows: DataFrame, routing: Sequence[str], order: str = "ord") -> DataFrame:
    """Deduplicated evidence in routing order (other sources last) with ids E1, E2, ...

    ``order`` is a number; where it ties, the source decides, then the key.  Ranges of it
    are cut at quantiles, one for each shuffle partition, and counted; an id is the count
    of all ranges before and the rank inside the range, so no window sees all rows.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.select(F.col(order).cast("double").alias(order)).approxQuantile(order, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    place = F.coalesce(*[F.when(F.col("source_type") == s, F.lit(i)) for i, s in enumerate(routing)], F.lit(len(routing))) if routing else F.lit(0)
    found = deduplicated(rows, order).withColumn("position", place).withColumn("_range", _range_of(F.col(order).cast("double"), cuts))
    sizes = found.groupBy("position", "_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("position", "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("position", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("position", "_range").orderBy(order, "source_type", "dedup_key"))
    placed = found.withColumn("_rank", rank).join(F.broadcast(starts), ["position", "_range"])
    numbered = placed.withColumn("evidence_id", F.concat(F.lit("E"), (F.col("_before") + F.col("_rank")).cast("string")))
    return numbered.select("dedup_key", *[c for c in rows.columns if c != "dedup_key"], "position", "evidence_id")


def _range_of(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted ``cuts`` are at most the value, by halving; -1 for null."""

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), below(lo, mid)).otherwise(below(mid + 1, hi))

    return F.when(value.isNull(), -1).otherwise(below(0, len(cuts)))


def gap_account(rows: DataFrame, asked: DataFrame, failed: DataFrame, floor: float = LOW_CONFIDENCE) -> DataFrame:
    """What every asked source gave: source_type, returned, kept, duplicates, low_confidence, status.

    ``asked`` and ``failed`` have the column source_type.  A source that failed is
    'failed', one without evidence 'silent', others 'ok'.
    """
    returned = rows.groupBy("source_type").agg(F.count("*").alias("returned"))
    kept = deduplicated(rows.select(dedup_key().alias("dedup_key"), "source_type", "confidence", "ord")).groupBy("source_type").agg(F.count("*").alias("kept"), F.count_if(F.col("confidence") < floor).alias("low_confidence"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = asked.select("source_type").distinct().join(returned, "source_type", "left").join(kept, "source_type", "left").join(failed.select("source_type", F.lit(True).alias("failed")).distinct(), "source_type", "left")
    return joined.select("source_type", zero("returned"), zero("kept"), (F.coalesce("returned", F.lit(0)) - F.coalesce("kept", F.lit(0))).alias("duplicates"), zero("low_confidence"), F.when(F.col("failed"), "failed").when(F.coalesce("kept", F.lit(0)) == 0, "silent").otherwise("ok").alias("status"))


def citation_report(answers: DataFrame, known: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """Resolution of each answer's citations: key, cited, resolved, unresolved, uncited, precision, coverage.

    ``known`` has key and evidence_id.  A ratio without a base is 1.
    """
    cited = answers.select(key, F.explode(citations(F.col(text))).alias("evidence_id")).distinct()
    known = known.select(key, "evidence_id").distinct()
    both = cited.withColumn("c", F.lit(1)).join(known.withColumn("k", F.lit(1)), [key, "evidence_id"], "full_outer")
    n = lambda x: F.count_if(x)
    is_c, is_k = F.col("c").isNotNull(), F.col("k").isNotNull()
    counts = both.groupBy(key).agg(n(is_c).alias("cited"), n(is_c & is_k).alias("resolved"), n(is_c & ~is_k).alias("unresolved"), n(is_k & ~is_c).alias("uncited"))
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    full = answers.select(key).distinct().join(counts, key, "left").na.fill(0, ["cited", "resolved", "unresolved", "uncited"])
    return full.withColumn("precision", share("resolved", "cited")).withColumn("known", F.col("resolved") + F.col("uncited")).withColumn("coverage", share("resolved", "known")).drop("known")


def malformed_report(answers: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    return answers.select(key, F.explode(malformed_citations(F.col(text))).alias("marker"))


def require_resolved(report: DataFrame) -> DataFrame:
    """The report, or an error at run time if a citation has no evidence."""
    return report.withColumn("unresolved", F.when(F.col("unresolved") > 0, F.raise_error(F.lit("a citation has no evidence")).cast("long")).otherwise(F.col("unresolved")))


def cite(kind: Column, fields: Mapping[str, Column]) -> Column:
    """The printed form of a locator."""
    f = fields
    rows = F.when(f["row_count"] == 1, F.lit("1 row")).otherwise(F.concat(f["row_count"].cast("string"), F.lit(" rows")))
    page = F.when(f["page"].isNotNull(), F.concat(F.lit("page "), f["page"].cast("string")))
    ocr = F.when(f["ocr"].isNotNull(), F.format_string("OCR %.2f", f["ocr"]))
    sep = " › "
    return (
        F.when(kind == "sql", F.concat_ws(sep, f["tables"], rows))
        .when(kind == "spreadsheet", F.concat_ws(sep, f["workbook"], f["sheet"], f["cells"]))
        .when(kind == "scanned", F.concat_ws(sep, f["document"], page, ocr))
        .otherwise(F.concat_ws(sep, f["document"], page, f["section"]))
    )


def footer(answers: DataFrame, known: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """Lines '[E1] citation' of the evidence that each answer cites, in the order of ids: key, footer.

    ``known`` has key, evidence_id and citation.
    """
    cited = answers.select(key, F.explode(citations(F.col(text))).alias("evidence_id")).distinct()
    number = F.substring("evidence_id", 2, 20).cast("long")
    lines = cited.join(known.select(key, "evidence_id", "citation"), [key, "evidence_id"]).withColumn("line", F.struct(number.alias("n"), F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.col("citation")).alias("t")))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x["t"]), "\n").alias("footer"))


def rendered(numbered: DataFrame, floor: float = LOW_CONFIDENCE) -> DataFrame:
    """One text per source of its numbered evidence, weak evidence marked: source_type, text."""
    mark = F.when(F.col("confidence") < floor, F.lit(" \u26a0 low confidence")).otherwise(F.lit(""))
    line = F.struct(F.substring("evidence_id", 2, 20).cast("long").alias("n"), F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.col("content"), mark).alias("t"))
    return numbered.groupBy("source_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))


#: A step over a sheet cites its rows if it has this many at most, else one summary.
CITED_ROWS = 25


def sheet_evidence(rows: DataFrame, step: str = "step") -> DataFrame:
    """Evidence of steps over sheets: step, locator, row_count.

    ``rows`` has step, _workbook, _sheet and _a1_range (null where lineage is lost).  A
    step whose rows all have lineage and are few is cited row by row, another one by one
    summary without a range.
    """
    sizes = rows.groupBy(step).agg(F.count("*").alias("row_count"), F.count("_a1_range").alias("placed"), F.min("_workbook").alias("_workbook"), F.min("_sheet").alias("_sheet"))
    each = (F.col("placed") == F.col("row_count")) & (F.col("row_count") <= CITED_ROWS)
    single = rows.join(sizes.where(each).select(step), step, "left_semi").select(step, F.concat_ws("!", "_workbook", "_sheet", "_a1_range").alias("locator"), F.lit(1).cast("long").alias("row_count"))
    summary = sizes.where(~each).select(step, F.concat_ws("!", "_workbook", "_sheet").alias("locator"), "row_count")
    return single.unionByName(summary)
