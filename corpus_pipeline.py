"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, written
from factloom.llm.jaccard import similar_components
from factloom.llm.packing import pack
from factloom.llm.quality import judge
from factloom.llm.substrings import remove_repeats


def whole_rows(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the row as one column, so that no name of a table can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the weighed votes reject go."""
    return judge(whole_rows(docs), keep=("_row",)).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 0.8) the document of the smallest id stays."""
    found = similar_components(docs, 5, 80)
    later = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("later_id")).distinct()
    return docs.join(later, docs["doc_id"].eqNullSafe(later["later_id"]), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 words that occur earlier go; a text that keeps no word stays as an empty one."""
    kept = remove_repeats(whole_rows(docs, ("text", "n_chars")), 20, keep=("_row",))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("best-fit packing", sequences)]

#: The votes' weights come from an iteration, so SQL can't express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
