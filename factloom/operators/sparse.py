"""A stored sparse index that skips what can't be among the best.

Documents are dealt to ranges of about RANGE_DOCS by their hash.  A row of the index is a block:
the postings of one term in one range, with the greatest weight among them.  A file has the blocks of
some ranges, sorted by term, so that the statistics of its row groups and pages prune all but a question's terms.
Only the texts are dealt out, by range; the postings, several times as large, are made where they are written.

A search reads the blocks' greatest weights first.  For each range their sum (times the terms'
rarity) bounds every score in it, and the greatest alone is reached by some document there.  So the k-th
greatest of the latter, over the ranges, is reached by k documents, and ranges whose bound
is lower are skipped with all their postings.  The result is that of scoring everything.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import stems
from factloom.functions.stems import stem
from factloom.functions.text import terms
from factloom.operators.ranking import ranked
from factloom.operators.retrieval import K1, SCORE_DIGITS, B

INDEX_VERSION = 4
#: Documents of a range on average.
RANGE_DOCS = 64
#: Terms of the texts that one task cuts and one file holds, on average: what is sorted at a time doesn't grow with the corpus.
TASK_TERMS = 2_000_000


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's frequency in a document of ``dl`` terms counts, between 0 and 1."""
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass(frozen=True)
class SparseIndex:
    """blocks: term, range, greatest, postings (array of key, tf, dl), n (of them); dictionary: term, df; sizes: n_docs, avgdl."""

    blocks: DataFrame
    dictionary: DataFrame
    n_docs: int
    avgdl: float
    signature: str
    key: str
    stemmed: bool

    def terms_of(self, question: str) -> list[str]:
        """The terms of a question, stemmed if the index is."""
        return query_terms(self.blocks.sparkSession, question, self.stemmed)

    def idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(self.n_docs) - df + 0.5) / (df + 0.5))

    def _asked(self, query: Sequence[str]) -> DataFrame:
        """term, rarity (idf times how often it is asked), of the query's terms that occur: a row for each, so it is broadcast."""
        times = F.create_map(*[x for t in dict.fromkeys(query) for x in (F.lit(t), F.lit(query.count(t)))])
        found = self.dictionary.where(F.col("term").isin(*dict.fromkeys(query)))
        return F.broadcast(found.select("term", (self.idf(F.col("df")) * times[F.col("term")]).alias("rarity")))

    def kept_ranges(self, query: Sequence[str], k: int) -> DataFrame:
        """The ranges (range) that may hold one of the k best: from terms, ranges and greatest weights alone."""
        heads = self.blocks.where(F.col("term").isin(*dict.fromkeys(query))).select("term", "range", "greatest").join(self._asked(query), "term")
        bounds = heads.groupBy("range").agg(F.sum(F.col("rarity") * F.col("greatest")).alias("most"), F.max(F.col("rarity") * F.col("greatest")).alias("reached"))
        # of k ranges the least 'reached'; with fewer than k ranges nothing can be skipped
        enough = bounds.orderBy(F.desc("reached")).limit(k).agg(F.when(F.count("*") == k, F.min("reached")).otherwise(F.lit(0.0)).alias("enough"))
        return bounds.crossJoin(F.broadcast(enough)).where(F.col("most") >= F.col("enough") * (1 - 1e-12)).select("range")  # one row

    def scores(self, query: Sequence[str], k: int | None = None) -> DataFrame:
        """Scores (key, score) of all documents with a term of the query, or of those in ranges that may hold one of the k best."""
        if not query:
            return self.blocks.sparkSession.createDataFrame([], f"{self.key} {self._key_type()}, score double")
        blocks = self.blocks.where(F.col("term").isin(*dict.fromkeys(query)))
        if k is not None:
            blocks = blocks.join(self.kept_ranges(query, k), "range", "left_semi")
        rows = blocks.join(self._asked(query), "term").select("rarity", F.explode("postings").alias("p"))
        part = F.col("rarity") * weight(F.col("p.tf"), F.col("p.dl"), F.lit(self.avgdl))
        return rows.groupBy(F.col(f"p.{self.key}").alias(self.key)).agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))

    def _key_type(self) -> str:
        return self.blocks.schema["postings"].dataType.elementType[self.key].dataType.simpleString()

    def search(self, query: Sequence[str], limit: int, allowed: DataFrame | None = None) -> DataFrame:
        """The best documents by BM25 with rank.  ``allowed`` (key) restricts them after scoring; then nothing is skipped, as the best may be elsewhere."""
        if allowed is None:
            return ranked(self.scores(query, limit).where("score > 0"), "score", self.key, limit)
        kept = self.scores(query).join(allowed.select(self.key).distinct(), self.key, "left_semi")
        return ranked(kept.where("score > 0"), "score", self.key, limit)


def query_terms(spark: SparkSession, question: str, stemmed: bool = False) -> list[str]:
    """The terms of a question as an index has them, repeats included."""
    found = spark.range(1).select(terms(F.lit(question)).alias("t")).first().t
    return [stem(t) for t in found] if stemmed else found


def write_index(chunks: DataFrame, base: str, signature: str, key: str = "doc_id", text: str = "text", stemmed: bool = False) -> None:
    """Write the index of chunks under ``base``: blocks, dictionary and, last, meta.  Texts are cut into terms twice, first for their lengths; terms are stemmed on demand."""
    spark = chunks.sparkSession
    cut = lambda df, *more: df.select(key, *more, F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("t"))
    lengths = cut(chunks).select(key, F.size("t").alias("dl")).groupBy(key).agg(F.first("dl").alias("dl"))
    sizes = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("n_terms")).first()
    ranges = max(1, -(-sizes.n_docs // RANGE_DOCS))
    tasks = max(min(ranges, spark.sparkContext.defaultParallelism), -(-(sizes.n_terms or 0) // TASK_TERMS))
    in_range = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(ranges)).cast("long").alias("range")
    # a document's terms are counted, and a range's blocks made, in the task that has its texts
    dealt = chunks.select(key, text, in_range).repartition(tasks, "range")
    counted = cut(dealt, "range").select(key, "range", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "range", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    if stemmed:  # stems are joined by term, so the ranges come together again
        counted = stems.stemmed(counted, key).select(key, "dl", "term", "tf", in_range).repartition(tasks, "range")
    blocks = counted.groupBy("term", "range").agg(F.max(weight(F.col("tf"), F.col("dl"), F.lit(sizes.avgdl or 0.0))).alias("greatest"), F.array_sort(F.collect_list(F.struct(key, "tf", "dl"))).alias("postings"))
    blocks = blocks.withColumn("n", F.size("postings"))
    blocks.sortWithinPartitions("term", "range").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{base}/blocks")
    written = spark.read.schema(blocks.schema).parquet(f"{base}/blocks")
    written.groupBy("term").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{base}/dictionary")
    meta = {"version": INDEX_VERSION, "signature": signature, "n_docs": sizes.n_docs, "avgdl": sizes.avgdl or 0.0, "key": key, "stemmed": stemmed}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/meta")


def read_index(spark: SparkSession, base: str) -> SparseIndex | None:
    """The index under ``base``; None if there is none, it can't be read or another version wrote it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/meta/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    line = spark.read.text(f"{base}/meta").first()
    try:
        meta = json.loads(line.value) if line else None
    except ValueError:
        return None
    if not isinstance(meta, Mapping) or meta.get("version") != INDEX_VERSION:
        return None
    return SparseIndex(spark.read.parquet(f"{base}/blocks"), spark.read.parquet(f"{base}/dictionary"), meta["n_docs"], meta["avgdl"], meta["signature"], meta["key"], meta["stemmed"])
