"""Scoped searches over a chunk store that answer with evidence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import cosine, terms
from factloom.operators.evidence import cite
from factloom.operators.ranking import RRF_K, rrf
from factloom.operators.retrieval import DENSE_K, RERANK_POOL, SPARSE_K, dense_search, rerank, where
from factloom.operators.sparse import SparseIndex

#: Confidence of a scanned chunk whose recognition wasn't scored: the reading that makes an answer qualify it.
UNSCORED = 0.0
RESULTS = 5

# What a step over the database shows of its rows.
SHOWN_ROWS, SHOWN_CHARS = 50, 120


class EmptyIndex(RuntimeError):
    """Nothing is indexed, which isn't the same as that nothing was found."""


def hybrid(chunks: DataFrame, index: SparseIndex, question: str, vector: Sequence[float], limit: int, filters: Mapping[str, object] | None = None, dense_k: int = DENSE_K, sparse_k: int = SPARSE_K, k: int = RRF_K) -> DataFrame:
    """Fused hits of both searches within a filter: id, rrf_score, score (cosine), rank.

    The sparse side scores over the whole index and is filtered then, as its statistics are those of all chunks.
    """
    inside = chunks.where(where(filters))
    dense = dense_search(inside, vector, dense_k, "id", "embedding")
    sparse = index.search(index.terms_of(question), sparse_k, inside.select("id") if filters else None)
    fused = rrf([dense, sparse], "id", k).orderBy(F.desc("rrf_score"), "id").limit(limit)
    q = F.array(*[F.lit(float(x)) for x in vector])
    return fused.join(chunks.select("id", "embedding"), "id").select("id", "rrf_score", cosine(F.col("embedding"), q).alias("score"))


def retrieve(chunks: DataFrame, index: SparseIndex | None, question: str, vector: Sequence[float], limit: int = RESULTS, mode: str = "hybrid", reranked: bool = True, filters: Mapping[str, object] | None = None, pool: int = RERANK_POOL) -> DataFrame:
    """The best chunks (all columns, score and rank from 1) by one mode, dense or hybrid, reranked or not.

    A rerank looks at ``pool`` candidates, or ``limit`` if that is more.  Hybrid without an index and an unknown mode are errors.
    """
    width = max(pool, limit) if reranked else limit
    if mode == "hybrid":
        if index is None:
            raise ValueError("hybrid retrieval needs an index")
        hits = hybrid(chunks, index, question, vector, width, filters)
    elif mode == "dense":
        hits = dense_search(chunks.where(where(filters)), vector, width, "id", "embedding").withColumn("rrf_score", F.col("score"))
    else:
        raise ValueError(f"no such mode of retrieval: {mode}")
    hits = hits.select("id", "rrf_score", "score")
    if reranked:
        best = rerank(hits, chunks, question, limit, "id").withColumn("_order", F.struct(-F.col("rerank_score"), -F.col("rrf_score"), "id"))
    else:
        best = hits.withColumn("_order", F.struct(-F.col("rrf_score"), F.lit(0.0), "id"))
    # at most ``limit`` rows
    placed = best.agg(F.array_sort(F.collect_list(F.struct("_order", "id", "score"))).alias("r")).select(F.posexplode("r").alias("p", "r"))
    return placed.select(F.col("r.id").alias("id"), F.col("r.score").alias("score"), (F.col("p") + 1).alias("rank")).join(chunks, "id")


@dataclass
class ChunkSearcher:
    """Searches one source of a store.

    ``embed`` gives the vector of a question.  The source is put into the filter last, so that no caller can
    search another one: a search of policies that returned a scanned page would cite it as a clause.
    """

    store: object
    embed: Callable[[str], Sequence[float]]
    mode: str = "hybrid"
    reranked: bool = True
    source_type: str = field(default="policy", init=False)

    def _hits(self, question: str, filters: Mapping[str, object] | None, limit: int) -> DataFrame:
        if not question.strip():
            raise ValueError("the question is empty")
        if self.store.total() == 0:
            raise EmptyIndex("nothing is indexed, so the documents can't answer; that is no evidence that they are silent")
        scoped = {**(filters or {}), "source_type": self.source_type}
        index = self.store.healed_index() if self.mode == "hybrid" else None
        return retrieve(self.store.chunks(), index, question, self.embed(question), limit, self.mode, self.reranked, scoped)

    def _evidence(self, hits: DataFrame, place, confidence) -> DataFrame:
        """source_type, source_id, content, locator, confidence, chunk_id, rank."""
        return hits.select("source_type", F.col("doc_id").alias("source_id"), F.col("text").alias("content"), place.alias("locator"), confidence.alias("confidence"), F.col("id").alias("chunk_id"), "rank")


@dataclass
class PolicySearch(ChunkSearcher):
    """Chunks (with doc_name, page, clause_id, section) as policy evidence; its text is what the document says, so confidence is 1."""

    def __post_init__(self):
        self.source_type = "policy"

    def search(self, question: str, filters: Mapping[str, object] | None = None, limit: int = RESULTS) -> DataFrame:
        hits = self._hits(question, filters, limit)
        place = cite(F.lit("policy"), {"document": F.col("doc_name"), "page": F.col("page"), "section": F.coalesce("clause_id", "section"), "ocr": F.lit(None).cast("double"), "tables": F.lit(""), "row_count": F.lit(0), "workbook": F.lit(""), "sheet": F.lit(""), "cells": F.lit("")})
        return self._evidence(hits, place, F.lit(1.0))


@dataclass
class ScannedSearch(ChunkSearcher):
    """Chunks (with doc_name, page, ocr_confidence) as scanned evidence, of one claim on demand; a chunk without a page can't be cited and is an error at run time."""

    def __post_init__(self):
        self.source_type = "scanned"

    def search(self, question: str, claim_id: str | None = None, filters: Mapping[str, object] | None = None, limit: int = RESULTS) -> DataFrame:
        scoped = {**(filters or {}), **({} if claim_id is None else {"claim_id": claim_id})}
        hits = self._hits(question, scoped, limit)
        score = F.coalesce(F.nanvl(F.col("ocr_confidence"), F.lit(UNSCORED)), F.lit(UNSCORED))
        page = F.coalesce(F.col("page"), F.raise_error(F.concat(F.lit("a scanned chunk has no page: "), F.col("id"))).cast("int"))
        place = cite(F.lit("scanned"), {"document": F.col("doc_name"), "page": page, "section": F.lit(""), "ocr": score, "tables": F.lit(""), "row_count": F.lit(0), "workbook": F.lit(""), "sheet": F.lit(""), "cells": F.lit("")})
        return self._evidence(hits, place, score)


def step_evidence(steps: DataFrame, rows: DataFrame, shown: int = SHOWN_ROWS, chars: int = SHOWN_CHARS) -> DataFrame:
    """Evidence of steps over the database, one of each step: step, source_type, source_id, content, locator, row_count, confidence.

    ``steps`` has step, purpose, table, tables (text), columns (array) and failure; ``rows`` has step, n (the place of the row, from 1)
    and cells (array of text).  The content is the purpose, the columns and the first rows, long cells
    cut; a step without rows is a finding too.  Of each step at most ``shown`` rows meet.
    """
    cell = lambda c: F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(F.coalesce(c, F.lit("")))
    line = F.struct("n", F.array_join(F.transform("cells", cell), " | ").alias("line"))
    counts = rows.groupBy("step").agg(F.count("*").alias("row_count"))
    first = rows.where(F.col("n") <= shown).groupBy("step").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    known = steps.join(counts, "step", "left").join(first, "step", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)).cast("long"))
    header = F.coalesce(F.nullif(F.col("purpose"), F.lit("")), F.lit("Claims database query"))
    none = F.concat(header, F.lit("\nNo rows. "), F.coalesce(F.nullif(F.col("failure"), F.lit("")), F.lit("The query returned no rows.")))
    last = F.when(F.col("row_count") > shown, F.concat(F.lit("... "), F.col("row_count").cast("string"), F.lit(f" rows in total; the first {shown} are shown."))).otherwise(F.concat(F.lit("("), F.col("row_count").cast("string"), F.lit(" rows)")))
    some = F.concat_ws("\n", header, F.array_join("columns", " | "), F.array_join("lines", "\n"), last)
    place = cite(F.lit("sql"), {"tables": F.col("tables"), "row_count": F.col("row_count"), "page": F.lit(None).cast("int"), "ocr": F.lit(None).cast("double"), "document": F.lit(""), "section": F.lit(""), "workbook": F.lit(""), "sheet": F.lit(""), "cells": F.lit("")})
    return known.select("step", F.lit("sql").alias("source_type"), F.col("table").alias("source_id"), F.when(F.col("row_count") == 0, none).otherwise(some).alias("content"), place.alias("locator"), "row_count", F.lit(1.0).alias("confidence"))


def hashed_embedding(text, width: int = 64):
    """A stand-in for an embedder, as a column: how many terms fall in each of ``width`` cells, with signs; no model."""
    cells = F.transform(terms(F.coalesce(text, F.lit(""))), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(width)).alias("cell"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.when(c["cell"] == i, c["sign"]).otherwise(0.0)))
