"""Sparse, dense and hybrid retrieval over chunks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import cosine, terms
from factloom.operators.ranking import RRF_K, ranked, rrf
from factloom.session import settled

# The usual constants of BM25.
K1 = 1.5
B = 0.75
DENSE_K = SPARSE_K = 20
#: Digits of a score that count: sums in another order differ in the last ones, which mustn't decide a tie.
SCORE_DIGITS = 9
RERANK_POOL = 40
#: Columns that a search may be restricted by.
FILTERABLE = ("source_type", "doc_id", "claim_id", "lang", "source")


def where(filters: Mapping[str, object] | None) -> Column:
    """The conjunction of equalities and memberships; an empty list and an unknown column are errors."""
    out = F.lit(True)
    for name, wanted in (filters or {}).items():
        if name not in FILTERABLE:
            raise ValueError(f"cannot filter by {name}")
        if isinstance(wanted, (list, tuple, set)):
            if not wanted:
                raise ValueError(f"no values for {name}")
            out = out & F.col(name).isin(*wanted)
        else:
            out = out & (F.col(name) == wanted)
    return out


def postings(chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sparse index: key, term, tf, dl (terms of the chunk)."""
    split = chunks.select(key, terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return split.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, sizes: DataFrame, query: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Scores over the whole corpus: key, score.

    ``index`` are postings, ``sizes`` one row (n_docs, avgdl).  The query's terms are
    pushed to the scan of the postings; their document frequencies come from the same
    few rows; a filter on documents has to come after scoring, or the scores change.
    """
    if not query:  # a question of stop words alone finds nothing
        return index.where(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    hits = index.where(F.col("term").isin(*query))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weights = {t: query.count(t) for t in query}
    times = F.create_map(*[x for t, n in weights.items() for x in (F.lit(t), F.lit(n))])
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(sizes))  # df: one row per query term; sizes: one row
    return scored.groupBy(key).agg(F.round(F.sum(times[F.col("term")] * idf * weight), SCORE_DIGITS).alias("score"))


def corpus_sizes(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(n_docs, avgdl) of all chunks."""
    return chunks.select(F.size(terms(F.coalesce(F.col(text), F.lit("")))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def sparse_search(chunks: DataFrame, query: str, limit: int, key: str = "doc_id", text: str = "text", filters: Mapping[str, object] | None = None) -> DataFrame:
    """The best chunks by BM25 with rank: statistics over all chunks, filter after scoring.

    Texts are cut into terms once; what is kept of each is its number of terms and those that are asked for.  A store that is searched often has
    an index (``operators.sparse``).
    """
    spark = chunks.sparkSession
    wanted = spark.range(1).select(terms(F.lit(query)).alias("t")).first().t
    cut = chunks.select(key, terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    counted = settled(cut.select(key, F.size("t").alias("dl"), (F.filter("t", lambda t: t.isin(*wanted)) if wanted else F.array().cast("array<string>")).alias("hits")))
    found = counted.select(key, "dl", F.explode("hits").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    sizes = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    scores = bm25(found, sizes, wanted, key)
    if filters:
        scores = scores.join(chunks.where(where(filters)).select(key), key, "left_semi")
    return ranked(scores.where("score > 0"), "score", key, limit)


def dense_search(vectors: DataFrame, query: Sequence[float], limit: int, key: str, vector: str, filters: Mapping[str, object] | None = None) -> DataFrame:
    """The nearest vectors by cosine similarity with rank: one scan and a top-k that each task cuts first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(where(filters)).select(key, cosine(F.col(vector), q).alias("score"))
    return ranked(scored, "score", key, limit)


def hybrid_search(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], limit: int, key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Fusion of both searches: key, rrf_score, similarity.  Hits of the sparse side alone get their similarity too."""
    sparse = sparse_search(chunks, query, SPARSE_K, key)
    dense = dense_search(vectors, query_vector, DENSE_K, key, "embedding")
    fused = rrf([dense, sparse], key, k)
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    best = fused.orderBy(F.desc("rrf_score"), key).limit(limit)
    return best.join(vectors.select(key, "embedding"), key).select(key, "rrf_score", cosine(F.col("embedding"), q).alias("similarity"))


def rerank(hits: DataFrame, chunks: DataFrame, query: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A deterministic stand-in for a cross-encoder: the share of the query's terms in the chunk."""
    wanted = F.array_distinct(terms(F.lit(query)))
    pool = hits.orderBy(F.desc("rrf_score"), key).limit(max(RERANK_POOL, limit))
    scored = pool.join(chunks.select(key, text), key).withColumn("rerank_score", F.size(F.array_intersect(terms(F.col(text)), wanted)) / F.greatest(F.size(wanted), F.lit(1)))
    return scored.orderBy(F.desc("rerank_score"), F.desc("rrf_score"), key).limit(limit).drop(text)


def signature(chunks: DataFrame, key: str = "doc_id", digest: str = "content_hash") -> DataFrame:
    """One row (n_chunks, signature) that changes with any chunk.

    Hashes of hash ranges are combined in their order, so that the list of all
    chunks is never in one place.
    """
    line = F.concat_ws(":", F.col(key).cast("string"), digest)
    parts = chunks.select(line.alias("line"), F.substring(F.sha2(line, 256), 1, 3).alias("bucket"))
    parts = parts.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ","), 256).alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ","), 256).alias("signature"))
