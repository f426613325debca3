"""Stores that change: published tables, chunks in buckets, the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import search, sparse
from factloom.queries.texts import QUESTION, bm25_sql
from factloom.session import new_folder, table
from factloom.sources.commits import Publication
from factloom.sources.documents import ChunkStore, IndexManifest, index_documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("source_type"), F.coalesce("text", F.lit("")).alias("text"))


def _changed_store(spark: SparkSession, d: str) -> ChunkStore:
    """All documents; then, in one version, every eleventh goes and every seventh comes with another text."""
    store, chunks = ChunkStore(spark, new_folder(spark, "chunks")), _chunks(spark, d)
    store.add(chunks)
    store.replace(chunks.where("id % 11 = 0"), chunks.where("id % 7 = 0").withColumn("text", F.concat(F.lit("changed "), F.col("text"))))
    return store


_LIVE = "select doc_id as id, coalesce(lang, '') as source_type, case when doc_id % 7 = 0 then 'changed ' else '' end || coalesce(text, '') as text from documents where doc_id % 11 <> 0 or doc_id % 7 = 0"


@query(f"select id, cast(id as varchar) as doc_id, source_type, sha256(text) as digest from ({_LIVE})")
def chunk_store_live(spark: SparkSession, d: str) -> DataFrame:
    return _changed_store(spark, d).chunks().select("id", "doc_id", "source_type", F.sha2("text", 256).alias("digest"))


@query(f"select count(*) as total, count(*) as counted, true as same_signature, true as compacted_signature from ({_LIVE})")
def chunk_store_total(spark: SparkSession, d: str) -> DataFrame:
    """The store's own number of chunks and signature, which changes kept up to date, beside those of a store made anew."""
    store = _changed_store(spark, d)
    live = store.chunks()  # of this version, whatever is compacted later
    anew = ChunkStore(spark, new_folder(spark, "anew"))
    anew.add(live)
    before = store.signature()
    store.compact(1)
    kept = store.signature() == before and store.chunks().count() == store.total()
    return live.agg(F.lit(store.total()).alias("total"), F.count("*").alias("counted"), F.lit(anew.signature() == before).alias("same_signature"), F.lit(kept).alias("compacted_signature"))


@query("""with d as (select doc_id, doc_id % 5 as k from documents)
    select 'added' as state, count(*) as n from d where k = 1 union all select 'updated', count(*) from d where k = 2 union all select 'skipped', count(*) from d where k in (3, 4)
    union all select 'removed', count(*) from d where k = 0 union all select 'chunks', count(*) from d where k <> 0""")
def store_reindexed(spark: SparkSession, d: str) -> DataFrame:
    """Documents are indexed twice: of five, one goes, one comes, one changes and two stay."""
    store, manifest = ChunkStore(spark, new_folder(spark, "indexed")), IndexManifest(spark, new_folder(spark, "manifest"))
    base = _chunks(spark, d).withColumn("k", F.col("id") % 5)
    hashed = lambda df: df.select("id", "doc_id", "source_type", "text", F.sha2("text", 256).alias("content_hash"))
    chunked = lambda df: df.select("id", "doc_id", "source_type", "text")
    index_documents(store, manifest, hashed(base.where("k <> 1")), chunked)
    second = base.where("k <> 0").withColumn("text", F.when(F.col("k") == 2, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    found = index_documents(store, manifest, hashed(second), chunked)
    return spark.createDataFrame([*found.items(), ("chunks", store.total())], "state string, n long")


@query("""select 'books' as owner, 'orders_by_status' as name, 'first' as generation, count(distinct o_orderstatus) as n_rows from orders
    union all select 'books', 'parts', 'first', count(*) from part union all select 'maps', 'nations', 'second', count(*) from nation""")
def published_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two tables are published; a second generation fails in its second table and changes nothing; another owner's tables are replaced."""
    held = Publication(spark, new_folder(spark, "published"))
    by_status = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    parts, nations = table(spark, d, "part"), table(spark, d, "nation")
    held.publish("books", "first", {"orders_by_status": by_status, "parts": parts})
    held.publish("maps", "first", {"nations": nations.limit(1), "regions": table(spark, d, "region")})
    try:
        held.publish("books", "second", {"orders_by_status": by_status.limit(1), "parts": parts.withColumn("p_size", F.raise_error(F.lit("broken")).cast("int"))})
    except Exception as error:
        if "broken" not in str(error):
            raise
    held.publish("maps", "second", {"nations": nations})
    out = None
    for name, t in sorted(held.tables().items()):
        n = held.table(name).agg(F.lit(t["owner"]).alias("owner"), F.lit(name).alias("name"), F.lit(t["generation"]).alias("generation"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


QUESTIONS = (QUESTION, "und der die nicht schaft", "que les dans tion une une")


@query(" union all ".join(f"select * from (with {bm25_sql(q)} select {i} as question, doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from scored where score > 0 order by score desc, doc_id limit 20)" for i, q in enumerate(QUESTIONS)))
def indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The index is written once; every question reads the index alone."""
    base = f"{new_folder(spark, 'index')}/index"
    sparse.write_index(table(spark, d, "documents").select("doc_id", "text"), base, "")
    index, out = sparse.read_index(spark, base), None
    for i, question in enumerate(QUESTIONS):
        hits = index.search(sparse.query_terms(spark, question), 20).select(F.lit(i).alias("question"), "doc_id", F.round("score", 6).alias("score"), "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


_SCORE = "case when doc_id % 5 = 0 then null when doc_id % 7 = 0 then 0.0 else (doc_id % 10) / 10.0::double end"
_SOURCE = "case when doc_id % 3 = 0 then 'scanned' else 'policy' end"
_VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(map(str, _VECTOR)) + "]::double[]"


def _searched(spark: SparkSession, d: str) -> ChunkStore:
    """Documents that have a vector, two of three as policies and the others as scans of five claims."""
    i = F.col("doc_id")
    scanned = i % 3 == 0
    score = F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, F.lit(float("nan"))).otherwise((i % 10) / 10.0)
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunks = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")), "doc_id").select(
        i.cast("string").alias("id"), F.concat(F.lit("doc"), (i % 50).cast("string")).alias("doc_id"), F.when(scanned, "scanned").otherwise("policy").alias("source_type"), F.concat(F.lit("CLM-"), (i % 5).cast("string")).alias("claim_id"),
        F.concat(F.lit("file"), (i % 50).cast("string"), F.lit(".txt")).alias("doc_name"), (i % 9 + 1).cast("int").alias("page"), F.when(i % 4 == 0, F.concat(F.lit("Clause "), (i % 8).cast("string"))).alias("clause_id"),
        F.when(i % 4 == 1, "General").alias("section"), F.when(scanned, score).alias("ocr_confidence"), "text", "embedding",
    )
    store = ChunkStore(spark, new_folder(spark, "searched"))
    store.add(chunks)
    return store


@query(f"""with documents as (select d.doc_id, d.text, d.lang, e.embedding from main.documents d join embeddings e on e.vec_id = d.doc_id), {bm25_sql(QUESTION)},
    policy as (select doc_id, list_cosine_similarity(embedding::double[], {_VECTOR_SQL}) as c, cast(doc_id as varchar) as id from documents where {_SOURCE} = 'policy'),
    dense as (select id, row_number() over (order by c desc, id) as r from policy order by c desc, id limit 20),
    sparse as (select p.id, row_number() over (order by s.score desc, p.id) as r from scored s join policy p using (doc_id) where s.score > 0 order by s.score desc, p.id limit 20),
    fused as (select id, coalesce(1.0::double / (60 + dense.r), 0) + coalesce(1.0::double / (60 + sparse.r), 0) as f from dense full join sparse using (id)),
    best as (select id, row_number() over (order by f desc, id) as rank from fused order by f desc, id limit 10)
    select 'policy' as source_type, 'doc' || doc_id % 50 as source_id, concat_ws(' › ', 'file' || doc_id % 50 || '.txt', 'page ' || (doc_id % 9 + 1), case when doc_id % 4 = 0 then 'Clause ' || doc_id % 8 when doc_id % 4 = 1 then 'General' end) as locator,
        1.0::double as confidence, b.id as chunk_id, cast(b.rank as bigint) as rank from best b join policy p on p.id = b.id""")
def policy_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of the policies, whatever source the caller's filter names."""
    found = search.PolicySearch(_searched(spark, d), lambda _: _VECTOR, reranked=False).search(QUESTION, {"source_type": "scanned"}, 10)
    return found.select("source_type", "source_id", "locator", "confidence", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with s as (select d.doc_id, cast(d.doc_id as varchar) as id, coalesce(d.text, '') as text, list_cosine_similarity(e.embedding::double[], {_VECTOR_SQL}) as c, coalesce({_SCORE}, 0.0) as score from documents d join embeddings e on e.vec_id = d.doc_id where d.doc_id % 3 = 0 and d.doc_id % 5 in (1, 2, 0)),
    r as (select *, row_number() over (partition by doc_id % 5 order by c desc, id) as rank from s)
    select 'CLM-' || doc_id % 5 as claim_id, 'doc' || doc_id % 50 as source_id, concat_ws(' › ', 'file' || doc_id % 50 || '.txt', 'page ' || (doc_id % 9 + 1), printf('OCR %.2f', score)) as locator, score as confidence, id as chunk_id, rank from r where rank <= 5""")
def scanned_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Dense search of the scans of three claims, one after another."""
    searcher, out = search.ScannedSearch(_searched(spark, d), lambda _: _VECTOR, mode="dense", reranked=False), None
    for claim in ("CLM-0", "CLM-1", "CLM-2"):
        found = searcher.search(QUESTION, claim).select(F.lit(claim).alias("claim_id"), "source_id", "locator", "confidence", "chunk_id", F.col("rank").cast("long").alias("rank"))
        out = found if out is None else out.unionByName(found)
    return out


@query("""with r as (select o_custkey % 500 as step, row_number() over (partition by o_custkey % 500 order by o_orderkey) as n, [cast(o_orderkey as varchar), o_orderstatus, case when o_orderkey % 3 = 0 then repeat('x', cast(o_orderkey % 200 as integer)) end] as cells from orders where o_custkey % 500 <> 7),
    s as (select distinct o_custkey % 500 as step from orders union select 7),
    c as (select step, count(*) as row_count, string_agg(case when n <= 50 then array_to_string(list_transform(cells, lambda x: case when length(x) > 120 then substring(x, 1, 120) || '...' else coalesce(x, '') end), ' | ') end, chr(10) order by n) as lines from r group by 1)
    select s.step, 'sql' as source_type, 'orders' as source_id, coalesce(row_count, 0) as row_count, concat_ws(' › ', 'orders, customer', case when row_count = 1 then '1 row' else coalesce(row_count, 0) || ' rows' end) as locator,
        sha256(case when row_count is null then 'Orders of step ' || s.step || chr(10) || 'No rows. The query returned no rows.'
            else 'Orders of step ' || s.step || chr(10) || 'o_orderkey | o_orderstatus | note' || chr(10) || lines || chr(10) || case when row_count > 50 then '... ' || row_count || ' rows in total; the first 50 are shown.' else '(' || row_count || ' rows)' end end) as digest
    from s left join c on c.step = s.step""")
def sql_step_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Five hundred steps over all orders, each one evidence; step 7 found nothing."""
    orders = table(spark, d, "orders").withColumn("step", F.col("o_custkey") % 500)
    note = F.when(F.col("o_orderkey") % 3 == 0, F.repeat(F.lit("x"), (F.col("o_orderkey") % 200).cast("int")))
    n = F.row_number().over(Window.partitionBy("step").orderBy("o_orderkey"))
    rows = orders.where("step <> 7").select("step", n.alias("n"), F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", note).alias("cells"))
    steps = orders.select("step").distinct().union(spark.range(7, 8)).distinct().select(
        "step", F.concat(F.lit("Orders of step "), F.col("step").cast("string")).alias("purpose"), F.lit("orders").alias("table"), F.lit("orders, customer").alias("tables"), F.array(*map(F.lit, ("o_orderkey", "o_orderstatus", "note"))).alias("columns"), F.lit(None).cast("string").alias("failure")
    )
    return search.step_evidence(steps, rows).select("step", "source_type", "source_id", "row_count", "locator", F.sha2("content", 256).alias("digest"))
