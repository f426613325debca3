"""Retrieval, citations, chunks, manifests and value coercion over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import chunks, text
from factloom.functions import values as cell_values
from factloom.operators import evidence, manifest, ranking, retrieval, structure
from factloom.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

QUESTION = "the tion of ther inthe, and anon"
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?"


def _terms(value: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({value}, '')), '({_WORD})', 1), lambda t: t not in ({_STOPS}))"



def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def bm25_sql(question: str) -> str:
    """Common table expressions that end with ``scored``: doc_id, lang and score of a question."""
    return f"""toks as (select doc_id, lang, {_terms("text")} as ts from documents), sizes as (select count(*) as n_docs, avg(len(ts)) as avgdl from toks),
    posts as (select doc_id, lang, dl, term, count(*) as tf from (select doc_id, lang, len(ts) as dl, unnest(ts) as term from toks) group by all),
    q as (select unnest({_terms(f"'{question}'")}) as term), dfs as (select term, count(*) as df from posts where term in (select term from q) group by 1),
    scored as (select p.doc_id, any_value(p.lang) as lang, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score
        from q join posts p on p.term = q.term join dfs on dfs.term = q.term cross join sizes group by 1)"""


_BM25 = bm25_sql(QUESTION)


@query(f"with {_BM25} select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from scored where score > 0 order by score desc, doc_id limit 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.sparse_search(table(spark, d, "documents"), QUESTION, 20)
    return hits.select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_BM25} select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from scored where score > 0 and lang in ('de', 'fr') order by score desc, doc_id limit 10")
def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.sparse_search(table(spark, d, "documents"), QUESTION, 10, filters={"lang": ["de", "fr"]})
    return hits.select("doc_id", F.round("score", 6).alias("score"), "rank")


_QUERY_VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(map(str, _QUERY_VECTOR)) + "]::double[]"


@query(f"with s as (select vec_id, list_cosine_similarity(embedding::double[], {_VECTOR_SQL}) as c from embeddings) select vec_id, round(c, 6) as score, row_number() over (order by c desc, vec_id) as rank from s order by c desc, vec_id limit 20")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.dense_search(table(spark, d, "embeddings"), _QUERY_VECTOR, 20, "vec_id", "embedding")
    return hits.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_BM25}, dense as (select vec_id as doc_id, row_number() over (order by list_cosine_similarity(embedding::double[], {_VECTOR_SQL}) desc, vec_id) as rank from embeddings order by rank limit 20),
    sparse as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where score > 0 order by rank limit 20)
    select doc_id, round(coalesce(1.0::double / (60 + dense.rank), 0) + coalesce(1.0::double / (60 + sparse.rank), 0), 6) as rrf_score from dense full outer join sparse using (doc_id)""")
def rrf_fused(spark: SparkSession, d: str) -> DataFrame:
    sparse = retrieval.sparse_search(table(spark, d, "documents"), QUESTION, 20)
    dense = retrieval.dense_search(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _QUERY_VECTOR, 20, "doc_id", "embedding")
    return ranking.rrf([dense, sparse], "doc_id").select("doc_id", F.round("rrf_score", 6).alias("rrf_score"))


@query()
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, d, "documents")
    hits = retrieval.hybrid_search(docs, vectors, QUESTION, _QUERY_VECTOR, 40)
    return retrieval.rerank(hits, docs, QUESTION, 5)


_NORMAL = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"with h as (select doc_id, sha256({_NORMAL}) as content_hash from documents) select content_hash, min(doc_id) as first_doc, count(*) as copies from h group by 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").select("doc_id", text.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("""with l as (select doc_id || ':' || sha256(coalesce(text, '')) as line from documents), b as (select substr(sha256(line), 1, 3) as bucket, line from l),
    p as (select bucket, count(*) as n, sha256(string_agg(line, ',' order by line)) as h from b group by 1)
    select cast(sum(n) as bigint) as n_chunks, sha256(string_agg(h, ',' order by bucket)) as signature from p""")
def chunk_signature(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return retrieval.signature(docs)


@query()
def split_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_texts(table(spark, d, "documents")).select("doc_id", "chunk_no", "chunk_id", "content_hash")


_MARKED = "coalesce(text, '') || case when conv_id % 3 = 0 then ' [E' || (turn + 1) || '] and [E00' || (turn + 1) || '] or [E9]' when conv_id % 3 = 1 then ' [E' || turn || '][e2] [known_gaps]' else '' end"


def marked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(_MARKED).alias("text"))


_CITED = f"list_distinct(list_transform(regexp_extract_all({_MARKED}, '\\[E([0-9]+)\\]', 1), lambda x: 'E' || cast(cast(x as bigint) as varchar)))"


@query(f"select conv_id, turn, array_to_string(list_sort({_CITED}), ',') as cited from conversations")
def citations_extract(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("conv_id", "turn", F.array_join(F.array_sort(text.citations(F.col("text"))), ",").alias("cited"))


@query(f"""with c as (select distinct conv_id, unnest({_CITED}) as evidence_id from conversations), k as (select distinct conv_id, 'E' || turn as evidence_id from conversations),
    j as (select coalesce(c.conv_id, k.conv_id) as conv_id, c.evidence_id as c, k.evidence_id as k from c full outer join k on c.conv_id = k.conv_id and c.evidence_id = k.evidence_id)
    select conv_id, count(c) as cited, count(*) filter (where c is not null and k is not null) as resolved, count(*) filter (where c is not null and k is null) as unresolved,
        count(*) filter (where c is null) as uncited, round(case when count(c) = 0 then 1.0 else cast(count(*) filter (where c is not null and k is not null) as double) / count(c) end, 6) as precision,
        round(cast(count(*) filter (where c is not null and k is not null) as double) / count(k), 6) as coverage from j group by 1""")
def citation_report(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("E"), F.col("turn").cast("string")).alias("evidence_id"))
    out = evidence.citation_report(marked(spark, d), known)
    return out.withColumn("precision", F.round("precision", 6)).withColumn("coverage", F.round("coverage", 6))


@query(f"""select conv_id, marker, count(*) as n from (select conv_id, unnest(list_distinct(list_filter(regexp_extract_all({_MARKED}, '(\\[(?:[Ee][^\\[\\]\\n]{{0,12}}|[A-Za-z_][A-Za-z0-9_]*)\\])', 1), lambda m: not regexp_full_match(m, '\\[E[0-9]+\\]')))) as marker from conversations) group by all""")
def citations_malformed(spark: SparkSession, d: str) -> DataFrame:
    return evidence.malformed_report(marked(spark, d)).groupBy("conv_id", "marker").agg(F.count("*").alias("n"))


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of four tables with whole texts and whole pages as content."""
    t = lambda n: table(spark, d, n)
    row = lambda kind, source, place, content, confidence, order: [F.lit(kind).alias("source_type"), source.alias("source_id"), place.cast("string").alias("locator"), content.cast("string").alias("content"), confidence.cast("double").alias("confidence"), order.cast("long").alias("ord")]
    one, c = F.lit(1.0), F.col
    return (
        t("documents").select(*row("policy", c("source"), c("lang"), F.coalesce("text", F.lit("")), one, c("doc_id")))
        .unionByName(t("events").select(*row("sql", F.lit("events"), c("event_type"), c("user_id"), one, c("event_id"))))
        .unionByName(t("labels").select(*row("spreadsheet", F.lit("labels"), c("quality"), c("toxic"), one, c("doc_id"))))
        .unionByName(t("pages").select(*row("scanned", F.lit("pages"), c("url"), c("html"), F.when(c("page_id") % 4 == 0, 0.4).otherwise(0.9), c("page_id"))))
    )


_EVIDENCE = """select 'policy' as source_type, source as source_id, lang as locator, coalesce(text, '') as content, 1.0::double as confidence, doc_id as ord from documents
    union all select 'sql', 'events', event_type, cast(user_id as varchar), 1.0, event_id from events
    union all select 'spreadsheet', 'labels', cast(quality as varchar), cast(toxic as varchar), 1.0, doc_id from labels
    union all select 'scanned', 'pages', url, html, case when page_id % 4 = 0 then 0.4 else 0.9 end, page_id from pages"""
_SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_KEY = f"sha256(source_type || chr(31) || coalesce(source_id, '') || chr(31) || coalesce(locator, '') || chr(31) || sha256(trim(regexp_replace(coalesce(content, ''), '{_SPACE}', ' ', 'g'))))"


@query(f"select {_KEY} as dedup_key, any_value(source_type) as source_type, min(ord) as ord from ({_EVIDENCE}) group by 1")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    """The union with whole texts and pages as content; only digests travel."""
    rows = evidence_rows(spark, d).select(evidence.dedup_key().alias("dedup_key"), "source_type", "ord")
    return evidence.deduplicated(rows).select("dedup_key", "source_type", "ord")


@query(f"""with f as (select {_KEY} as dedup_key, any_value(source_type) as source_type, min(ord) as ord from ({_EVIDENCE}) group by 1)
    select source_type, ord, 'E' || row_number() over (order by case source_type when 'sql' then 0 when 'policy' then 1 else 2 end, ord, source_type) as evidence_id from f""")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence_rows(spark, d).select(evidence.dedup_key().alias("dedup_key"), "source_type", "ord")
    return evidence.canonical(rows, ["sql", "policy"]).select("source_type", "ord", "evidence_id")


@query(f"""with e as ({_EVIDENCE}), f as (select {_KEY} as dedup_key, any_value(source_type) as source_type, arg_min(confidence, ord) as confidence from e group by 1),
    r as (select source_type, count(*) as returned from e group by 1), s as (select source_type, count(*) as kept, count(*) filter (where confidence < 0.6) as low_confidence from f group by 1),
    a as (select unnest(['policy', 'sql', 'spreadsheet', 'scanned', 'archive', 'broken']) as source_type)
    select source_type, coalesce(returned, 0) as returned, coalesce(kept, 0) as kept, coalesce(returned, 0) - coalesce(kept, 0) as duplicates, coalesce(low_confidence, 0) as low_confidence,
        case when source_type = 'broken' then 'failed' when coalesce(kept, 0) = 0 then 'silent' else 'ok' end as status from a left join r using (source_type) left join s using (source_type)""")
def gap_account(spark: SparkSession, d: str) -> DataFrame:
    return evidence.gap_account(evidence_rows(spark, d), *asked_and_failed(spark))


def asked_and_failed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    asked = spark.createDataFrame([(s,) for s in (*evidence.SOURCE_TYPES, "archive", "broken")], "source_type string")
    return asked, spark.createDataFrame([("broken",)], "source_type string")


_MANIFEST = """now as (select doc_id, sha256(coalesce(text, '')) as h from documents where doc_id % 11 <> 0),
    old as (select doc_id, case when doc_id % 5 = 0 then 'other' else sha256(coalesce(text, '')) end as h from documents where doc_id % 7 <> 0)"""


@query(f"""with {_MANIFEST} select coalesce(now.doc_id, old.doc_id) as doc_id, case when now.h is null then 'removed' when old.h is null then 'added'
        when old.doc_id % 13 = 0 then 'inconsistent' when old.h = now.h then 'skipped' else 'updated' end as state from now full outer join old on now.doc_id = old.doc_id""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    now = docs.where("doc_id % 11 <> 0")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.lit(2).alias("chunk_count"))
    stored = old.select("doc_id", F.when(F.col("doc_id") % 13 == 0, 1).otherwise(2).alias("n_chunks"))
    return manifest.manifest_diff(old, now, stored)


_LINES = "select doc_id, line, row_number() over (partition by doc_id order by i) as line_no from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents) where trim(line) <> ''"
_SIGNATURE = "trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))"


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents in pages of 6 lines each."""
    raw = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).where(F.trim("line") != "")
    numbered = raw.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")))
    return numbered.select("doc_id", F.floor((F.col("line_no") - 1) / 6).alias("page"), "line_no", "line")


@query(f"""with l as (select *, (line_no - 1) // 6 as page from ({_LINES})), s as (select *, {_SIGNATURE} as signature, row_number() over (partition by doc_id, page order by line_no) as t, row_number() over (partition by doc_id, page order by line_no desc) as e from l),
    p as (select doc_id, count(distinct page) as pages from l group by 1 having count(distinct page) >= 3), n as (select doc_id, signature, count(distinct page) as n_pages from s where t <= 2 or e <= 2 group by 1, 2)
    select n.doc_id, n.signature, n.n_pages from n join p using (doc_id) where 2 * n_pages >= pages""")
def furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    return manifest.furniture(document_lines(spark, d), 2)


@query(f"""select doc_id, line_no, case (doc_id + line_no) % 7 when 0 then 'markdown' when 1 then 'section' when 2 then 'cover' when 3 then 'clause' else 'capitals' end as kind from ({_LINES})
    where (doc_id + line_no) % 7 < 5 and not ((doc_id + line_no) % 7 = 0 and contains(line, '....'))""")
def heading_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents with marks, some replaced by headings, entries of a table of contents or plain lines."""
    k, no = (F.col("doc_id") + F.col("line_no")) % 7, F.col("line_no").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("## "), "line")).when(k == 1, F.concat(F.lit("Section "), no, F.lit(" - Limits"))).when(k == 2, F.concat(F.lit("- Endorsement "), no))
        .when(k == 3, F.concat(no, F.lit(".2 Escape of water"))).when(k == 4, "GENERAL CONDITIONS").when(k == 5, F.concat(F.lit("SECTION 1 ........ "), no)).otherwise(F.concat(F.lit("see "), "line"))
    )
    found = document_lines(spark, d).select("doc_id", "line_no", text.heading(line).alias("h"))
    return found.where("h is not null").select("doc_id", "line_no", F.col("h.kind").alias("kind"))


@query("""select page_id, case when length(html) / 500000.0 >= 0.0002 * 10 then 'digital' when length(html) / 500000.0 <= 1e-6 * 10 then 'scanned' else 'mixed' end as kind from pages where html is not null""")
def page_density_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where("html is not null").select("page_id", text.page_class(F.length("html"), F.lit(5_000_000.0)).alias("kind"))


@query("""with m as (select unnest(['bilding', 'AUTO MOBILE', 'machinry', 'house hold']) as mention), s as (select distinct c_mktsegment as value from customer),
    g as (select 'm' as k, mention as v, list_distinct(list_transform(range(1, length(mention) + 3), lambda i: substr('  ' || lower(mention) || '  ', i, 3))) as t from m union all
        select 's', value, list_distinct(list_transform(range(1, length(value) + 3), lambda i: substr('  ' || lower(value) || '  ', i, 3))) from s)
    select a.v as mention, b.v as value, round(cast(len(list_intersect(a.t, b.t)) as double) / len(list_distinct(list_concat(a.t, b.t))), 6) as jaccard from g a join g b on a.k = 'm' and b.k = 's'
    where len(list_intersect(a.t, b.t)) > 0""")
def jaccard_trigram(spark: SparkSession, d: str) -> DataFrame:
    mentions = spark.createDataFrame([("bilding",), ("AUTO MOBILE",), ("machinry",), ("house hold",)], "mention string")
    stored = table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).distinct()
    left = mentions.select("mention", F.explode(text.trigrams(F.lower("mention"))).alias("gram"))
    right = stored.select("value", F.explode(text.trigrams(F.lower("value"))).alias("gram"))
    pairs = left.join(right, "gram").select("mention", "value").distinct()
    return pairs.select("mention", "value", F.round(text.trigram_jaccard(F.lower("mention"), F.lower("value")), 6).alias("jaccard"))


@query()
def fuzzy_resolve(spark: SparkSession, d: str) -> DataFrame:
    from factloom.functions.similarity import match_mentions

    mentions = spark.createDataFrame([("bilding",), ("AUTO MOBILE",), ("machinry ltd",), ("unknown thing",)], "mention string")
    stored = table(spark, d, "customer").select(F.lit("c_mktsegment").alias("column_name"), F.col("c_mktsegment").alias("value")).distinct()
    return match_mentions(mentions, stored)


_RAW = """case event_id % 8 when 0 then '$' || cast(cast(round(value, 2) as decimal(18,2)) as varchar) when 1 then '(' || cast(cast(round(value, 2) as decimal(18,2)) as varchar) || ')' when 2 then 'N/A' when 3 then cast(event_id % 100 as varchar) || '%'
    when 4 then 'PKR 1,' || lpad(cast(event_id % 1000 as varchar), 3, '0') when 5 then strftime(ts, '%Y-%m-%d') when 6 then 'yes' else 'n/k?' end"""


@query(f"""with r as (select event_id, event_id % 8 as k, value, {_RAW} as raw from events)
    select event_id, raw, case k when 0 then cast(cast(round(value, 2) as decimal(18,2)) as double) when 1 then -cast(cast(round(value, 2) as decimal(18,2)) as double) when 3 then (event_id % 100)::double when 4 then 1000.0 + event_id % 1000 end as number,
        k in (0, 1, 2, 3, 4) as number_ok, case when k = 3 then round((event_id % 100) / 100.0::double, 6) end as share, case when k = 5 then raw end as day, case when k = 6 then true end as flag from r""")
def coerce_values(spark: SparkSession, d: str) -> DataFrame:
    shown = F.round("value", 2).cast("decimal(18,2)").cast("string")
    k = F.col("event_id") % 8
    raw = (
        F.when(k == 0, F.concat(F.lit("$"), shown)).when(k == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(k == 2, "N/A").when(k == 3, F.concat((F.col("event_id") % 100).cast("string"), F.lit("%")))
        .when(k == 4, F.concat(F.lit("PKR 1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))).when(k == 5, F.date_format("ts", "yyyy-MM-dd")).when(k == 6, "yes").otherwise("n/k?")
    )
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    number = cell_values.decimal(F.regexp_replace("raw", "%$", ""))
    share = F.when(F.contains("raw", F.lit("%")), cell_values.percent(F.col("raw")))
    return rows.select(
        "event_id", "raw", number.cast("double").alias("number"), (number.isNotNull() | cell_values.is_blank(F.col("raw"))).alias("number_ok"),
        F.round(share.cast("double"), 6).alias("share"), cell_values.date(F.col("raw")).cast("string").alias("day"), cell_values.boolean(F.when(k == 6, F.col("raw"))).alias("flag"),
    )


_STAMPED = "case when doc_id % 3 <> 0 and line_no % 6 = 1 then 'Page ' || cast((line_no - 1) // 6 + 1 as bigint) else line end"


@query(f"""with l as (select doc_id, line_no, (line_no - 1) // 6 as page, {_STAMPED} as line from ({_LINES})), s as (select *, {_SIGNATURE} as signature, row_number() over (partition by doc_id, page order by line_no) as t, row_number() over (partition by doc_id, page order by line_no desc) as e from l),
    p as (select doc_id, page, signature, line, unnest(list_filter([case when t <= 2 then t - 1 end, case when e <= 2 then -e end], lambda x: x is not null)) as slot from s)
    select doc_id, signature from p group by 1, 2 having count(distinct slot) = 1 and count(distinct page) >= 3 and count(distinct line) = count(distinct page)""")
def page_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Of two documents in three every page begins with its number."""
    stamp = (F.col("doc_id") % 3 != 0) & (F.col("line_no") % 6 == 1)
    lines = document_lines(spark, d).withColumn("line", F.when(stamp, F.concat(F.lit("Page "), (F.col("page") + 1).cast("long").cast("string"))).otherwise(F.col("line")))
    return manifest.page_stamps(lines, 2)


_SCORE = "case when page_id % 10 = 0 then 1.0 when page_id % 9 = 0 then 0.0 else page_id % 10 / 10.0::double end"


@query(f"""select page_id, {_SCORE} as confidence, case when page_id % 7 = 0 then '[page could not be read]' else 'x' end as kind from pages where {_SCORE} < 0.6""")
def low_confidence_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a score that is a number, NaN (odd multiples of 9) or null (even ones); every tenth page is digital."""
    k = F.col("page_id")
    score = F.when(k % 18 == 0, F.lit(None)).when(k % 9 == 0, F.lit(float("nan"))).otherwise((k % 10) / 10.0)
    text_of, _ = text.scanned_page_text(F.when(k % 7 == 0, " \n-- \n").otherwise("x\n--"), F.lit(1.0))
    return table(spark, d, "pages").select("page_id", text.page_confidence(k % 10 == 0, score).alias("confidence"), text_of.alias("kind")).where("confidence < 0.6")


@query("""with s as (select user_id, event_id, sum(event_id % 7 + 1) over (partition by user_id order by ts, event_id rows unbounded preceding) as total from events)
    select event_id, cast(total as bigint) as total, cast(event_id % 7 + 1 as bigint) as delta from s""")
def state_deltas(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators import usage

    running = F.sum(F.col("event_id") % 7 + 1).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    states = table(spark, d, "events").select("user_id", "event_id", running.cast("long").alias("total"))
    return usage.deltas(states, "user_id", "total", "total").select("event_id", "total", "delta")


@query("""with m as (select case when user_id % 2 = 0 then upper(event_type) else event_type end as value, event_id from events) select arg_min(value, event_id) as value, count(*) as n from m group by lower(value)""")
def first_spellings(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators import usage

    rows = table(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("value"), "event_id")
    return usage.first_spellings(rows, "value", "event_id")


@query("""with a as (select 'q' || (o_custkey % 50) as question, c as candidate, o_orderpriority, case when c = 'cand_c' and o_custkey % 3 = 0 then 'x' else o_orderstatus end as status from orders, (select unnest(['cand_a', 'b', 'cand_c']) as c)),
    k as (select question, candidate, string_agg(o_orderpriority || '|' || status, ',' order by o_orderpriority, status) as answer from a group by 1, 2)
    select question, count(*) as candidates, arg_min(candidate, length(candidate)) as shortest from k group by question, answer""")
def answer_clusters(spark: SparkSession, d: str) -> DataFrame:
    from factloom.operators import usage

    base = table(spark, d, "orders").select(F.concat(F.lit("q"), (F.col("o_custkey") % 50).cast("string")).alias("question"), "o_custkey", "o_orderpriority", "o_orderstatus", F.explode(F.array(F.lit("cand_a"), F.lit("b"), F.lit("cand_c"))).alias("candidate"))
    changed = base.withColumn("status", F.when((F.col("candidate") == "cand_c") & (F.col("o_custkey") % 3 == 0), "x").otherwise(F.col("o_orderstatus")))
    return usage.answer_clusters(changed, "candidate", "question", ["o_orderpriority", "status"]).select("question", "candidates", "shortest")


@query("""with r as (select o_custkey as step, case when o_custkey % 4 = 0 and o_orderkey % 5 = 0 then null else 'A' || o_orderkey || ':D' || o_orderkey end as a from orders),
    z as (select step, count(*) as n, count(a) as placed from r group by 1)
    select r.step, 'book!sheet!' || a as locator, cast(1 as bigint) as row_count from r join z using (step) where n = placed and n <= 25 union all select step, 'book!sheet', n from z where not (n = placed and n <= 25)""")
def sheet_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.sheet_evidence(sheet_rows(spark, d))


def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of one sheet, with the customer as step; some rows have lost their lineage."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("step"), F.lit("book").alias("_workbook"), F.lit("sheet").alias("_sheet"), F.when(~((F.col("o_custkey") % 4 == 0) & (F.col("o_orderkey") % 5 == 0)), F.concat(F.lit("A"), key, F.lit(":D"), key)).alias("_a1_range"))


@query(f"""with c as (select distinct conv_id, unnest({_CITED}) as evidence_id from conversations), k as (select distinct conv_id, 'E' || turn as evidence_id, 'turn ' || turn as citation, turn from conversations)
    select conv_id, string_agg('[' || evidence_id || '] ' || citation, chr(10) order by turn) as footer from c join k using (conv_id, evidence_id) group by 1""")
def citation_footer(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    known = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("E"), turn).alias("evidence_id"), F.concat(F.lit("turn "), turn).alias("citation"))
    return evidence.footer(marked(spark, d), known)


@query("""select doc_id, len(string_split(regexp_replace(coalesce(text, ''), '([.;:])[ \\t]+([0-9]+(\\.[0-9]+)+\\.?[ \\t]+[A-Z])', '\\1' || chr(10) || '\\2', 'g'), chr(10))) as n_lines from (select doc_id, regexp_replace(coalesce(text, ''), '\\. ', '. 4.' || (doc_id % 7) || ' A ', 'g') as text from documents)""")
def unmerged_clauses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), F.lit("\\. "), F.concat(F.lit(". 4."), (F.col("doc_id") % 7).cast("string"), F.lit(" A "))).alias("text"))
    return docs.select("doc_id", F.size(F.split(text.unmerged_clauses(F.col("text")), "\n")).cast("long").alias("n_lines"))


_PLAIN_LINE = "translate(line, '0123456789', '')"
_LEVEL = "(doc_id * 7 + line_no * 3) % 23"


def _structured_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents without digits in pages of six; of 23 lines five are headings of different depths, the others plain."""
    k, no = (F.col("doc_id") * 7 + F.col("line_no") * 3) % 23, F.col("line_no").cast("string")
    line = (
        F.when(k == 0, "## Cover and limits").when(k == 1, F.concat(F.lit("Section "), no, F.lit(" - Limits"))).when(k == 2, F.concat(F.lit("- Endorsement "), no))
        .when(k == 3, F.concat(no, F.lit(".2 Escape of water"))).when(k == 4, "GENERAL CONDITIONS").when(k == 5, F.concat(F.lit("SECTION 1 ........ "), no)).otherwise(F.concat(F.lit("see "), F.translate("line", "0123456789", "")))
    )
    lines = document_lines(spark, d).select("doc_id", F.col("page").cast("int").alias("page"), "line_no", line.alias("line"))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(f"""with l as (select doc_id, (line_no - 1) // 6 as page, line_no, {_LEVEL} as k, line from ({_LINES})),
    h as (select doc_id, page, line_no, k, case k when 0 then 2 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 3 end as depth,
            case k when 0 then 'Cover and limits' when 1 then 'Section ' || line_no || ' - Limits' when 2 then 'Endorsement ' || line_no when 3 then line_no || '.2 Escape of water' when 4 then 'GENERAL CONDITIONS' end as label,
            case k when 1 then 'SECTION ' || line_no when 2 then 'ENDORSEMENT ' || line_no when 3 then line_no || '.2' end as clause,
            case k when 0 then '## Cover and limits' when 5 then 'SECTION 1 ........ ' || line_no else 'see ' || {_PLAIN_LINE} end as plain from l),
    s as (select *, max(case when depth = 2 then line_no end) over w as d2, max(case when depth = 3 then line_no end) over w as d3, max(case when depth = 4 then line_no end) over w as d4,
            max(case when depth is not null or line_no % 6 = 1 then line_no end) over w as block, lead(line_no) over (partition by doc_id, page order by line_no) as next
        from h window w as (partition by doc_id order by line_no)),
    b as (select doc_id, page, block, string_agg(case when k in (1, 2, 3, 4) then label else plain end || case when next is not null then chr(10) else '' end, '' order by line_no) as text,
            min(d2) filter (line_no = block) as d2, min(case when d3 > coalesce(d2, 0) then d3 end) filter (line_no = block) as d3, min(case when d4 > greatest(coalesce(d2, 0), coalesce(d3, 0)) then d4 end) filter (line_no = block) as d4 from s group by 1, 2, 3),
    r as (select b.doc_id, b.page, b.block, b.text, concat_ws(' > ', x.label, y.label, z.label) as labels, coalesce(z.clause, y.clause, x.clause) as clause
        from b left join h x on x.doc_id = b.doc_id and x.line_no = b.d2 left join h y on y.doc_id = b.doc_id and y.line_no = b.d3 left join h z on z.doc_id = b.doc_id and z.line_no = b.d4)
    select doc_id, row_number() over (partition by doc_id order by block) - 1 as chunk_no, cast(page as bigint) as page, case when labels <> '' then 'doc' || doc_id || ' > ' || labels end as section, clause as clause_id, sha256(text) as content_hash from r""")
def document_structure(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all documents with their breadcrumbs and clauses; blocks aren't split here."""
    pages = _structured_pages(spark, d).withColumn("doc_name", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return structure.policy_chunks(pages, 10**8).select("doc_id", "chunk_no", F.col("page").cast("long").alias("page"), "section", "clause_id", "content_hash")
