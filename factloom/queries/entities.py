"""Resolution of mentions over the tables' values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import NOISE_WORDS
from factloom.operators import resolution
from factloom.plans import observe, rewrite
from factloom.plans.guard import Guard
from factloom.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Mentions beside those made of part names: a paraphrase, a typo, other cases and orders, too short ones, references.
_MENTIONS = ("bilding", "AUTO MOBILE", "machinry ltd", "The Nation 7", "nation", "asia", "midle east", "zz", "quite unknown", "brand 1", "ORD-000042", "ord 43", "ord 000043", "999999999")


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "part": table(spark, d, "part").select("p_name", "p_type", "p_brand"),
        "customer": table(spark, d, "customer").select("c_mktsegment"),
        "nation": table(spark, d, "nation").select("n_name"),
        "region": table(spark, d, "region").select("r_name"),
    }


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct part name without its third character, and the fixed ones."""
    made = table(spark, d, "part").where("p_name is not null").select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("mention")).distinct()
    return made.unionByName(spark.createDataFrame([(m,) for m in _MENTIONS], "mention string"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    return resolution.references_of({"orders": table(spark, d, "orders").select(F.format_string("ORD-%06d", "o_orderkey").alias("order_ref"))})


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve_mentions(_mentions(spark, d), resolution.catalogue_of(_tables(spark, d)), _references(spark, d))


_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_RUNS = "array_to_string(list_filter(string_split({0}, ''), lambda c, i: i = 1 or c <> substring({0}, i - 1, 1)), '')"
_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_BARE = f"coalesce(nullif(trim(regexp_replace(regexp_replace({{0}}, '^(?:(?:{'|'.join(NOISE_WORDS)})(?: |$))+', ''), '(?:(?:^| )(?:{'|'.join(NOISE_WORDS)}))+$', '')), ''), {{0}})"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substring('  ' || {0} || '  ', i, 3)))"
_JACCARD = f"(len(list_intersect({_GRAMS.format('{0}')}, {_GRAMS.format('{1}')})) * 1.0::double / len(list_distinct(list_concat({_GRAMS.format('{0}')}, {_GRAMS.format('{1}')}))))"
# the longest common piece of x and y, of equal ones the first in x, then in y
_PIECE = "list_filter(flatten(list_transform(range(1, least(length(x), length(y)) + 1), lambda k: list_transform(range(1, length(x) - k + 2), lambda i: {'k': -k, 'i': i, 'j': instr(y, substring(x, i, k))}))), lambda p: p.j > 0)"
_WHOLE = "greatest(0.55::double * greatest({r}1.q, {r}2.q) + 0.45::double * {j1}, 0.55::double * greatest({r}3.q, {r}4.q) + 0.45::double * {j2})"

#: All pairs are compared, and likeness is found by cutting pairs of texts at their longest common piece again and again.
_RESOLVED = f"""
    with recursive stored as (
        select distinct * from (select 'part' as table_name, 'p_name' as column_name, p_name as value from part union all select 'part', 'p_type', p_type from part union all select 'part', 'p_brand', p_brand from part
            union all select 'customer', 'c_mktsegment', c_mktsegment from customer union all select 'nation', 'n_name', n_name from nation union all select 'region', 'r_name', r_name from region) where trim(value) <> ''),
    vocabulary as (select *, {_BARE.format("p")} as text, row_number() over (order by table_name, column_name, value) as place from (select *, {_PLAIN.format("value")} as p from stored) where p <> ''),
    asked as (
        select mention, {_PLAIN.format("mention")} as p, regexp_replace(lower(mention), '[^a-z0-9]+', '', 'g') as key
        from (select distinct substring(p_name, 1, 2) || substring(p_name, 4) as mention from part where p_name is not null union select unnest([{", ".join(f"'{m}'" for m in _MENTIONS)}]))),
    forms as (select mention, key, {_BARE.format("p")} as m, regexp_full_match(key, '(?:[a-z]{{2,6}})?[0-9]{{3,}}') as is_ref from asked),
    texts as (select text, min(place) as place from vocabulary group by 1),
    wanted as (select * from forms where not is_ref and length(replace(m, ' ', '')) >= 3),
    pairs as (select distinct m as a, text as b from wanted, texts union select x.text, y.text from texts x, texts y where x.text < y.text),
    shaped as (select a, b, {_SORTED.format("a")} as a2, {_SORTED.format("b")} as b2, {_RUNS.format("a")} as a3, {_RUNS.format("b")} as b3 from pairs),
    shapes as (select *, {_SORTED.format("a3")} as a4, {_SORTED.format("b3")} as b4 from shaped),
    tokens as (select distinct x, y from (select unnest(string_split(a, ' ')) as x, b from pairs where a in (select m from wanted)), lateral (select unnest(string_split(b, ' ')) as y) where length(x) >= 3),
    needed as (select a as x, b as y from shapes union select a2, b2 from shapes union select a3, b3 from shapes union select a4, b4 from shapes union select x, y from tokens union select {_RUNS.format("x")}, {_RUNS.format("y")} from tokens),
    parts as (
        select x as x0, y as y0, x, y, list_sort({_PIECE})[1] as p from needed
        union all
        select x0, y0, x, y, list_sort({_PIECE})[1] as p from (
            select x0, y0, unnest([{{'x': substring(x, 1, p.i - 1), 'y': substring(y, 1, p.j - 1)}}, {{'x': substring(x, p.i - p.k), 'y': substring(y, p.j - p.k)}}], recursive := true) from parts where p is not null) where x <> '' and y <> ''),
    ratios as (select x0 as x, y0 as y, 2.0::double * coalesce(sum(-p.k), 0) / (length(x0) + length(y0)) as q from parts group by 1, 2),
    token_scores as (
        select t.x, t.y, r3.q as run_ratio, greatest(r1.q, r3.q, {_JACCARD.format("t.x", "t.y")}) as likeness
        from tokens t join ratios r1 on r1.x = t.x and r1.y = t.y join ratios r3 on r3.x = {_RUNS.format("t.x")} and r3.y = {_RUNS.format("t.y")}),
    whole as (
        select s.a, s.b, r2.q as in_order, {_WHOLE.format(r="r", j1=_JACCARD.format("s.a", "s.b"), j2=_JACCARD.format("s.a3", "s.b3"))} as score
        from shapes s join ratios r1 on r1.x = s.a and r1.y = s.b join ratios r2 on r2.x = s.a2 and r2.y = s.b2 join ratios r3 on r3.x = s.a3 and r3.y = s.b3 join ratios r4 on r4.x = s.a4 and r4.y = s.b4),
    by_token as (
        select a, b, count(*) as n_asked, min(run_best) as least_run, min(best) as least, sum(best) / count(*) as mean, any_value(len(string_split(b, ' '))) as n_there
        from (select a, b, i, max(run_ratio) as run_best, max(likeness) as best
            from (select a, b, unnest(range(1, len(string_split(a, ' ')) + 1)) as i, string_split(a, ' ') as ts, unnest(string_split(b, ' ')) as dummy from pairs where false union all
                select a, b, i, ts, y from (select a, b, string_split(a, ' ') as ts, unnest(range(1, len(string_split(a, ' ')) + 1)) as i from pairs where a in (select m from wanted)), lateral (select unnest(string_split(b, ' ')) as y)) z
            join token_scores t on t.x = z.ts[z.i] and t.y = z.dummy group by 1, 2, 3) group by 1, 2),
    scores as (
        select w.a, w.b, greatest(w.score, case when t.n_asked is null then 0 when least_run >= 0.85 then least(1.0, 0.85 + 0.15::double * (n_asked * 1.0::double / n_there))
            when n_asked >= 2 and least >= 0.75 and mean >= 0.8 then least(1.0, 0.85 + 0.15::double * mean * (n_asked * 1.0::double / n_there)) else 0 end) as score
        from whole w left join by_token t on t.a = w.a and t.b = w.b),
    scored as (select mention, b as text, score, max(score) over (partition by mention) as top from wanted join scores on a = m),
    near as (select a, b from whole where in_order >= 0.9 union select b, a from whole where in_order >= 0.9 union select text, text from texts),
    members as (
        select mention, text, cast(0 as bigint) as place from scored where top >= 0.88 and score >= 0.9 * top
        union
        select g.mention, n.b, t.place from members g join near n on n.a = g.text join texts t on t.text = n.b where t.place > g.place),
    grouped as (select distinct mention, text from members),
    linked as (select a, b from whole where score >= 0.8 or in_order >= 0.9 union select b, a from whole where score >= 0.8 or in_order >= 0.9),
    reach as (select mention, text, text as label from grouped union select g.mention, g.text, r.label from reach r join linked l on l.a = r.text join grouped g on g.mention = r.mention and g.text = l.b),
    clustered as (select r.mention, r.text, min(label) as cluster, any_value(s.score) as score from reach r join scored s on s.mention = r.mention and s.text = r.text group by 1, 2),
    best as (select mention, cluster, max(score) as score from clustered group by 1, 2),
    ranked as (select *, row_number() over (partition by mention order by score desc, cluster desc) as r, count(*) over (partition by mention) as n, lead(score) over (partition by mention order by score desc, cluster desc) as next from best),
    chosen as (select mention, cluster from ranked where r = 1 and (n = 1 or (score >= 0.98 and next <= score - 0.05))),
    held as (select f.mention, r.value from forms f join (select distinct printf('ORD-%06d', o_orderkey) as value from orders) r on f.is_ref and regexp_replace(lower(r.value), '[^a-z0-9]+', '', 'g') = f.key),
    hits as (select mention, list_sort(list(value)) as vs from held group by 1),
    everything as (
        select c.mention, 'resolved' as status, 'value' as kind, v.table_name, v.column_name, array_to_string(list_sort(list(distinct v.value)), '|') as found, round(max(c.score), 6) as score
        from clustered c join chosen using (mention, cluster) join vocabulary v using (text) group by all
        union all
        select mention, 'ambiguous', 'value', null, null, array_to_string(list(value order by score desc, value)[1:4], '|'), null from (
            select c.mention, c.cluster, arg_max(v.value, c.score) as value, max(c.score) as score from
                (select mention, cluster, text, score, row_number() over (partition by mention, cluster order by score desc, (select min(value) from vocabulary v where v.text = k.text)) as r from clustered k) c join (select text, min(value) as value from vocabulary group by 1) v using (text)
            where r = 1 and c.mention not in (select mention from chosen) group by 1, 2) group by 1
        union all select mention, 'not_found', 'value', null, null, '', null from forms where not is_ref and mention not in (select mention from grouped)
        union all select mention, 'resolved', 'reference', 'orders', 'order_ref', vs[1], 1.0 from hits where len(vs) = 1
        union all select mention, 'ambiguous', 'reference', null, null, array_to_string(vs, '|'), null from hits where len(vs) > 1
        union all select mention, 'not_found', 'reference', null, null, '', null from forms where is_ref and mention not in (select mention from hits))"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("mention", "status", "kind", "table_name", "column_name", F.coalesce(F.array_join(F.coalesce("values", "candidates"), "|"), F.lit("")).alias("found"), F.round("score", 6).alias("score"))


@query(f"{_RESOLVED} select mention, status, kind, table_name, column_name, found, score from everything")
def resolve_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt part names, other names and order references, found among the values of four tables and all orders."""
    return _shown(_resolved(spark, d))


_CHAR_3 = "substring(p_name, 1, 2) || substring(p_name, 4)"


@query(f"""{_RESOLVED}, questions as (select p_partkey as question_id, {_CHAR_3} as m, p_partkey % 2 = 0 as scoped from part where p_name is not null),
    unclear as (select mention, '"' || replace(found, '|', '" or "') || '"' as options from everything where status = 'ambiguous'),
    asks as (select question_id, case when u.mention is not null and (not scoped or {_PLAIN.format("m")} = {_PLAIN.format("m")}) then 'Did you mean ' || u.options || ' for "' || m || '"?' end as one,
        case when not scoped then (select 'Did you mean ' || options || ' for "nation"?' from unclear where mention = 'nation') end as two from questions left join unclear u on u.mention = m)
    select question_id, coalesce(one, two) is not null as needs_clarification, coalesce(one, two, '') as clarification_question from asks""")
def clarify_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question for every part: it names the misspelt part and quotes 'nation' in a filter; every other one is scoped to the part alone."""
    asked = F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))
    questions = table(spark, d, "part").where("p_name is not null").select(
        F.col("p_partkey").alias("question_id"), F.array(asked).alias("entities"), F.array(F.lit("n_name = 'nation'")).alias("filters"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Parts like "), asked)).alias("scope"),
    )
    return resolution.resolve_questions(questions, _resolved(spark, d))


@query(f"{_RESOLVED} select mention, table_name, column_name, found as stored, 'equals' as match_kind from everything where status = 'resolved'")
def stored_values(spark: SparkSession, d: str) -> DataFrame:
    shown = resolution.stored_values(_resolved(spark, d))
    return shown.select("mention", "table_name", "column_name", F.array_join("values", "|").alias("stored"), "match_kind")


def _ground(spark: SparkSession, d: str, sql: str) -> str:
    """The statement with the spellings that are stored in the columns of its predicates."""
    literals = spark.createDataFrame([(v,) for p in rewrite.predicates(spark, sql) for v in p.values], "mention string")
    found = resolution.stored_values(resolution.resolve_mentions(literals, resolution.catalogue_of(_tables(spark, d)), _references(spark, d))).collect()
    known = {(r.mention, r.column_name): (r.match_kind, r["values"]) for r in found}
    return rewrite.rewritten(spark, sql, lambda column, literal: known.get((literal, column.split(".")[-1]))) or sql


def _guard(spark: SparkSession, d: str, rows: int | None = 500) -> Guard:
    return Guard(spark, {f"ops.{n}": table(spark, d, n) for n in ("region", "nation", "customer", "part", "orders")}, rows)


@query("select c_nationkey, count(*) as customers from customer where c_mktsegment in ('BUILDING', 'AUTOMOBILE') group by c_nationkey")
def grounded_statement(spark: SparkSession, d: str) -> DataFrame:
    """A statement with misspelt literals, rewritten to stored spellings and admitted again."""
    return _guard(spark, d, None).run(_ground(spark, d, "select c.c_nationkey, count(*) as customers from customer c where c.c_mktsegment in ('bilding', 'AUTOMOBIL') group by c.c_nationkey"))


@query("select p_partkey, p_name, p_size from part where p_type = 'ECONOMY' and p_size > 45 order by p_size desc, p_partkey limit 40")
def restored_statement(spark: SparkSession, d: str) -> DataFrame:
    """The plan asks for name and size, which the statement doesn't project; its literal is misspelt, too."""
    sql = _ground(spark, d, "select p_partkey from part where p_type = 'econmy' and p_size > 45 order by p_size desc, p_partkey limit 40")
    return _guard(spark, d).run(rewrite.restored(spark, sql, ["p_name", "p_size"], table(spark, d, "part").columns))


_RIGHT = "select n_name, sum(c_acctbal) as balance from customer join nation on c_nationkey = n_nationkey group by n_name order by n_name limit 25"


@query(f"select n_name, cast(balance as double) as balance from ({_RIGHT.replace('sum(c_acctbal)', 'sum(cast(c_acctbal as decimal(18,2)))')})")
def voted_statement(spark: SparkSession, d: str) -> DataFrame:
    """Of five candidates two agree, one multiplies rows, one has no rows and one doesn't bind; the rows are those of the one that is trusted."""
    guard, results = _guard(spark, d), []
    money = "sum(cast(c_acctbal as decimal(18,2)))"
    for sql in (
        _RIGHT.replace("sum(c_acctbal)", money),
        f"select n.n_name, {money} as balance from nation n join customer c on c.c_nationkey = n.n_nationkey group by n.n_name order by 1 limit 25",
        f"select n_name, {money} as balance from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by n_name order by n_name limit 25",
        f"select n_name, {money} as balance from customer join nation on c_nationkey = n_nationkey where n_name = 'NOWHERE' group by n_name limit 25",
        "select n_name, sum(no_such_column) as balance from nation group by n_name limit 25",
    ):
        verdict = guard.check(sql)
        result = observe.execute(lambda sql=sql: guard.run(sql)) if verdict.ok else observe.Result(error=verdict.reason)
        results.append((sql, result, observe.observe(result, "What is the balance of each nation?")))
    chosen = observe.choose(results)
    return guard.run(chosen.sql).select("n_name", F.col("balance").cast("double").alias("balance"))
