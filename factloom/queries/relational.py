"""Joins, aggregates, windows, set operations and checks over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import checks, profile, ranking, reports, usage
from factloom.plans.guard import Guard
from factloom.session import table
from factloom.sources import sheets

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def doubles(df: DataFrame) -> DataFrame:
    """Decimals of a result as doubles: sums are exact until the end, and every engine prints them alike."""
    return df.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes])


def query(sql: str | None = None, money: str = ""):
    """Register a query under its own name, with the SQL of the same result; ``money`` names its decimal columns."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: doubles(f(spark, d))
        if sql:
            replaced = ", ".join(f"cast({c} as double) as {c}" for c in money.split())
            ORACLE_SQL[f.__name__] = f"select * replace ({replaced}) from ({sql})" if money else sql
        return f

    return add


def guard(spark: SparkSession, d: str, rows: int | None = None) -> Guard:
    return Guard(spark, {f"ops.{n}": table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}, rows)


def guarded(sql: str):
    """A query that goes through the guard, whose SQL both engines run: all its rows, as far as it has no limit of its own."""

    def make(name: str) -> None:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return guard(spark, d).run(sql)

        run.__name__ = name
        QUERIES[name] = run
        ORACLE_SQL[name] = sql

    return make


guarded("""SELECT n_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 100""")("guarded_revenue_by_nation")
guarded("""SELECT c_mktsegment, count(*) AS n FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000) GROUP BY c_mktsegment""")("semi_join_exists")
guarded("""SELECT c_mktsegment, count(*) AS n FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 200000) GROUP BY c_mktsegment""")("anti_join_not_exists")
guarded("""SELECT s_nationkey, count(*) AS n FROM supplier
    WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY s_nationkey""")("in_subquery")
guarded("""SELECT v.label, count(*) AS n, CAST(sum(CASE WHEN n_regionkey <= v.bound THEN 1 ELSE 0 END) AS BIGINT) AS within
    FROM nation CROSS JOIN LATERAL (VALUES ('low', 1), ('high', 3)) AS v(label, bound) GROUP BY v.label""")("lateral_values")
guarded("""SELECT r_name, n_name, count(s_suppkey) AS n_suppliers FROM region JOIN nation ON n_regionkey = r_regionkey
    LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name""")("left_join_unassigned")
guarded("""WITH per AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)
    SELECT o_custkey, n FROM per WHERE n = (SELECT max(n) FROM per)""")("guarded_superlative")
guarded("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders WHERE o_orderpriority ILIKE '%i%' GROUP BY o_orderpriority""")("filtered_aggregates")
guarded("""SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey AS k FROM supplier""")("set_union")
guarded("""SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000""")("set_union_all")
guarded("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier""")("set_intersect")
guarded("""SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9900""")("set_except")
guarded("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue FROM lineitem
    WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""")("pricing_summary")


@query("select o_custkey, n from (select o_custkey, count(*) as n, rank() over (order by count(*) desc) as r from orders where o_custkey is not null group by 1) where r = 1")
def superlative_ties(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").where("o_custkey is not null").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return ranking.superlative(per, "n")


@query("select l_shipmode_key as flag, numerator, denominator, round(cast(numerator as double) / nullif(denominator, 0), 6) as ratio from (select l_returnflag as l_shipmode_key, count(*) filter (where l_discount > 0.05) as numerator, count(*) as denominator from lineitem group by 1)")
def ratio_with_parts(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.ratio(table(spark, d, "lineitem"), ["l_returnflag"], F.count_if(F.col("l_discount") > 0.05), F.count("*"))
    return out.select(F.col("l_returnflag").alias("flag"), "numerator", "denominator", F.round("ratio", 6).alias("ratio"))


@query("""select coalesce(o_orderstatus, 'TOTAL') as o_orderstatus, coalesce(o_orderpriority, 'TOTAL') as o_orderpriority, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as amount
    from orders where o_orderstatus is not null and o_orderpriority is not null group by grouping sets ((o_orderstatus, o_orderpriority), ())""", money="amount")
def rollup_total_row(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus is not null and o_orderpriority is not null")
    parts = rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(reports.money("o_totalprice")).alias("amount"))
    return ranking.with_total(parts, ["o_orderstatus", "o_orderpriority"], n=F.sum("n"), amount=F.sum("amount"))


_STAR_LINES = """select o_orderkey, c_nationkey, n_regionkey, l_returnflag, cast(l_extendedprice as decimal(18,2)) as price, cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as lost
    from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"""


def star_lines(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "c_nationkey", "n_regionkey", "l_returnflag", reports.money("l_extendedprice").alias("price"), (reports.money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).alias("lost"))


@query(f"""with s as ({_STAR_LINES}), p as (select n_regionkey, l_returnflag, sum(price) as base, sum(lost) as part from s group by 1, 2)
    select cast(n_regionkey as varchar) as n_regionkey, l_returnflag, base, part, round(cast(part as double) / nullif(cast(base as double), 0), 6) as ratio from p
    union all select 'TOTAL', 'TOTAL', sum(base), sum(part), round(cast(sum(part) as double) / nullif(cast(sum(base) as double), 0), 6) from p""", money="base part")
def report_ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    lines = star_lines(spark, d)
    return reports.ratio_of_sums(lines, lines, ["n_regionkey", "l_returnflag"], F.sum("price"), F.sum("lost"))


@query("""select s_nationkey, count(*) as n, coalesce(cast(cast(round(cast(sum(case when s_acctbal > 9000 then cast(s_acctbal as decimal(18,2)) end) as decimal(28,6)) / nullif(count(case when s_acctbal > 9000 then 1 end), 0), 2) as decimal(18,2)) as varchar), 'N/A') as average
    from supplier group by 1""")
def report_average_or_mark(spark: SparkSession, d: str) -> DataFrame:
    return reports.average_or_mark(table(spark, d, "supplier"), "s_nationkey", F.when(F.col("s_acctbal") > 9000, reports.money("s_acctbal")))


@query("""with g as (select o_orderpriority as k, cast(round(count(*) * 10350 / 10000.0, 0) as bigint) as c, cast(round(sum(cast(o_totalprice as decimal(18,2))) * 10350 / 10000, 2) as decimal(18,2)) as a
        from orders where month(o_orderdate) <= 3 group by 1)
    select k as o_orderpriority, cast(c as bigint) as target_count, a as target_amount from g union all select 'TOTAL', cast(sum(c) as bigint), sum(a) from g""", money="target_amount")
def report_targets(spark: SparkSession, d: str) -> DataFrame:
    return reports.targets(table(spark, d, "orders").where(F.month("o_orderdate") <= 3), "o_orderpriority", "o_totalprice", 350)


@query("""with n as (select c_nationkey, count(*) as n from customer group by 1), s as (select c_nationkey, ((n + 30) // 60) * 10 as scheduled from n)
    select c_nationkey, scheduled, (scheduled * 8350) // 10000 as completed, round(cast((scheduled * 8350) // 10000 as double) / nullif(scheduled, 0), 6) as rate from s""")
def report_compliance(spark: SparkSession, d: str) -> DataFrame:
    return reports.compliance(table(spark, d, "customer"), "c_nationkey", 8350)


@query("""with g as (select o_orderstatus, o_orderpriority, count(*) filter (where o_totalprice > 50000) as due, count(*) filter (where o_totalprice > 50000 and month(o_orderdate) > 6) as renewed from orders group by 1, 2)
    select *, round(cast(renewed as double) / nullif(due, 0), 6) as rate from (select * from g union all select 'TOTAL', 'TOTAL', cast(sum(due) as bigint), cast(sum(renewed) as bigint) from g)""")
def report_renewals(spark: SparkSession, d: str) -> DataFrame:
    return reports.renewals(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], F.col("o_totalprice") > 50000, F.month("o_orderdate") > 6)


@query("""with s as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as total, sum(cast(l_extendedprice as decimal(18,2))) filter (where l_returnflag = 'R') as returned,
        sum(cast(l_extendedprice as decimal(18,2))) filter (where l_returnflag <> 'R') as rest, max(l_linenumber) as n from lineitem group by 1)
    select 'parts' as invariant, count(*) filter (where abs(total - returned - rest) > 0.01) as violations from s union all
    select 'lines', count(*) filter (where total < 0) from s union all select 'order', count(*) filter (where n > 5) from s""")
def invariant_violations(spark: SparkSession, d: str) -> DataFrame:
    p = reports.money("l_extendedprice")
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(p).alias("total"), F.sum(F.when(F.col("l_returnflag") == "R", p)).alias("returned"), F.sum(F.when(F.col("l_returnflag") != "R", p)).alias("rest"), F.max("l_linenumber").alias("n")).withColumn("five", F.lit(5))
    return checks.violation_counts(sums, [checks.SumOf("parts", ("total", "returned", "rest")), checks.NonNegative("lines", ("total",)), checks.Ordered("order", ("n", "five"))])


@query("""with once as (select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as total from orders group by 1),
    joined as (select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as total from orders join lineitem on l_orderkey = o_orderkey group by 1)
    select once.o_custkey, once.total as stored_total, joined.total as joined_total from once join joined using (o_custkey) where abs(once.total - joined.total) > 0.01""", money="stored_total joined_total")
def fanout_detect(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    once = orders.groupBy("o_custkey").agg(F.sum(reports.money("o_totalprice")).alias("stored_total"))
    joined = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").groupBy("o_custkey").agg(F.sum(reports.money("o_totalprice")).alias("joined_total"))
    both = once.join(joined, "o_custkey").withColumn("zero", F.lit(0))
    return checks.SumOf("fanout", ("stored_total", "joined_total", "zero")).violations(both).drop("zero")


@query("""select 'orders.o_custkey' as rule, count(*) as n from orders where o_custkey not in (select c_custkey from customer)
    union all select 'lineitem.l_orderkey', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
    union all select 'lineitem.l_partkey', count(*) from lineitem where l_partkey not in (select p_partkey from part)
    union all select 'customer.c_nationkey', count(*) from customer where c_nationkey not in (select n_nationkey from nation)
    union all select 'nation.n_regionkey', count(*) from nation where n_regionkey not in (select r_regionkey from region where r_regionkey < 4)""")
def dq_referential(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    pairs = [("orders", "o_custkey", t("customer"), "c_custkey"), ("lineitem", "l_orderkey", t("orders"), "o_orderkey"), ("lineitem", "l_partkey", t("part"), "p_partkey"), ("customer", "c_nationkey", t("nation"), "n_nationkey"), ("nation", "n_regionkey", t("region").where("r_regionkey < 4"), "r_regionkey")]
    out = None
    for child, key, parent, parent_key in pairs:
        rows = checks.orphans(t(child), key, parent, parent_key).agg(F.count("*").alias("n")).select(F.lit(f"{child}.{key}").alias("rule"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""select 'o_orderstatus' as rule, count(*) as n from orders where o_orderstatus not in ('F', 'O') union all
    select 'c_mktsegment', count(*) from customer where c_mktsegment not in ('BUILDING', 'AUTOMOBILE') union all
    select 'o_orderkey', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)""")
def dq_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    one = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    return one(checks.outside_vocabulary(orders, "o_orderstatus", ("F", "O")), "o_orderstatus").unionByName(one(checks.outside_vocabulary(customer, "c_mktsegment", ("BUILDING", "AUTOMOBILE")), "c_mktsegment")).unionByName(one(checks.duplicates(orders, ["o_orderkey"]), "o_orderkey"))


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    """columns: name -> kind (text, double, time, number)."""
    shown = {"text": "{c}", "double": "cast(cast(round({c}, 2) as decimal(20,2)) as varchar)", "time": "strftime({c}, '%Y-%m-%d %H:%M:%S')", "number": "cast({c} as varchar)"}
    parts = []
    for c, kind in columns.items():
        v = shown[kind].format(c=c)
        low, high = (shown[kind].format(c=f"min({c})"), shown[kind].format(c=f"max({c})")) if kind != "text" else ("cast(null as varchar)", "cast(null as varchar)")
        values = f"(select string_agg(v, '|' order by v) from (select distinct {v} as v from {name} where {c} is not null order by v limit {{n}}))"
        value_set = f"case when count(distinct {v}) < {profile.VALUE_SET_BELOW} then coalesce({values.format(n=profile.VALUE_SET_BELOW)}, '') end" if kind == "text" else "cast(null as varchar)"
        parts.append(f"select '{c}' as column_name, count(*) as total, count(distinct {v}) as n_distinct, count(*) filter (where {c} is null) as n_null, {low} as min_value, {high} as max_value, coalesce({values.format(n=profile.SAMPLES)}, '') as samples, {value_set} as value_set from {name}")
    return " union all ".join(parts)


PROFILED = {
    "customer": {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "double", "c_mktsegment": "text"},
    "orders": {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "time", "o_orderpriority": "text"},
    "part": {"p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "double"},
    "events": {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "double", "props": "text"},
}
for _name, _columns in PROFILED.items():

    def _run(spark: SparkSession, d: str, _name: str = _name) -> DataFrame:
        return profile.profile(table(spark, d, _name))

    QUERIES[f"profile_columns_{_name}"] = _run
    ORACLE_SQL[f"profile_columns_{_name}"] = _profile_sql(_name, _columns)


@query("""with s as (select distinct 'c_mktsegment' as column_name, c_mktsegment as stored from customer union select distinct 'p_type', p_type from (select replace(p_type, ' ', ', ') as p_type from part)),
    f as (select s.* from s join (select column_name from s group by 1 having count(*) <= 1000) using (column_name)),
    p as (select column_name, trim(stored) as value, stored, 'equals' as match_kind from f union all select column_name, trim(unnest(string_split(stored, ','))), stored, 'contains' from f where contains(stored, ','))
    select column_name, value, max(match_kind) as match_kind, min(stored) as stored from p where value <> '' and length(value) <= 120 group by 1, 2""")
def value_catalogue(spark: SparkSession, d: str) -> DataFrame:
    customer = profile.value_catalogue(table(spark, d, "customer"), ["c_mktsegment"])
    part = table(spark, d, "part").select(F.regexp_replace("p_type", " ", ", ").alias("p_type"))
    return customer.unionByName(profile.value_catalogue(part, ["p_type"]))


@query("select c_custkey, c_name from customer where regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') = 'customer000000042'")
def reference_lookup(spark: SparkSession, d: str) -> DataFrame:
    return profile.reference_lookup(table(spark, d, "customer"), "c_name", "customer 000000042").select("c_custkey", "c_name")


@query("""select 'c_phone' as column_name, 'documented' as side union all select 'c_nationkey', 'observed' union all select 'c_acctbal', 'observed'""")
def column_drift(spark: SparkSession, d: str) -> DataFrame:
    documented = spark.createDataFrame([(c,) for c in ("c_custkey", "c_name", "c_phone", "c_mktsegment")], "column_name string")
    observed = spark.createDataFrame([(c,) for c in table(spark, d, "customer").columns], "column_name string")
    return profile.column_drift(documented, observed)


@query("""select event_id, event_type, cast(count(*) over (partition by event_type order by ts range between interval '3599.999999 seconds' preceding and current row) as bigint) as n_recent,
    count(*) over (partition by event_type order by ts range between interval '3599.999999 seconds' preceding and current row) > 5 as over_limit from events""")
def limiter_window(spark: SparkSession, d: str) -> DataFrame:
    return usage.limited(table(spark, d, "events"), "event_type", "ts", 5, 3600).select("event_id", "event_type", "n_recent", "over_limit")


@query("""with e as (select event_id, user_id, cast(ts - case when ts >= timestamp '2024-03-10 10:00:00' and ts < timestamp '2024-11-03 09:00:00' then interval 7 hour else interval 8 hour end as date) as day, ts from events)
    select event_id, user_id, cast(day as varchar) as day, row_number() over (partition by user_id, day order by ts, event_id) as nth, row_number() over (partition by user_id, day order by ts, event_id) > 2 as over_quota from e""")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_quota(table(spark, d, "events"), "user_id", "ts", "event_id", 2).select("event_id", "user_id", F.col("day").cast("string").alias("day"), "nth", "over_quota")


@query("""with s as (select event_id, user_id, coalesce(sum(cast(value as decimal(18,2))) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as spent_before from events)
    select event_id, user_id, cast(spent_before as decimal(18,2)) as spent_before, spent_before >= 500 as blocked from s""", money="spent_before")
def running_spend(spark: SparkSession, d: str) -> DataFrame:
    out = usage.running_spend(table(spark, d, "events"), "user_id", "ts", "event_id", "value", 500)
    return out.select("event_id", "user_id", F.col("spent_before").cast("decimal(18,2)").alias("spent_before"), "blocked")


@query("select event_type, count(*) as calls, sum(cast(value as decimal(18,2))) as cost, min(ts) as first_at, max(ts) as last_at from events group by 1", money="cost")
def ledger_by_type(spark: SparkSession, d: str) -> DataFrame:
    return usage.ledger(table(spark, d, "events"), "event_type", "ts", "value")


@query("""with p as (select user_id, 'event_type' as field, event_type as form from events union select user_id, 'props', props from events)
    select user_id, field, count(*) as n_forms from p group by 1, 2 having count(*) > 1""")
def varied_fields(spark: SparkSession, d: str) -> DataFrame:
    return usage.varied_fields(table(spark, d, "events"), "user_id", ["event_type", "props"])


@query("""select '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as value from events""")
def ndjson_events(spark: SparkSession, d: str) -> DataFrame:
    return usage.ndjson(table(spark, d, "events").select("event_id", "event_type"))


@query("""select o_custkey, o_orderkey, n from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n <= 3""")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", nth.alias("n")).where("n <= 3")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 20 offset 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 40, 20)


@query("""with n as (select distinct c_mktsegment as sheet, c_nationkey + 1 as k from customer where c_acctbal > 9900), g as (select sheet, k, k - row_number() over (partition by sheet order by k) as g from n),
    i as (select sheet, min(k) as first_key, max(k) as last_key, count(*) as size from g group by sheet, g.g) select sheet, row_number() over (partition by sheet order by first_key) as island, first_key, last_key, size from i""")
def islands(spark: SparkSession, d: str) -> DataFrame:
    """Nations of a segment's richest customers as the occupied rows of one sheet."""
    cells = table(spark, d, "customer").where("c_acctbal > 9900").select(F.lit("book").alias("workbook"), F.col("c_mktsegment").alias("sheet"), (F.col("c_nationkey") + 1).cast("long").alias("row")).distinct()
    found = sheets.islands(cells).groupBy("sheet", F.col("island").cast("long").alias("island"))
    return found.agg(F.min("row").alias("first_key"), F.max("row").alias("last_key"), F.count("*").alias("size"))


_NAMED = "case when doc_id % 17 = 0 then 'scan' || doc_id || '.pdf' else 'CLM-' || (doc_id + 100) || '.pdf' end"


@query(f"""with files as (select 'policy' as source, 'doc' || s_suppkey || '.txt' as name from supplier where s_suppkey % 10 <> 3 union all select 'scanned', {_NAMED} from documents
        union all select 'workbook', 'book' || n_nationkey || '.xlsx' from nation where n_nationkey <> 4 union all select 'workbook', 'extra' || r_regionkey || '.xlsx' from region),
    expected as (select 'policy' as source, count(*) as expected from supplier union all select 'scanned', count(*) from documents union all select 'workbook', count(*) from nation union all select 'audio', 1),
    claims as (select 'CLM-' || (o_orderkey + 100) as claim_number from orders where o_orderkey % 13 <> 5),
    sheet as (select distinct 'book' || c_nationkey || '.xlsx' as workbook, case when c_custkey % 50 = 0 then 'NOWHERE' when c_custkey % 50 = 1 then ' ' else r_name end as region from customer join region on r_regionkey = c_nationkey % 5)
    select 0 as place, 'source_incomplete' as rule, e.source || ': ' || coalesce(n, 0) || ' of ' || expected || ' files' as detail from expected e left join (select source, count(*) as n from files group by 1) f using (source) where coalesce(n, 0) <> expected
    union all select 1, 'policy_document_missing', s_name || ': doc' || s_suppkey || '.txt' from supplier where 'doc' || s_suppkey || '.txt' not in (select name from files where source = 'policy')
    union all select 2, 'scanned_filename_unkeyed', name from files where source = 'scanned' and name not like 'CLM%'
    union all select 3, 'scanned_claim_unknown', name from files where source = 'scanned' and name like 'CLM%' and replace(name, '.pdf', '') not in (select claim_number from claims)
    union all select 4, 'workbook_missing', 'book' || n_nationkey || '.xlsx' from nation where 'book' || n_nationkey || '.xlsx' not in (select name from files)
    union all select 5, 'workbook_undeclared', name from files where source = 'workbook' and name not in (select 'book' || n_nationkey || '.xlsx' from nation)
    union all select 6, 'workbook_region_unknown', workbook || ': ' || region from sheet where trim(region) <> '' and region not in (select r_name from region)
    union all select 7, 'ops_invariant_violated', 'ops.customer: balance: ' || c_custkey from customer where c_acctbal < 0
    union all select 8, 'sheet_invariant_violated', 'sheets.parts: price: ' || p_partkey from part where p_retailprice - p_size > 900""")
def cross_source_checks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as products, documents as scans of orders, nations as workbooks: every rule finds something."""
    t = lambda n: table(spark, d, n)
    text = lambda c: F.col(c).cast("string")
    document, book = F.concat(F.lit("doc"), text("s_suppkey"), F.lit(".txt")), lambda c: F.concat(F.lit("book"), text(c), F.lit(".xlsx"))
    scan = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("scan"), text("doc_id"), F.lit(".pdf"))).otherwise(F.concat(F.lit("CLM-"), (F.col("doc_id") + 100).cast("string"), F.lit(".pdf")))
    named = lambda df, kind, name: df.select(F.lit(kind).alias("source"), name.alias("name"))
    files = named(t("supplier").where("s_suppkey % 10 <> 3"), "policy", document).unionByName(named(t("documents"), "scanned", scan)).unionByName(named(t("nation").where("n_nationkey <> 4"), "workbook", book("n_nationkey"))).unionByName(named(t("region"), "workbook", F.concat(F.lit("extra"), text("r_regionkey"), F.lit(".xlsx"))))
    size = lambda n, kind: t(n).agg(F.lit(kind).alias("source"), F.count("*").alias("expected"))
    sources = size("supplier", "policy").unionByName(size("documents", "scanned")).unionByName(size("nation", "workbook")).unionByName(t("region").limit(1).select(F.lit("audio").alias("source"), F.lit(1).cast("long").alias("expected")))
    customers = t("customer").join(t("region"), F.col("r_regionkey") == F.col("c_nationkey") % 5)
    region = F.when(F.col("c_custkey") % 50 == 0, "NOWHERE").when(F.col("c_custkey") % 50 == 1, " ").otherwise(F.col("r_name"))
    return checks.cross_source_findings(
        sources, files, t("supplier").select(F.col("s_name").alias("product"), document.alias("policy_document")), t("orders").where("o_orderkey % 13 <> 5").select(F.concat(F.lit("CLM-"), (F.col("o_orderkey") + 100).cast("string")).alias("claim_number")),
        t("nation").select(book("n_nationkey").alias("workbook")), customers.select(book("c_nationkey").alias("workbook"), region.alias("region")), t("region").select(F.col("r_name").alias("region_name")),
        ops=[("ops.customer", t("customer"), "c_custkey", [checks.NonNegative("balance", ("c_acctbal",))])],
        sheets=[("sheets.parts", t("part").select("p_partkey", (F.col("p_retailprice") - F.col("p_size")).alias("net"), F.lit(900.0).alias("most")), "p_partkey", [checks.Ordered("price", ("net", "most"))])],
    )
