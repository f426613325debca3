import pytest

from factloom.plans.guard import Guard
from factloom.plans.observe import Observation, Result, answer_key, choose, execute, expects_scalar, observe, repaired, steps, unreachable
from factloom.plans.rewrite import dropped_projections, predicates, restored, rewritten, unresolvable


@pytest.fixture(scope="module")
def tables(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "ops.claims": frame([(1, 1, "fire", 10.0), (2, 1, "storm", 4.0)], "claim_id int, policy_id int, peril string, incurred double"),
        "ops.policies": frame([(1, "gold", 2)], "policy_id int, plan string, region_id int"),
        "ops.regions": frame([(2, "Lahore")], "region_id int, region_name string"),
        "sheets.regions": frame([(2, "Lahore")], "region_id int, region_name string"),
        "sheets.inspections": frame([("Lahore", 0.5)], "region_name string, rate double"),
    }


@pytest.fixture(scope="module")
def guard(spark, tables):
    return Guard(spark, tables, 50)


ADMITTED = [
    "SELECT * FROM ops.claims",
    "SELECT claim_id FROM claims WHERE peril = 'fire' LIMIT 500",
    "SELECT c.claim_id, p.plan FROM ops.claims c LEFT JOIN ops.policies AS p ON p.policy_id = c.policy_id",
    "WITH x AS (SELECT * FROM claims) SELECT count(*) AS n FROM x",
    "SELECT r.region_name FROM ops.regions r JOIN sheets.inspections i ON i.region_name = r.region_name",
    "SELECT claim_id FROM claims c WHERE EXISTS (SELECT 1 FROM policies p WHERE p.policy_id = c.policy_id)",
    "SELECT claim_id FROM claims WHERE policy_id IN (SELECT policy_id FROM policies)",
    "SELECT claim_id FROM claims WHERE incurred = (SELECT max(incurred) FROM claims)",
    "SELECT claim_id FROM claims UNION ALL SELECT policy_id FROM policies LIMIT 3",
    "SELECT v.x FROM claims CROSS JOIN LATERAL (VALUES (1), (2)) AS v(x)",
    "SELECT peril, sum(incurred) FILTER (WHERE claim_id > 0) AS s FROM claims GROUP BY peril HAVING count(*) > 0 ORDER BY s DESC NULLS LAST",
    "SELECT t.* FROM claims t ORDER BY 1 LIMIT 5 OFFSET 1",
    "SELECT 'a from hidden.t; drop' AS x FROM claims -- hidden.t",
    "SELECT peril, rank() OVER (ORDER BY incurred) AS r FROM claims",
]

REFUSED = [
    ("DROP TABLE ops.claims", "Only SELECT"),
    ("DELETE FROM ops.claims", "Only SELECT"),
    ("EXPLAIN SELECT * FROM claims", "Only SELECT"),
    ("SET x = 1", "Only SELECT"),
    ("CACHE TABLE claims", "Only SELECT"),
    ("SELECT 1; SELECT 2", "Exactly one"),
    ("SELECT * FROM ops.claims FOR UPDATE", "locking"),
    ("SELECT * INTO x FROM ops.claims", "DDL and DML"),
    ("SELEC", "SQL parse error"),
    ("SELECT 1", "allowed table"),
    ("SELECT *", "requires an allowed source table"),
    ("SELECT * FROM regions", "ambiguous"),
    ("SELECT * FROM secret.t", "Schema is not allowed"),
    ("SELECT * FROM a.b.c", "Catalog is not allowed"),
    ("SELECT * FROM ops.nope", "Table is not allowed"),
    ("SELECT nope FROM ops.claims", "Column validation failed"),
    ("SELECT * FROM range(3)", "Table is not allowed"),
    ("SELECT * FROM parquet.`/etc`", "Schema is not allowed"),
    ("SELECT reflect('java.lang.System', 'exit', 0) FROM claims", "Function is not allowed"),
    ("SELECT * FROM claims WHERE EXISTS (SELECT 1 FROM policies)", "EXISTS"),
    ("SELECT claim_id FROM claims LIMIT -1", "LIMIT"),
    ("SELECT claim_id FROM claims LIMIT 1 + 1", "LIMIT"),
]
#: Positions in which a forbidden table could hide.
HIDING = [
    "WITH a AS (SELECT * FROM hidden.t) SELECT * FROM claims",
    "SELECT claim_id FROM claims WHERE policy_id IN (SELECT x FROM hidden.t)",
    "SELECT claim_id FROM claims c WHERE EXISTS (SELECT 1 FROM hidden.t h WHERE h.x = c.claim_id)",
    "SELECT (SELECT max(x) FROM hidden.t) AS m FROM claims",
    "SELECT peril FROM claims GROUP BY peril HAVING count(*) > (SELECT max(x) FROM hidden.t)",
    "SELECT l.x FROM claims, LATERAL (SELECT x FROM hidden.t) AS l",
    "SELECT claim_id FROM claims UNION SELECT x FROM hidden.t",
    "SELECT claim_id FROM (SELECT * FROM (SELECT x AS claim_id FROM hidden.t) a) b JOIN claims USING (claim_id)",
    "SELECT claim_id FROM claims ORDER BY (SELECT max(x) FROM hidden.t)",
]


@pytest.mark.parametrize("sql", ADMITTED)
def test_admitted(guard, sql):
    verdict = guard.check(sql)
    assert verdict.ok, verdict.reason
    assert len(guard.run(sql).collect()) <= 50


@pytest.mark.parametrize("sql,reason", REFUSED)
def test_refused(guard, sql, reason):
    verdict = guard.check(sql)
    assert not verdict.ok and reason in verdict.reason and verdict.sql == "" and verdict.tables == ()


@pytest.mark.parametrize("sql", HIDING)
def test_hidden_tables(guard, sql):
    assert "Schema is not allowed" in guard.check(sql).reason


def test_bounds(spark, tables):
    assert Guard(spark, {}, 5).check("SELECT 1").reason
    assert Guard(spark, tables, True).check("SELECT * FROM claims").reason
    assert Guard(spark, tables, 1).run("SELECT * FROM claims LIMIT 9").count() == 1
    with pytest.raises(PermissionError):
        Guard(spark, tables, 1).run("DROP TABLE claims")


def test_no_bound_keeps_every_row(spark, tables):
    assert Guard(spark, tables, None).run("SELECT claim_id FROM claims CROSS JOIN LATERAL (SELECT explode(sequence(1, 400)) AS x)").count() == 800
    assert Guard(spark, tables, None).run("SELECT * FROM claims LIMIT 1").count() == 1
    with pytest.raises(PermissionError):
        Guard(spark, tables, None).run("DROP TABLE claims")


def test_observe(guard):
    sums = [("sum", "incurred", "paid", "reserve"), ("non_negative", "paid"), ("ordered", "low", "high")]
    bare = lambda *c: tuple(("", x) for x in c)
    assert observe(Result(error="x"), "").verdict == "sql_error"
    assert observe(Result(("a",)), "").verdict == "empty_result"
    assert observe(Result(("a",), ((1,), (2,))), "sum of amounts").verdict == "suspicious_shape"
    assert observe(Result(("a",), ((None,),), "", (("average", "a"),)), "x").verdict == "suspicious_shape"
    ok = Result(("i", "p", "r"), ((10, 4, 6), (None, 1, 2)), "", bare("incurred", "paid", "reserve"))
    assert observe(ok, "list", sums).verdict == "ok"
    bad = Result(("i", "p", "r"), ((20, 4, 6),), "", tuple(("sum", c) for c in ("incurred", "paid", "reserve")))
    assert observe(bad, "list", sums).verdict == "implausible_values"
    assert observe(Result(("p",), ((-1,),), "", (("min", "paid"),)), "list", sums).verdict == "implausible_values"
    assert observe(Result(("l", "h"), ((2, 1),), "", bare("low", "high")), "list", sums).verdict == "implausible_values"
    real = execute(lambda: guard.run("SELECT peril, sum(incurred) AS s, max(claim_id) + 1 AS m FROM claims GROUP BY peril LIMIT 5"))
    assert real.sources == (("", "peril"), ("sum", "incurred"), None)
    assert execute(lambda: guard.run("SELECT claim_id / 0 AS x FROM claims")).error


def test_questions():
    assert expects_scalar("sum of paid amounts") and expects_scalar("AVG of at least 3, no grouping") and expects_scalar("count, ungrouped")
    assert not any(map(expects_scalar, ("list the claims", "sum per region", "count, grouped by peril", "distribution of counts", "rank by sum", "the highest sum", "max(paid) of all", "minimum value of paid", "average, ties kept")))


def test_choice():
    ok, one, two = Observation("ok"), Result(("a",), ((1.0,),)), Result(("a",), ((2,),))
    assert answer_key(Result(("x",), ((1,), (2,)))) == answer_key(Result(("y",), ((2.0,), (1.0000000001,))))
    pool = [("select aaa", one, ok), ("select a", one, ok), ("s2", two, ok), ("bad", Result(error="e"), Observation("sql_error"))]
    assert choose(pool).sql == "select a" and choose(pool[:2]).reason == "single_cluster"
    assert choose(pool, lambda sqls: {"s2": 3}).sql == "s2"
    assert choose(pool, lambda sqls: 1 / 0).reason.startswith("arbitration_unavailable")
    assert choose(pool[3:]).reason == "no_candidates"


def test_repairs():
    error, empty, fine = Observation("sql_error"), Observation("empty_result"), Observation("ok")
    seen = {"a": error, "b": fine, "e": empty, "e2": empty}
    run = lambda sql: (Result(), seen[sql])
    assert repaired("a", run, lambda s, o: "b").status == "ok"
    assert repaired("a", run, lambda s, o: " A ").status == "no_progress"
    assert repaired("e", run, lambda s, o: "e2").status == "ok_empty"
    assert repaired("e", run, lambda s, o: "b", lambda s: ["x"]).details == ("x",)
    assert repaired("a", run, lambda s, o: "b", budget=0, clock=iter([0.0, 1.0]).__next__).status == "budget_exhausted"
    flip = {"a": "c", "c": "a"}
    assert repaired("a", lambda s: (Result(), error), lambda s, o: flip[s]).status == "attempts_exhausted"
    done = steps(["x", "y", "z"], lambda p, before: (type("S", (), {"status": "ok" if p == "x" else "failed"})(), Result(("a",), ((1,),) * 30)))
    assert len(done) == 2


def test_joins():
    assert unreachable(["a", "b", "c"], [("a", "b"), ("c", "d")]) == ["c"]


def test_rewrites(spark):
    sql = "SELECT * FROM t WHERE peril = 'Watr' AND city IN ('a', 'b') AND name LIKE '%x%' AND id = 3 AND other LIKE 'x%'"
    assert [(p.column, p.kind, p.values) for p in predicates(spark, sql)] == [("peril", "equals", ("Watr",)), ("city", "in", ("a", "b")), ("name", "contains", ("x",))]
    known = {"Watr": ("equals", ["water", "wa'ter"]), "a": ("equals", ["A"]), "b": ("equals", ["B"]), "x": ("contains", ["50%"])}
    out = rewritten(spark, sql, lambda c, v: known.get(v))
    assert "peril IN ('water', 'wa\\'ter')" in out and "city IN ('A', 'B')" in out and "name ILIKE" in out
    assert out.endswith("AND city IN ('A', 'B') AND (name ILIKE '%50\\\\%%') AND id = 3 AND other LIKE 'x%'")  # a membership and a pattern take their column along
    assert rewritten(spark, sql, lambda c, v: None) is None
    assert unresolvable(spark, sql, lambda c, v: v != "Watr") == ["Watr"]
    assert dropped_projections(spark, "SELECT a FROM t", ["a", "b", "c"], ["a", "b"]) == ["b"]
    assert restored(spark, "SELECT a FROM t", ["a", "b"], ["a", "b"]) == "SELECT b, a FROM t"
    assert restored(spark, "SELECT a, count(*) FROM t GROUP BY a", ["b"], ["a", "b"]).startswith("SELECT a,")
