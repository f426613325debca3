"""Evidence as a whole: whole texts and pages."""

from factloom.operators import evidence
from factloom.queries import texts


def made(spark, folder, n=3):
    """Texts and pages that differ behind equal beginnings, and one exact copy."""
    head = "The same forty characters and some more: "
    docs = [(i, head + str(i // 2), "en", "s") for i in range(n)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string"),
        "events": ([(i, "click", i % 5) for i in range(n)], "event_id long, event_type string, user_id long"),
        "labels": ([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int"),
        "pages": ([(i, "u", "<html><body><p>same beginning " + str(i)) for i in range(n)], "page_id long, url string, html string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_whole_content(spark, tmp_path):
    rows = texts.evidence_rows(spark, made(spark, tmp_path))
    kept = {(r.source_type, r.ord) for r in evidence.deduplicated(rows).collect()}
    assert {k for k in kept if k[0] in ("policy", "scanned")} == {("policy", 0), ("policy", 2), ("scanned", 0), ("scanned", 1), ("scanned", 2)}
    union = {(r.source_type, r.ord) for r in texts.evidence_union(spark, str(tmp_path)).collect()}
    assert union == kept
    account = {r.source_type: (r.returned, r.kept, r.duplicates) for r in texts.gap_account(spark, str(tmp_path)).collect()}
    assert account["policy"] == (3, 2, 1) and account["scanned"] == (3, 3, 0)


def test_ids_of_all_rows(spark, tmp_path):
    made(spark, tmp_path, 120)
    out = texts.evidence_ids(spark, str(tmp_path)).collect()
    place = {"sql": 0, "policy": 1}
    expected = sorted(((place.get(r.source_type, 2), r.ord, r.source_type) for r in texts.evidence_union(spark, str(tmp_path)).collect()))
    assert [(r.source_type, r.ord) for r in sorted(out, key=lambda r: int(r.evidence_id[1:]))] == [(s, o) for _, o, s in expected]
    assert sorted(int(r.evidence_id[1:]) for r in out) == list(range(1, len(expected) + 1)) and max(r.ord for r in out) == 119


def test_no_window_over_all_rows(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'sql', 'policy') source_type", "'t' source_id", "'' locator", "string(id) content", "1.0D confidence", "id div 7 ord")
    found = evidence.canonical(rows, ["policy", "sql"])
    got = sorted(found.collect(), key=lambda r: int(r.evidence_id[1:]))
    assert [int(r.evidence_id[1:]) for r in got] == list(range(1, 5001))
    key = lambda r: (r.source_type != "policy", r.ord, r.dedup_key)
    assert [r.dedup_key for r in got] == [r.dedup_key for r in sorted(got, key=key)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(position" in plan


def test_all_steps_give_evidence(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 2), (3, 3), (5, 4), (10, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.step, r.locator, r.row_count) for r in texts.sheet_evidence(spark, str(tmp_path)).collect()}
    assert got == {(1, "book!sheet!A1:D1", 1), (2, "book!sheet!A2:D2", 1), (3, "book!sheet!A3:D3", 1), (4, "book!sheet", 2)}
