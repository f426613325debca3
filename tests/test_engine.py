import zipfile
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom import protocols
from factloom.control import runs
from factloom.corpus import generator
from factloom.operators import evidence, manifest, ranking, retrieval
from factloom.sources import sheets, xlsx
from factloom.streaming import events


def workbook(path, rows, merges=()):
    """A minimal .xlsx with inline texts; a float or int is a number cell, ('%', x) has a percent format."""
    letters = "ABCDEFGHIJ"
    body = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{letters[c]}{r}"
            if v is None:
                continue
            if isinstance(v, tuple):
                cells.append(f'<c r="{ref}" s="1"><v>{v[1]}</v></c>')
            elif isinstance(v, str):
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    merged = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Compliance" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData><mergeCells>{merged}</mergeCells></worksheet>')


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    path = tmp_path_factory.mktemp("books") / "inspections q1.xlsx"
    workbook(path, [["Inspection report"], [], ["Region", "Done", None, "Rate"], ["Lahore", 12, None, ("%", 0.82)], ["Karachi", "N/A", None, "60%"], ["Multan", 3, None, ("%", 0.5)], ["TOTAL", 15]], ["A1:D1"])
    return path


def test_xlsx(spark, book):
    xlsx.register(spark)
    cells = spark.read.format("xlsx_cells").load(str(book.parent))
    assert cells.where("row = 1").count() == 4
    frame = cells.toPandas()
    (t,) = sheets.sheet_tables(frame)
    assert t.title == "Inspection report" and t.header_rows == (3,) and (t.first_row, t.last_row, t.footer_rows) == (4, 6, (7,))
    assert [label for _, label in t.columns] == ["Region", "Done", "Rate"] and t.a1_range(4) == "A4:D4"
    numbered = sheets.islands(cells).select("row", "island").distinct().toPandas().sort_values("row").island.tolist()
    assert numbered == [1, 2, 2, 2, 2, 2]
    first = sheets.islands(cells).where("col = 1").withColumnRenamed("value", "first_cell")
    assert [r.row for r in sheets.footer_rows(first).where("is_footer").collect()] == [7]
    rows = sheets.typed_table(spark, cells, t, "g").orderBy("_row").collect()
    assert [(r.region, r.done, float(r.rate), r._a1_range) for r in rows] == [("Lahore", Decimal(12), 0.82, "A4:D4"), ("Karachi", None, 0.6, "A5:D5"), ("Multan", Decimal(3), 0.5, "A6:D6")]
    shown, total, cut = sheets.verbatim(cells, book.name, "Compliance", 2)
    assert (len(shown), total, cut) == (2, 6, True)
    with pytest.raises(KeyError):
        sheets.verbatim(cells, book.name, "Nope")


def test_ingest(spark, book, tmp_path):
    placed = sheets.ingest(spark, str(book), str(tmp_path))
    assert list(placed) == ["inspections_q1__compliance"]
    assert spark.read.parquet(next(iter(placed.values()))).count() == 3


def test_stacked_header():
    cells = [("b", "s", 1, 1, "Region"), ("b", "s", 1, 2, "Q1"), ("b", "s", 1, 3, "Q1"), ("b", "s", 2, 2, "Target"), ("b", "s", 2, 3, "Actual"), ("b", "s", 3, 1, "Lahore"), ("b", "s", 3, 2, "5"), ("b", "s", 3, 3, "6")]
    frame = pd.DataFrame([(*c, "number" if c[4].isdigit() else "text") for c in cells], columns=["workbook", "sheet", "row", "col", "value", "value_kind"])
    (t,) = sheets.sheet_tables(frame)
    assert t.header_rows == (1, 2) and [label for _, label in t.columns] == ["Region", "Q1 Target", "Q1 Actual"]


def test_corpus(spark):
    small = {"customers": 400, "policies": 600, "claims": 1200}
    tables = generator.generate(spark, 7, small)
    assert generator.findings(tables).count() == 0
    assert generator.findings({"claims": tables["claims"]}).count() == 6
    shares = {r.status: r["count"] for r in tables["claims"].groupBy("status").count().collect()}
    assert shares == {"open": 480, "closed": 420, "denied": 60, "reopened": 144, "pending": 96}
    again = generator.generate(spark, 7, small)["claims"]
    assert again.exceptAll(tables["claims"]).count() == 0
    assert generator.generate(spark, 8, small)["claims"].exceptAll(tables["claims"]).count() > 0
    per = generator.scanned_selection(tables["claims"], 2).groupBy("peril", F.date_format("date_of_loss", "yyyy-MM")).count()
    assert per.agg(F.max("count")).first()[0] <= 2
    broken = dict(tables, claims=tables["claims"].withColumn("paid", F.col("paid") + 1))
    assert generator.findings(broken).where("rule = 'money'").count() == 1200


def test_evidence(spark):
    rows = spark.createDataFrame([("sql", "t", "a", "x  y", 1.0, 1), ("sql", "t", "a", "x y", 0.5, 2), ("policy", "d", "p1", "z", 0.4, 3)], "source_type string, source_id string, locator string, content string, confidence double, ord long")
    ids = evidence.canonical(rows, ["policy", "sql"]).orderBy("evidence_id").collect()
    assert [(r.source_type, r.ord) for r in ids] == [("policy", 3), ("sql", 1)]
    reject = spark.createDataFrame([("x", "c", 0.5), ("sql", " ", 0.5), ("sql", "c", float("nan")), ("sql", "c", 1.0)], "source_type string, content string, confidence double")
    assert [r.r for r in reject.select(evidence.rejected().alias("r")).collect()] == ["unknown source", "blank content", "confidence out of range", None]
    report = spark.createDataFrame([(1, 1)], "conv_id int, unresolved long")
    with pytest.raises(Exception, match="no evidence"):
        evidence.require_resolved(report).collect()


def test_rrf(spark):
    lists = [spark.createDataFrame(rows, "id string, rank int") for rows in ([("a", 1), ("b", 2)], [("b", 1), ("a", 2)])]
    assert [r.rrf_score for r in ranking.rrf(lists, "id").collect()] == [1 / 61 + 1 / 62] * 2
    with pytest.raises(ValueError):
        ranking.rrf(lists, "id", 0)


def test_retrieval_filters(spark):
    with pytest.raises(ValueError):
        retrieval.where({"nope": 1})
    with pytest.raises(ValueError):
        retrieval.where({"lang": []})
    docs = spark.createDataFrame([(1, "leak of water in a pipe", "en"), (2, "theft of a car", "en"), (3, "water water damage", "de")], "doc_id int, text string, lang string")
    assert [r.doc_id for r in retrieval.sparse_search(docs, "water", 5).orderBy("rank").collect()] == [3, 1]
    both, one = (retrieval.sparse_search(docs, "water", 5, filters=f).where("doc_id = 1").first().score for f in (None, {"lang": "en"}))
    assert both == one


def test_manifest(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    store = frame([("a", "a:0"), ("b", "b:0"), ("c", "c:0")], "doc_id string, chunk_id string")
    diff = frame([("a", "skipped"), ("b", "updated"), ("c", "removed"), ("d", "added")], "doc_id string, state string")
    fresh = frame([("b", "b:9"), ("d", "d:0")], "doc_id string, chunk_id string")
    assert sorted(r.chunk_id for r in manifest.upserted(store, fresh, diff).collect()) == ["a:0", "b:9", "d:0"]
    assert manifest.without_chunks(fresh, diff).count() == 0
    assert [r.doc_id for r in manifest.without_chunks(fresh.where("doc_id = 'b'"), diff).collect()] == ["d"]
    pages = frame([("d", f"d:{i}") for i in (10, 2, 1)] + [("d", "odd")], "doc_id string, chunk_id string")
    assert [r.chunk_id for r in manifest.chunk_page(pages, "d", 3, 1).collect()] == ["d:2", "d:10", "odd"]
    lines = frame([("d", p, n, t) for p in (1, 2, 3) for n, t in ((1, "ACME policy"), (2, f"body {p} x" * p), (3, f"Page {p}"))], "doc_id string, page int, line_no int, line string")
    assert {r.signature for r in manifest.furniture(lines, 1).collect()} == {"ACME policy", "Page #"}
    assert [r.signature for r in manifest.page_stamps(lines, 1).collect()] == ["Page #"]


def test_streams(spark, sf, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").coalesce(2).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    out, seen = tmp_path / "out", []
    events.ndjson_sink(events.folder_stream(spark, str(source), schema).select("event_id"), str(out), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.text(str(out)).count() == spark.read.parquet(str(source)).count()
    docs = events.folder_stream(spark, str(source), schema).selectExpr("event_type as doc_id", "event_type as content_hash")
    events.ingest_changes(docs, lambda batch, n: seen.append(batch.count()), str(tmp_path / "c2")).awaitTermination(60)
    assert sum(seen) == 5
    counts = events.tumbling_counts(events.folder_stream(spark, str(source), schema), "ts", "event_type")
    query = counts.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == spark.read.parquet(str(source)).count()


def test_control():
    budget = runs.Budget(request=0.01, session=0, lifetime=1)
    budget.record(0.02)
    with pytest.raises(runs.Refused, match="request"):
        budget.check()
    budget.new_request()
    budget.check()
    now = [1000.0]
    limiter = runs.Limiter(2, 3, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert [limiter.acquire() for _ in range(3)] == [0.0, 0.0, 60.0]
    with pytest.raises(runs.Refused, match="daily"):
        limiter.acquire()

    def slow(prompt):
        raise TimeoutError("slow")

    assert runs.walk_ladder([runs.Rung("a", slow), runs.Rung("b", str.upper, True), runs.Rung("c", str.title)], "hi")[:2] == ("Hi", "c")
    with pytest.raises(runs.Refused):
        runs.walk_ladder([runs.Rung("a", slow)], "hi")
    assert runs.load_routing({"plan": "small"}, {"small": "m"}, ["plan"]) == {"plan": "m"}
    with pytest.raises(ValueError):
        runs.load_routing({"plan": "odd"}, {"small": "m"}, ["plan"])
    assert runs.parse_json('```json\n{"a": 1}\n```') == {"a": 1} and runs.clamped(float("nan")) == 0.0 and runs.clamped("x") == 0.0

    def broken(question):
        raise OSError("down")

    found = list(runs.run_graph({"sql": lambda q: [{"x": 1}], "policy": broken}, "q", lambda q: ["sql", "policy"], lambda rows: [], lambda q, rows: f"{len(rows)}"))
    assert [e["kind"] for e in found] == ["started", "stage", "evidence", "stage", "answer"] and found[3]["error"]
    assert list(runs.run_graph({}, "q", lambda q: ["no"], lambda r: [], lambda q, r: ""))[-1]["kind"] == "error"
    registry = runs.Registry()
    lines = registry.events("r", iter([{"kind": "started"}, {"kind": "answer"}]))
    next(lines)
    assert registry.cancel("r") and "cancelled" in next(lines) and next(lines, None) is None
    assert not registry.cancel("r")


def test_protocols():
    vectors = protocols.checked_embeddings(protocols.HashingEmbedder(16), ["a b", "c"], 16, 1)
    assert len(vectors) == 2 and abs(sum(x * x for x in vectors[0]) - 1) < 1e-9
    with pytest.raises(ValueError):
        protocols.checked_embeddings(protocols.HashingEmbedder(16), ["a"], 8)
    assert protocols.split_pages("a|b", "|", 3) == ["a", "b", ""]
    with pytest.raises(ValueError):
        protocols.split_pages("a|b", "|", 1)
    assert protocols.escalated([(1, "t", 0.9), (2, "u", 0.1), (3, "v", 0.1), (4, "w", 0.1)], {2: (True, "U", 0.99), 3: (False, "", 0)}) == [(1, "t", 0.9, "kept"), (2, "U", 0.85, "replaced"), (3, "v", 0.0, "illegible"), (4, "w", 0.1, "unavailable")]
    with pytest.raises(ValueError):
        protocols.checked_route(["a", "a"], ["a"], 0.5, False)
    with pytest.raises(ValueError):
        protocols.checked_plan({"a": "x"}, ["b"])


def test_contexts(spark, tmp_path):
    import json

    from factloom.plans import contexts

    write = lambda name, **raw: (tmp_path / f"{name}.json").write_text(json.dumps(raw))
    write("claims", table="ops.claims", columns=["claim_id", "policy_id", "paid"], joins=[{"column": "policy_id", "table": "ops.policies", "to": "policy_id"}], invariants=[{"kind": "non_negative", "columns": ["paid"]}])
    with pytest.raises(contexts.ContextError, match="isn't described"):
        contexts.load_contexts(str(tmp_path))
    write("policies", table="ops.policies", columns=["policy_id"])
    found = contexts.load_contexts(str(tmp_path))
    assert contexts.join_pairs(found) == [("ops.claims", "ops.policies")] and found["ops.claims"].checks()[0].columns == ("paid",)
    df = spark.createDataFrame([(1, 2, 3, 4)], "claim_id int, policy_id int, paid int, extra int")
    assert contexts.refreshed(found["ops.claims"], df).columns[-1] == "extra"
    with pytest.raises(contexts.ContextError, match="lost"):
        contexts.refresh_all(found, {"ops.claims": df.drop("paid"), "ops.policies": df})
    write("again", table="ops.policies", columns=["policy_id"])
    with pytest.raises(contexts.ContextError, match="twice"):
        contexts.load_contexts(str(tmp_path))
    (tmp_path / "sources.json").write_text(json.dumps([{"name": "sql", "description": "d"}]))
    assert contexts.load_capabilities(str(tmp_path / "sources.json"))[0]["name"] == "sql"
    (tmp_path / "sources.json").write_text(json.dumps([{"name": "sql", "odd": 1}]))
    with pytest.raises(contexts.ContextError):
        contexts.load_capabilities(str(tmp_path / "sources.json"))


def test_documents(spark, tmp_path):
    from factloom.sources import documents

    (tmp_path / "docs" / "deep").mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "docs" / "deep" / "b.md").write_text("# head")
    (tmp_path / "docs" / "c.bin").write_text("no")
    files = documents.document_files(spark, str(tmp_path / "docs")).orderBy("path").collect()
    assert [f.text for f in files] == ["plain � text", "# head"]
    assert documents.corpus_manifest(documents.document_files(spark, str(tmp_path / "docs")), "policy").count() == 2

    store = documents.ChunkStore(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.chunks()
    schema = "id string, doc_id string, source_type string, text string"
    rows = [("a:0", "a", "policy", "water leak"), ("a:1", "a", "policy", "fire"), ("b:0", "b", "scanned", "water")]
    vectors = spark.createDataFrame([(r[0], [1.0, 0.0]) for r in rows], "id string, embedding array<double>")
    store.add(spark.createDataFrame(rows, schema), vectors)
    assert {r.doc_id: r.n_chunks for r in store.counts().collect()} == {"a": 2, "b": 1}
    with pytest.raises(FileNotFoundError):
        store.load_index()
    assert store.healed_index().dictionary.where("term = 'water'").first().df == 2
    store.add(spark.createDataFrame([("a:0", "a", "policy", "storm")], schema), vectors)
    assert sorted(r.id for r in store.chunks().collect()) == ["a:0", "b:0"] and store.chunks({"doc_id": "b"}).count() == 1
    with pytest.raises(documents.CorruptIndex):
        store.load_index()
    assert store.healed_index().dictionary.where("term = 'storm'").first().df == 1
    with pytest.raises(Exception, match="no embedding"):
        store.add(spark.createDataFrame([("z:0", "z", "policy", "x")], schema), vectors)
    store.delete(spark.createDataFrame([("b",)], "doc_id string"))
    assert [r.id for r in store.by_ids(spark.createDataFrame([("a:0",), ("b:0",)], "id string")).collect()] == ["a:0"]


def test_spend(spark, tmp_path):
    path = str(tmp_path / "spend.json")
    spend = runs.PersistentSpend(path)
    spend.record("m", 10, 5, 0.25, 1.0)
    assert runs.PersistentSpend(path).total == 0.25
    (tmp_path / "spend.json").write_text("{broken")
    assert runs.PersistentSpend(path).total == 0
    assert runs.with_timeout(spark, 30, lambda: spark.range(10).count()) == 10
    with pytest.raises(TimeoutError):
        runs.with_timeout(spark, 1, lambda: spark.range(1 << 40).selectExpr("sum(sqrt(id) * sqrt(id + 1))").collect())


def test_page_texts(spark):
    from factloom.functions import text

    assert text.normalise_page("ﬁre­  x \n\n\n\n y ") == "fire x\n\n y"
    table = spark.createDataFrame([([["a", "", "b"], ["", None, ""], ["c", " ", "d"]],), ([["only", "row"]],)], "t array<array<string>>")
    assert [r.x for r in table.select(text.rendered_table(F.col("t")).alias("x")).collect()] == ["a | b\nc | d", ""]
    pages = spark.createDataFrame([("--\n ok \n***",), ("--",), (None,)], "t string")
    got = pages.select(*[c.alias(n) for c, n in zip(text.scanned_page_text(F.col("t"), F.lit(0.9)), ("t", "c"), strict=True)]).collect()
    assert [(r.t, r.c) for r in got] == [("ok", 0.9), (text.UNREADABLE, 0.0), (text.UNREADABLE, 0.0)]
    ids = spark.createDataFrame([("sql", "E2", "x", 0.2), ("sql", "E10", "y", 1.0)], "source_type string, evidence_id string, content string, confidence double")
    assert evidence.rendered(ids).first().text == "[E2] x ⚠ low confidence\n[E10] y"
