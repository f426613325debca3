"""Commits, published tables, the chunk store and the stored index: failures, conflicts, readers beside writers."""

import math
import os
import random
import threading
from collections import Counter

import pytest
from helpers import moved
from pyspark.sql import functions as F

from factloom.operators import retrieval, sparse
from factloom.sources import commits, documents

CHUNKS = "id string, doc_id string, source_type string, text string"


def test_one_of_two_writers_looks_again(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    assert log.state() == (0, {})
    assert log.commit(0, {"a": 1}) == 1
    with pytest.raises(commits.Conflict):
        log.commit(0, {"b": 1})
    seen = []

    def change(state):
        if not seen:
            log.commit(1, {"other": True})  # another writer, between reading and committing
        seen.append(state)
        return {**state, "mine": True}

    assert log.update(change) == 3 and log.state()[1] == {"other": True, "mine": True} and len(seen) == 2
    assert log.state(1) == (1, {"a": 1}) and log.update(lambda s: None) == 3
    (tmp_path / "_log" / f"{4:020d}.json").write_text("{broken")
    with pytest.raises(commits.Unreadable):
        log.state()


def test_tables_are_published_together(spark, tmp_path):
    held = commits.Publication(spark, str(tmp_path))
    old, new = spark.range(3), spark.range(5).withColumn("more", F.lit("x"))
    assert held.publish("book", "g1", {"a": old, "b": old}) == 1
    assert held.publish("book", "g1", {"a": new, "b": new}) == 1  # the same generation again is the same commit
    reader = held.table("a")

    broken = new.withColumn("id", F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        held.publish("book", "g2", {"a": new, "b": broken})
    assert held.log.version() == 1 and held.table("a").count() == 3 and len(held.log.files.names("data")) == 1

    def dies(batches):
        for batch in batches:
            os._exit(9)
            yield batch

    with pytest.raises(Exception):  # noqa: B017
        held.publish("book", "g2", {"a": new, "b": old.mapInArrow(dies, "id long")})
    assert held.tables()["b"]["generation"] == "g1" and held.table("b").count() == 3

    assert held.publish("book", "g2", {"a": new, "c": new}) == 2
    assert set(held.tables()) == {"a", "c"} and held.table("a").columns == ["id", "more"] and held.table("a", 1).count() == 3
    assert reader.count() == 3  # a reader keeps what it began with
    with pytest.raises(ValueError, match="another owner"):
        held.publish("other", "g", {"a": old})
    assert len(held.log.files.names("data")) == 2
    assert held.publish("other", "g", {"d": old}) == 3 and held.withdraw("other") == 4 and held.withdraw("other") == 4
    assert len(held.vacuum()) == 2 and held.table("a").count() == 5
    with pytest.raises(KeyError):
        held.table("d")


def rows(n, text="text"):
    return [(f"d{i}:{k}", f"d{i}", "policy" if i % 2 else "scanned", f"{text} {i} {k}") for i in range(n) for k in range(3)]


def files(tmp_path):
    return {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet")}


def test_a_change_touches_its_buckets(spark, tmp_path):
    store = documents.ChunkStore(spark, str(tmp_path), 8)
    with pytest.raises(LookupError):
        store.chunks()
    frame = lambda r: spark.createDataFrame(r, CHUNKS)
    store.add(frame(rows(40)))
    before, reader, first = files(tmp_path), store.chunks(), store.signature()
    leaves = store.log.state()[1]["leaves"]
    store.add(frame([("d3:0", "d3", "policy", "only one now")]))
    fresh = files(tmp_path) - before
    assert before <= files(tmp_path) and len({p.split("_bucket=")[1].split("/")[0] for p in fresh}) == 1
    again = store.log.state()[1]["leaves"]
    assert sum(leaves[b] != again[b] for b in leaves) == 1 and store.signature() != first
    assert reader.count() == 120 and store.chunks().count() == store.total() == 118
    assert [r.text for r in store.chunks({"doc_id": "d3"}).collect()] == ["only one now"]
    store.add(frame([r for r in rows(40) if r[1] == "d3"]))
    assert store.signature() == first  # the same chunks again, whatever the way to them
    store.delete(spark.createDataFrame([("d3",), ("unknown",)], "doc_id string"))
    assert store.total() == 117 and store.chunks({"doc_id": "d3"}).count() == 0
    state, signed = store.log.state()[1], store.signature()
    assert max(map(len, state["deltas"].values())) == 4
    store.compact(1)
    assert max(map(len, store.log.state()[1]["deltas"].values())) == 1 and store.signature() == signed and store.chunks().count() == 117
    assert store.compact(1) == store.version()
    assert store.vacuum() and store.chunks().count() == 117
    assert [r.id for r in store.ordered({"source_type": ["policy"]}).limit(3).collect()] == sorted(r[0] for r in rows(40) if int(r[1][1:]) % 2 and r[1] != "d3")[:3]
    with pytest.raises(ValueError, match="other columns"):
        store.add(frame(rows(1)).withColumn("x", F.lit(1)))
    store.reset()
    assert store.total() == 0
    with pytest.raises(LookupError):
        store.chunks()


def test_pages_of_a_document(spark, tmp_path):
    store = documents.ChunkStore(spark, str(tmp_path), 4)
    store.add(spark.createDataFrame([(f"a:{i}", "a", "policy", "x") for i in range(12)] + [("odd", "a", "policy", "x"), ("b:0", "b", "policy", "x")], CHUNKS))
    page, total = store.document_page("a", 3, 9)
    assert [r.id for r in page.collect()] == ["a:9", "a:10", "a:11"] and total == 13
    page, total = store.document_page("a", 5, 12)
    assert [r.id for r in page.collect()] == ["odd"] and store.document_page("none", 5)[1] == 0


def test_two_writers_at_once(spark, tmp_path):
    store = documents.ChunkStore(spark, str(tmp_path), 4)
    store.add(spark.createDataFrame(rows(6), CHUNKS))
    failures = []

    def write(i):
        try:
            documents.ChunkStore(spark, str(tmp_path), 4).add(spark.createDataFrame([(f"new{i}:0", f"new{i}", "policy", "x")], CHUNKS))
        except Exception as error:  # noqa: BLE001
            failures.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures and store.version() == 4 and store.total() == 21 == store.chunks().count()


def test_documents_are_indexed_incrementally(spark, tmp_path):
    store, manifest = documents.ChunkStore(spark, str(tmp_path / "s"), 4), documents.IndexManifest(spark, str(tmp_path / "m"))
    docs = lambda r: spark.createDataFrame([(d, f"h{t}", t) for d, t in r], "doc_id string, content_hash string, text string")
    asked = []

    def chunked(df):
        asked.append({r.doc_id for r in df.collect()})
        return df.where("text <> ''").select(F.concat("doc_id", F.lit(":0")).alias("id"), "doc_id", F.lit("policy").alias("source_type"), "text")

    store.add(spark.createDataFrame([("z:0", "z", "scanned", "of another manifest")], CHUNKS))
    run = lambda r, **k: documents.index_documents(store, manifest, docs(r), chunked, **k)
    assert run([("a", "1"), ("b", "2"), ("c", "3")]) == {"added": 3, "updated": 0, "skipped": 0, "removed": 0}
    version = store.version()
    assert run([("a", "1"), ("b", "2"), ("c", "3")]) == {"added": 0, "updated": 0, "skipped": 3, "removed": 0} and store.version() == version and asked[-1] == set()
    assert run([("a", "1"), ("b", "new"), ("d", "4")]) == {"added": 1, "updated": 1, "skipped": 1, "removed": 1} and asked[-1] == {"b", "d"}
    assert {r.doc_id: r.text for r in store.chunks().collect()} == {"a": "1", "b": "new", "d": "4", "z": "of another manifest"}
    with pytest.raises(documents.NoChunks, match="e"):
        run([("a", "1"), ("e", "")])
    assert store.total() == 4
    store.delete(spark.createDataFrame([("a",)], "doc_id string"))  # behind the manifest's back
    assert run([("a", "1"), ("b", "new"), ("d", "4")])["updated"] == 3 and store.total() == 4
    assert run([("a", "1"), ("b", "new"), ("d", "4")], force=True)["updated"] == 3
    (tmp_path / "m" / "_log" / f"{manifest.log.version():020d}.json").write_text("[")
    assert manifest.load().count() == 0 and run([("a", "1"), ("b", "new"), ("d", "4")])["added"] == 3 and store.total() == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_skipping_keeps_the_best(spark, tmp_path, seed):
    """The index gives the rows of scoring everything; rare terms let it skip ranges."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randrange(1, 60)))) for i in range(1500)] + [(9000, None), (9001, ""), (9002, "the of and")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    base = str(tmp_path / "index")
    assert sparse.read_index(spark, base) is None
    sparse.write_index(frame, base, "sig")
    index = sparse.read_index(spark, base)
    assert (index.n_docs, index.signature) == (1503, "sig")
    total_ranges = index.blocks.select("range").distinct().count()
    skipped = False
    for question in ("w0 w59", "w40 w41 w1", "w55", "w3 w3 w7", "w0", "none of these", "the"):
        query = sparse.query_terms(spark, question)
        got = [(x.doc_id, x.score, x["rank"]) for x in index.search(query, 7).collect()]
        want = [(x.doc_id, x.score, x["rank"]) for x in retrieval.sparse_search(frame, question, 7).collect()]
        assert sorted(got, key=lambda x: x[2]) == sorted(want, key=lambda x: x[2]), question
        if query:
            kept = index.kept_ranges(query, 7).count()
            skipped |= kept < total_ranges / 2
    assert skipped
    hits = index.search(["w0"], 7)
    assert all("/index/" in f for f in hits.inputFiles())
    allowed = frame.where("doc_id % 2 = 1").select("doc_id")
    assert all(x.doc_id % 2 for x in index.search(["w0", "w9"], 7, allowed).collect())
    df = Counter(w for _, t in docs for w in set((t or "").split()))
    assert {x.term: x.df for x in index.dictionary.where("term like 'w%'").collect()} == {w: n for w, n in df.items() if w in words}
    n, avg = 1503, sum(len([w for w in (t or "").split() if w in words]) for _, t in docs) / 1503
    best = index.search(["w55"], 1).first()
    text = dict(docs)[best.doc_id].split()
    tf = text.count("w55")
    assert best.score == pytest.approx(math.log(1 + (n - df["w55"] + 0.5) / (df["w55"] + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(text) / avg)), abs=1e-8)
    (tmp_path / "index" / "meta" / "part-x").unlink(missing_ok=True)
    for p in (tmp_path / "index" / "meta").glob("part-*"):
        p.write_text("{broken")
    for p in (tmp_path / "index" / "meta").glob(".part-*.crc"):
        p.unlink()
    assert sparse.read_index(spark, base) is None


def test_an_index_moves_texts_not_postings(spark, tmp_path):
    """What is shuffled is a row for each document, twice, and what the dictionary needs; nothing but the index is written."""
    words = [f"w{i}" for i in range(40)]
    frame = spark.createDataFrame([(i, " ".join(words)) for i in range(2000)], "doc_id long, text string").repartition(4).localCheckpoint()
    base = str(tmp_path / "index")
    records, _, _ = moved(spark, lambda: sparse.write_index(frame, base, ""))
    assert 2000 < records < 2 * 2000 + 20 * len(words)  # 80,000 postings
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["blocks", "dictionary", "meta"]
    index = sparse.read_index(spark, base)
    assert index.dictionary.where("df = 2000").count() == 40 and index.blocks.agg(F.sum("n"), F.sum(F.size("postings"))).first()[:] == (80000, 80000)
    assert [r.doc_id for r in index.search(["w3"], 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_merging_moves_keys_not_texts(spark, tmp_path):
    """Of a store with replaced and deleted documents what is shuffled is narrow; rows beyond a bitmap's 32,768 count, too."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.sha2(F.concat_ws(":", "id", i), 256)))
    made = lambda n, t: spark.range(n).select(F.concat("id", F.lit(":0")).alias("id"), F.col("id").cast("string").alias("doc_id"), F.lit("policy").alias("source_type"), t.alias("text"))
    store = documents.ChunkStore(spark, str(tmp_path / "s"), 2)
    store.add(made(2000, text))
    store.replace(made(2000, F.lit("")).where("doc_id % 11 = 0").select("doc_id"), made(2000, F.lit("changed")).where("doc_id % 7 = 0"))
    found = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that Spark wouldn't broadcast
    try:
        _, shuffled, _ = moved(spark, lambda: found.extend(store.chunks().select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n")).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {int(r.doc_id): r.n == 7 for r in found} == {i: i % 7 == 0 for i in range(2000) if i % 11 or i % 7 == 0} and len(found) == store.total()
    assert shuffled < 500_000 < 2000 * 40 * 65 * 0.5  # hexadecimal texts don't shrink below half
    many = documents.ChunkStore(spark, str(tmp_path / "many"), 1)
    many.add(made(300_000, F.lit("a")))
    many.replace(made(300_000, F.lit("")).where("doc_id % 3 = 0").select("doc_id"), made(300_000, F.lit("b")).where("doc_id % 5 = 0"))
    assert [tuple(r) for r in many.chunks().groupBy("text").agg(F.count("*"), F.sum(F.col("doc_id").cast("long"))).orderBy("text").collect()] == [
        (t, len(ids), sum(ids)) for t, ids in (("a", [i for i in range(300_000) if i % 3 and i % 5]), ("b", range(0, 300_000, 5)))
    ]
    many.compact(1)
    assert many.chunks().count() == many.total() == 160_000 + 60_000
