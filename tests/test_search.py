"""Scoped searches, step evidence, stems, same statements, the value cache and usage windows."""

import datetime
import random
import time
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factloom.functions.stems import stem
from factloom.operators import search, sparse, usage
from factloom.plans import observe
from factloom.plans.guard import Guard
from factloom.plans.values import ValueCache
from factloom.sources.documents import ChunkStore

CHUNKS = "id string, doc_id string, source_type string, claim_id string, doc_name string, page int, clause_id string, section string, ocr_confidence double, text string, embedding array<double>"
ROWS = [
    ("p:0", "p", "policy", None, "motor.txt", 1, "4.2", "Cover", None, "Water damage is covered by this policy", [1.0, 0.0]),
    ("p:1", "p", "policy", None, "motor.txt", 2, None, "Limits", None, "Fire and theft limits", [0.0, 1.0]),
    ("p:2", "p", "policy", None, "motor.txt", None, None, None, None, "Damaged water pipes", [0.6, 0.8]),
    ("s:0", "s", "scanned", "CLM-1", "scan.pdf", 3, None, None, 0.55, "water damage estimate", [1.0, 0.0]),
    ("s:1", "s", "scanned", "CLM-1", "scan.pdf", 4, None, None, None, "water invoice", [0.9, 0.1]),
    ("t:0", "t", "scanned", "CLM-2", "other.pdf", 1, None, None, float("nan"), "water", [1.0, 0.0]),
    ("u:0", "u", "scanned", "CLM-3", "broken.pdf", None, None, None, 0.9, "water", [1.0, 0.0]),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    made = ChunkStore(spark, str(tmp_path_factory.mktemp("store")), 4, stemmed=True)
    made.add(spark.createDataFrame(ROWS, CHUNKS))
    return made


def test_scoped_search(spark, store, tmp_path):
    vector = lambda q: [1.0, 0.0]
    found = search.PolicySearch(store, vector).search("water damage", {"source_type": "scanned"}, 2).orderBy("rank").collect()
    assert [(r.source_type, r.source_id, r.locator, r.confidence, r.chunk_id, r["rank"]) for r in found] == [("policy", "p", "motor.txt › page 1 › 4.2", 1.0, "p:0", 1), ("policy", "p", "motor.txt", 1.0, "p:2", 2)]
    scans = search.ScannedSearch(store, vector, mode="dense", reranked=False)
    mine = scans.search("water", "CLM-1").orderBy("rank").collect()
    assert [(r.chunk_id, r.locator, r.confidence) for r in mine] == [("s:0", "scan.pdf › page 3 › OCR 0.55", 0.55), ("s:1", "scan.pdf › page 4 › OCR 0.00", 0.0)]
    assert scans.search("water", "CLM-2").first().confidence == 0.0 and scans.search("water", "CLM-9").count() == 0
    with pytest.raises(Exception, match="no page"):
        scans.search("water", "CLM-3").collect()
    with pytest.raises(ValueError, match="empty"):
        scans.search("  ")
    with pytest.raises(ValueError, match="cannot filter"):
        scans.search("water", filters={"text": "x"})
    with pytest.raises(search.EmptyIndex):
        search.PolicySearch(ChunkStore(spark, str(tmp_path)), vector).search("water")


def test_modes(spark, store):
    chunks = store.chunks()
    with pytest.raises(ValueError, match="index"):
        search.retrieve(chunks, None, "water", [1.0, 0.0])
    with pytest.raises(ValueError, match="mode"):
        search.retrieve(chunks, None, "water", [1.0, 0.0], mode="sparse")
    dense = search.retrieve(chunks, None, "fire limits", [1.0, 0.0], 3, "dense", reranked=False, filters={"source_type": "policy"}).orderBy("rank").collect()
    assert [r.id for r in dense] == ["p:0", "p:2", "p:1"]
    again = search.retrieve(chunks, None, "fire limits", [1.0, 0.0], 1, "dense", filters={"source_type": "policy"}).collect()
    assert [(r.id, r["rank"]) for r in again] == [("p:1", 1)]  # the rerank looks beyond the limit
    hybrid = search.hybrid(chunks, store.healed_index(), "theft", [1.0, 0.0], 9, {"source_type": "policy"}, dense_k=1).collect()
    assert {r.id: round(r.score, 6) for r in hybrid} == {"p:0": 1.0, "p:1": 0.0}  # a sparse hit has its own likeness
    assert store.healed_index().terms_of("The damages") == ["damag"]


def test_steps_as_evidence(spark):
    steps = spark.createDataFrame([(1, "Open claims", "claims", "claims, policies", ["a", "b"], None), (2, "", "claims", "claims", ["a"], "no such region"), (3, "Many", "claims", "claims", ["n"], None)], "step int, purpose string, table string, tables string, columns array<string>, failure string")
    rows = spark.createDataFrame([(1, 1, ["x", None]), (1, 2, ["y" * 130, "z"])] + [(3, i, [str(i)]) for i in range(60, 0, -1)], "step int, n int, cells array<string>")
    got = {r.step: r for r in search.step_evidence(steps, rows).collect()}
    assert got[1].content == "Open claims\na | b\nx | \n" + "y" * 120 + "... | z\n(2 rows)" and got[1].locator == "claims, policies › 2 rows"
    assert got[2].content == "Claims database query\nNo rows. no such region" and got[2].row_count == 0
    assert got[3].content == "Many\nn\n" + "\n".join(map(str, range(1, 51))) + "\n... 60 rows in total; the first 50 are shown."


# Pairs of words and stems as the stemmer's authors publish them.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspiring conspir constable constabl constables constabl
constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock
knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()


def test_stems():
    for word, want in zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True):
        assert stem(word) == want, word
    more = {"ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre", "hopping": "hop", "hoping": "hope", "luxuriated": "luxuri", "cry": "cri", "by": "by", "say": "say", "generate": "generat", "general": "general", "communism": "communism", "arsenal": "arsenal", "skies": "sky", "succeed": "succeed", "relational": "relat", "claims": "claim", "covered": "cover", "national": "nation", "damages": "damag", "bed": "bed", "shed": "shed", "rap": "rap", "at": "at", "is": "is", "controlling": "control", "roll": "roll"}
    assert {w: stem(w) for w in more} == more


def test_a_stemmed_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "claims claimed claim"), (2, "claiming other things"), (3, "thing"), (4, None)], "doc_id long, text string")
    sparse.write_index(docs, str(tmp_path / "i"), "", stemmed=True)
    index = sparse.read_index(spark, str(tmp_path / "i"))
    assert {r.term: r.df for r in index.dictionary.collect()} == {"claim": 2, "other": 1, "thing": 2}
    assert [r.doc_id for r in index.search(index.terms_of("The claims"), 5).orderBy("rank").collect()] == [1, 2] and (index.n_docs, index.avgdl) == (4, 7 / 4)


def test_same_statements(spark):
    claims = spark.createDataFrame([(1, "open", 2.0)], "id int, status string, paid double")
    guard = Guard(spark, {"ops.claims": claims}, 100)
    base = "select status, sum(paid) as total from claims where id > 3 group by status"
    same = ["SELECT c.status,\n SUM(c.paid) AS total FROM claims c WHERE c.id > 3 GROUP BY c.status", "select x.status, sum(x.paid) total from ops.claims as x where (x.id > 3) group by x.status"]
    other = ["select status, sum(paid) as total from claims where id > 4 group by status", "select status, sum(paid) as s from claims where id > 3 group by status", "select status, avg(paid) as total from claims where id > 3 group by status"]
    assert all(observe.same_statement(base, s, guard.frame) for s in same) and not any(observe.same_statement(base, s, guard.frame) for s in other)
    assert not observe.same_statement(base, same[0])
    assert observe.same_statement("select  nonsense from", "SELECT nonsense\nFROM", guard.frame) and not observe.same_statement("not sql", base, guard.frame)
    votes = observe.distinct_statements([*other[:1], *same, base], guard.frame)
    assert votes == [(base, 3), (other[0], 1)]
    tried = []

    def run(sql):
        tried.append(sql)
        return observe.Result(), observe.Observation("sql_error", ("no",))

    assert observe.repaired(base, run, lambda s, o: same[0], frame=guard.frame).status == "no_progress" and len(tried) == 1


def test_values_are_kept_by_generation(spark, tmp_path):
    for name, rows in (("a", [("Lahore, Punjab", "CLM-1")]), ("b", [("Water", "CLM-2")])):
        spark.createDataFrame(rows, "city string, claim_number string").write.parquet(str(tmp_path / name))
    cache = ValueCache(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")})
    values = lambda: {r.value for r in cache.catalogue().where("column_name = 'city'").collect()}
    assert values() == {"Lahore, Punjab", "Lahore", "Punjab", "Water"} and cache.refreshed == ["a", "b"]
    assert {r.value for r in cache.references().collect()} == {"CLM-1", "CLM-2"} and cache.refreshed == []
    time.sleep(0.02)
    spark.createDataFrame([("Fire", "CLM-3")], "city string, claim_number string").write.mode("append").parquet(str(tmp_path / "b"))
    assert values() == {"Lahore, Punjab", "Lahore", "Punjab", "Water", "Fire"} and cache.refreshed == ["b"]
    spark.createDataFrame([("Theft", "CLM-4")], "city string, claim_number string").write.mode("overwrite").parquet(str(tmp_path / "a"))
    assert values() == {"Theft", "Water", "Fire"} and cache.refreshed == ["a"]
    assert {r.table_name for r in cache.catalogue(["b"]).collect()} == {"b"} and cache.refreshed == []
    cache.invalidate("a")
    assert values() and cache.refreshed == ["a"]


def test_windows_over_hot_keys(spark):
    """Counts and sums as by plain Python, with ties, negative and missing times; a hot key is spread over tasks."""
    r = random.Random(3)
    start = datetime.datetime(1969, 12, 31, 23, 59)
    calls = [(i, r.choice(["hot", "hot", "hot", "hot", "cold", None]), None if r.random() < 0.03 else start + datetime.timedelta(seconds=r.randrange(0, 1200)), r.choice([None, 0.1, 1.25, 3.0])) for i in range(900)]
    df = spark.createDataFrame(calls, "id long, k string, ts timestamp_ntz, cost double")
    got = {x.id: (x.n_recent, x.over_limit) for x in usage.limited(df, "k", "ts", 20, 60).collect()}
    by = defaultdict(list)
    for c in calls:
        by[c[1]].append(c)
    for i, k, ts, _ in calls:
        n = sum((t is None) == (ts is None) and (ts is None or datetime.timedelta(0) <= ts - t < datetime.timedelta(seconds=60)) for _, _, t, _ in by[k])
        assert got[i] == (n, n > 20)
    spent = {x.id: (x.spent_before, x.blocked) for x in usage.running_spend(df, "k", "ts", "id", "cost", 100, slice_seconds=100).collect()}
    assert len(spent) == len(calls)
    for rows in by.values():
        total = Decimal(0)
        for i, _, _, cost in sorted(rows, key=lambda c: (c[2] is not None, c[2] or start, c[0])):
            assert spent[i] == (total, total >= 100)
            total += Decimal(str(cost or 0))
    hot = df.where("k = 'hot' and ts is not null")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = Counter(x.p for x in usage.calls_in_window(hot.repartition(3), "k", "ts", 20).withColumn("p", F.spark_partition_id()).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 3 and max(tasks.values()) < 0.5 * sum(tasks.values())
