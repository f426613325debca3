"""The pipeline on a small corpus against its stages done by hand."""

from collections import Counter, defaultdict

from test_brute_force import BYTE_BPE, brute_components, brute_repeats, documents, ids_of

import corpus_pipeline
from factloom.llm import quality


def test_stages(spark, tmp_path):
    rows = [(r[0], r[1] and r[1].replace("7 ", "7. "), *r[2:5]) for r in documents(150, 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] or "" for r in rows}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "best-fit packing"]

    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept and 0 < len(kept) < len(texts)

    two = corpus_pipeline.near_duplicates(spark, one, str(tmp_path))
    left = [(d, texts[d]) for d in kept]
    roots = {d for d, _, c in brute_components(left, 5, 80) if c == d}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == roots

    three = corpus_pipeline.repeated_passages(spark, two, str(tmp_path))
    left = [(d, texts[d]) for d in roots]
    want = {(d, n, gone) for d, n, gone, _ in brute_repeats(left, 20)}
    got = three.collect()
    assert three.columns == docs.columns and {r.doc_id for r in got} == roots
    removed = {d: gone for d, _, gone in want}
    for r in got:
        assert r.n_chars == len(r.text) and (r.text == texts[r.doc_id] if not removed[r.doc_id] else len(r.text.split()) == len(texts[r.doc_id].split()) - removed[r.doc_id])
    assert any(removed.values())

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = Counter()
    for r in packed:
        sizes[r.doc_id] += r.length
    assert sizes == Counter({r.doc_id: len(ids_of(r.text)) + 1 for r in got})
    by = defaultdict(int)
    for r in packed:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 2048 and BYTE_BPE


def test_extra_columns(spark, tmp_path):
    rows = [(i, f"word{i} and more. " * 3 + " ".join(f"x{i}y{j}." for j in range(80)), "en", "s", 10, 7) for i in range(12)]
    odd = ["bucket", "n_words", "kept", "quality", "v_length", "runs", "later_id", "_row", "id", "root"]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, x int")
    made.selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"x as `{c}`" for c in odd]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *odd]
    assert docs.count() == 12
