import pytest
from pyspark.sql import functions as F

from factloom.functions import similarity, text, values
from factloom.functions.chunks import split_text
from factloom.operators import structure


def one(spark, column, **row):
    names = list(row)
    schema = ", ".join(f"{n} {'string' if isinstance(row[n], str) or row[n] is None else 'double'}" for n in names)
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("x")).first().x


def test_normal_forms(spark):
    rows = [("Al-Faláh  INSURANCE",), (None,), ("",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(text.normalised("t").alias("x")).collect()]
    assert got == ["al falah insurance", None, ""]
    strip = lambda t: one(spark, text.without_noise(F.col("t")), t=t)
    assert strip("al falah insurance pvt ltd") == "al falah insurance"
    assert strip("ltd co") == "ltd co" and strip("co operative") == "operative" and strip("a ltd b") == "a ltd b"
    assert similarity.noise_stripped("ltd co") == "ltd co"


def test_citations(spark):
    cited = lambda t: one(spark, text.citations(F.col("t")), t=t)
    assert cited("x [E2] [E007][E2] [E] [e1]") == ["E2", "E7"]
    bad = one(spark, text.malformed_citations(F.col("t")), t="[E] [EX] [E ] [e] [known_gaps] [E12] [two words]")
    assert bad == ["[E]", "[EX]", "[E ]", "[e]", "[known_gaps]"]


def test_pages(spark):
    assert [one(spark, text.page_class(F.col("n"), F.col("a")), n=n, a=a) for n, a in ((100.0, 1e5), (0.0, 1e5), (1.0, 1e5), (5.0, 0.0))] == ["digital", "scanned", "mixed", "scanned"]
    score = lambda x: one(spark, text.page_confidence(F.lit(False), F.col("s")), s=x)
    assert [score(x) for x in (0.5, float("nan"), float("inf"), 1.5, -1.0)] == [0.5, 0.0, 0.0, 1.0, 0.0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(text.cosine(F.col("a"), F.col("b")).alias("x")).first().x == 0.0
    with pytest.raises(Exception, match="differ"):
        df.select(text.cosine(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_coercion(spark):
    number = lambda t: one(spark, values.decimal(F.col("t")), t=t)
    for spelling in ("250000", "250,000", "PKR 250,000", "Rs. 250000", "$250,000", "250 000", "pkr250000 ".replace("pkr", "PKR "), "250,000.00", "+250000", "€250000"):
        assert number(spelling) == 250000, spelling
    assert number("(12.5)") == -12.5 and number("n/a") is None and number("abc") is None and number(None) is None
    assert float(one(spark, values.percent(F.col("t")), t="82%")) == 0.82 and float(one(spark, values.percent(F.col("t")), t="0.5")) == 0.5
    assert str(one(spark, values.date(F.col("t")), t="03/04/2026")) == "2026-04-03"
    assert [one(spark, values.boolean(F.col("t")), t=t) for t in ("Yes", "0", "maybe")] == [True, False, None]
    assert one(spark, values.column_index(F.col("t")), t="AB") == 28 and values.column_letters(28) == "AB"
    made = one(spark, values.coerced(F.col("t"), "decimal"), t="oops")
    assert (made.value, made.ok, made.raw) == (None, False, "oops")
    assert one(spark, values.coerced(F.col("t"), "decimal"), t="N/A").ok


def test_split_text():
    body = "alpha beta gamma. " * 80
    parts = split_text(body, 20, 5)
    assert all(len(p) <= 80 for p in parts)
    back = parts[0] + "".join(p[20:] for p in parts[1:])
    assert back == body
    assert split_text("x" * 200, 10, 2)[0] == "x" * 40 and split_text("  ", 10, 2) == []
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            split_text("a", *bad)


def brute_stack(pages):
    """(page, labels, clause, text) of each block by a stack, line by line; headings are given as (depth, label, clause, line)."""
    stack, out = [], []
    for number, lines in enumerate(pages, 1):
        text, seen = "", list(stack)
        for i, line in enumerate(lines):
            end = "\n" if i + 1 < len(lines) else ""
            if isinstance(line, tuple):
                if text.strip():
                    out.append((number, [s[1] for s in seen], next((s[2] for s in reversed(seen) if s[2]), None), text))
                while stack and stack[-1][0] >= line[0]:
                    stack.pop()
                stack.append(line)
                text, seen = line[3] + end, list(stack)
            else:
                text += line + end
        if text.strip():
            out.append((number, [s[1] for s in seen], next((s[2] for s in reversed(seen) if s[2]), None), text))
    return out


FORMS = [
    lambda n: (1, f"Top {n}", None, f"# Top {n}"), lambda n: (2, f"SECTION {n}", f"SECTION {n}", f"SECTION {n}"), lambda n: (3, f"COVERAGE {n} - Rent", f"COVERAGE {n}", f"COVERAGE {n} - Rent"), lambda n: (4, f"{n}.1 Escape", f"{n}.1", f"{n}.1 Escape"),
    lambda n: (3, "GENERAL CONDITIONS", None, "GENERAL CONDITIONS"), lambda n: (5, f"Deep {n}", None, f"##### Deep {n}"), lambda n: (2, f"SECTION {n}: Limits", f"SECTION {n}", f"## SECTION {n}: Limits"),
]


@pytest.mark.parametrize("segment", [1, 3, 2000])
def test_nested_headings(spark, segment):
    """The scan in segments gives the blocks of the stack, whatever the length of a segment."""
    import random

    r = random.Random(segment)
    rows, want = [], {}
    for doc in range(12):
        pages = [[r.choice(FORMS)(r.randrange(1, 9)) if r.random() < 0.4 else r.choice(["some text", "  indented", "", "Contents ......... 3"]) for _ in range(r.randrange(0, 9))] for _ in range(r.randrange(1, 5))]
        rows += [(f"d{doc}", n, "\n".join(x[3] if isinstance(x, tuple) else x for x in p) if p else None) for n, p in enumerate(pages, 1)]
        # a text that ends with an empty line has no such line
        want[f"d{doc}"] = brute_stack([p if not p or p[-1] != "" else [*p[:-1]] for p in pages])
    df = spark.createDataFrame(rows, "doc_id string, page int, text string").repartition(4)
    got = {}
    for x in structure.policy_blocks(df, segment).orderBy("doc_id", "page", "block").collect():
        got.setdefault(x.doc_id, []).append((x.page, x.labels, x.clause_id, x.text))
    for doc, blocks in want.items():
        plain = [(p, labels, c, t.rstrip("\n")) for p, labels, c, t in got.get(doc, [])]
        assert plain == [(p, labels, c, t.rstrip("\n")) for p, labels, c, t in blocks], doc


def test_headings(spark):
    pages = ["SECTION 1\nintro\n- 1.1 Water\r\nwater text", "more water. 1.2 Fire is covered\nSECTION 2 - Limits\nlimit text"]
    df = spark.createDataFrame([("d", "doc", 2, pages[1]), ("d", "doc", 1, pages[0]), ("e", "e", 1, None), ("f", None, 1, "plain")], "doc_id string, doc_name string, page int, text string")
    got = {x.chunk_no: x for x in structure.policy_chunks(df).where("doc_id = 'd'").collect()}
    assert [got[i].clause_id for i in range(5)] == ["SECTION 1", "1.1", "1.1", "1.2", "SECTION 2"] and [got[i].page for i in range(5)] == [1, 1, 2, 2, 2]
    assert got[1].section == "doc > SECTION 1 > 1.1 Water" and got[1].chunk_text == "1.1 Water\r\nwater text" and got[3].chunk_text == "1.2 Fire is covered\n"
    rest = {x.doc_id: x for x in structure.policy_chunks(df).where("doc_id <> 'd'").collect()}
    assert set(rest) == {"f"} and rest["f"].section is None and rest["f"].clause_id is None
    long = spark.createDataFrame([("g", "g", 1, "SECTION 1\n" + "words and more. " * 300), ("g", "g", 2, "next")], "doc_id string, doc_name string, page int, text string")
    parts = structure.policy_chunks(long, 100, 10).orderBy("chunk_no").collect()
    assert [p.chunk_no for p in parts] == list(range(len(parts))) and len(parts) > 10 and all(len(p.chunk_text) <= 400 for p in parts) and parts[-1].chunk_text == "next" and parts[-1].section == "g > SECTION 1"


def test_scanned_chunks(spark):
    pages = [("s", "scan.pdf", 1, "# Findings\n- roof open\n<!-- image -->\n\n1.1 Not a clause", 0.8), ("s", "scan.pdf", 2, "<!-- image -->\n  ", 0.9), ("s", "scan.pdf", 3, "before\n## Cost\n100", None), ("t", "t.pdf", 1, None, None)]
    df = spark.createDataFrame(pages, "doc_id string, doc_name string, page int, text string, confidence double")
    got = [(x.doc_id, x.chunk_no, x.page, x.section, x.clause_id, x.chunk_text, x.confidence) for x in structure.scanned_chunks(df).orderBy("doc_id", "chunk_no").collect()]
    assert got == [
        ("s", 0, 1, "scan.pdf > p.1 > Findings", None, "Findings\nroof open\n1.1 Not a clause", 0.8), ("s", 1, 2, "scan.pdf > p.2", None, text.UNREADABLE, 0.0), ("s", 2, 3, "scan.pdf > p.3", None, "before", None),
        ("s", 3, 3, "scan.pdf > p.3 > Cost", None, "Cost\n100", None), ("t", 0, 1, "t.pdf > p.1", None, text.UNREADABLE, 0.0),
    ]


def test_kinds_of_headings(spark):
    kinds = spark.createDataFrame([("# A",), ("plain",), ("1.2 Foo",), ("ALL CAPS LINE",)], "l string").select(text.heading(F.col("l"))["kind"].alias("k")).toPandas().k.tolist()
    assert kinds == ["markdown", None, "clause", "capitals"]


def test_resolution():
    stored = ["Al Falah Insurance", "AL-FALAH INSURANCE LTD", "Jubilee General", "CLM-1088"]
    assert similarity.resolve("clm 1088", stored).values == ("CLM-1088",)
    assert similarity.resolve("CLM-1089", stored).status == "not_found"
    assert similarity.resolve("Al Faláh Insurance", stored).values == ("AL-FALAH INSURANCE LTD", "Al Falah Insurance")
    assert similarity.resolve("zz", stored).status == "not_found" and similarity.resolve("quite different", stored).status == "not_found"
    assert similarity.resolve("smith", ["john smith", "jane smith"]).status == "ambiguous"
    assert similarity.gram_overlap("", "") == 1.0 and similarity.score("water damage", "watter damage") > 0.9


def test_terms_of_any_script(spark):
    got = one(spark, text.terms(F.col("t")), t="Größe über café the foo- a--b x_1 日本語 -y")
    assert got == ["größe", "über", "café", "foo", "a--b", "x_1", "日本語", "y"]


def test_indentation_stays():
    assert text.normalise_page("a \n  b\t\tc\n\n\n\n d ") == "a\n b c\n\n d"


def test_token_likeness():
    from factloom.functions.similarity import token_likeness

    assert token_likeness("aab", "ab") == 1.0 and token_likeness("abc", "abc") == 1.0 and 0 < token_likeness("night", "nacht") < 1


def test_headings_with_marks(spark):
    h = lambda t: one(spark, text.heading(F.col("t")), t=t)
    assert tuple(h("## SECTION 4 - WATER DAMAGE")) == ("markdown", 2, "SECTION 4 - WATER DAMAGE", "SECTION 4")
    assert tuple(h("- 4.2 Sudden escape of water"))[:2] == ("clause", 4) and h("- 4.2 Sudden escape of water").clause_id == "4.2"
    assert h("## Notes").clause_id is None and h("SECTION 4 covers much") is None and h("4.2 Rent .... 7") is None
    assert tuple(h("COVERAGE C: RENT")) == ("cover", 3, "COVERAGE C: RENT", "COVERAGE C")
    assert len(h("4.2 " + "x" * 200).label) == 80


def test_unbroken_text_is_cut_at_multiples():
    from factloom.functions.chunks import cut_places, split_text

    assert cut_places("x" * 10, 4) == [4, 8, 10] and cut_places("ab cd efghijkl", 4) == [3, 6, 10, 14]
    words = "one two. three\n\nfour " + "y" * 50 + " five"
    parts = split_text(words, 5, 1)
    assert all(len(p) <= 20 for p in parts) and parts[0][-1] in " \n"
    joined = parts[0] + "".join(p[4:] for p in parts[1:])
    assert joined == words and split_text(" \n ", 5, 1) == []


def test_numbers_with_exponents(spark):
    from factloom.functions import values

    assert one(spark, values.decimal(F.col("t")).cast("double"), t="1e3") == 1000.0 and one(spark, values.decimal(F.col("t")), t="e3") is None


def test_repeated_rank_is_refused(spark):
    import pytest

    from factloom.operators import ranking

    twice = spark.createDataFrame([("a", 1), ("a", 2)], "id string, rank int")
    with pytest.raises(Exception, match="repeats a"):
        ranking.rrf([twice, twice], "id").collect()
