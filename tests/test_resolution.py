"""Resolution over tables against comparing every mention with every value."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import similarity as s
from factloom.functions.text import normalise_text
from factloom.operators import resolution

CATALOGUE = "table_name string, column_name string, value string, match_kind string"
REFERENCES = "table_name string, column_name string, value string"


def form(text):
    return s.noise_stripped(normalise_text(text) or "")


def brute(mention, catalogue, references):
    """Rows (status, kind, table, column, values, match_kind, score, candidates) of one mention."""
    key = re.sub(r"[^a-z0-9]+", "", mention.lower())
    if re.fullmatch(r"(?:[a-z]{2,6})?[0-9]{3,}", key):
        hits = [r for r in references if re.sub(r"[^a-z0-9]+", "", r[2].lower()) == key]
        values = sorted({r[2] for r in hits})
        if len(values) != 1:
            return [("ambiguous" if values else "not_found", "reference", None, None, None, None, None, values or None)]
        return [("resolved", "reference", *slot, values, "equals", 1.0, None) for slot in sorted({r[:2] for r in hits})]
    wanted, missing = form(mention), [("not_found", "value", None, None, None, None, None, None)]
    if len(wanted.replace(" ", "")) < 3:
        return missing
    scored = [(t, c, v, k, form(v)) for t, c, v, k in sorted(catalogue)]
    scored = [(*r, s.score(wanted, r[4])) for r in scored if r[4]]
    top = max((r[5] for r in scored), default=0)
    if top < s.RESOLVED:
        return missing
    group = [r for r in scored if r[5] >= s.BAND * top]
    for r in scored:
        if r not in group and any(s.near_variant(r[4], g[4]) for g in group):
            group.append(r)
    label = {r[4]: r[4] for r in group}
    for _ in label:
        for a in label:
            for b in label:
                if s.whole_score(*sorted((a, b))) >= s.SAME_CLUSTER or s.near_variant(*sorted((a, b))):
                    label[a] = label[b] = min(label[a], label[b])
    best = sorted(((max(r[5] for r in group if label[r[4]] == c), c) for c in set(label.values())), reverse=True)
    if len(best) == 1 or (best[0][0] >= s.DOMINANT and best[1][0] <= best[0][0] - s.DOMINANT_LEAD):
        mine = [r for r in group if label[r[4]] == best[0][1]]
        out = []
        for slot in sorted({r[:2] for r in mine}):
            here = [r for r in mine if r[:2] == slot]
            out.append(("resolved", "value", *slot, sorted({r[2] for r in here}), "contains" if any(r[3] == "contains" for r in here) else "equals", max(r[5] for r in here), None))
        return out
    shown = [min(((r[2].count(",") > 0, -r[5], r[2]) for r in group if label[r[4]] == c)) for _, c in best]
    plain = [x for x in shown if not x[0]] or shown
    return [("ambiguous", "value", None, None, None, None, None, [v for _, v in sorted((m, v) for _, m, v in plain)][: s.LABELS])]


def made(seed, n):
    r = random.Random(seed)
    first = "Ahmed Ahmad Hussain Husain Al-Falah Smith Jane John Crescent National United Karachi Lahore".split()
    second = "Textiles Textile Insurance Foods Mills Trading Traders Motors & Sons,Group".split(" ")
    values = []
    for _ in range(n):
        v = " ".join(r.choices(first, k=r.choice([1, 1, 2])) + r.choices(second, k=r.choice([0, 1, 2])) + r.choices(["", "Ltd", "Pvt Ltd", "and Company"], k=1)).strip()
        if r.random() < 0.4:
            at = r.randrange(len(v))
            v = v[:at] + r.choice(["", v[at] * 2, "x", "é"]) + v[at + 1 :]
        values.append(v)
    return values


def as_rows(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r.mention, []).append((r.status, r.kind, r.table_name, r.column_name, r["values"], r.match_kind, r.score, r.candidates))
    return {m: sorted(v, key=str) for m, v in rows.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    r = random.Random(seed)
    values = made(seed, 60)
    catalogue = sorted({(r.choice(["claims", "policies"]), r.choice(["insured", "city"]), v, r.choice(["equals", "equals", "contains"])) for v in values})
    seen = {}
    catalogue = [c for c in catalogue if seen.setdefault(c[:3], c) == c]
    references = [("claims", "claim_number", "CLM-1088"), ("policies", "policy_number", "CLM 1088"), ("claims", "claim_number", "CLM-2000"), ("policies", "claim_ref", "CLM-2000")]
    mentions = [*made(seed + 10, 25), *values[:8], "smith", "ahmed", "clm1088", "CLM-2000", "clm 2001", "zz", "ltd", "x", "quite different", "Water, Damage"]
    df = spark.createDataFrame([(m,) for m in [*mentions, *mentions[:3], None, "  "]], "mention string")
    got = as_rows(resolution.resolve_mentions(df, spark.createDataFrame(catalogue, CATALOGUE), spark.createDataFrame(references, REFERENCES)))
    assert set(got) == set(map(str.strip, mentions))
    statuses = set()
    for m in got:
        want = brute(m, catalogue, references)
        assert [x[:6] + x[7:] for x in got[m]] == sorted([x[:6] + x[7:] for x in want], key=str), m
        assert [x[6] for x in got[m]] == pytest.approx([x[6] for x in sorted(want, key=str)])
        statuses |= {x[:2] for x in got[m]}
    assert {("resolved", "value"), ("ambiguous", "value"), ("not_found", "value"), ("resolved", "reference"), ("ambiguous", "reference"), ("not_found", "reference")} <= statuses


def test_no_candidate_is_lost(spark):
    """Every pair of forms that scores enough is a candidate, and few others are."""
    values, mentions = sorted({form(v) for v in made(5, 300)}), sorted({form(v) for v in made(6, 60)} | {"ahmed", "jane smith mills"})
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts if t], "text string")
    found = {(r.a, r.b) for r in resolution.candidate_pairs(frame(mentions), frame(values)).collect()}
    wanted = {(a, b) for a in mentions for b in values if s.score(a, b) >= s.BAND * s.RESOLVED}
    assert wanted <= found and len(found) < 0.6 * len(mentions) * len(values)


@pytest.mark.parametrize(("share", "seed"), [(0.5, 1), (0.6, 2), (0.82, 3), (1.0, 4)])
def test_prefix_index_is_exact(spark, share, seed):
    r = random.Random(seed)
    sets = [sorted(set(r.choices("abcdefghijkl", k=r.randrange(1, 9)))) for _ in range(120)]
    df = spark.createDataFrame([(f"{i}", x) for i, x in enumerate(sets)], "text string, items array<string>")
    left, right = df.where("int(text) < 50"), df.where("int(text) >= 50")
    got = {(int(x.a), int(x.b)) for x in resolution.alike_sets(left, right, share).collect()}
    assert got == {(i, j) for i in range(50) for j in range(50, 120) if len(set(sets[i]) & set(sets[j])) >= share * len(set(sets[i]) | set(sets[j])) - 1e-9}


def test_questions(spark):
    catalogue = spark.createDataFrame([("c", "name", v, "equals") for v in ("John Smith", "Jane Smith", "Lahore")], CATALOGUE)
    references = spark.createDataFrame([("c", "claim_no", "CLM-1")], REFERENCES)
    questions = spark.createDataFrame(
        [(1, ["smith", " lahore "], ["city = 'Lahore'", None, "name = \"smith\""], None), (2, ["smith"], None, "what about Smith?"), (3, ["smith"], [], "other things"), (4, None, None, None), (5, ["lahore", None, ""], ["x = 'it'"], None)],
        "question_id int, entities array<string>, filters array<string>, scope string",
    )
    places = {(r.question_id, r.place, r.mention) for r in resolution.mentions_of(questions).collect()}
    assert places == {(1, 0, "smith"), (1, 1, "lahore"), (1, 2, "Lahore"), (2, 0, "smith"), (3, 0, "smith"), (5, 0, "lahore"), (5, 1, "it")}
    resolved = resolution.resolve_mentions(resolution.mentions_of(questions).select("mention"), catalogue, references)
    got = {r.question_id: (r.needs_clarification, r.clarification_question) for r in resolution.resolve_questions(questions, resolved).collect()}
    asked = (True, 'Did you mean "Jane Smith" or "John Smith" for "smith"?')
    assert got == {1: asked, 2: asked, 3: (False, ""), 4: (False, ""), 5: (False, "")}
    assert {r.mention for r in resolution.stored_values(resolved).collect()} == {"lahore", "Lahore"}


def test_catalogues_of_tables(spark):
    a = spark.createDataFrame([("Lahore, Punjab", "CLM-1", "x@y"), ("Lahore", "CLM-2", None)], "city string, claim_number string, email string")
    found = {(r.table_name, r.column_name, r.value, r.match_kind) for r in resolution.catalogue_of({"a": a}).where(F.col("column_name") == "city").collect()}
    assert found == {("a", "city", "Lahore, Punjab", "equals"), ("a", "city", "Lahore", "equals"), ("a", "city", "Punjab", "contains")}
    assert {(r.column_name, r.value) for r in resolution.references_of({"a": a}).collect()} == {("claim_number", "CLM-1"), ("claim_number", "CLM-2")}
    with pytest.raises(ValueError):
        resolution.references_of({"b": a.select("city")})
