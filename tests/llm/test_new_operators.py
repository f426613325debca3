"""Conversation repair, packing along the curve and whitening against plain Python."""

import hashlib
import random
import re
import sys
from array import array
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from helpers import connection  # noqa: E402

from factloom.llm import curve, queries, repair, whitening, words  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORD_BPE)
STEPS = {(0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3, (0, "s"): 1}


def brute_repair(initials_and_faults):
    """(cost, audit) by comparing whole audits from every state."""

    def inserted(best):
        for _ in range(4):
            for (s, c), t in STEPS.items():
                if c != "s" and best[t] is not None:
                    best[s] = min(x for x in (best[s], (best[t][0] + 5, "I" + best[t][1])) if x is not None)
        return best

    best = inserted([(0, ""), None, None, (0, "")])
    for initial, fault in reversed(initials_and_faults):
        more, before = (5 if fault == repair.CUT else 0), []
        for s in range(4):
            options = [(best[s][0] + 2, "D" + best[s][1])]
            if fault in (repair.SOUND, repair.CUT):
                options += [(best[t][0] + more + (c != initial), ("K" if c == initial else "R") + best[t][1]) for (f, c), t in STEPS.items() if f == s and (c != "s" or c == initial)]
            before.append(min(options))
        best = inserted(before)
    return best[0]


def test_least_edits():
    r = random.Random(1)
    for n in range(4):
        for codes in product(product(["u", "a", "s", "x"], [repair.SOUND, repair.BLANK, repair.CUT]), repeat=n):
            assert repair.least_edits(list(codes)) == brute_repair(list(codes))
    for _ in range(5000):
        codes = [(r.choice(["u", "a", "s", "x", ""]), r.choice([0, 0, 0, 1, 2, 3, 3])) for _ in range(r.randrange(4, 40))]
        assert repair.least_edits(codes) == brute_repair(codes)


def test_spread_of_costs():
    """No state's rest costs over SPREAD more than another's, or sixteen layers wouldn't do."""
    r = random.Random(2)
    for _ in range(3000):
        layers = 1 << repair.START | 1 << repair.DONE
        cost = [0, 10, 5, 0]
        for _ in range(r.randrange(30)):
            initial, fault = r.choice("uasx"), r.choice([0, 1, 3])
            more, new = (5 if fault == 3 else 0), []
            for s in range(4):
                options = [cost[s] + 2]
                if fault != 1:
                    options += [cost[t] + more + (c != initial) for (f, c), t in STEPS.items() if f == s and (c != "s" or c == initial)]
                new.append(min(options))
            for _ in range(3):
                new = [min([new[s], *(new[t] + 5 for (f, c), t in STEPS.items() if f == s and c != "s")]) for s in range(4)]
            cost = new
            assert max(cost) - min(cost) <= repair.SPREAD
        assert layers


def brute_conversations(given):
    """The contract, row by row."""
    original = {r[0] for r in given}
    left = defaultdict(list)
    for conv, turn, role, text in given:
        role, text = (" " if v is None else v for v in (role, text))
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv in original:
        mine = sorted(left[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, codes, found = set(), [], Counter()
        for _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = repair.BLANK if not body else repair.DUPLICATE if (role, text) in seen else repair.CUT if body[-1] not in ".!?" else repair.SOUND
            seen.add((role, text))
            found[fault] += 1
            codes.append((role[:1], fault))
        cost, audit = brute_repair(codes)
        state, repaired, rest = 0, [], list(mine)
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else rest.pop(0)
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = STEPS[state, role[0]]
            repaired.append(f"{role}:{text}")
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, found[repair.BLANK], found[repair.DUPLICATE], found[repair.CUT], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations():
    r = random.Random(4)
    texts = ["Yes.", "No!", "What?", "cut off", "", " \t\n", "a: b\n.", "x.  \n", "end ", "é…", "l" * 9000 + "."]
    out = []
    for conv in [*range(60), None, -3]:
        for turn in range(r.randrange(1, 12)):
            out.append((conv, None if r.random() < 0.1 else turn - r.randrange(2), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"]), r.choice([*texts, None])))
    out += out[::9]
    out += [(7, t, "user", "again.") for t in range(100, 160)] + [(8, 5, "user", "same.")] * 40
    r.shuffle(out)
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_repair_against_plain_python(spark):
    given = odd_conversations()
    df = spark.createDataFrame([(*g, 1, "x") for g in given], CONVERSATIONS + ", copies int, audit string").repartition(5)
    got = sorted(map(tuple, repair.damage_and_repair(df).collect()), key=str)
    assert got == brute_conversations(given)
    assert {"D", "K", "R"} == set("".join(g[7] for g in got))  # an insertion is never cheaper than to delete its partner
    assert repair.damage_and_repair(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    dropped = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    gone = repair.damage_and_repair(spark.createDataFrame([(dropped, 0, "user", "Hi.")], CONVERSATIONS)).collect()
    assert [tuple(g) for g in gone] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_of_a_hot_conversation(spark, monkeypatch):
    """Rows that repeat at many turns are frequent keys of the join; a long conversation needs no more layers."""
    from factloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    given = [(1, t, "user" if t % 2 else "assistant", "ok." if t % 3 else f"number {t}.") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    got = sorted(map(tuple, repair.damage_and_repair(spark.createDataFrame(given, CONVERSATIONS)).collect()), key=str)
    assert got == brute_conversations(given)


def test_repair_in_sql_with_odd_rows(spark):
    given = odd_conversations()
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", given)
    found = con.execute(queries.ORACLE_SQL["op11_repair"]).fetchall()
    assert sorted(map(tuple, repair.damage_and_repair(spark.createDataFrame(given, CONVERSATIONS)).collect()), key=str) == sorted(found, key=str)


def test_word_encoder():
    r = random.Random(1)
    e = words.encoder(WORD_BPE)
    assert isinstance(e, words.WordEncoder)
    parts = [*map(chr, range(256)), "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "ς", "é", "ͅ", "　", "ﬁ", "ẞ", "  ", "\U0001f468‍\U0001f469", "한", " "]
    for _ in range(4000):
        text = "".join(r.choices(parts, k=r.randrange(30)))
        assert e.ids(text) == array("I", LIBRARY.encode(text, add_special_tokens=False).ids).tobytes(), ascii(text)
    assert not isinstance(words.encoder(public_tokenizers.path("byte_bpe_50k.json")), words.WordEncoder)


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 5), (3, 3), (4, 2)])
def test_hilbert_curve(dimensions, bits):
    """Every cell once, and neighbours on the curve are neighbours in the grid."""
    cells = np.array(list(product(range(1 << bits), repeat=dimensions)))
    keys = curve.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


DOCS = "doc_id long, text string, lang string, place long, row int, ids string"


def check_packing(pieces, docs, capacity):
    """Each id in exactly one piece, sequences gapless, all full but for powers of two; the digests."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(by_doc) == set(want)
    for doc_id, copies in want.items():
        if len(copies) == 1:
            at = 0
            for p in sorted(by_doc[doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(copies[0])
                assert p.ids_crc32 == crc32(array("I", copies[0][p.start : p.start + p.length]).tobytes())
                at += p.length
            assert at == len(copies[0])
        else:
            assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, copies))
    lengths = []
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        lengths.append(at)
    assert all(n == capacity or n & (n - 1) == 0 for n in lengths) and sum(n != capacity for n in lengths) <= capacity.bit_length()


def test_packing_along_the_curve(spark):
    r = random.Random(5)
    vocabulary = ["alpha beta gamma delta", "eins zwei drei vier", "un deux trois quatre"]
    docs = [(i, " ".join(r.choices(vocabulary[i % 3].split(), k=r.choice([1, 5, 60, 400])))) for i in range(90)]
    docs += [(90, None), (91, ""), (92, "x" * 5000), (93, "word " * 9000), (94, "한국어 テキスト 🎉"), (None, "no id"), (None, "no id"), (95, "twice"), (95, "twice")] + [(100 + i, "a copy of one text") for i in range(60)]
    df = spark.createDataFrame([(*d, "en", 1, 2, "x") for d in docs], DOCS).repartition(5)
    for capacity in (64, 2048):
        pieces = curve.pack_along_curve(df, WORD_BPE, capacity).collect()
        check_packing(pieces, docs, capacity)
    with_ids = curve.pack_along_curve(df, WORD_BPE, 64, with_ids=True).collect()
    assert all(crc32(array("I", p.ids).tobytes()) == p.ids_crc32 and len(p.ids) == p.length for p in with_ids)
    assert curve.pack_along_curve(spark.createDataFrame([], DOCS), WORD_BPE).count() == 0


def test_neighbours_on_the_curve_are_alike(spark, sf):
    """Documents that follow each other share their language far more often than by chance, and copies follow one another."""
    con = connection(sf.replace("0.001", "0.01"))
    lang = dict(con.execute("select doc_id, lang from documents").fetchall())
    pieces = queries.op12_curve(spark, sf.replace("0.001", "0.01")).collect()
    check_packing(pieces, con.execute("select doc_id, text from documents").fetchall(), 2048)
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    same = sum(lang[a] == lang[b] for a, b in zip(order, order[1:], strict=False)) / (len(order) - 1)
    chance = sum((n / len(lang)) ** 2 for n in Counter(lang.values()).values())
    assert same > chance + 0.5 * (1 - chance)


def test_a_frequent_place_is_dealt(spark):
    """The rows of one place that is the bound of several ranges spread over them, in the order of the curve."""
    df = spark.createDataFrame([(7 if i % 3 else i, i % 4, i) for i in range(3000)], "place long, task int, row long")
    bounds = np.array([2, 7, 7, 7, 7, 2000])
    found = df.select("place", curve.range_of(bounds).alias("at")).collect()
    hot = Counter(r["at"] for r in found if r.place == 7)
    assert set(hot) == {1, 2, 3, 4, 5} and max(hot.values()) < 1.2 * 2000 / 5
    assert all(r["at"] == np.searchsorted(bounds, r.place) for r in found if r.place not in (2, 7, 2000))


def test_one_sided_jacobi():
    r = np.random.default_rng(0)
    for d in (1, 2, 3, 8, 33):
        a = r.normal(size=(max(d, 5), d)) * np.geomspace(1, 1e-7, d)
        norms, turned = whitening.one_sided_jacobi(a)
        assert np.allclose(turned.T @ turned, np.eye(d), atol=1e-13) and (np.diff(norms) <= 0).all()
        assert np.allclose(np.linalg.norm(a @ turned, axis=0), norms, rtol=1e-12)
        assert np.allclose(norms, np.linalg.svd(a, compute_uv=False), rtol=1e-9)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, n int, x string"


def brute_whitening(given, most=4):
    """By eigh of the covariance of the distinct whole vectors."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in given if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in kept}), dtype=np.int64)
    n, sums = len(fit), fit.sum(0)
    c = (fit - sums / n).T @ (fit - sums / n) / n
    e, v = np.linalg.eigh(c)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return kept, n, sums, e, v, np.trace(c)


def test_whitening_against_eigh(spark):
    r = np.random.default_rng(3)
    made = (r.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + [1, 0, 0, -2, 0, 0]).astype(np.float32).tolist()
    given = [(i, v) for i, v in enumerate(made)] + [(1000 + i, made[i % 3]) for i in range(200)] + [(None, made[5]), (1, made[0])]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 0, 0, 0, 0]), (2003, [1.0, float("nan"), 0, 0, 0, 0]), (2004, [float("inf")] * 6), (2005, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], 1, 2, "x") for i, v in given + bad], EMBEDDINGS).repartition(7)
    found = whitening.whiten(df, keep=("vec_id", "n")).collect()
    kept, n, sums, e, v, trace = brute_whitening(given)
    assert len(found) == 4 * len(kept) and {f.n for f in found} == {n} and {f.in_n for f in found} == {2}
    signs = {}
    want = defaultdict(list)
    for vec_id, x in kept:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        want[vec_id].append((deviation, (x - sums / n) @ v / np.sqrt(e)))
    for f in found:
        options = [w for w in want[f.vec_id] if w[0] == f.deviation]
        assert options
        value = options[0][1][f.component - 1]
        if abs(value) > 1e-6:
            sign = np.sign(value * f.whitened)
            assert signs.setdefault(f.component, sign) == sign
        assert abs(abs(f.whitened) - abs(value)) < 1e-8
        assert abs(f.explained / (e[f.component - 1] / trace) - 1) < 1e-10 and 0 <= f.identity_error < 1e-10


def test_whitening_of_few_and_huge_vectors(spark):
    small = lambda data: whitening.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert small([]).count() == 0 and small([(1, None)]).count() == 0
    assert small([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0  # one distinct vector has no deviation
    two = small([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])]).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in two) == [(i, 1, 2, 2 * 256**2, 1.0) for i in (1, 2, 3)]
    huge = small([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.25])]).collect()
    assert len(huge) == 3 and all(r.deviation is None for r in huge if r.vec_id == 1) and all(np.isfinite(r.whitened) for r in huge)  # the other component is a rounding error beside it


def test_many_triangles(spark):
    """More tasks than one stacks: the same R as of all rows, up to signs."""
    r = np.random.default_rng(9)
    x = r.integers(-300, 300, size=(900, 5))
    fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<bigint>").repartition(60)
    sums = np.array(x.sum(0).tolist(), dtype=object)
    got = whitening.tall_skinny_r(fit, sums, len(x))
    want = whitening.triangle(x - x.sum(0) / len(x))
    assert np.allclose(np.abs(got), np.abs(want), rtol=1e-9)


@pytest.mark.parametrize("name", ["op13_whiten"])
def test_whitening_query(spark, sf, name):
    found = queries.QUERIES[name](spark, sf).toPandas()
    given = connection(sf).execute("select vec_id, embedding from embeddings").fetchall()
    kept, n, sums, e, v, trace = brute_whitening(given)
    x = np.array([w for _, w in sorted(kept)])
    z = (x - sums / n) @ v / np.sqrt(e)
    got = found.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(-1, 4)
    assert np.allclose(np.abs(got), np.abs(z), atol=1e-8) and found.identity_error.max() < 1e-9
    assert sorted(found.deviation.unique()) == sorted({int((row * n - sums) @ (row * n - sums)) for row in x})
