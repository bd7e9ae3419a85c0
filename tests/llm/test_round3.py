"""Hard negatives (11), collocations (12) and language identification (13)."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adlens.llm import collocations as C
from adlens.llm import hard_negatives as H
from adlens.llm import language_tree as L
from tests.conftest import SF_CHECK
from tests.llm.frames import CLASH, awkward

# --- hard negatives -------------------------------------------------------


def brute_negatives(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    kept = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) >= 2 ** 61:
            continue
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, (label, q) in kept.items():
        if i % every:
            continue
        scored = sorted((-dot(q, b), j, m) for j, (m, b) in kept.items() if j != i)
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p]
            out |= {(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(fit[:negatives], 1)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, [1], "q") for i, v, y in rows],
                                 "vec_id long, embedding array<float>, label int, id long, q array<int>, kind string")


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=8) + (i % 3)).astype(np.float32).tolist(), i % 3) for i in range(260)]
    rows += [(300 + i, [1.0] * 8, i % 2) for i in range(60)]                          # ties
    rows += [(400, None, 1), (401, [1.0] * 8, None), (None, [1.0] * 8, 1), (402, [float("nan")] * 8, 1),
             (403, [float("inf")] * 8, 1), (500, [None] * 8, 1), (404, [], 1), (600, [2.0, 1.0], 0), (700, [0.0] * 8, 2),
             (800, [3e38] * 8, 1), (900, [4e6] * 8, 1), (901, [-4e6] * 8, 1), (902, [4e6] * 7 + [-9.0], 2),
             (100, rows[100][1], rows[100][2]), (200, [0.5] * 8, 1)]
    want = brute_negatives(rows)
    assert len(want) > 100
    assert {tuple(x) for x in H.hard_negatives(vectors(spark, rows)).collect()} == want
    monkeypatch.setattr(H, "BLOCK", 16)
    monkeypatch.setattr(H, "ANCHORS", 2)
    assert {tuple(x) for x in H.hard_negatives(vectors(spark, rows)).collect()} == want
    assert H.hard_negatives(vectors(spark, [])).collect() == []
    assert H.hard_negatives(vectors(spark, [(0, [1.0], 1)])).collect() == []


def test_residue_product_is_exact():
    r = np.random.default_rng(2)
    for top, dim in ((200, 64), (2 ** 20, 2500), (2 ** 29, 3), (1, 1), (5, 0)):
        a, b = r.integers(-top, top + 1, (9, dim)), r.integers(-top, top + 1, (7, dim))
        a[0], b[0] = top, -top
        want = a.astype(object) @ b.astype(object).T if dim else np.zeros((9, 7), dtype=object)
        primes = H.moduli(dim * top * top)
        assert math.prod(primes) > 2 * dim * top * top
        assert (H.exact_product(a.astype(np.int32), b.astype(np.int32), primes).astype(object) == want).all()


# --- collocations ---------------------------------------------------------

def brute_collocations(rows, least, top=2000, scale=2_000_000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i:i + m]] = max(longest[p[i:i + m]], a)
        found = []
        for p, a in cand.items():
            score, k = min((scale * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longest[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, le, ri) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, le, ri, n[lang], -s))
    return out


def texts(spark, rows):
    return spark.createDataFrame([(g, t, *(7, 7, "k", "h", "t", 7, 7, "v", "x"), 5, "p") for g, t in rows],
                                 "lang string, text string, " + CLASH + ", a long, phrase string")


def phrase_rows():
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)] + ["ça", "漢字", "İx", "\x00z", "B-C", " "]
    rows = []
    for i in range(120):
        t = "".join(words[int(x)] + str(r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", ": "]))
                    for x in r.zipf(1.4, 80) % len(words))
        rows.append(([None, "en", "fr", "und"][i % 4], t + " the new York times a a a a a"))
    return rows + [("en", None), (None, ""), ("de", " \n "), ("en", "only"), ("en", "w1 w2 " * 3000), rows[0], rows[0]] + [
        ("en", t) for _, t, _ in awkward()]


def test_collocations_equal_brute_force(spark, monkeypatch):
    rows = phrase_rows()
    want = brute_collocations(rows, 12)
    assert len(want) > 60
    got = C.collocations(texts(spark, rows), least=12)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(x) for x in got.collect()} == want
    assert {tuple(x) for x in C.collocations(texts(spark, rows), least=12, top=5).collect()} == brute_collocations(rows, 12, 5)
    assert C.collocations(texts(spark, [])).collect() == []
    assert C.collocations(texts(spark, [("en", None), (None, "x y z")])).collect() == []


def count_locally(rows, words):
    """Counts of a task, by the local counters."""
    ones = np.full(1 << 10, np.uint64(2 ** 64 - 1))
    value = type("V", (), {"value": ones})
    batch = pa.RecordBatch.from_arrays([pa.array([g or "und" for g, _ in rows]), pa.array([t or "" for _, t in rows])], ["lang", "text"])
    out, parts = Counter(), 5
    run = C.count_words if words == 1 else C.count_phrases(parts, value) if words == 2 else C.count_phrases(parts, value, value)
    made = list(run(iter([batch.slice(0, 50), batch.slice(50)])))
    if words > 1:       # the blocks of each prefix partition, as its task gets them
        rows = pa.Table.from_batches(made).sort_by("part").to_batches() if made else []
        assert all(0 <= p < parts for b in rows for p in b["part"].to_pylist())
        made = list(C.sum_blocks(1)(iter(rows)))
    for part in made:
        for g, p, n in zip(part["lang"].to_pylist(), part["phrase"].to_pylist(), part["n"].to_pylist()):
            assert words == 1 or (g, p) not in out      # one prefix partition has all of a phrase
            out[g, p] += n
    return out


@pytest.mark.parametrize("limits", [{}, {"MAX_ENTRIES": 40, "BURST": 3}, {"MAX_IDS": 12, "SLICE": 500}, {"SLICE": 64, "BURST": 1},
                                    {"MAX_IDS": 9, "MAX_ENTRIES": 25, "BURST": 2}])
def test_counts_with_small_limits(limits, monkeypatch):
    for k, v in limits.items():
        monkeypatch.setattr(C, k, v)
    rows = phrase_rows()
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                want.update((lang or "und", " ".join(w[i:i + m])) for i in range(len(w) - m + 1))
    got = count_locally(rows, 1) + count_locally(rows, 2) + count_locally(rows, 3)
    assert got == want


# --- languages ------------------------------------------------------------

def test_languages_held_out(spark):
    d = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = L.identify_languages(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == d.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.family == L.family_of(r.lang_pred) for r in rows)
    # a prediction reads no language, source or id
    moved = d.withColumn("lang", F.expr("case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end"))
    assert {r.doc_id: r.lang_pred for r in L.identify_languages(moved).collect()} == {r.doc_id: r.lang_pred for r in rows}


def test_languages_awkward(spark):
    schema = "doc_id long, text string, lang string, source string, family string, r long, id string"
    make = lambda rows: spark.createDataFrame([(*x, "s", "f", 1, "i") for x in rows], schema)
    en, de = "the house and the garden were in the town", "das haus und der garten sind in der stadt"
    rows = [(i, f"{en} {'with a tree ' * (i % 5)}", "en") for i in range(40)]
    rows += [(100 + i, f"{de} {'mit einem baum ' * (i % 5)}", "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 €!", "fr"), (203, "漢字", None), (None, en, "de"),
             (204, "the garden " * 100_000, None), (205, "der baum", None), (0, en, "en"), (0, en, "en"), (207, "x", "xx-YY")]
    got = defaultdict(list)
    for r in L.identify_languages(make(rows), per_language=20).collect():
        got[r.doc_id].append((r.lang_pred, round(r.score, 9)))
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i] == [("und", 0.0)] for i in (200, 201, 202)) and got[204][0][0] == "en" and got[205][0][0] == "de"
    assert len(set(got[0])) == 1 and got[None][0][0] == "en"
    assert all(got[i][0][0] == "en" for i in range(40)) and all(got[100 + i][0][0] == "de" for i in range(40))
    one = L.identify_languages(make([(1, en, "en"), (4, de, None), (5, "??", None)])).collect()
    assert {(r.doc_id, r.lang_pred) for r in one} in ({(1, "en"), (4, "en"), (5, "und")}, {(1, "und"), (4, "und"), (5, "und")})
    assert {r.lang_pred for r in L.identify_languages(make([(1, en, None)])).collect()} == {"und"}
    assert L.identify_languages(make([])).collect() == []


def test_one_versus_one_votes():
    names = ["a", "b", "c"]
    p = np.array([[0.9, 0.2, 0.4], [0.5, 0.5, 0.5], [0.1, 0.6, 0.4]])   # a-b, a-c, b-c
    best, sure = L.decide(p, names, L.pairs_of(names))
    assert [names[i] for i in best] == ["c", "a", "b"]
    assert sure[0] == pytest.approx((0.8 + 0.6) / 2)
    assert L.family_of("en-US") == "germanic" and L.family_of("fr") == "romance" and L.family_of("zz") == "other"
