"""Cross-polytope search (5), toxicity (9) and the n-gram join (10)."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from adlens.llm import cross_polytope as X
from adlens.llm import toxicity as T
from adlens.llm import vertical_join as V
from adlens.llm.graph import components
from tests.llm.frames import awkward, docs, prose


# --- nearest neighbours ---------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, [1.0], "q") for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, cid long, v array<float>, q string")


def brute_nearest(rows, k, every):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, v), v)
    dim = max(map(len, good.values()), default=0)
    full = {i: np.pad(np.array(v, np.float32).astype(float), (0, dim - len(v))) for i, v in good.items()}
    out = {}
    for q in full:
        if q % every == 0:
            s = sorted(((-float(full[q] @ full[i]), i) for i in full if i != q))[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


def as_lists(got):
    out = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_awkward_vectors_and_copies(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), r.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.5]) for i in range(70)] + [(90, [0.0] * 6), (91, None), (92, []),
             (93, [1.0, None]), (94, [float("nan")] * 6), (95, [float("inf")] * 6), (None, [1.0] * 6), (96, [-0.0, 3.0]),
             (0, rows[0][1]), (98, [5.0, 1.0]), (98, [4.0, 1.0])]
    got, want = as_lists(X.nearest(vectors(spark, rows), k=20, every=20).collect()), brute_nearest(rows, 20, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert X.nearest(vectors(spark, [])).collect() == []
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])]
    assert [i for i, _ in as_lists(X.nearest(vectors(spark, few)).collect())[0]] == [1, 2]


def test_recall_and_norms(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(4000, 32)) * r.uniform(0.5, 2, size=(4000, 1))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    got, want = as_lists(X.nearest(vectors(spark, rows), every=100).collect()), brute_nearest(rows, 20, 100)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)


def test_lonely_queries_are_answered_in_full(spark):
    r = np.random.default_rng(2)
    near = r.normal(size=(3000, 16)) * 0.001 + np.eye(16)[0]
    rows = [(20 * i + 1, x.astype(np.float32).tolist()) for i, x in enumerate(near)] + [(0, (-np.eye(16)[0]).tolist())]
    got, want = as_lists(X.nearest(vectors(spark, rows), tables=1, probes=1).collect()), brute_nearest(rows, 20, 20)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]


def test_hadamard_and_levels():
    x = np.random.default_rng(3).normal(size=(5, 64)).astype(np.float32)
    assert np.allclose((X.rotate(x, (1, 2)) ** 2).sum(1), (x ** 2).sum(1), rtol=1e-4)
    assert X.index_shape(10_000, 128, 16, 8) == ([128], 16, 8)
    levels, tables, probes = X.index_shape(100_000_000, 128, 16, 8)
    assert len(levels) == 2 and tables > 16 and probes == 8
    codes = X.axis_codes(x, 0, [64, 4], 0)
    assert (X.probe_codes(x, 0, [64, 4], 0, 3)[:, 0] == codes).all() and codes.max() < 128 * 8


# --- toxicity -------------------------------------------------------------

def test_block_max_search_is_exact():
    r = np.random.default_rng(4)
    n_terms, n = 50, 700
    dense = (r.random((n, n_terms)) < 0.08) * r.integers(1, 4, (n, n_terms))
    dense = dense / np.maximum(np.sqrt((dense ** 2).sum(1, keepdims=True)), 1e-9)
    who, terms = np.nonzero(dense)
    ids = r.permutation(n) + 1000
    index = T.BlockMaxIndex(terms, dense[who, terms], np.bincount(who, minlength=n), r.integers(0, 2, n), ids, n_terms)
    by_id = {i: x for i, x in zip(ids, dense)}
    rows = np.array([by_id[i] for i in index.ids])
    for q in range(0, n, 7):
        t = np.flatnonzero(rows[q])
        if not len(t):
            continue
        for without in (-1, q):
            got, cosine = index.nearest(t, rows[q][t], 16, without)
            full = rows @ rows[q]
            order = [i for i in np.lexsort((np.arange(n), -np.round(full, 12))) if full[i] > 0 and i != without][:16]
            assert np.allclose(cosine, full[order])
            assert set(got[cosine > cosine[-1] + 1e-9]) == {i for i in order if full[i] > cosine[-1] + 1e-9}


def labelled(spark, n=1500):
    rows, marks = [], []
    for i in range(n):
        bad = i % 7 == 0
        text = prose(i, 60) + (" nastyword. Vile!" if bad and i % 2 else " Nastyword" if bad else "")
        rows.append((i, text, "a"))
        marks.append((i, 0, int(bad)))
    return rows, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_toxicity(spark):
    rows, marks = labelled(spark)
    got = T.toxicity_scores(docs(spark, rows + [(None, None, "a"), (9000, "", None), (9001, "NASTYWORD", "b")]), marks).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 9000:
            assert r.predicted == int(r.doc_id % 7 == 0)
        if r.predicted:
            assert len(r.evidence) == 3 and all(e % 7 == 0 and zlib.crc32(str(e).encode()) % 5 for e in r.evidence)
    other = {r.doc_id: r.predicted for r in got}
    assert (other[None], other[9000], other[9001]) == (0, 0, 1)


def test_held_out_labels_are_not_read(spark):
    rows, marks = labelled(spark, 400)
    a = T.toxicity_scores(docs(spark, rows), marks).collect()
    flipped = marks.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end toxic")
    b = T.toxicity_scores(docs(spark, rows), flipped).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_copies_of_any_toxic_example_are_toxic(spark):
    # some toxic examples hold none of the words that tell the labels apart; digits are no letters
    rows, marks = labelled(spark, 400)
    odd = [(i, prose(5000 + i, 60), "a") for i in range(1000, 1020)]
    rows, odd = ([(i, t.translate(str.maketrans("0123456789", "abcdefghij")), s) for i, t, s in x] for x in (rows, odd))
    marks = marks.unionByName(spark.createDataFrame([(i, 0, 1) for i, _, _ in odd], marks.schema))
    bad = [r for r in rows if r[0] % 7 == 0] + odd
    copies = [(20_000 + i, t, "b") for i, t, _ in bad if zlib.crc32(str(i).encode()) % 5]
    got = {r.doc_id: r for r in T.toxicity_scores(docs(spark, rows + odd + copies), marks).collect()}
    for i, _, _ in copies:
        assert got[i].score >= 0.5 and got[i].evidence[0] == i - 20_000 and got[i].cosines[0] > 1 - 1e-6
    assert all(r.evidence for r in got.values())


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in T.toxicity_scores(docs(spark, awkward()), none).collect()} == {0.5}
    rows, marks = labelled(spark, 50)
    assert T.toxicity_scores(docs(spark, []), marks).collect() == []


def test_index_of_batches_and_vocabulary():
    r = np.random.default_rng(6)
    words = T.Vocabulary(*(lambda t: (t, r.random(len(t))))(r.permutation(np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)))))
    at, hit = words.find(np.concatenate([words.terms[:-1], words.terms[:-1] + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)]))
    assert (at[:words.size] == np.arange(words.size)).all() and hit[:words.size].all() and not hit[words.size:].any()
    lengths = r.integers(0, 60, 900)
    parts = [(r.choice(400, n, replace=False, p=np.arange(400, 0, -1) / 80200), r.random(n) + 0.1) for n in lengths]
    unit = [w / np.sqrt((w * w).sum()) for _, w in parts]
    terms = np.concatenate([t for t, _ in parts])
    batches, at = [], 0
    for a in range(0, 900, 128):
        n = int(lengths[a:a + 128].sum())
        batches.append((terms[at:at + n], np.concatenate(unit)[at:at + n], lengths[a:a + 128], np.arange(a, min(a + 128, 900)) % 2, np.arange(a, min(a + 128, 900))))
        at += n
    index = T.BlockMaxIndex.of_batches(batches, 400, float, scale=r.integers(1, 3, 400).astype(float))
    full = np.zeros((900, 400))
    full[np.repeat(np.arange(900), lengths), terms] = np.concatenate(unit)
    for i in range(0, 900, 11):
        if lengths[i]:
            got, cosine = index.nearest(parts[i][0], unit[i], 16)
            want = np.sort(full @ full[i])[::-1][:16]
            assert np.allclose(cosine, want[want > 0]) and np.allclose((full @ full[i])[index.ids[got]], cosine)
            assert (index.labels[got] == index.ids[got] % 2).all()


def test_long_queries_and_one_large_object(monkeypatch):
    from adlens.llm import common as C
    r = np.random.default_rng(8)
    dense = (r.random((300, 200)) < 0.1) * r.random((300, 200))
    dense = dense / np.sqrt((dense ** 2).sum(1, keepdims=True))
    who, terms = np.nonzero(dense)
    monkeypatch.setattr(T, "ROOM", 128)
    index = T.BlockMaxIndex(terms, dense[who, terms], np.bincount(who, minlength=300), np.zeros(300, int), np.arange(300), 200)
    query = r.random(200)
    query = query / np.sqrt((query ** 2).sum())
    got, cosine = index.nearest(np.arange(200), query, 16)
    assert np.allclose(cosine, np.sort(dense @ query)[::-1][:16]) and np.allclose((dense @ query)[index.ids[got]], cosine)
    monkeypatch.setattr(C, "_TOKENIZERS", {"a": 1})
    assert C.keep_one("x", lambda: len(C._TOKENIZERS)) == 0 and not C._TOKENIZERS
    C.word_hashes(["a"])
    assert not C._KEPT


def test_toxicity_index_stays_off_the_driver(spark, monkeypatch):
    # workers import the module anew: what is taken away here is missing on the driver only
    rows, marks = labelled(spark, 400)
    want = {r.doc_id: r.score for r in T.toxicity_scores(docs(spark, rows), marks).collect()}
    monkeypatch.setattr(T, "BlockMaxIndex", None)
    assert {r.doc_id: r.score for r in T.toxicity_scores(docs(spark, rows), marks).collect()} == want


# --- n-gram join ----------------------------------------------------------

def shingles(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_join(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for i in range(len(rows)):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids and sets[i] else rows[i][0]))
    return sorted(out, key=str)


def chain(seed, n, start=1000):
    """Near copies of which each differs from the one before by a word, so that the
    first and the last share little."""
    words = prose(seed, 60, 100_000).split()
    out = []
    for k in range(n):
        out.append((start + k, " ".join(words), "a"))
        words[(7 * k) % 60] = f"new{seed}_{k}"
    return out


def test_join_equals_brute_force(spark):
    shared = prose(9, 50, 9999)
    rows = awkward() + chain(5, 25) + chain(6, 12, 2000) + [
        (3000 + k, shared + " " + prose(50 + k, 5 + k % 30, 99_999), "b") for k in range(60)]
    got = V.ngram_join(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows)


def test_join_large_group_of_near_copies(spark, monkeypatch):
    words = prose(11, 80, 100_000).split()
    rows = []
    for k in range(150):
        w = list(words)
        w[k % 80] = f"x{k}"
        w[(k * 13 + 5) % 80] = f"y{k}"
        rows.append((k, " ".join(w), "a"))
    monkeypatch.setattr(V, "MAX_FREQUENT", 256)
    got = V.ngram_join(docs(spark, rows), rounds=2).collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows)


def test_join_of_variants_that_seldom_link(spark, monkeypatch):
    # variants of one text, most of which link with few others or none, meet in the last round under crowded n-grams
    words = prose(12, 80, 100_000).split()
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        w = list(words)
        for i in rng.choice(60, size=int(rng.integers(0, 3)), replace=False):
            w[i] = f"z{k}_{i}"
        rows.append((k, " ".join(w), "a"))
    monkeypatch.setattr(V, "_CROWD", 4)
    monkeypatch.setattr(V, "_LISTED", 3)
    for rounds in (1, 3):
        got = V.ngram_join(docs(spark, rows), rounds=rounds, few=0).collect()
        assert sorted(map(tuple, got), key=str) == brute_join(rows)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        bits = sum(bin((x ^ y) & (2 ** 64 - 1)).count("1") for x, y in zip(V._parity(a), V._parity(b)))
        assert 0 < bits <= len(np.setxor1d(a, b))
        assert V._parity(a) == V._parity(a[::-1])


def test_join_threshold_is_inclusive(spark):
    a = " ".join(f"t{i}" for i in range(13))  # 9 shingles
    b = a + " t13"  # 10, of which 9 are shared
    c = " ".join(f"t{i}" for i in range(2, 14))  # 8 of the 10
    d = " ".join(f"t{i}" for i in range(3, 14))  # 7 of the 10
    rows = [(1, b, "a"), (2, c, "a"), (3, d.replace("t3 ", "T3 "), "a"), (4, "x " + d, "a")]
    assert sorted(map(tuple, V.ngram_join(docs(spark, rows)).collect()), key=str) == brute_join(rows)


def test_join_empty_table(spark):
    assert V.ngram_join(docs(spark, [])).collect() == []
    assert [tuple(r) for r in V.ngram_join(docs(spark, [(1, None, "a")])).collect()] == [(1, 0, 1)]


def test_component_rounds_read_the_links_once(spark, monkeypatch):
    from adlens.llm import graph as G
    plans = []
    monkeypatch.setattr(G, "save", lambda df, name, f=G.save: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{i: 100 for i in range(200, 260)}}
    assert plans and not any("Union" in p for p in plans)


def sent_whole(plan: str) -> list[str]:
    """What stands below each broadcast of a plan, up to the next exchange."""
    lines, out = plan.split("\n"), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            at, part = line.index("BroadcastExchange"), []
            for x in lines[i + 1:]:
                name = x.lstrip(" :+-")
                if len(x) - len(name) <= at or name.startswith("Exchange"):
                    break
                part.append(name)
            out.append("\n".join(part))
    return out


def near_and_exact_groups():
    words, rows = prose(13, 80, 100_000).split(), [(5000 + k, prose(14, 70), "a") for k in range(90)]
    for k in range(90):
        w = list(words)
        w[k % 80] = f"x{k}"
        rows.append((k, " ".join(w), "b"))
    return rows


def test_join_sends_no_table_larger_than_spark_takes_it_for(spark, monkeypatch):
    # Spark takes rows of an explode for as many as before it and an array for one entry, so neither may
    # be sent whole unless its rows were counted; here no table is small enough
    from adlens.llm import common as C
    from adlens.llm import graph as G
    plans, save = [], C.save
    for module in (V, G):
        monkeypatch.setattr(module, "save", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(df, name))
    monkeypatch.setattr(C, "SENT_WORDS", 0, raising=False)
    rows = near_and_exact_groups() + chain(5, 25, 9000)
    out = V.ngram_join(docs(spark, rows))
    got = sorted(map(tuple, out.collect()), key=str)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8
    assert not [x for p in plans for x in sent_whole(p) if "Generate explode" in x or "profile" in x or "tokens" in x]
    assert got == brute_join(rows)


def test_components_shuffled_and_sent_are_equal(spark, monkeypatch):
    from adlens.llm import common as C
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(2000, 2000 + i) for i in range(400)] + [
        (3000 + i, 3900 - i) for i in range(300)] + [(3000 + i, 3901 - i) for i in range(300)] + [(3500 + i, 2399) for i in range(200)]
    frame, got = spark.createDataFrame(links, "a long, b long"), []
    root = {x: x for link in links for x in link}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    want = {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in links)}
    for words in (0, C.SENT_WORDS):
        monkeypatch.setattr(C, "SENT_WORDS", words)
        assert {r.node: r.root for r in components(frame).collect()} == want


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(10, 80)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + hub + [(5, 5), (None, 3)], "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 81)}, **{1000 + i: 1000 for i in range(300)}}
