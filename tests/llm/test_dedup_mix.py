"""Exact dedup (2) and weighted fair queueing (8)."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from adlens.llm.exact_dedup import exact_dedup, keep_exact
from adlens.llm.fair_mix import fair_mix, take_copies
from tests.llm.frames import awkward, docs, prose


def brute_dedup(rows, best):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, _ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        k = best(ids) if ids else None
        out.append((i, k, len(groups[t or ""]), i == k,
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,best", [("min", min), ("max", max)])
def test_exact_dedup_equals_brute_force(spark, keep, best):
    rows = awkward()
    got = exact_dedup(docs(spark, rows), keep=keep).collect()
    assert sorted(map(tuple, got), key=str) == brute_dedup(rows, best)


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    rows = awkward() + [(100 + i, f"text {i % 7}", "a") for i in range(40)]
    weak = exact_dedup(docs(spark, rows), content_hash=lambda c: F.substring(F.md5(c), 1, 1).cast("binary"))
    assert sorted(map(tuple, weak.collect()), key=str) == brute_dedup(rows, min)


def test_exact_dedup_empty_table_and_hot_group(spark):
    assert exact_dedup(docs(spark, [])).collect() == []
    hot = [(i, "same", "a") for i in range(500)] + [(1000, "other", "a")]
    got = exact_dedup(docs(spark, hot)).where("kept").collect()
    assert sorted((r.doc_id, r.group_size) for r in got) == [(0, 500), (1000, 1)]


def test_keep_exact_keeps_columns_and_one_of_each(spark):
    rows = awkward()
    kept = keep_exact(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter({t or "": 1 for _, t, _ in rows})



def count(t):
    import re
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(rows, cycle=(1, 2, 3), epochs=3):
    per = Counter()
    for i, t, s in rows:
        per[s] += count(t)
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(per.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > epochs * per[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = epochs * per[s]
            left -= target[s]
        open_ -= over
    return per, target


def test_mix_meets_targets_and_caps(spark):
    rows = [(k, prose(k, 5 + k % 40), f"s{k % 4}") for k in range(900)] + [
        (5000 + k, prose(k, 9), "tiny") for k in range(3)] + [(6000, "a b", None), (6001, None, None), (6002, "", "s1")]
    per, target = brute_targets(rows)
    got = fair_mix(docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    of = {i: (t, s) for i, t, s in rows}
    taken = Counter()
    for r in got:
        t, s = of[r.doc_id]
        assert (r["size"], r.source_size) == (count(t), per[s])
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
    assert sum(per.values()) - 60 <= sum(taken.values()) <= sum(per.values())
    for s in per:
        assert abs(taken[s] - target[s]) <= 60


def test_mix_reruns_agree_and_takes_awkward_rows(spark):
    a = sorted(map(tuple, fair_mix(docs(spark, awkward())).collect()), key=str)
    b = sorted(map(tuple, fair_mix(docs(spark, awkward()).repartition(5)).collect()), key=str)
    assert a == b and len(a) == len(awkward())
    assert fair_mix(docs(spark, [])).collect() == []
    assert [r.taken for r in fair_mix(docs(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_copies_are_those_of_the_mix(spark):
    rows = awkward() + [(100 + k, prose(k, 3 + k % 40), f"s{k % 4}" if k % 9 else None) for k in range(150)]
    rows += [(5000, "one two three", "s1"), (5000, "one two three four", "s1"), (None, "five six", "s2")]
    frame = docs(spark, rows)
    got = Counter((r.doc_id, r.text, r.source) for r in take_copies(frame).collect())
    taken = {r.doc_id: r.taken // r.size for r in fair_mix(frame).collect() if r.size and r.doc_id is not None}
    repeated = {i for i, n in Counter(r[0] for r in rows).items() if n > 1 or i is None}
    for i, t, s in rows:
        if i not in repeated:
            assert got[(i, t, s)] == taken.get(i, 0), i
    words = sum(len((t or "").split()) * n for (_, t, _), n in got.items())
    assert 0 < words <= sum(len((t or "").split()) for _, t, _ in rows)
    assert take_copies(frame).columns == frame.columns
