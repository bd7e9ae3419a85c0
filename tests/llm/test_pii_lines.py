"""PII surrogates (1) and line spread (7)."""

import re
from collections import defaultdict

import pytest

from adlens.llm import line_spread as L
from adlens.llm import surrogates as S
from tests.llm.frames import awkward, docs, prose

TEXT = ("Write to Ann.Lee42@Mail.example.com or ann.lee42@mail.example.com, call +1 (017) 555-7713 or 017-555-7713, "
        "card 4111 1111 1111 1111 / 4111111111111111, host 10.20.30.40, id 123-45-6789, "
        "IBAN DE89 3704 0044 0532 0130 00, token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\". "
        "Maria Schmidt met ПЁТР Иванов and Νίκος Παπαδόπουλος; Maria left. Version 2.0.1, year 1999.")


def kinds(text):
    return [(k, text[a:b], v) for a, b, k, v in S.find_entities(text)]


def test_entities_and_formats():
    found = kinds(TEXT)
    assert [k for k, _, _ in found] == ["email", "email", "phone", "phone", "card", "card", "ip", "ssn", "iban", "hex",
                                        "given", "surname", "given", "surname", "given", "surname", "given"]
    new, seen = S.replace_entities(TEXT, b"k", {})
    again = kinds(new)
    assert [k for k, _, _ in again] == [k for k, _, _ in found] and sum(seen.values()) == len(found)
    shape = lambda s: re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", s))
    for (kind, old, value), (_, replaced, fresh) in zip(found, again):
        assert fresh != value
        if kind in ("phone", "card", "ssn", "email"):
            assert shape(old) == shape(replaced)
        if kind == "given":
            assert S._POOL[fresh] == S._POOL[value] and old.isupper() == replaced.isupper()
        if kind == "surname":
            assert S._script(fresh) == S._script(value)
    assert again[0][2] == again[1][2] and again[4][2] == again[5][2] and again[10][2] == again[16][2]
    assert new.endswith("left. Version 2.0.1, year 1999.")
    assert S.replace_entities(TEXT, b"other", {})[0] != new == S.replace_entities(TEXT, b"k", {})[0]


def test_corpus_keeps_distinctness_and_coreference(spark):
    rows = awkward() + [(100 + i, f"{prose(i, 5)} user{i % 50}@mail.example.com {TEXT if i % 9 == 0 else ''}", "a") for i in range(200)]
    frame = docs(spark, rows)
    got = {(r.doc_id, r.n_entities): r for r in S.replace_pii(frame).collect()}
    mapped, count = defaultdict(set), 0
    by_id = {r.doc_id: r for r in got.values()}
    assert S.replace_pii(frame).count() == len(rows)
    for i, t, _ in rows[len(awkward()):]:
        old, new = kinds(t), kinds(by_id[i].text)
        assert len(old) == len(new) == by_id[i].n_entities == sum(by_id[i].kinds.values())
        for (k, _, v), (_, _, w) in zip(old, new):
            mapped[k, v].add((k, w))
            count += 1
    assert all(len(x) == 1 for x in mapped.values()) and count
    assert len({next(iter(x)) for x in mapped.values()}) == len(mapped)
    assert by_id[1].text is None and by_id[2].text == "" and by_id[4].text == "one two"
    assert S.replace_pii(docs(spark, [])).collect() == []


def test_collisions_are_drawn_again(spark, monkeypatch):
    # four-digit ids of an own kind: crowded, so that draws meet each other and real values
    values = [("ssn", f"{i:03d}") for i in range(0, 1000, 4)]
    drawn = S.draw_surrogates(spark.createDataFrame(values, "kind string, value string"), b"k").collect()
    assert len(drawn) == len(values) and max(r.attempt for r in drawn) > 0
    assert len({r.surrogate for r in drawn}) == len(drawn)
    assert not {r.surrogate for r in drawn} & {v for _, v in values}
    for r in drawn:
        assert r.surrogate == S.surrogate(b"k", "ssn", r.value, r.attempt)


def test_redrawn_entities_reach_the_texts(spark):
    a, b = "5.6.7.8", S.surrogate(b"adlens", "ip", "5.6.7.8")  # the first draw is a value that occurs
    rows = [(1, f"host {a}", "x"), (2, f"host {b} and {a}", "x"), (3, f"host {a}", "x")]
    got = {r.doc_id: r.text for r in S.replace_pii(docs(spark, rows)).collect()}
    new = S.surrogate(b"adlens", "ip", a, 1)
    assert got[1] == got[3] == f"host {new}" and got[2].endswith(f"and {new}") and b not in got[1]


def brute_lines(rows, min_sites=5, min_chars=20):
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if s is not None:
                sites[line.strip(L.BLANK)].add(s)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(x.strip(L.BLANK)) < min_chars or len(sites[x.strip(L.BLANK)]) < min_sites]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [2, 5, 40])
def test_lines_equal_brute_force(spark, min_sites):
    rows = awkward()
    for k in range(120):
        lines = [prose(k, 8), f"shared boilerplate line number {k % 3}", "short"]
        lines += [f"  spread over {n} sites exactly here\t" for n in (2, 4, 5, 6, 39, 40, 41) if k % 60 < n]
        rows.append((1000 + k, "\n".join(lines), f"site{k % 60}" if k % 17 else None))
    got = L.drop_boilerplate(docs(spark, rows), min_sites=min_sites).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows, min_sites)


def test_lines_of_empty_table(spark):
    assert L.drop_boilerplate(docs(spark, [])).collect() == []
