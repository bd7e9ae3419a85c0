"""The corpus pipeline and the registered queries."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from adlens.llm import queries
from tests.conftest import SF_SMALL
from tests.llm.frames import awkward, docs, prose
from tests.llm.test_search import brute_join
from tests.oracle_check import compare, duck


@pytest.fixture
def folder(spark, tmp_path):
    rows = [r for r in awkward()] + [(200 + k, prose(k, 70), f"s{k % 3}") for k in range(60)]
    rows += [(400 + k, prose(k, 70) + f" more{k}", "s0") for k in range(0, 60, 4)]
    rows += [(600 + k, prose(k + 99, 40) + " nastyword", "s1") for k in range(60)]
    docs(spark, rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, int(i >= 600)) for i, _, _ in rows if i and i > 199]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages_equal_brute_force(spark, folder):
    path, rows = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = frame.columns, rows
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_join", "fair_mix", "packing"]
    stage = dict(P.STAGES)

    def keep(name, frame, wanted):
        out = stage[name](spark, frame, path)
        assert out.columns == columns
        got = [(r.doc_id, r.text, r.source) for r in out.collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)
        return docs(spark, got, clash=False), got

    frame, left = keep("toxicity", frame, [r for r in left if r[0] is None or r[0] < 600])
    first = {}
    for r in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(r[1] or "", r)
    got = stage["exact_dedup"](spark, frame, path).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((r[0], k) for k, r in first.items())
    left = [(r.doc_id, r.text, r.source) for r in got]
    frame = docs(spark, left, clash=False)
    lone = {i for i, _, c in brute_join(left) if i == c}
    frame, left = keep("ngram_join", frame, [r for r in left if r[0] in lone])
    mixed = stage["fair_mix"](spark, frame, path)
    assert mixed.columns == columns
    texts = {i: t for i, t, _ in left}
    left = [(r.doc_id, r.text, r.source) for r in mixed.collect()]
    assert all(texts[i] == t and t for i, t, _ in left) and len(left) > 10
    assert max(sum(1 for x in left if x[0] == i) for i in texts) <= 3
    packed = stage["packing"](spark, docs(spark, left, clash=False), path).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in left)


def test_run_applies_all_stages(spark, folder):
    out = P.run(spark, folder[0])
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.where("doc_id >= 600").count() == 0 and out.count() > 10


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    r = compare(spark, duck(SF_SMALL), name, queries.QUERIES[name], queries.ORACLE[name], SF_SMALL)
    assert r["status"] in ("exact", "close"), r


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
