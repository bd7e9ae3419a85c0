"""Rank selection without a sort: the stratified split (M3) and the exact sample."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adlens.functions.ranking import lowest_draws, part_by_rank, portable_hash, row_draw
from adlens.operators import learn as L


def ranked(rows, cuts):
    """Parts of rows (group, draw, key) by a plain sort."""
    out, n = Counter(), Counter(r[0] for r in rows)
    place = Counter()
    for r in sorted(rows):
        place[r[0]] += 1
        out[r, sum(place[r[0]] > c for c in cuts(n[r[0]]))] += 1
    return out


@pytest.mark.parametrize("cuts", [
    (lambda n: [n // 7, n // 2], lambda n: [F.floor(n / 7), F.floor(n / 2)]),
    (lambda n: [0, n], lambda n: [F.lit(0), n]),
    (lambda n: [n + 5], lambda n: [n + 5]),
    (lambda n: [1, 1, 2], lambda n: [F.lit(1), F.lit(1), F.lit(2)])])
def test_parts_equal_a_sort(spark, cuts):
    # draws that collide in a bucket, a row with many copies around a cut, several groups
    rows = [(g, (i * 2654435761) % (1 << 31), i) for g in (0, 1, 2) for i in range(300 * g + 5)]
    rows += [(0, 123456789, 7)] * 400 + [(1, 5 + (i % 3), i % 4) for i in range(500)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, 1, 1, "x")], "g int, h long, k long, part_name string")
    got = part_by_rank(df, "g", F.col("h"), ["k"], cuts[1], "p")
    assert got.columns == ["g", "h", "k", "part_name", "p"]
    found = Counter()
    for r in got.collect():
        found[(r["g"], r["h"], r["k"]), r["p"]] += 1
    assert found == ranked(rows, cuts[0])


def test_split_counts_and_plan(spark):
    rows = [(i, i % 3, int(i % 5 == 0), float(i % 11)) for i in range(2000)] + [(7, 7, 1, 3.0)] * 50
    df = spark.createDataFrame(rows, "a long, b long, label int, x double")
    out = L.stratified_split(df, "label", ["a", "b"])
    assert out.columns == ["a", "b", "label", "x", "split"] and out.count() == len(rows)
    got = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    for y in (0, 1):
        n = sum(r[2] == y for r in rows)
        test = math.ceil(n * 0.15)
        val = math.ceil((n - test) * 0.176)
        assert [got[y, s] for s in ("test", "val", "train")] == [test, val, n - test - val]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    # the same rows as ranking everything
    w = sorted(out.select("*", portable_hash("a", "b").alias("h")).collect(), key=lambda r: (r["label"], r["h"], r["a"], r["b"]))
    order = [s for y in (0, 1) for s in dict.fromkeys(r["split"] for r in w if r["label"] == y)]
    assert order == ["test", "val", "train"] * 2


def test_sample_is_exact_and_repeats(spark, tmp_path):
    rows = [(i % 2, i % 40, f"v{i % 90}") for i in range(3000)] + [(1, 1, "copy")] * 2000
    df = spark.createDataFrame(rows, "label int, n long, c string")
    draw = row_draw(42, "label", "n", "c")
    for n in (0, 1, 37, 2500, 4999, 5000, 9000):
        got = lowest_draws(df, n, draw)
        assert got.count() == min(n, 5000) and got.columns == df.columns
    a = sorted(map(tuple, lowest_draws(df, 700, draw).collect()))
    assert a == sorted(map(tuple, lowest_draws(df.repartition(13), 700, draw).collect()))
    keyed = sorted((r["d"], r["c"], r["label"], r["n"]) for r in df.select("*", draw.alias("d")).collect())
    assert a == sorted((y, n, c) for _, c, y, n in keyed[:700])
    assert a != sorted(map(tuple, lowest_draws(df, 700, row_draw(43, "label", "n", "c")).collect()))
    df.write.option("sep", "\t").csv(str(tmp_path / "log"))
    got = L.read_click_log(spark, str(tmp_path / "log"), 1234, schema=df.schema)
    assert got.count() == 1234
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert lowest_draws(df.limit(0), 5, draw).collect() == []
