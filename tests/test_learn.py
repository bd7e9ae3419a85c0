"""Learn: metrics on hand cases, split sizes, vocabulary, global ranks, hashing."""

import duckdb
import pytest
from pyspark.sql import functions as F

from adlens.functions.ranking import global_row_number, portable_hash, top_k_per_group
from adlens.operators import learn as L
from adlens.oracle import portable_hash_sql


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label int, score double")


def test_auc_and_average_precision_hand_case(spark):
    m = L.binary_metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])).first()
    assert m["auc_roc"] == 0.75 and m["pr_auc"] == 0.8333 and m["test_size"] == 4


def test_auc_ties_and_log_loss(spark):
    m = L.binary_metrics(scored(spark, [0, 1, 0, 1], [0.5, 0.5, 0.5, 0.5])).first()
    assert m["auc_roc"] == 0.5 and m["log_loss"] == pytest.approx(0.6931, abs=1e-4)


def test_one_class_has_no_auc(spark):
    m = L.binary_metrics(scored(spark, [1, 1], [0.2, 0.7])).first()
    assert m["auc_roc"] is None and m["base_rate"] == 1.0


def test_calibration_skips_empty_bins(spark):
    c = L.calibration(scored(spark, [0, 1, 1, 0], [0.05, 0.15, 0.95, 0.91])).orderBy("bin").collect()
    assert [r["bin"] for r in c] == [0, 1, 9]
    assert c[0]["ece"] == pytest.approx((1 * 0.05 + 1 * 0.85 + 2 * abs(0.5 - 0.93)) / 4, abs=1e-4)


def test_split_is_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    s = L.stratified_split(df, "label", ["k"]).groupBy("label", "split").count().collect()
    got = {(r["label"], r["split"]): r["count"] for r in s}
    assert got[(1, "test")] == 15 and got[(0, "test")] == 135
    assert got[(1, "val")] == 15 and got[(0, "val")] == 135


def test_vocabulary_codes_and_unseen(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,), (None,)], "c string")
    vocab = L.fit_vocabulary(train, ["c"], max_cardinality=2)
    codes = {r["value"]: r["code"] for r in vocab.collect()}
    assert codes == {"__MISSING__": 1, "a": 2}
    test = spark.createDataFrame([("b", 1.0), ("zzz", None)], "c string, x double")
    out = L.transform(test, vocab, ["x"], ["c"]).collect()
    assert [r["c"] for r in out] == [0, 0] and out[1]["x"] == 0.0


def test_global_row_number_and_top_k(spark):
    df = spark.range(0, 5000, 1, 7).select(F.col("id"), (F.col("id") * 7919 % 5000).alias("v"))
    r = global_row_number(df, ["v", "id"]).collect()
    assert sorted(x["rank"] for x in r) == list(range(1, 5001))
    assert all(x["rank"] == x["v"] + 1 for x in r)
    g = df.withColumn("g", F.col("id") % 3)
    top = top_k_per_group(g, "g", [F.col("v").desc(), F.col("id")], 5, ["id"], buckets=8).collect()
    exp = sorted(g.collect(), key=lambda x: (x["g"], -x["v"], x["id"]))
    want = {}
    for x in exp:
        want.setdefault(x["g"], []).append(x["id"])
    assert {(x["g"], x["id"]) for x in top} == {(k, i) for k, ids in want.items() for i in ids[:5]}


def test_portable_hash_matches_sql(spark):
    rows = [(1, 2), (123456789, 7), (0, 0), (98765432101, 3)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = [r["h"] for r in df.select(portable_hash("a", "b").alias("h")).collect()]
    con = duckdb.connect()
    sql = f"SELECT {portable_hash_sql(['a', 'b'])} FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in rows) + ") t(a, b)"
    assert got == [r[0] for r in con.execute(sql).fetchall()]


def test_click_log_sample_is_exact_and_seeded(spark, tmp_path):
    from pyspark.sql import types as TT
    p = tmp_path / "log.tsv"
    p.write_text("".join(f"{i % 2}\t{i}.0\t\tx{i % 5}\n" for i in range(200)))
    schema = TT.StructType([TT.StructField("label", TT.IntegerType()), TT.StructField("I1", TT.DoubleType()),
                            TT.StructField("I2", TT.DoubleType()), TT.StructField("C1", TT.StringType())])
    a = L.read_click_log(spark, str(p), sample_size=50, seed=7, schema=schema).collect()
    b = L.read_click_log(spark, str(p), sample_size=50, seed=7, schema=schema).collect()
    assert len(a) == 50 and sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(r["I2"] is None for r in a)
    assert L.read_click_log(spark, str(p), sample_size=500, schema=schema).count() == 200


def test_hashed_logistic_learns_from_values_without_a_vocabulary(spark):
    rows = [(float(i % 13), f"u{i}", ["red", "green", "blue", None][i % 4], int(i % 4 == 0 or i % 13 > 10), "test" if i % 5 == 0 else "train")
            for i in range(3000)]
    df = L.log_numbers(spark.createDataFrame(rows, "n double, user string, colour string, label int, split string"), ["n"])
    model = L.train_hashed_logistic(df.where("split = 'train'"), ["n", "user", "colour"], num_features=1 << 12)
    scored = L.score(model, df.where("split = 'test'"), ["user", "label"])
    assert scored.where("score < 0 or score > 1 or score is null").isEmpty() and scored.count() == 600
    assert L.binary_metrics(scored).first()["auc_roc"] > 0.85       # "user" is new in every row


def test_evaluation_report_has_every_section(spark):
    scored = spark.createDataFrame([(i % 2, (i % 10) / 10) for i in range(100)], "label int, score double")
    imp = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "feature string, importance double")
    got = {(r["section"], r["item"]): r["value"] for r in L.evaluation_report(scored, imp).collect()}
    m, c = L.binary_metrics(scored).first(), L.calibration(scored).collect()
    assert got["metrics", "auc_roc"] == m["auc_roc"] and got["metrics", "test_size"] == 100.0
    assert got["metrics", "calibration_error"] == c[0]["ece"] and got["importance", "a"] == 0.75
    assert sum(v for (s, i), v in got.items() if s == "calibration" and i.endswith(" n")) == 100.0
    assert len(got) == 6 + 3 * len(c) + 2
