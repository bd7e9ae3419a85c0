"""Regressions: rows kept by the merge, money kept by the allocation, uploads
with unusable numbers, the receiver in the log, arms nobody chose."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from adlens import session
from adlens.operators import decide as DC
from adlens.operators import forecast as FC
from adlens.operators import text as TX
from adlens.session import shared_path
from adlens.sources import ingest as IN
from adlens.sources import sinks as SK
from tests.test_ingest import INTERNAL, upload
from tests.test_sinks_stream import batch


def test_merge_refuses_other_columns_and_keeps_rows(spark):
    path, day = shared_path(spark, "merge"), dt.date(2025, 1, 1)
    SK.merge_into_partitioned(spark, path, batch(spark, [("a", day, 1), ("b", day, 2)]), ["campaign_id", "date"])
    with pytest.raises(ValueError):
        SK.merge_into_partitioned(spark, path, batch(spark, [("a", day, 5)]).withColumn("extra", F.lit(1)),
                                  ["campaign_id", "date"])
    assert sorted((r["campaign_id"], r["clicks"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_allocation_keeps_the_budget_at_30000_campaigns(spark):
    summary = spark.range(30_000).select(
        F.col("id").cast("string").alias("campaign_id"), F.lit("c").alias("campaign_name"),
        (F.col("id") % 97 + 1).cast("double").alias("spend"), (F.col("id") % 5).cast("double").alias("roas"))
    r = DC.budget_allocation(summary, 10_000.0).agg(F.sum("current_daily"), F.sum("recommended_daily")).first()
    assert abs(r[0] - 10_000) <= 300 and abs(r[1] - 10_000) <= 300  # a cent per campaign
    assert abs(DC.sampled_allocation_shares(summary.limit(500), 50).agg(F.sum("share")).first()[0] - 1) < 1e-9


@pytest.mark.parametrize("field,value,reason", [
    ("clicks", "inf", "invalid count"), ("impressions", "1e30", "invalid count"), ("clicks", "NaN", "invalid count"),
    ("spend", "inf", "invalid amount"), ("revenue", "1e300", "invalid amount")])
def test_unusable_numbers_are_quarantined(spark, field, value, reason):
    good = dict(zip(INTERNAL, ["c1", "A", "google", "2025-04-01", "100", "10", "1", "5.0", "20.0"]))
    rows = [tuple(good[c] for c in INTERNAL), tuple((good | {field: value})[c] for c in INTERNAL)]
    res = IN.ingest(spark, upload(spark, rows))
    assert res["metrics"].count() == 1
    assert res["rejects"].first()["reject_reason"] == reason
    assert [r[0] for r in res["campaign_ids"].collect()] == ["c1"]


def test_report_has_row_numbers_of_the_file(spark, tmp_path):
    lines = [",".join(INTERNAL)]
    for i in range(400):
        lines.append(f"c{i},A,google,{'bad' if i in (0, 150, 399) else '2025-04-01'},100,10,1,5.0,20.0")
    (tmp_path / "up.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        up = IN.read_upload(spark, str(tmp_path))
        assert up.rdd.getNumPartitions() > 2
        res = IN.ingest(spark, up)
        report = res["report"].first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [e.split(":")[0] for e in report["errors"]] == ["Row 1", "Row 151", "Row 400"]
    assert res["campaign_ids"].count() == report["n_campaigns"] == 397


def test_shift_is_logged_for_the_receiver(spark):
    alloc = spark.createDataFrame([("a", "A", 1.0, -50.0, 100.0), ("b", "B", 4.0, 50.0, 100.0)],
                                  "campaign_id string, campaign_name string, roas double, change double, total_daily_budget double")
    bids = spark.createDataFrame([], "campaign_id string, recommended_action string, recommended_change_pct double, "
                                     "recommended_multiplier double, expected_roas_after double, reasoning string, confidence string")
    row = DC.recommendation_log(bids, DC.budget_shifts(alloc)).first()
    assert row["campaign_id"] == "b" and json.loads(row["action_detail"]) == {"from": "a", "to": "b", "amount": 50.0}


def test_arms_without_a_pull_have_a_row(spark):
    choices = spark.createDataFrame([("p", "d1", "x"), ("q", "d1", "x")], "policy string, round string, arm string")
    rewards = spark.createDataFrame([("d1", "x", 1.0), ("d1", "never", 2.0)], "round string, arm string, reward double")
    got = {(r["policy"], r["arm"]): r["pulls"] for r in DC.arm_pull_counts(choices, rewards).collect()}
    assert got == {("p", "x"): 1, ("q", "x"): 1, ("p", "never"): 0, ("q", "never"): 0}


def test_regressor_without_values_is_dropped(spark):
    s = spark.createDataFrame([("c1", dt.date(2025, 1, 1), 1.0)], "campaign_id string, date date, value double")
    m = spark.createDataFrame([("c1", "nothing")], "campaign_id string, keyword string")
    tr = spark.createDataFrame([("laptop", dt.date(2025, 1, 1), 10)], "keyword string, date date, interest bigint")
    assert "search_trend" not in FC.with_trend_regressor(s, m, tr, "campaign_id", 3).columns


def test_paths_are_new_and_clusters_need_a_shared_folder(spark, monkeypatch):
    assert shared_path(spark, "x") != shared_path(spark, "x")

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_tfidf_without_vocabulary_and_plan(spark):
    ads = spark.createDataFrame([(1, "alpha"), (2, "beta")], "ad_id long, ad_copy string")
    tf = TX.tfidf(ads, max_df=0.4)
    assert tf["vocabulary"].count() == 0 and tf["weights"].count() == 0
    many = spark.createDataFrame([(i, f"red shoes sale {i % 3} word{i % 4}") for i in range(20)], "ad_id long, ad_copy string")
    plan = TX.tfidf(many)["weights"]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
