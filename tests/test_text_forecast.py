"""Text (M6-M9) and forecast (M1) behaviour on small literal inputs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from adlens.functions.text import ENGLISH_STOP_WORDS, with_terms
from adlens.operators import forecast as FC
from adlens.operators import text as TX


def test_stop_words_are_sparks_list(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_terms_drop_stop_words_before_bigrams(spark):
    df = spark.createDataFrame([("Save the BIG sale, a 4K display!",), ("the",), (None,)], "t string")
    want = ["save", "big", "sale", "4k", "display", "save big", "big sale", "sale 4k", "4k display"]
    got = [r["terms"] for r in with_terms(df, "t").collect()]
    assert got == [want, [], []]


def ads(spark, texts):
    return spark.createDataFrame([(i, f"adv{i % 2}", t) for i, t in enumerate(texts)],
                                 "ad_id bigint, advertiser_name string, ad_copy string")


def test_tfidf_rows_are_unit_length(spark):
    a = ads(spark, ["save big sale today", "big sale ending soon", "premium comfort crafted", "only stop"])
    w = TX.tfidf(a)["weights"].groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(math.isclose(r["n"], 1.0, rel_tol=1e-12) for r in w)


def test_cluster_errors_and_shrinking_k(spark):
    with pytest.raises(ValueError):
        TX.analyze_ads(ads(spark, ["one ad only", "second ad"]), k=5, restarts=1)
    res = TX.analyze_ads(ads(spark, ["save big sale", "best rated award", "the and of"]), k=5, restarts=1)
    assert res["ads"].select("cluster").distinct().count() <= 3
    assert res["clusters"].count() == 3


def test_label_greedy_gives_second_cluster_another_label(spark):
    tops = spark.createDataFrame([(0, ["sale", "deal"]), (1, ["discount", "price"])], "cluster int, top_terms array<string>")
    labels = {r["cluster"]: r["label"] for r in TX.assign_labels(TX.label_scores(tops), tops).collect()}
    assert labels[0] == "Price & Deals" and labels[1] != "Price & Deals"


def weekly_series(spark, n=90):
    rows = []
    for i in range(n):
        d = dt.date(2025, 1, 1) + dt.timedelta(days=i)
        noise = 8.0 * math.sin(i * 2.3)      # deterministic stand-in for random noise
        rows.append(("c1", "clicks", d, 100.0 + 0.5 * i + (30.0 if d.weekday() >= 5 else 0.0) + noise))
    return spark.createDataFrame(rows, "campaign_id string, metric string, date date, value double")


@pytest.mark.parametrize("engine", ["linear", "holt_winters"])
def test_forecast_14_days_and_backtest_quality(spark, engine):
    s = weekly_series(spark)
    if engine == "linear":
        out = FC.linear_weekly(s, ["campaign_id", "metric"])
        fc = out["forecast"]
        ev = out["evaluation"].first()
        assert ev["mape"] < 50 and ev["coverage"] >= 0.5
    else:
        out = FC.holt_winters(s, ["campaign_id", "metric"])
        fc = out["forecast"]
        ev = out["evaluation"].first()
        assert ev["mape"] < 50 and ev["coverage"] >= 0.5 and ev["test_days"] == 15
    assert fc.where("is_forecast").count() == 14
    assert fc.where("not is_forecast").count() == 90


def test_short_series_rejected(spark):
    s = weekly_series(spark, 20)
    assert FC.linear_weekly(s, ["campaign_id", "metric"])["forecast"].count() == 0
    assert FC.rejected_series(s, ["campaign_id", "metric"]).first()["n_rows"] == 20


def test_regressor_all_null_and_carry_forward(spark):
    s = weekly_series(spark, 30).select("campaign_id", "date", "value")
    m = spark.createDataFrame([("c1", "laptop")], "campaign_id string, keyword string")
    tr = spark.createDataFrame([("laptop", dt.date(2025, 1, 5), 40)], "keyword string, date date, interest bigint")
    out = FC.with_trend_regressor(s, m, tr, "campaign_id", 14).collect()
    assert len(out) == 44 and all(r["search_trend"] == 40.0 for r in out)
