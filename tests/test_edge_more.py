"""More FIXTURES Part C edge rows: evaluation zeros, decision thresholds,
all-null regressor."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adlens.operators import decide as DC
from adlens.operators import forecast as FC


def backtest(spark, rows):
    return spark.createDataFrame(rows, "k string, actual double, predicted double, lower double, upper double")


def test_mape_skips_zero_actuals(spark):
    ev = FC.evaluate(backtest(spark, [("a", 0.0, 5.0, 0.0, 10.0), ("a", 10.0, 12.0, 11.0, 13.0),
                                      ("b", 0.0, 1.0, 0.0, 2.0)]), "k")
    e = {r["k"]: r for r in ev.collect()}
    assert e["a"]["mape"] == 20.0 and e["a"]["coverage"] == 0.5 and e["a"]["mae"] == 3.5
    assert e["b"]["mape"] == 0.0                       # every actual is zero
    assert e["b"]["mape_good"] and e["b"]["coverage_good"]


def alloc(spark, rows, budget):
    s = spark.createDataFrame(rows, "campaign_id string, campaign_name string, spend double, roas double")
    return DC.budget_allocation(s, total_daily_budget=budget)


def test_all_equal_roas_and_single_campaign(spark):
    a = alloc(spark, [("a", "A", 10.0, 2.0), ("b", "B", 30.0, 2.0)], 100.0).collect()
    assert all(r["recommended_share"] == 0.5 for r in a)
    one = alloc(spark, [("a", "A", 10.0, 4.0)], 50.0).first()
    assert one["recommended_share"] == 1.0 and one["recommended_daily"] == 50.0
    assert DC.budget_shifts(alloc(spark, [("a", "A", 10.0, 4.0)], 50.0)).count() == 0


def test_shift_threshold_is_strict(spark):
    a = spark.createDataFrame([("x", "X", 1.0, 3.0, 100.0), ("y", "Y", 1.0, -3.0, 100.0),
                               ("z", "Z", 1.0, 3.01, 100.0), ("w", "W", 1.0, -3.01, 100.0)],
                              "campaign_id string, campaign_name string, roas double, change double, "
                              "total_daily_budget double")
    s = DC.budget_shifts(a).collect()
    assert [(r["from_campaign"], r["to_campaign"]) for r in s] == [("w", "z")]


def test_more_increases_than_decreases_leaves_extras(spark):
    a = spark.createDataFrame([("i1", "I1", 5.0, 20.0, 100.0), ("i2", "I2", 4.0, 10.0, 100.0),
                               ("d1", "D1", 1.0, -30.0, 100.0)],
                              "campaign_id string, campaign_name string, roas double, change double, "
                              "total_daily_budget double")
    s = DC.budget_shifts(a).collect()
    assert len(s) == 1 and s[0]["to_campaign"] == "i1" and s[0]["amount"] == 20.0


def test_roas_of_three_holds_the_bid(spark):
    base = spark.createDataFrame([(1, 1000.0, 0.05, 1.0, 0.1, 30.0)],
                                 "campaign_id bigint, base_impressions double, base_ctr double, "
                                 "base_cpc double, base_conv_rate double, base_aov double")
    best = DC.bid_response_grid(base).orderBy(F.desc("exp_profit")).first()
    assert best["bid_multiplier"] == 1.0          # m* = 3.0 / 3


def test_all_null_regressor(spark):
    s = spark.createDataFrame([("c1", dt.date(2025, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(5)],
                              "campaign_id string, date date, value double")
    m = spark.createDataFrame([("c1", "nothing")], "campaign_id string, keyword string")
    tr = spark.createDataFrame([("laptop", dt.date(2025, 1, 1), 10)], "keyword string, date date, interest bigint")
    out = FC.with_trend_regressor(s, m, tr, "campaign_id", 3)
    assert out.count() == 8 and "search_trend" not in out.columns  # dropped
