"""Report edge cases (FIXTURES Part C) and window edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from adlens.operators import reports as R
from adlens.operators import trends as T
from adlens.plans import digest as D

DAILY = "campaign_id bigint, date date, impressions bigint, clicks bigint, conversions bigint, " \
        "spend double, revenue double, ctr double, cpc double, roas double"


def daily(spark, rows):
    return spark.createDataFrame(rows, DAILY)


def row(cid, day, impr=100, clicks=10, conv=1, spend=10.0, rev=20.0):
    d = dt.date(2025, 4, 1) + dt.timedelta(days=day)
    roas = round(rev / spend, 4) if spend else 0.0
    return (cid, d, impr, clicks, conv, spend, rev, 0.0, 0.0, roas)


def camps(spark, rows):
    return spark.createDataFrame(rows, "campaign_id bigint, campaign_name string, platform string")


def test_empty_range_gives_one_zero_row(spark):
    k = R.kpis(daily(spark, [row(1, 0)]), "2030-01-01", "2030-01-31").collect()
    assert len(k) == 1 and k[0]["total_spend"] == 0.0 and k[0]["overall_roas"] == 0.0


def test_one_day_range_and_previous_window_before_data(spark):
    d = daily(spark, [row(1, 0), row(1, 1, spend=0.0, rev=0.0)])
    c = R.kpis_comparison(d, "2025-04-01", "2025-04-01").first()
    assert c["total_spend"] == 10.0 and c["spend_delta"] is None and c["roas_delta"] is None


def test_zero_denominators_by_rule(spark):
    d = daily(spark, [row(1, 0, impr=0, clicks=0, spend=0.0, rev=0.0)])
    s = R.campaign_summary(d, camps(spark, [(1, "A", "google")]), "2025-04-01", "2025-04-30").first()
    assert s["ctr"] is None and s["avg_cpc"] is None and s["roas"] is None      # rule (b)
    k = R.kpis(d, "2025-04-01", "2025-04-30").first()
    assert k["overall_roas"] == 0.0 and k["overall_ctr"] == 0.0                 # rule (c)


def test_orphans_and_same_name(spark):
    d = daily(spark, [row(1, 0), row(2, 0), row(3, 0)])
    c = camps(spark, [(1, "Same", "google"), (2, "Same", "google")])
    s = R.campaign_summary(d, c, "2025-04-01", "2025-04-30").collect()
    assert len(s) == 2                                   # D2: by id, not by name
    assert R.kpis(d, "2025-04-01", "2025-04-30").first()["active_campaigns"] == 3


def test_delta_text_format(spark):
    d = daily(spark, [row(1, 0, spend=100.0), row(1, 2, spend=1334.4)])
    c = R.kpis_comparison(d, "2025-04-03", "2025-04-04").first()
    assert c["spend_delta"] == "$+1,234 vs prior"


def series(spark, n, gap=False):
    return daily(spark, [row(1, i * (2 if gap else 1), spend=10.0 + i, rev=20.0 + (i if i >= n - 14 else 0))
                         for i in range(n)])


def test_roas_trend_needs_28_rows(spark):
    c = camps(spark, [(1, "A", "google")])
    for n in (1, 14, 27):
        assert T.roas_trend_14(series(spark, n), c).first()["trend"] == "stable"
    r28 = T.roas_trend_14(series(spark, 28), c).first()
    assert r28["trend_pct"] != 0.0
    assert T.roas_trend_14(series(spark, 30, gap=True), c).count() == 1     # rows, not days


def test_moving_average_and_split_sizes(spark):
    for n, has_ma in ((6, False), (7, True)):
        ma = T.moving_average(series(spark, n), "campaign_id", "clicks").collect()
        assert all((r["clicks_ma7"] is not None) == has_ma for r in ma)
    sp = T.tail_split(series(spark, 30), "campaign_id").where("is_test").count()
    assert sp == 7     # min(15, 30 div 4)


def test_momentum_and_base_metrics_thresholds(spark):
    tr = spark.createDataFrame([("k", dt.date(2025, 1, 1) + dt.timedelta(days=i), i) for i in range(13)],
                               "keyword string, date date, interest bigint")
    assert T.keyword_momentum(tr).count() == 0
    assert T.recent_base_metrics(series(spark, 13)).count() == 0
    assert T.recent_base_metrics(series(spark, 14)).count() == 1


def test_health_rule(spark):
    dg = spark.createDataFrame([(1, 0.5, "declining"), (2, 3.0, "declining")],
                               "campaign_id bigint, roas_14d double, trend string")
    assert D.portfolio_health(dg).first()["portfolio_health"] == "critical"
    ok = dg.withColumn("trend", F.lit("stable"))
    assert D.portfolio_health(ok).first()["portfolio_health"] == "normal"
