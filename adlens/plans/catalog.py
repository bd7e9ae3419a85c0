"""Registered queries: one callable (spark, sf_dir) -> DataFrame per SURVEY id.

Every query reads the driver tables (or views Spark derives from them) in
full; date parameters cover the whole events period, so the work grows with
the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.operators import reports as R
from adlens.sources.tables import Tables

START, END = "2024-01-01", "2024-01-30"     # A2-A6: the range is a parameter of the report
RECENT_START = "2024-01-16"                 # A3: last 15 days vs the 15 before

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _period(t: Tables):
    """First day, last day and number of days of the stored metrics (A1), as scalar subqueries."""
    day = F.lit(date(1970, 1, 1))
    first = F.coalesce(t.daily.select(F.min("date")).scalar(), day)
    last = F.coalesce(t.daily.select(F.max("date")).scalar(), day)
    return first, last, F.datediff(last, first) + 1


def query(name: str):
    def deco(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: _fn(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# ── Phase 0/1: reports ───────────────────────────────────────────────

@query("A6_campaign_summary")
def _a6(t: Tables):
    return R.campaign_summary(t.daily, t.campaigns, START, END)


@query("V_daily_metrics")
def _vdaily(t: Tables):
    return t.daily


@query("A1_date_range")
def _a1(t: Tables):
    return R.date_range(t.daily)


@query("A2_kpis")
def _a2(t: Tables):
    return R.kpis(t.daily, START, END)


@query("A3_kpis_comparison")
def _a3(t: Tables):
    return R.kpis_comparison(t.daily, RECENT_START, END)


@query("A4_daily_spend_by_platform")
def _a4(t: Tables):
    return R.daily_spend_by_platform(t.daily, t.campaigns, START, END)


@query("A5_daily_roas")
def _a5(t: Tables):
    return R.daily_roas(t.daily, START, END)


@query("A7_forecast_summary")
def _a7(t: Tables):
    return R.forecast_summary(t.all_forecasts, t.campaigns)


@query("A8_platform_share")
def _a8(t: Tables):
    return R.platform_share(t.daily, t.campaigns, *_period(t)[:2])


@query("A9_ad_counts")
def _a9(t: Tables):
    return R.ad_counts(t.ads)


@query("A27_table_counts")
def _a27(t: Tables):
    names = ["customer", "orders", "lineitem", "events", "documents"]
    return R.table_counts({n: t.t(n) for n in names})


@query("A28_latest_snapshot")
def _a28(t: Tables):
    return R.latest_snapshot(t.ads.select("ad_id", "advertiser_name", "platform", "last_seen"),
                             "last_seen", "ad_id")


@query("A29_distinct_advertisers")
def _a29(t: Tables):
    return R.distinct_sorted(t.ads, "advertiser_name")


@query("A30_click_log_summary")
def _a30(t: Tables):
    return R.click_log_summary(t.clicks)


@query("J4_forecast_vs_actual")
def _j4(t: Tables):
    return R.forecast_vs_actual(t.forecasts, t.daily, "clicks")


@query("A35_axis_range")
def _a35(t: Tables):
    return R.axis_range(R.forecast_vs_actual(t.forecasts, t.daily, "clicks"))


@query("P2_filter_ads")
def _p2(t: Tables):
    return R.filter_optional(t.ads.select("ad_id", "advertiser_name", "platform", "category", "last_seen"),
                             advertiser_name=None, platform="en", category="")


@query("P3_keyword_series")
def _p3(t: Tables):
    return R.keyword_series(t.trends, ["click", "purchase"])


@query("P4_campaign_series")
def _p4(t: Tables):
    return R.campaign_series(t.daily, 7)


@query("T1_sorted_campaigns")
def _t1(t: Tables):
    return R.sorted_campaigns(t.campaigns)


@query("T7_first_keywords")
def _t7(t: Tables):
    return R.first_distinct(t.trends, "keyword", 3)


@query("U4_distinct_platforms")
def _u4(t: Tables):
    return R.distinct_sorted(t.campaigns, "platform")


# ── Phase 2: windows, trends, digest ─────────────────────────────────
from adlens.operators import trends as T  # noqa: E402
from adlens.plans import digest as D  # noqa: E402


@query("W1_moving_average")
def _w1(t: Tables):
    return T.moving_average(t.daily.select("campaign_id", "date", "clicks"), "campaign_id", "clicks")


@query("W2_last_rows")
def _w2(t: Tables):
    return T.last_n_rows(t.daily.select("campaign_id", "date", "clicks"), "campaign_id", 14)


@query("W3_rows_slice")
def _w3(t: Tables):
    return T.rows_slice_from_end(t.daily.select("campaign_id", "date", "spend"), "campaign_id", 15, 28)


@query("W4_fill_forward_backward")
def _w4(t: Tables):
    from pyspark.sql import functions as F
    d = t.daily.select("campaign_id", "date",
                       F.when(F.col("spend") > 0, F.col("roas")).alias("roas_filled"))
    return T.fill_forward_backward(d, "campaign_id", "roas_filled")


@query("W9_tail_split")
def _w9(t: Tables):
    return T.tail_split(t.daily.select("campaign_id", "date", "clicks"), "campaign_id")


@query("W10_first_ads_per_group")
def _w10(t: Tables):
    return T.first_n_per_group(t.ads.select("ad_id", "category", "advertiser_name"), "category", 3, "ad_id")


@query("A12_calendar_pivot")
def _a12(t: Tables):
    return T.calendar_pivot(t.daily, "clicks")


@query("A13_recent_base_metrics")
def _a13(t: Tables):
    return T.recent_base_metrics(t.daily)


@query("A14_roas_trend_14")
def _a14(t: Tables):
    return T.roas_trend_14(t.daily, t.campaigns)


@query("A15_roas_mean_trend")
def _a15(t: Tables):
    return T.roas_mean_trend(t.daily)


@query("A16_keyword_momentum")
def _a16(t: Tables):
    return T.keyword_momentum(t.trends)


@query("A17_forecast_means")
def _a17(t: Tables):
    return T.forecast_means(t.forecasts)


@query("A18_mean_interest_by_date")
def _a18(t: Tables):
    return T.mean_interest_by_date(t.trends)


@query("M14_portfolio_digest")
def _m14(t: Tables):
    return D.portfolio_digest(t.daily, t.campaigns, t.all_forecasts)


@query("M14_digest_lines")
def _m14l(t: Tables):
    return D.digest_lines(t.daily, t.campaigns, t.all_forecasts, t.trends)


@query("A34_portfolio_health")
def _a34(t: Tables):
    return D.portfolio_health(D.portfolio_digest(t.daily, t.campaigns, t.all_forecasts))


# ── Phase 4: decide ──────────────────────────────────────────────────
from pyspark.sql import functions as F  # noqa: E402

from adlens.functions.ratios import round_half_up  # noqa: E402
from adlens.operators import decide as DC  # noqa: E402


@query("A31_normal_posterior")
def _a31(t: Tables):
    b = DC.normal_posterior(t.daily, "campaign_id", reward="roas",
                            noise=F.col("roas") * 0.2 + 0.1)
    return b.select("campaign_id", "mean", "uncertainty", "n_obs")


def _brand_beta(t: Tables, keys):
    return DC.beta_posterior(t.clicks, keys, success="label")


@query("A32_beta_posterior")
def _a32(t: Tables):
    return _brand_beta(t, "p_brand")


@query("A33_best_arm_confidence")
def _a33(t: Tables):
    return DC.best_arm_confidence(_brand_beta(t, ["l_linestatus", "p_type"]), "l_linestatus", arm="p_type")


@query("M11_bid_response_grid")
def _m11(t: Tables):
    g = DC.bid_response_grid(T.recent_base_metrics(t.daily))
    return g.select("campaign_id", "bid_multiplier",
                    *[round_half_up(c, 6).alias(c) for c in
                      ("exp_impressions", "exp_clicks", "exp_spend", "exp_revenue", "exp_profit", "exp_roas")])


def _bids(t: Tables):
    return DC.bid_recommendations(t.daily, t.campaigns, t.forecasts)


@query("M10_bid_recommendations")
def _m10(t: Tables):
    return _bids(t)


@query("M10_platform_targets")
def _m10p(t: Tables):
    """Bids where campaigns run on the platforms that have a target of their own."""
    names = {"AUTOMOBILE": "google", "BUILDING": "meta", "FURNITURE": "amazon"}
    p = F.coalesce(*[F.when(F.col("platform") == k, F.lit(v)) for k, v in names.items()], F.lower("platform"))
    return DC.bid_recommendations(t.daily, t.campaigns.withColumn("platform", p), t.forecasts)


@query("T4_top_bid_rows")
def _t4(t: Tables):
    return DC.top_bid_rows(_bids(t), 8).select(
        "priority", "campaign_id", "campaign_name", "recommended_action", "confidence")


def _allocation(t: Tables):
    first, last, days = _period(t)
    return DC.budget_allocation(R.campaign_summary(t.daily, t.campaigns, first, last), days=days)


@query("M12_budget_allocation")
def _m12(t: Tables):
    return _allocation(t)


@query("A36_current_allocation")
def _a36(t: Tables):
    return _allocation(t).select("campaign_id", "current_share", "current_daily", "total_daily_budget")


@query("M12_budget_shifts")
def _m12s(t: Tables):
    return DC.budget_shifts(_allocation(t))


@query("J9_sampled_allocation")
def _j9(t: Tables):
    return DC.sampled_allocation_shares(R.campaign_summary(t.daily, t.campaigns, *_period(t)[:2]),
                                        n_samples=1000, seed=42).drop("share")


def _choices(t: Tables):
    return DC.round_robin_choices(t.rewards).unionByName(DC.follow_the_leader_choices(t.rewards))


@query("W5_policy_replay")
def _w5(t: Tables):
    return DC.policy_replay(t.rewards, _choices(t))


@query("M13_policy_summary")
def _m13(t: Tables):
    return DC.policy_summary(t.rewards, _choices(t))


@query("A37_arm_pull_counts")
def _a37(t: Tables):
    return DC.arm_pull_counts(_choices(t), t.rewards)


@query("U2_recommendation_log")
def _u2(t: Tables):
    """The bids, the shifts between campaigns and those between segments."""
    return DC.recommendation_log(_bids(t), DC.budget_shifts(_allocation(t)), DC.budget_shifts(_segment_allocation(t)))


def _channel_allocation(t: Tables):
    first, last, days = _period(t)
    return DC.budget_allocation(R.channel_summary(t.daily, t.campaigns, first, last), days=days)


@query("M12_channel_allocation")
def _m12c(t: Tables):
    return _channel_allocation(t)


@query("M12_channel_shifts")
def _m12cs(t: Tables):
    return DC.budget_shifts(_channel_allocation(t))


def _segment_allocation(t: Tables):
    first, last, days = _period(t)
    return DC.budget_allocation(R.segment_summary(t.daily, t.campaigns, first, last), days=days)


@query("M12_segment_allocation")
def _m12g(t: Tables):
    return _segment_allocation(t)


@query("M12_segment_shifts")
def _m12gs(t: Tables):
    return DC.budget_shifts(_segment_allocation(t))


def _recommended(t: Tables):
    return DC.recommendation_log(_bids(t), DC.budget_shifts(_segment_allocation(t)))


# ── Phase 5: forecast ────────────────────────────────────────────────
from adlens.operators import forecast as FC  # noqa: E402

_SERIES_KEYS = ["series", "metric"]


def _linear(t: Tables):
    return FC.linear_weekly(t.series, _SERIES_KEYS)


@query("U3_metric_series")
def _u3(t: Tables):
    return FC.metric_series(t.daily)


@query("M1_linear_forecast")
def _m1(t: Tables):
    return _linear(t)["forecast"]


@query("M1_linear_backtest")
def _m1b(t: Tables):
    return _linear(t)["backtest"]


@query("A20_forecast_evaluation")
def _a20(t: Tables):
    return _linear(t)["evaluation"]


@query("A19_weekly_profile")
def _a19(t: Tables):
    return _linear(t)["weekly"]


@query("A19_trend_direction")
def _a19t(t: Tables):
    return _linear(t)["trend"]


@query("M1_rejected_series")
def _m1r(t: Tables):
    return FC.rejected_series(FC.metric_series(t.daily), ["campaign_id", "metric"])


def _with_trend(t: Tables):
    """The long series beside the mean interest of their keywords (matched by the series' name)."""
    named = t.series.select(F.col("series").alias("campaign_id"), F.col("series").alias("campaign_name")).distinct()
    kw = FC.match_trend_keywords(named, t.trends).withColumnRenamed("campaign_id", "series")
    return FC.with_trend_regressor(t.series, kw, t.trends, _SERIES_KEYS)


def _regressed(t: Tables):
    return FC.linear_weekly(_with_trend(t).where("not is_forecast"), _SERIES_KEYS, regressors=["search_trend"])


@query("M1_regressor_forecast")
def _m1x(t: Tables):
    return _regressed(t)["forecast"]


@query("M1_regressor_backtest")
def _m1xb(t: Tables):
    return _regressed(t)["backtest"]


@query("M1_holt_winters")
def _m1hw(t: Tables):
    return FC.holt_winters(t.series, _SERIES_KEYS)["forecast"]


@query("M1_holt_winters_backtest")
def _m1hwb(t: Tables):
    return FC.holt_winters(t.series, _SERIES_KEYS)["backtest"]


@query("A20_holt_winters_evaluation")
def _a20hw(t: Tables):
    return FC.holt_winters(t.series, _SERIES_KEYS)["evaluation"]


PRODUCTS = ("Gaming Laptop", "Headphones", "4K Monitor", "Laptop and Monitor", "Chairs", "Earbuds")


def _named(t: Tables):
    """Campaigns named after products, and the trends of these products."""
    products = F.array(*[F.lit(x) for x in PRODUCTS])
    name = F.concat("campaign_name", F.lit(" "), F.element_at(products, (F.col("campaign_id") % len(PRODUCTS) + 1).cast("int")))
    keyword = F.coalesce(*[F.when(F.col("keyword") == k, F.lit(v)) for k, v in (
        ("view", "laptop"), ("click", "headphones"), ("purchase", "computer monitor"))], F.col("keyword"))
    return t.campaigns.withColumn("campaign_name", name), t.trends.withColumn("keyword", keyword)


@query("J7_trend_keywords")
def _j7(t: Tables):
    return FC.match_trend_keywords(*_named(t))


@query("J5_trend_regressor")
def _j5(t: Tables):
    camps, trends = _named(t)
    return FC.with_trend_regressor(t.daily.select("campaign_id", "date", "clicks"),
                                   FC.match_trend_keywords(camps, trends), trends)


# ── Phase 6: learn (click-through) and ad-copy text ──────────────────
from adlens.operators import learn as L  # noqa: E402
from adlens.operators import text as TX  # noqa: E402
from adlens.session import shared_path  # noqa: E402

CLICK_KEYS = ["l_orderkey", "l_linenumber"]
CLICK_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]
CLICK_CAT = ["p_brand", "p_type", "p_name", "l_linestatus"]


def _split(t: Tables):
    return L.stratified_split(t.clicks, "label", CLICK_KEYS, seed=42)


@query("M3_stratified_split")
def _m3(t: Tables):
    return _split(t).select(*CLICK_KEYS, "label", "split")


def _vocab(t: Tables, split=None):
    s = split if split is not None else _split(t)
    return L.fit_vocabulary(s.where(F.col("split") == "train"), CLICK_CAT)


@query("A21_vocabulary")
def _a21(t: Tables):
    return _vocab(t)


@query("M2_transform")
def _m2(t: Tables):
    s = _split(t)
    x = L.transform(s, _vocab(t, s), CLICK_NUM, CLICK_CAT, keep=CLICK_KEYS + ["label", "split"])
    # numerics rounded to 9 places: the SQL oracle has ln(1 + x), not log1p
    return x.select(*[round_half_up(c, 9).alias(c) if c in CLICK_NUM else F.col(c) for c in x.columns])


def _click_log(t: Tables, sample_size: int | None = None):
    """Write the click log as headerless TSV to the shared folder, read it back."""
    from pyspark.sql import types as TT
    cols = ["label"] + CLICK_NUM + CLICK_CAT
    path = shared_path(t.spark, "click_log_tsv_" + "".join(ch if ch.isalnum() else "_" for ch in t.sf_dir))
    t.clicks.select(*cols).write.mode("overwrite").option("sep", "\t").option("nullValue", "") \
        .option("header", False).csv(path)
    schema = TT.StructType([TT.StructField("label", TT.IntegerType())]
                           + [TT.StructField(c, TT.DoubleType()) for c in CLICK_NUM]
                           + [TT.StructField(c, TT.StringType()) for c in CLICK_CAT])
    return L.read_click_log(t.spark, path, sample_size=sample_size, schema=schema)


@query("S2_read_click_log")
def _s2(t: Tables):
    return _click_log(t)


@query("S2_sampled_click_log")
def _s2s(t: Tables):
    """An exact sample of 20,000 rows of the written log (a sampling operator)."""
    return _click_log(t, 20_000)


@query("A22_binary_metrics")
def _a22(t: Tables):
    return L.binary_metrics(t.scored)


@query("A23_calibration")
def _a23(t: Tables):
    return L.calibration(t.scored)


def _stored_split(t: Tables):
    """The split written to the shared folder once: training and scoring scan it many times, and
    neither join nor rank selection is repeated."""
    path = shared_path(t.spark, f"click_split_{_tag(t)}")
    _split(t).write.parquet(path)
    return t.spark.read.parquet(path)


def _gbt(t: Tables):
    """The click model and its transformed rows, trained anew by each query that uses it."""
    s = _stored_split(t)
    x = L.transform(s, _vocab(t, s), CLICK_NUM, CLICK_CAT, keep=CLICK_KEYS + ["label", "split"])
    return L.train_gbt(x.where(F.col("split") != "test"), CLICK_NUM + CLICK_CAT), x


def _tested(model, x):
    """Scores of the test rows, stored: evaluations read them several times."""
    return L.score(model, x.where(F.col("split") == "test"), CLICK_KEYS + ["label"]).checkpoint(eager=True)


@query("M4_ctr_predictions")
def _m4(t: Tables):
    model, x = _gbt(t)
    return L.score(model, x.where(F.col("split") == "test"), CLICK_KEYS + ["label"])


def _hashed(t: Tables):
    """The wide-log model (hashed features, no vocabulary) and its rows."""
    x = L.log_numbers(_stored_split(t), CLICK_NUM)
    return L.train_hashed_logistic(x.where(F.col("split") != "test"), CLICK_NUM + CLICK_CAT), x


@query("M4_hashed_predictions")
def _m4h(t: Tables):
    model, x = _hashed(t)
    return L.score(model, x.where(F.col("split") == "test"), CLICK_KEYS + ["label"])


@query("M5_ctr_evaluation")
def _m5(t: Tables):
    model, x = _gbt(t)
    return L.evaluation_report(_tested(model, x), L.feature_importance(model, CLICK_NUM + CLICK_CAT))


@query("M5_model_comparison")
def _m5c(t: Tables):
    """The trees beside the hashed logistic model, on the same test rows."""
    parts = [L.binary_metrics(_tested(*made(t))).withColumn("model", F.lit(name)) for name, made in (("trees", _gbt), ("hashed", _hashed))]
    return parts[0].unionByName(parts[1])


@query("M5_model_checks")
def _m5i(t: Tables):
    """What must hold for any trained model, as rows (item, value): the test rows are all scored, in
    [0, 1], by the trees, by the model read back from storage alike, and by the hashed model;
    importances are not negative and add up to 1; calibration bins hold all rows."""
    model, x = _gbt(t)
    path = shared_path(t.spark, f"ctr_model_{_tag(t)}")
    SK.save_model(model, path, {"features": CLICK_NUM + CLICK_CAT})
    scored = _tested(model, x)
    again = _tested(SK.load_model(path), x)
    differing = scored.exceptAll(again).unionByName(again.exceptAll(scored))     # rows share keys: compared as bags
    hashed = _tested(*_hashed(t))
    imp = L.feature_importance(model, CLICK_NUM + CLICK_CAT)
    count = lambda df, **c: df.agg(*[F.coalesce(x.cast("double"), F.lit(0.0)).alias(k.replace("_", " ")) for k, x in c.items()])
    inside = F.count_if(F.col("score").between(0.0, 1.0))
    parts = [count(scored, tree_rows=F.count(F.lit(1)), tree_scores_in_range=inside),
             count(differing, loaded_model_differs=F.count(F.lit(1))),
             count(hashed, hashed_rows=F.count(F.lit(1)), hashed_scores_in_range=inside),
             count(imp, features=F.count(F.lit(1)), negative_importances=F.count_if(F.col("importance") < 0),
                   importance_total=F.round(F.sum("importance"), 3)),
             count(L.calibration(scored), rows_in_calibration_bins=F.sum("n"))]
    long = [p.unpivot([], p.columns, "item", "value") for p in parts]
    out = long[0]
    for p in long[1:]:
        out = out.unionByName(p)
    return out


@query("A24_feature_importance")
def _a24(t: Tables):
    model, _ = _gbt(t)
    return L.feature_importance(model, CLICK_NUM + CLICK_CAT)


def _tfidf(t: Tables):
    return TX.tfidf(t.ads)


@query("M6_tfidf_weights")
def _m6(t: Tables):
    w = _tfidf(t)["weights"]
    return w.select("doc_id", "term", round_half_up("weight", 9).alias("weight"))


@query("M6_vocabulary")
def _m6v(t: Tables):
    return _tfidf(t)["vocabulary"]


def _by_category(t: Tables):
    return t.ads.select(F.col("ad_id").alias("doc_id"), "category")


@query("A25_mean_tfidf_per_group")
def _a25(t: Tables):
    m = TX.mean_tfidf_per_group(_tfidf(t)["weights"], _by_category(t), "category")
    return m.select("category", "term", round_half_up("mean_weight", 9).alias("mean_weight"))


@query("A26_group_sizes")
def _a26(t: Tables):
    return TX.group_sizes(_by_category(t), "category")


def _tops(t: Tables):
    return TX.top_terms(TX.mean_tfidf_per_group(_tfidf(t)["weights"], _by_category(t), "category"), "category")


@query("T3_top_terms")
def _t3(t: Tables):
    return _tops(t)


@query("J11_label_scores")
def _j11(t: Tables):
    return TX.label_scores(_tops(t), "category")


def _group_labels(t: Tables, tops):
    return TX.assign_labels(TX.label_scores(tops, "category"), t.ads.select("category"), "category")


@query("M9_group_labels")
def _m9(t: Tables):
    return _group_labels(t, _tops(t))


def _group_summary(t: Tables):
    tops = _tops(t).checkpoint(eager=True)  # one row per group, used twice
    sizes = TX.group_sizes(_by_category(t), "category")
    return sizes.join(tops, "category", "left").join(_group_labels(t, tops), "category")


@query("M9_group_summary")
def _m9g(t: Tables):
    return _group_summary(t)


@query("A10_crosstab")
def _a10(t: Tables):
    return TX.crosstab(t.ads, "advertiser_name", "platform")


@query("A11_dominant")
def _a11(t: Tables):
    return TX.dominant(t.ads, "advertiser_name", "platform")


def _analysis(t: Tables):
    return TX.analyze_ads(t.ads, k=5, restarts=10, seed=42)


@query("M7_kmeans_clusters")
def _m7(t: Tables):
    return _analysis(t)["ads"].select("ad_id", "advertiser_name", "cluster", "cluster_label")


@query("M8_projection")
def _m8(t: Tables):
    got = _analysis(t)
    first, second = (F.lit(v) for v in got["explained_variance"])
    return got["ads"].select("ad_id", "x", "y", first.alias("explained_x"), second.alias("explained_y"))


@query("M9_cluster_summary")
def _m9c(t: Tables):
    return _analysis(t)["clusters"]


@query("A10_strategy_matrix")
def _a10s(t: Tables):
    return _analysis(t)["strategy_matrix"]


# ── Phase 3: ingest, sinks ───────────────────────────────────────────
from adlens.functions.formatting import strip_code_fence  # noqa: E402
from adlens.sources import ingest as IN  # noqa: E402
from adlens.sources import sinks as SK  # noqa: E402

BAD_DAY, CLAMPED_DAY = "2024-01-05", "2024-02-05"
LATE_COPY_FROM = "2024-01-25"   # rows from this day appear again later in the upload


def _tag(t: Tables) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in t.sf_dir)


def _google_upload(t: Tables):
    """A Google Ads export of the daily metrics written by Spark, followed by a
    second copy of the last days with doubled revenue (last row must win)."""
    d = t.daily.join(t.campaigns.select("campaign_id", "campaign_name"), "campaign_id")

    def export(x):
        return x.select(
            F.col("campaign_name").alias("Campaign"), F.col("campaign_id").cast("string").alias("Campaign ID"),
            F.date_format("date", "yyyy-MM-dd").alias("Day"),
            F.col("impressions").cast("string").alias("Impressions"), F.col("clicks").cast("string").alias("Clicks"),
            F.col("spend").cast("string").alias("Cost"), F.col("conversions").cast("string").alias("Conversions"),
            F.col("revenue").cast("string").alias("Conv. value"),
            F.concat(F.format_string("%.2f", F.col("ctr") * 100), F.lit("%")).alias("CTR"))
    late = d.where(F.col("date") >= F.lit(LATE_COPY_FROM).cast("date")).withColumn("revenue", F.col("revenue") * 2)
    path = shared_path(t.spark, f"upload_google_{_tag(t)}")
    export(d).unionByName(export(late)).write.option("header", True).csv(f"{path}/part=1")
    # a last file whose rows are bad in turn: id, date, count, amount; or a clamped one that loads
    bad = export(d.where(F.col("date") == F.lit(BAD_DAY).cast("date"))).withColumn("_k", F.col("Campaign ID").cast("bigint") % 5)
    bad = bad.select(
        "Campaign", F.when(F.col("_k") == 0, F.lit(" ")).otherwise(F.col("Campaign ID")).alias("Campaign ID"),
        F.when(F.col("_k") == 1, F.lit("someday")).otherwise(F.lit(CLAMPED_DAY)).alias("Day"),
        F.when(F.col("_k") == 2, F.lit("many")).otherwise(F.col("Impressions")).alias("Impressions"), "Clicks",
        F.when(F.col("_k") == 3, F.lit("inf")).otherwise(F.concat(F.lit("-1"), F.col("Cost"))).alias("Cost"), "Conversions",
        "`Conv. value`", "CTR", F.col("Campaign ID").cast("bigint").alias("_id"))
    bad.repartition(1).sortWithinPartitions("_id").drop("_id").write.option("header", True).csv(f"{path}/part=2")
    return IN.read_upload(t.spark, [f"{path}/part=1", f"{path}/part=2"])


def _ingested(t: Tables):
    camps = t.campaigns.withColumn("campaign_id", F.col("campaign_id").cast("string"))
    target = t.daily.withColumn("campaign_id", F.col("campaign_id").cast("string")).where(
        F.col("date") < F.lit("2024-01-16").cast("date"))
    # rows of the year before are in no upload: they stay
    target = target.unionByName(target.withColumn("date", F.add_months("date", -12)))
    return {**IN.ingest(t.spark, _google_upload(t), target, camps), "target": target}


GOOD_COLS = ["campaign_id", "date", "impressions", "clicks", "conversions", "spend", "revenue",
             "ctr", "cpc", "roas", "campaign_name", "platform", "daily_budget"]


@query("S5_validate_upload")
def _s5(t: Tables):
    return IN.good_rows(_ingested(t)["validated"]).select(*GOOD_COLS)


METRIC_COLS = ["campaign_id", "date", "impressions", "clicks", "conversions", "spend", "revenue", "ctr", "cpc", "roas"]


def _store(t: Tables) -> SK.Store:
    """A database of its own per call, below the shared folder."""
    folder = shared_path(t.spark, "store")
    return SK.Store(t.spark, folder, "adlens_" + folder.rpartition("_")[2])


@query("S6_upsert_metrics")
def _s6(t: Tables):
    """The upload merged into a stored table, which is read and replaced."""
    store, got = _store(t), _ingested(t)
    store.replace("daily_metrics", got["target"])
    return store.upsert("daily_metrics", IN.good_rows(got["validated"]), ["campaign_id", "date"], "_row_idx").select(*METRIC_COLS)


@query("S7_upsert_campaigns")
def _s7(t: Tables):
    return _ingested(t)["campaigns"]


@query("S8_ingestion_report")
def _s8(t: Tables):
    return _ingested(t)["report"]


def _competitor_upload(t: Tables, version: int = 1):
    a = t.ads
    return a.select(F.col("advertiser_name").alias(" Brand "), F.col("ad_copy").alias("text"),
                    (F.col("headline") if version == 1 else F.concat(F.col("headline"), F.lit(" v2"))).alias("Title"),
                    F.upper(F.col("platform")).alias("channel"), F.col("category").alias("vertical"),
                    F.upper(F.col("spend_tier")).alias("budget_tier"),
                    *([F.lit("Buy now").alias("call_to_action")] if version == 2 else []))


@query("S9_competitor_ingest")
def _s9(t: Tables):
    return IN.ingest_competitor_ads(_competitor_upload(t, 1), seen="2024-01-31")


@query("S10_competitor_upsert")
def _s10(t: Tables):
    # some ads are in the first upload only, some in the second only
    first = IN.ingest_competitor_ads(_competitor_upload(t, 1).where("vertical <> '1'"), seen="2024-01-31")
    second = IN.ingest_competitor_ads(_competitor_upload(t, 2).where("vertical <> '2'"), seen="2024-02-01")
    return IN.upsert_competitor_ads(first, second)


@query("S11_trends_wide_to_long")
def _s11(t: Tables):
    wide = t.trends.groupBy("date").pivot("keyword").agg(F.first("interest"))
    return IN.trends_wide_to_long(wide.withColumn("isPartial", F.lit(False)))


@query("S12_upsert_trends")
def _s12(t: Tables):
    tr = t.trends
    target = tr.where(F.col("date") < F.lit("2024-01-20").cast("date"))
    # the batch has another interest for the days that both have, and each key twice: the last row counts
    batch = tr.where(F.col("date") >= F.lit("2024-01-15").cast("date")).select(
        "keyword", "date", "interest", F.explode(F.array(F.lit(1), F.lit(2))).alias("_row_idx")).withColumn(
        "interest", F.col("interest") + F.col("_row_idx"))
    return IN.upsert_last_wins(target, batch, ["keyword", "date"])


@query("S13_store_forecasts")
def _s13(t: Tables):
    series = FC.metric_series(t.daily)
    fc = FC.linear_weekly(series, ["campaign_id", "metric"])["forecast"]
    return SK.store_forecasts(t.forecasts, fc)


def _log(t: Tables):
    """An older entry per campaign, all by default values, then the recommendations of the day."""
    none = F.lit(None).cast("string")
    old = t.campaigns.select("campaign_id", none.alias("action_type"), none.alias("action_detail"), none.alias("reasoning"),
                             none.alias("confidence"))
    log = SK.store_recommendations(None, old, created_at="2024-01-15 00:00:00")
    return SK.store_recommendations(log, _recommended(t), created_at="2024-01-31 00:00:00")


@query("S14_store_recommendations")
def _s14(t: Tables):
    return _log(t)


@query("T2_recent_recommendations")
def _t2(t: Tables):
    camps = t.campaigns.withColumn("campaign_id", F.col("campaign_id").cast("string"))
    return R.recent_recommendations(_log(t), camps, 20)


@query("S15_truncate")
def _s15(t: Tables):
    """All seven tables written, five of them reset, and all read back."""
    store = _store(t)
    text = F.col("campaign_id").cast("string").alias("campaign_id")
    store.replace("campaigns", t.campaigns.select(text, "campaign_name", "platform"))
    store.replace("daily_metrics", t.daily.withColumn("campaign_id", text))
    store.replace("forecasts", t.all_forecasts.withColumn("campaign_id", text))
    store.append("recommendations", SK.store_recommendations(None, t.campaigns.select(
        "campaign_id", *[F.lit(None).cast("string").alias(c) for c in ("action_type", "action_detail", "reasoning", "confidence")])))
    store.replace("search_trends", t.trends)
    store.replace("competitor_ads", t.ads.withColumn("ad_id", F.col("ad_id").cast("string")).where("ad_copy is not null"))
    store.replace("competitor_clusters", t.ads.groupBy(F.col("category").cast("bigint").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n_ads")).select("cluster_id", "n_ads", F.lit("Other").alias("cluster_label"), F.array(
            F.lit("x")).alias("top_terms"), F.lit("2024-01-31").cast("date").alias("analysis_date")))
    before = t.spark.createDataFrame(store.counts().collect(), "table_name string, rows_before bigint")
    store.reset()
    return before.join(store.counts().withColumnRenamed("n_rows", "rows_after"), "table_name")


@query("S16_store_cluster_results")
def _s16(t: Tables):
    """Two stored snapshots, of which the later is partly older: its groups are replaced,
    those that are gone and the earlier snapshot stay."""
    store = _store(t)
    groups = t.ads.select("category").distinct().select(F.col("category").cast("bigint").alias("cluster_id"))
    stale = groups.select("cluster_id", F.lit("Stale").alias("label"), F.array(F.lit("old")).alias("top_terms"), F.lit(1).alias("n_ads"))
    gone = stale.withColumn("cluster_id", F.col("cluster_id") + 100)
    store.append("competitor_clusters", SK.store_cluster_results(None, stale, "2024-01-30"))
    store.append("competitor_clusters", SK.store_cluster_results(None, stale.where("cluster_id % 2 = 0").unionByName(gone), "2024-01-31"))
    new = SK.store_cluster_results(None, _group_summary(t).withColumnRenamed("category", "cluster_id"), "2024-01-31")
    return store.upsert("competitor_clusters", new, ["cluster_id", "analysis_date"]).drop("created_at")


@query("S17_export_csv")
def _s17(t: Tables):
    from pyspark.sql import types as TT
    path = shared_path(t.spark, f"export_csv_{_tag(t)}")
    SK.export_metrics_csv(t.daily, t.campaigns, path)
    schema = TT.StructType([
        TT.StructField("campaign_id", TT.LongType()), TT.StructField("date", TT.DateType()),
        TT.StructField("impressions", TT.LongType()), TT.StructField("clicks", TT.LongType()),
        TT.StructField("conversions", TT.LongType()), TT.StructField("spend", TT.DoubleType()),
        TT.StructField("revenue", TT.DoubleType()), TT.StructField("campaign_name", TT.StringType()),
        TT.StructField("platform", TT.StringType())])
    return t.spark.read.option("header", True).schema(schema).csv(path)


@query("S18_json_roundtrip")
def _s18(t: Tables):
    path = shared_path(t.spark, f"allocation_json_{_tag(t)}")
    alloc = _allocation(t)
    SK.write_json(alloc, path)
    return SK.read_json(t.spark, path, schema=alloc.schema)


@query("S19_model_roundtrip")
def _s19(t: Tables):
    model, x = _gbt(t)
    path = shared_path(t.spark, f"ctr_model_{_tag(t)}")
    SK.save_model(model, path, {"features": CLICK_NUM + CLICK_CAT})
    loaded = SK.load_model(path)
    return L.score(loaded, x.where(F.col("split") == "test"), CLICK_KEYS + ["label"])


@query("S21_preview")
def _s21(t: Tables):
    return IN.preview(t.campaigns.orderBy("campaign_id"), 5)


@query("F8_parse_replies")
def _f8(t: Tables):
    r = t.replies
    parsed = F.from_json(strip_code_fence("text"), "k INT", {"mode": "PERMISSIVE"})
    return r.select("reply_id", parsed["k"].alias("k"))


# ── Streaming ────────────────────────────────────────────────────────
from adlens.streaming import daily_stream as ST  # noqa: E402


@query("STREAM_daily_metrics")
def _stream_daily(t: Tables):
    """The daily fact table built by a watermarked streaming aggregation."""
    import uuid
    run = shared_path(t.spark, f"stream_daily_{_tag(t)}_{uuid.uuid4().hex[:8]}")
    return ST.run_daily_metrics(t.spark, f"{t.sf_dir}/event[s].parquet", f"{run}/table", f"{run}/checkpoint")


# ── Remaining small operators ────────────────────────────────────────
from adlens.functions import formatting as FMT  # noqa: E402


@query("P6_has_rows")
def _p6(t: Tables):
    """Has-rows probes as LIMIT 1 scalar subqueries (never a full count)."""
    def probe(df):
        return df.select(F.lit(1).alias("x")).limit(1).select(F.count(F.lit(1)) > 0).scalar()
    return t.spark.range(1).select(probe(t.daily).alias("has_metrics"), probe(t.forecasts).alias("has_forecasts"),
                                   probe(t.ads).alias("has_ads"))


@query("P9_single_or_portfolio")
def _p9(t: Tables):
    one = R.portfolio_or_single(t.forecasts, 7).withColumn("scope", F.lit("single"))
    unknown = R.portfolio_or_single(t.forecasts, -1).withColumn("scope", F.lit("unknown"))
    return one.unionByName(unknown)


@query("T5_priority_order")
def _t5(t: Tables):
    top = DC.top_bid_rows(_bids(t), 8)
    # bid rows without a priority sort after the numbered ones
    rest = _bids(t).join(top.select("campaign_id"), "campaign_id", "left_anti").withColumn(
        "priority", F.lit(None).cast("int"))
    return T.order_by_priority(top.unionByName(rest)).select("campaign_id", "priority")


@query("T6_numeric_arm_order")
def _t6(t: Tables):
    g = DC.bid_response_grid(T.recent_base_metrics(t.daily))
    per = g.groupBy(F.col("bid_multiplier").cast("string").alias("arm")).agg(
        F.count(F.lit(1)).alias("n_campaigns"),
        round_half_up(F.count_if(F.col("exp_profit") > 0).cast("double") / F.count(F.lit(1)), 4).alias("share_profitable"))
    return T.order_numeric_text(per, "arm")


@query("F3_parse_multiple")
def _f3(t: Tables):
    s = R.campaign_summary(t.daily, t.campaigns, *_period(t)[:2])
    txt = s.select("campaign_id", FMT.multiple("roas", 1).alias("roas_text"))
    return txt.select("campaign_id", "roas_text", FMT.parse_multiple("roas_text").alias("roas_value"))


@query("F6_join_top_terms")
def _f6(t: Tables):
    return _tops(t).select("category", FMT.join_first("top_terms", 3).alias("top_3"))


@query("P8_optional_filters")
def _p8(t: Tables):
    """A category and a tier are chosen; "All", an empty text and None choose nothing."""
    return R.filter_optional(t.ads.select("ad_id", "advertiser_name", "platform", "category", "spend_tier"),
                             category="3", spend_tier="low", platform="All", advertiser_name="", ad_id=None)


@query("F2_campaign_labels")
def _f2(t: Tables):
    """Chart labels: platform capitalised, segment in title case, name without its platform."""
    c = t.campaigns
    prefix = F.when(F.col("campaign_id") % 3 == 0, F.lit("Google - ")).when(F.col("campaign_id") % 3 == 1, F.lit("Meta - ")).otherwise("")
    return c.select("campaign_id", FMT.capitalize("platform").alias("platform_label"),
                    FMT.title_case(F.concat_ws(" ", F.lower("platform"), F.col("status"))).alias("segment_label"),
                    FMT.shorten_name(F.concat(prefix, F.col("campaign_name"))).alias("short_name"))


@query("F10_date_labels")
def _f10(t: Tables):
    """Axis labels of every stored day."""
    return t.daily.select("date").distinct().select(
        "date", FMT.month_day_label("date").alias("label"), FMT.weekday_name("date").alias("weekday"),
        FMT.monday_week_start("date").alias("week_start"))
