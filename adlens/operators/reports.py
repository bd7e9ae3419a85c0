"""Reports over the daily fact table: P1-P9, A1-A9, A27-A30, A35, J1-J4, T1-T2, T7, U4.

All functions are lazy DataFrame plans.  Aggregations run partial/final
(map-side combine), so a campaign holding a third of all rows only adds one
partial row per input partition.  Joins to the campaign dimension happen
*after* aggregating the fact table to one row per campaign (A6) so that the
join input is bounded by the number of campaigns, not the number of days.
Join strategy is left to Catalyst/AQE: the dimension is broadcast only when
its measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.formatting import signed_money_delta, signed_pct
from adlens.functions.ratios import count_sum, money_sum, ratio_case, ratio_null, round_half_up

COUNT_COLS = ("impressions", "clicks", "conversions")
MONEY_COLS = ("spend", "revenue")

# Metric names a caller may ask for; anything else means clicks.
METRIC_ALLOW_LIST = ("clicks", "conversions", "spend", "revenue")


def _d(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, (_dt.date, str)):
        return F.lit(str(x)).cast("date")
    raise TypeError(f"not a date: {x!r}")


# ── P1-P4, P7, P9 ────────────────────────────────────────────────────

def in_range(df: DataFrame, start, end, col: str = "date") -> DataFrame:
    """Inclusive date range."""
    return df.where(F.col(col).between(_d(start), _d(end)))


def filter_optional(df: DataFrame, **equals) -> DataFrame:
    """Conjunctive equality filters; None, "" and "All" mean no filter."""
    conds = [F.col(k) == F.lit(v) for k, v in equals.items() if v not in (None, "", "All")]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def keyword_series(trends: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Trends for an IN-list of keywords (all when empty), sorted."""
    out = trends.where(F.col("keyword").isin(list(keywords))) if keywords else trends
    return out.select("keyword", "date", "interest").orderBy("keyword", "date")


def campaign_series(daily: DataFrame, campaign_id) -> DataFrame:
    """The daily series of one campaign, by date."""
    return daily.where(F.col("campaign_id") == F.lit(campaign_id)).orderBy("date")


def metric_column(metric: str | None) -> str:
    """Allow-listed metric name; unknown names fall back to clicks."""
    return metric if metric in METRIC_ALLOW_LIST else "clicks"


def portfolio_or_single(df: DataFrame, campaign_id=None) -> DataFrame:
    """One campaign when an id is given (unknown id -> empty), else all."""
    return df if campaign_id is None else df.where(F.col("campaign_id") == F.lit(campaign_id))


def has_rows(df: DataFrame) -> bool:
    """A LIMIT 1 probe, never a full count."""
    return not df.isEmpty()


# ── A1-A5 ────────────────────────────────────────────────────────────

def date_range(daily: DataFrame) -> DataFrame:
    """A1: one row (min_date, max_date); NULLs on an empty table."""
    return daily.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def _kpi_measures(cond: Column | None = None, prefix: str = "") -> list[Column]:
    def w(c):
        return F.when(cond, F.col(c)) if cond is not None else F.col(c)
    cid = F.when(cond, F.col("campaign_id")) if cond is not None else F.col("campaign_id")
    return [
        money_sum(w("spend")).alias(f"{prefix}total_spend"),
        money_sum(w("revenue")).alias(f"{prefix}total_revenue"),
        count_sum(w("conversions")).alias(f"{prefix}total_conversions"),
        count_sum(w("clicks")).alias(f"{prefix}total_clicks"),
        count_sum(w("impressions")).alias(f"{prefix}total_impressions"),
        F.count_distinct(cid).alias(f"{prefix}active_campaigns"),
    ]


def _kpi_ratios(prefix: str = "") -> list[Column]:
    p = prefix
    return [
        ratio_case(f"{p}total_revenue", f"{p}total_spend", 2).alias(f"{p}overall_roas"),
        ratio_case(f"{p}total_clicks", f"{p}total_impressions", 4).alias(f"{p}overall_ctr"),
    ]


def kpis(daily: DataFrame, start, end) -> DataFrame:
    """A2: portfolio KPIs for [start, end]; always exactly one row."""
    a = in_range(daily, start, end).agg(*_kpi_measures())
    return a.select("*", *_kpi_ratios())


def kpis_comparison(daily: DataFrame, start, end) -> DataFrame:
    """A3: KPIs for [start, end] and the preceding window of equal length.

    One scan with conditional sums instead of two queries.  The previous
    window is [start - 1 - (end - start), start - 1].  Deltas are NULL when
    the previous value is 0; the ROAS delta uses the already rounded ROAS.
    """
    s, e = _dt.date.fromisoformat(str(start)), _dt.date.fromisoformat(str(end))
    length = (e - s).days
    prev_end = s - _dt.timedelta(days=1)
    prev_start = prev_end - _dt.timedelta(days=length)
    d = in_range(daily, prev_start, e)
    cur = F.col("date").between(_d(s), _d(e))
    prev = F.col("date").between(_d(prev_start), _d(prev_end))
    a = d.agg(*_kpi_measures(cur), *_kpi_measures(prev, "prev_"))
    a = a.select("*", *_kpi_ratios(), *_kpi_ratios("prev_"))
    return a.select(
        F.lit(s).alias("start_date"), F.lit(e).alias("end_date"),
        F.lit(prev_start).alias("prev_start_date"), F.lit(prev_end).alias("prev_end_date"),
        "total_spend", "total_revenue", "total_conversions", "total_clicks",
        "total_impressions", "active_campaigns", "overall_roas", "overall_ctr",
        "prev_total_spend", "prev_total_conversions", "prev_overall_roas",
        F.when(F.col("prev_total_spend") != 0,
               signed_money_delta(F.col("total_spend") - F.col("prev_total_spend"))
               ).alias("spend_delta"),
        F.when(F.col("prev_overall_roas") != 0,
               signed_pct((F.col("overall_roas") - F.col("prev_overall_roas"))
                          / F.col("prev_overall_roas") * 100)).alias("roas_delta"),
        F.when(F.col("prev_total_conversions") != 0,
               signed_pct((F.col("total_conversions") - F.col("prev_total_conversions"))
                          / F.col("prev_total_conversions") * 100)).alias("conversions_delta"),
    )


def daily_spend_by_platform(daily: DataFrame, campaigns: DataFrame, start, end) -> DataFrame:
    """A4 (J1): spend per day and platform; metrics without a campaign drop out."""
    d = in_range(daily, start, end).select("campaign_id", "date", "spend")
    j = d.join(campaigns.select("campaign_id", "platform"), "campaign_id")
    return (j.groupBy("date", "platform").agg(money_sum("spend").alias("spend"))
            .orderBy("date", "platform"))


def daily_roas(daily: DataFrame, start, end) -> DataFrame:
    """A5: spend, revenue and rule-(c) ROAS (2 dp) per day."""
    a = in_range(daily, start, end).groupBy("date").agg(
        money_sum("spend").alias("spend"), money_sum("revenue").alias("revenue"))
    return a.select("date", "spend", "revenue",
                    ratio_case("revenue", "spend", 2).alias("roas")).orderBy("date")


# ── A6 (J1) ──────────────────────────────────────────────────────────

def campaign_summary(daily: DataFrame, campaigns: DataFrame, start, end) -> DataFrame:
    """Per-campaign performance, highest spend first.

    Deviation D2: grouped by id, name and platform (the name alone is not a
    key).  The fact table is aggregated to one row per campaign *before* the
    inner join, so orphan metrics vanish and the join input is small.
    """
    per = in_range(daily, start, end).groupBy("campaign_id").agg(
        count_sum("impressions").alias("impressions"),
        count_sum("clicks").alias("clicks"),
        money_sum("spend").alias("spend"),
        count_sum("conversions").alias("conversions"),
        money_sum("revenue").alias("revenue"),
    )
    j = per.join(campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id")
    return j.select(
        "campaign_id", "campaign_name", "platform", "impressions", "clicks",
        ratio_null("clicks", "impressions", 4).alias("ctr"),
        "spend",
        ratio_null("spend", "clicks", 2).alias("avg_cpc"),
        "conversions",
        ratio_null("conversions", "clicks", 4).alias("conv_rate"),
        "revenue",
        ratio_null("revenue", "spend", 2).alias("roas"),
    ).orderBy(F.desc("spend"), "campaign_id")


# ── A7 (J2), J4, A8, A9 ──────────────────────────────────────────────

def forecast_summary(forecasts: DataFrame, campaigns: DataFrame) -> DataFrame:
    """A7 (J2): stored-forecast summary per campaign x metric, with the time of the
    newest row (NULL when the rows carry none)."""
    made = F.col("created_at") if "created_at" in forecasts.columns else F.lit(None).cast("timestamp_ntz")
    f = forecasts.groupBy("campaign_id", "metric").agg(
        F.count("*").alias("forecast_days"),
        F.min("forecast_date").alias("first_date"),
        F.max("forecast_date").alias("last_date"),
        F.sum("predicted_value").alias("_sum_pred"),
        F.max(made).alias("generated_at"),
    )
    j = f.join(campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id")
    return j.select(
        "campaign_id", "campaign_name", "platform", "metric", "forecast_days",
        "first_date", "last_date",
        round_half_up(F.col("_sum_pred") / F.col("forecast_days"), 1).alias("avg_predicted"),
        "generated_at",
    ).orderBy("platform", "campaign_name", "metric")


def forecast_vs_actual(forecasts: DataFrame, daily: DataFrame, metric: str = "clicks") -> DataFrame:
    """Stored forecasts joined to actuals on (campaign, date); P7 allow-list."""
    m = metric_column(metric)
    f = forecasts.where(F.col("metric") == m).select(
        "campaign_id", F.col("forecast_date").alias("date"),
        "predicted_value", "lower_bound", "upper_bound")
    a = daily.select("campaign_id", "date", F.col(m).cast("double").alias("actual_value"))
    return f.join(a, ["campaign_id", "date"]).orderBy("date", "campaign_id")


def platform_share(daily: DataFrame, campaigns: DataFrame, start, end) -> DataFrame:
    """Spend per platform and its percent of the total.

    The fact rows are reduced to one row per platform first; only that small
    result meets the ``over ()`` window that computes the total.
    """
    d = in_range(daily, start, end).groupBy("campaign_id").agg(money_sum("spend").alias("spend"))
    per = (d.join(campaigns.select("campaign_id", "platform"), "campaign_id")
           .groupBy("platform").agg(money_sum("spend").alias("spend")))
    total = F.sum(F.col("spend").cast("decimal(18,2)")).over(Window.partitionBy()).cast("double")
    return per.select("*", total.alias("_total")).select(
        F.initcap(F.lower("platform")).alias("platform_label"), "platform", "spend",
        F.when(F.col("_total") > 0, round_half_up(F.col("spend") / F.col("_total") * 100, 4))
         .otherwise(F.lit(0.0)).alias("share_pct"),
    )


def ad_counts(ads: DataFrame, approx: bool = False) -> DataFrame:
    """Number of ads, advertisers, platforms and categories."""
    cd = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return ads.agg(
        F.count("*").alias("n_ads"),
        cd("advertiser_name").alias("n_advertisers"),
        cd("platform").alias("n_platforms"),
        cd("category").alias("n_categories"),
    )


# ── A27-A30, A35, T1, T2, T7, U4 ─────────────────────────────────────

def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One (table_name, n_rows) row per table, as a union of counts."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def latest_snapshot(df: DataFrame, date_col: str, order_by: str | None = None) -> DataFrame:
    """Rows whose ``date_col`` equals the table's maximum (scalar subquery)."""
    mx = df.agg(F.max(date_col).alias("_max"))
    out = df.join(mx, F.col(date_col) == F.col("_max")).drop("_max")
    return out.orderBy(order_by) if order_by else out


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of one column."""
    return df.select(col).distinct().orderBy(col)


def click_log_summary(clicks: DataFrame) -> DataFrame:
    """Rows, positives and the positive rate of a click log."""
    return clicks.agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("label").cast("bigint")).alias("n_clicks"),
        round_half_up(F.sum(F.col("label").cast("bigint")) / F.count("*"), 6).alias("click_rate"),
    )


def axis_range(pairs: DataFrame, a: str = "actual_value", b: str = "predicted_value",
               pad: float = 0.05) -> DataFrame:
    """[min - 5 %, max + 5 %] over two columns (predicted-vs-actual chart)."""
    r = pairs.agg(F.least(F.min(a), F.min(b)).alias("lo"), F.greatest(F.max(a), F.max(b)).alias("hi"))
    p = (F.col("hi") - F.col("lo")) * F.lit(pad)
    return r.select((F.col("lo") - p).alias("range_low"), (F.col("hi") + p).alias("range_high"))


def sorted_campaigns(campaigns: DataFrame) -> DataFrame:
    """Campaigns by platform, then name."""
    return campaigns.orderBy("platform", "campaign_name", "campaign_id")


def ads_by_recency(ads: DataFrame) -> DataFrame:
    """Competitor ads, most recently seen first."""
    return ads.orderBy(F.desc("last_seen"), "ad_id")


def first_distinct(df: DataFrame, col: str, n: int) -> DataFrame:
    """The first n distinct values (an explicit order; the reference had none)."""
    return df.select(col).distinct().orderBy(col).limit(n)


def recent_recommendations(recs: DataFrame, campaigns: DataFrame, n: int = 20) -> DataFrame:
    """T2 (J3): newest n recommendations, left-joined to campaign names
    (orphans keep a NULL name).  Ties on the time go by id, type and detail."""
    j = recs.join(campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id", "left")
    return j.orderBy(F.desc("created_at"), "campaign_id", "action_type", "action_detail").limit(n)


def channel_summary(daily: DataFrame, campaigns: DataFrame, start, end) -> DataFrame:
    """A6 at channel grain: one row per platform, keyed like a campaign row
    (campaign_id = campaign_name = platform) so the allocator (M12) can move
    budget across channels."""
    per = in_range(daily, start, end).groupBy("campaign_id").agg(
        money_sum("spend").alias("spend"), money_sum("revenue").alias("revenue"))
    j = per.join(campaigns.select("campaign_id", "platform"), "campaign_id")
    ch = j.groupBy("platform").agg(money_sum("spend").alias("spend"), money_sum("revenue").alias("revenue"))
    return ch.select(F.col("platform").alias("campaign_id"), F.col("platform").alias("campaign_name"),
                     "spend", "revenue", ratio_null("revenue", "spend", 2).alias("roas"))


def segment_summary(daily: DataFrame, campaigns: DataFrame, start, end) -> DataFrame:
    """A6 at segment grain: platform and spend tier of the campaign (whole powers of e), keyed
    like a campaign row, so that the allocator can move budget between small and large spenders."""
    per = in_range(daily, start, end).groupBy("campaign_id").agg(
        money_sum("spend").alias("spend"), money_sum("revenue").alias("revenue"))
    tier = F.floor(F.ln(F.greatest(F.col("spend"), F.lit(1.0)))).cast("string")
    j = per.join(campaigns.select("campaign_id", "platform"), "campaign_id").select(
        F.concat(F.col("platform"), F.lit("/"), tier).alias("campaign_id"), "spend", "revenue")
    seg = j.groupBy("campaign_id").agg(money_sum("spend").alias("spend"), money_sum("revenue").alias("revenue"))
    return seg.select("campaign_id", F.col("campaign_id").alias("campaign_name"), "spend", "revenue",
                      ratio_null("revenue", "spend", 2).alias("roas"))
