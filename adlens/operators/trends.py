"""Row-based windows and momentum: W1-W4, W9, W10, A12-A18, T5, T6.

All windows partition by a series key (campaign, keyword, metric).  The
input of these windows is the *daily* grain — at most one row per series per
day — so even a campaign holding a third of all raw events contributes only
one row per day here; a window partition is bounded by the days of history,
not by the event volume.  Windows over the same key and order share one
exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.formatting import (monday_week_start, weekday_index, weekday_name)
from adlens.functions.ratios import MONEY, round_half_up, safe_div

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def with_row_from_end(df: DataFrame, key, order: str = "date",
                      name: str = "rn_desc") -> DataFrame:
    """Adds 1 for the newest row of each series, 2 for the one before, ..."""
    w = Window.partitionBy(*_keys(key)).orderBy(F.col(order).desc())
    return df.withColumn(name, F.row_number().over(w))


def last_n_rows(df: DataFrame, key, n: int, order: str = "date") -> DataFrame:
    """The last n rows of each series (rows, not calendar days)."""
    return with_row_from_end(df, key, order).where(F.col("rn_desc") <= n).drop("rn_desc")


def rows_slice_from_end(df: DataFrame, key, first: int, last: int, order: str = "date") -> DataFrame:
    """Rows ``first``..``last`` counted from the end (1 = newest)."""
    return (with_row_from_end(df, key, order)
            .where(F.col("rn_desc").between(first, last)).drop("rn_desc"))


def moving_average(df: DataFrame, key, value: str, n: int = 7, order: str = "date",
                   name: str | None = None) -> DataFrame:
    """N-row trailing mean (min 1 row); NULL for series shorter than n rows."""
    k = _keys(key)
    w = Window.partitionBy(*k).orderBy(order).rowsBetween(-(n - 1), 0)
    size = F.count(F.lit(1)).over(Window.partitionBy(*k))
    return df.withColumn(name or f"{value}_ma{n}",
                         F.when(size >= n, F.avg(F.col(value)).over(w)))


def fill_forward_backward(df: DataFrame, key, value: str, order: str = "date") -> DataFrame:
    """Carry the last seen value forward, then fill the head backward."""
    k = _keys(key)
    fwd = Window.partitionBy(*k).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*k).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(fwd),
                        F.first(value, ignorenulls=True).over(bwd))
    return df.withColumn(value, filled)


def tail_split(df: DataFrame, key, test_cap: int = 15, order: str = "date") -> DataFrame:
    """Mark the last min(test_cap, n div 4) rows of each series as test."""
    k = _keys(key)
    w_all = Window.partitionBy(*k)
    out = with_row_from_end(df, k, order).withColumn("n_rows", F.count(F.lit(1)).over(w_all))
    test_days = F.least(F.lit(test_cap), F.floor(F.col("n_rows") / 4)).cast("int")
    return out.withColumn("test_days", test_days).withColumn(
        "is_test", F.col("rn_desc") <= F.col("test_days")).drop("rn_desc")


def first_n_per_group(df: DataFrame, key, n: int, order) -> DataFrame:
    """The first n rows of each group by a unique order."""
    order = [order] if isinstance(order, (str, Column)) else list(order)
    w = Window.partitionBy(*_keys(key)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# ── A12 calendar pivot ───────────────────────────────────────────────

def calendar_long(daily: DataFrame, metric: str) -> DataFrame:
    """A12 (long form): metric summed per weekday x Monday-start week."""
    return daily.groupBy(
        weekday_name("date").alias("dow"), weekday_index("date").alias("dow_index"),
        monday_week_start("date").alias("week_start"),
    ).agg(F.sum(metric).alias("value"))


def calendar_pivot(daily: DataFrame, metric: str, weeks: list[str] | None = None) -> DataFrame:
    """Weekday rows (Mon..Sun) x one column per week start ('yyyy-MM-dd').

    Pass ``weeks`` to avoid the extra distinct job Spark runs to find the
    pivot values.  Every weekday row is present even without data.
    """
    long = calendar_long(daily, metric).withColumn(
        "week", F.date_format("week_start", "yyyy-MM-dd"))
    piv = long.groupBy("dow", "dow_index")
    piv = piv.pivot("week", weeks) if weeks else piv.pivot("week")
    wide = piv.agg(F.sum("value"))
    days = daily.sparkSession.createDataFrame(
        [(d, i) for i, d in enumerate(WEEKDAYS)], "dow string, dow_index int")
    return days.join(wide, ["dow", "dow_index"], "left").orderBy("dow_index")


# ── A13-A18 ──────────────────────────────────────────────────────────

def recent_base_metrics(daily: DataFrame, n: int = 30, min_rows: int = 14,
                        defaults: tuple[float, float, float] = (0.01, 0.01, 100.0)) -> DataFrame:
    """Funnel base metrics over the last n rows of each campaign.

    Campaigns with fewer than ``min_rows`` rows, or with zero spend or
    clicks in the window, get no row.  ``defaults`` = (ctr, conv rate, AOV)
    when their denominators are zero.
    """
    d_ctr, d_cr, d_aov = defaults
    w_all = Window.partitionBy("campaign_id")
    x = with_row_from_end(daily, "campaign_id").withColumn("n_rows", F.count(F.lit(1)).over(w_all))
    x = x.where((F.col("rn_desc") <= n) & (F.col("n_rows") >= min_rows))
    a = x.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("conversions").alias("total_conversions"),
        F.sum(F.col("spend").cast(MONEY)).cast("double").alias("total_spend"),
        F.sum(F.col("revenue").cast(MONEY)).cast("double").alias("total_revenue"),
    ).where((F.col("total_spend") != 0) & (F.col("total_clicks") != 0))
    return a.select(
        "*",
        (F.col("total_impressions") / F.col("n_days")).alias("base_impressions"),
        safe_div("total_clicks", "total_impressions", d_ctr).alias("base_ctr"),
        safe_div("total_spend", "total_clicks").alias("base_cpc"),
        safe_div("total_conversions", "total_clicks", d_cr).alias("base_conv_rate"),
        safe_div("total_revenue", "total_conversions", d_aov).alias("base_aov"),
        safe_div("total_revenue", "total_spend").alias("current_roas"),
    )


def roas_trend_14(daily: DataFrame, campaigns: DataFrame, block: int = 14,
                  band_pct: float = 5.0) -> DataFrame:
    """Last-14-rows vs prior-14-rows ROAS (ratio of sums) per campaign.

    Fewer than 2x14 rows -> 'stable', 0.0.  Bands at ±5 %.
    """
    w_all = Window.partitionBy("campaign_id")
    x = with_row_from_end(daily, "campaign_id").withColumn("n_rows", F.count(F.lit(1)).over(w_all))
    x = x.where(F.col("rn_desc") <= 2 * block)
    rec = F.col("rn_desc") <= block
    pri = F.col("rn_desc") > block
    m = lambda c, cond: F.sum(F.when(cond, F.col(c).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))).cast("double")
    a = x.groupBy("campaign_id").agg(
        F.max("n_rows").alias("n_rows"),
        m("spend", rec).alias("r_spend"), m("revenue", rec).alias("r_rev"),
        F.sum(F.when(rec, F.col("conversions")).otherwise(0)).alias("r_conv"),
        F.sum(F.when(rec, F.col("clicks")).otherwise(0)).alias("r_clicks"),
        m("spend", pri).alias("p_spend"), m("revenue", pri).alias("p_rev"),
    )
    r_roas = F.when(F.col("r_spend") > 0, F.col("r_rev") / F.col("r_spend")).otherwise(F.lit(0.0))
    p_roas = F.when(F.col("p_spend") > 0, F.col("p_rev") / F.col("p_spend")).otherwise(F.lit(0.0))
    a = a.select("*", r_roas.alias("r_roas"), p_roas.alias("p_roas"))
    has_prior = (F.col("n_rows") >= 2 * block) & (F.col("p_roas") > 0)
    pct = F.when(has_prior, (F.col("r_roas") - F.col("p_roas")) / F.col("p_roas") * 100).otherwise(F.lit(0.0))
    a = a.withColumn("pct", pct)
    trend = (F.when(F.col("pct") > band_pct, "improving")
              .when(F.col("pct") < -band_pct, "declining").otherwise("stable"))
    j = a.join(campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id")
    return j.select(
        "campaign_id", "campaign_name", "platform",
        round_half_up("r_spend", 2).alias("spend_14d"),
        round_half_up("r_rev", 2).alias("revenue_14d"),
        F.col("r_conv").cast("bigint").alias("conversions_14d"),
        F.col("r_clicks").cast("bigint").alias("clicks_14d"),
        round_half_up("r_roas", 2).alias("roas_14d"),
        trend.alias("trend"),
        round_half_up("pct", 1).alias("trend_pct"),
    )


def _block_mean(col: str, cond: Column, scale: int = 4) -> Column:
    """Exact mean of a fixed-point column over the rows where ``cond`` holds."""
    s = F.sum(F.when(cond, F.col(col).cast(f"decimal(28,{scale})")))
    return (s.cast("double") / F.count_if(cond))


def roas_mean_trend(daily: DataFrame, block: int = 14, band_pct: float = 2.0) -> DataFrame:
    """Trend on the *mean of daily ROAS* (not a ratio of sums), ±2 % bands.

    Only campaigns with at least 2x14 rows and a positive prior mean get a row.
    """
    w_all = Window.partitionBy("campaign_id")
    x = with_row_from_end(daily, "campaign_id").withColumn("n_rows", F.count(F.lit(1)).over(w_all))
    x = x.where((F.col("rn_desc") <= 2 * block) & (F.col("n_rows") >= 2 * block))
    a = x.groupBy("campaign_id").agg(
        _block_mean("roas", F.col("rn_desc") <= block).alias("recent_roas"),
        _block_mean("roas", F.col("rn_desc") > block).alias("prior_roas"),
    ).where(F.col("prior_roas") > 0)
    pct = (F.col("recent_roas") - F.col("prior_roas")) / F.col("prior_roas") * 100
    a = a.withColumn("pct", pct)
    return a.select(
        "campaign_id",
        round_half_up("recent_roas", 6).alias("recent_roas"),
        round_half_up("prior_roas", 6).alias("prior_roas"),
        round_half_up("pct", 1).alias("trend_pct"),
        F.when(F.col("pct") > band_pct, "improving").when(F.col("pct") < -band_pct, "declining")
         .otherwise("stable").alias("direction"),
    )


def keyword_momentum(trends: DataFrame, block: int = 7) -> DataFrame:
    """Last-7 vs prior-7 mean interest; change = (r - p) / (p + 1) * 100."""
    w_all = Window.partitionBy("keyword")
    x = with_row_from_end(trends, "keyword").withColumn("n_rows", F.count(F.lit(1)).over(w_all))
    x = x.where((F.col("rn_desc") <= 2 * block) & (F.col("n_rows") >= 2 * block))
    a = x.groupBy("keyword").agg(
        (F.sum(F.when(F.col("rn_desc") <= block, F.col("interest"))) / F.lit(block)).alias("r"),
        (F.sum(F.when(F.col("rn_desc") > block, F.col("interest"))) / F.lit(block)).alias("p"),
    )
    return a.select(
        "keyword",
        round_half_up("r", 1).alias("recent_interest"),
        round_half_up((F.col("r") - F.col("p")) / (F.col("p") + 1) * 100, 1).alias("change_pct"),
    )


def forecast_means(forecasts: DataFrame) -> DataFrame:
    """Mean predicted value (1 dp) and day count per campaign x metric."""
    a = forecasts.groupBy("campaign_id", "metric").agg(
        F.sum("predicted_value").alias("_s"), F.count(F.lit(1)).alias("forecast_days"))
    return a.select("campaign_id", "metric",
                    round_half_up(F.col("_s") / F.col("forecast_days"), 1).alias("avg_predicted"),
                    "forecast_days")


def mean_interest_by_date(trends: DataFrame) -> DataFrame:
    """Mean interest across keywords per date (the forecast regressor)."""
    return trends.groupBy("date").agg(F.avg(F.col("interest").cast("double")).alias("search_trend"))


def order_by_priority(df: DataFrame, col: str = "priority", missing: int = 99) -> DataFrame:
    """T5: sort by priority with missing values last (as 99)."""
    return df.orderBy(F.coalesce(F.col(col), F.lit(missing)))


def order_numeric_text(df: DataFrame, col: str) -> DataFrame:
    """Sort text labels such as '0.95', '1.1' by their numeric value."""
    return df.orderBy(F.col(col).try_cast("double"), F.col(col))
