"""M14 portfolio digest and A34 health rule.

The reference builds its briefing with one query per campaign (N+1) and
asks a language model whether the portfolio is critical.  Here the digest is
one grouped plan (A14 + A15 + A17 joined on campaign_id), its lines with the
period, KPIs and keyword momentum (A1, A2, A16) another, and the health flag
is the stated rule: critical iff some campaign has 14-day ROAS below 1.0
and is declining.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.functions.formatting import fixed, sign_char
from adlens.functions.ratios import round_half_up
from adlens.operators import reports as R
from adlens.operators import trends as T


def campaign_line(name="campaign_name", platform="platform", roas="roas_14d", spend="spend_14d",
                  conv="conversions_14d", trend="trend", pct="trend_pct"):
    """'Name (platform): ROAS=1.2x, Spend=$1,234, Conv=5, Trend=stable (+0.0%)'."""
    spend_txt = F.format_number(round_half_up(spend, 0).cast("bigint"), 0)
    pct_txt = F.concat(sign_char(pct), F.format_string("%.1f", round_half_up(F.abs(F.col(pct)), 1)))
    return F.concat(
        F.col(name), F.lit(" ("), F.col(platform), F.lit("): ROAS="), fixed(roas, 1),
        F.lit("x, Spend=$"), spend_txt, F.lit(", Conv="), F.col(conv).cast("string"),
        F.lit(", Trend="), F.col(trend), F.lit(" ("), pct_txt, F.lit("%)"))


#: Metrics whose forecast means the digest has a column for.
DIGEST_METRICS = ("clicks", "conversions", "spend", "revenue")


def portfolio_digest(daily: DataFrame, campaigns: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row per campaign with its 14-day block, trends and the forecast mean of
    every metric (one pivoted aggregate)."""
    block = T.roas_trend_14(daily, campaigns)
    mean_trend = T.roas_mean_trend(daily).select(
        "campaign_id", F.col("trend_pct").alias("roas_mean_trend_pct"),
        F.col("direction").alias("roas_mean_direction"))
    fc = T.forecast_means(forecasts).groupBy("campaign_id").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("avg_predicted"))).alias(f"forecast_{m}_avg") for m in DIGEST_METRICS])
    out = block.join(mean_trend, "campaign_id", "left").join(fc, "campaign_id", "left")
    return out.select("*", campaign_line().alias("line"))


def _amount(c, places: int = 0):
    """1,234 or 1,234.5, rounded half up."""
    return F.format_number(round_half_up(c, places).cast("bigint" if places == 0 else f"decimal(28,{places})"), places)


def digest_lines(daily: DataFrame, campaigns: DataFrame, forecasts: DataFrame, trends: DataFrame) -> DataFrame:
    """The whole briefing as rows (section, item, line): the period (A1), the portfolio's
    KPIs over it (A2), one line per campaign, per stored forecast (every metric, A17) and
    per keyword's momentum (A16).  Sort by section and item to read it."""
    first, last = daily.select(F.min("date")).scalar(), daily.select(F.max("date")).scalar()
    k = R.kpis(daily, first, last)
    kpi = [("1 spend", F.concat(F.lit("Spend: $"), _amount("total_spend"))),
           ("2 revenue", F.concat(F.lit("Revenue: $"), _amount("total_revenue"))),
           ("3 roas", F.concat(F.lit("ROAS: "), fixed("overall_roas", 2), F.lit("x"))),
           ("4 conversions", F.concat(F.lit("Conversions: "), _amount("total_conversions"))),
           ("5 clicks", F.concat(F.lit("Clicks: "), _amount("total_clicks"))),
           ("6 impressions", F.concat(F.lit("Impressions: "), _amount("total_impressions"))),
           ("7 campaigns", F.concat(F.lit("Campaigns with data: "), _amount("active_campaigns")))]
    kpis = k.select(F.explode(F.array(*[F.struct(F.lit(i).alias("item"), c.alias("line")) for i, c in kpi])).alias("x")).select(
        F.lit("2 kpis").alias("section"), "x.item", "x.line")
    period = R.date_range(daily).select(F.lit("1 period").alias("section"), F.lit("dates").alias("item"), F.concat(
        F.lit("Period: "), F.col("min_date").cast("string"), F.lit(" to "), F.col("max_date").cast("string")).alias("line"))
    blocks = T.roas_trend_14(daily, campaigns).select(
        F.lit("3 campaigns").alias("section"), F.col("campaign_id").cast("string").alias("item"), campaign_line().alias("line"))
    means = T.forecast_means(forecasts).select(
        F.lit("4 forecasts").alias("section"), F.concat(F.col("campaign_id").cast("string"), F.lit("/"), F.col("metric")).alias("item"),
        F.concat(F.col("metric"), F.lit(": "), fixed("avg_predicted", 1), F.lit(" a day over "), F.col("forecast_days").cast("string"),
                 F.lit(" days")).alias("line"))
    momentum = T.keyword_momentum(trends).select(
        F.lit("5 keywords").alias("section"), F.col("keyword").alias("item"),
        F.concat(F.col("keyword"), F.lit(": interest "), fixed("recent_interest", 1), F.lit(" ("), sign_char("change_pct"),
                 F.format_string("%.1f", round_half_up(F.abs(F.col("change_pct")), 1)), F.lit("%)")).alias("line"))
    return reduce(DataFrame.unionByName, [period, kpis, blocks, means, momentum])


def portfolio_health(digest: DataFrame) -> DataFrame:
    """A34: 'critical' iff any campaign has roas_14d < 1.0 and is declining."""
    bad = (F.col("roas_14d") < 1.0) & (F.col("trend") == "declining")
    a = digest.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("_any"),
                   F.count_if(bad).alias("n_critical"),
                   F.count(F.lit(1)).alias("n_campaigns"))
    return a.select(F.when(F.col("_any"), "critical").otherwise("normal").alias("portfolio_health"),
                    "n_critical", "n_campaigns")
