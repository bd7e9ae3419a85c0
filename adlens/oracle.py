"""DuckDB SQL text for the correctness oracle.

Each entry of ``ORACLE`` is plain SQL over the driver's pre-registered views
(region ... conversations).  The stand-in views are repeated as CTEs so the
oracle never reads anything Spark produced.  Rounding goes through
DECIMAL(38,12) on both sides (see ``adlens.functions.ratios``).
"""

from __future__ import annotations


def rnd(expr: str, k: int) -> str:
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,12)), {k}) AS DOUBLE)"


def ratio_zero(n: str, d: str, k: int) -> str:
    return f"CASE WHEN ({d}) = 0 THEN 0.0 ELSE {rnd(f'CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE)', k)} END"


def ratio_null(n: str, d: str, k: int) -> str:
    return rnd(f"CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0)", k)


def ratio_case(n: str, d: str, k: int) -> str:
    return f"CASE WHEN ({d}) > 0 THEN {rnd(f'CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE)', k)} ELSE 0.0 END"


def msum(x: str) -> str:
    return f"CAST(COALESCE(SUM(CAST({x} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def csum(x: str) -> str:
    return f"CAST(COALESCE(SUM({x}), 0) AS BIGINT)"


V_CAMPAIGNS = """v_campaigns AS (
  SELECT CAST(c_custkey AS BIGINT) AS campaign_id, c_name AS campaign_name,
         c_mktsegment AS platform, 'active' AS status, CAST(c_acctbal AS DOUBLE) AS daily_budget
  FROM customer)"""

V_DAILY = f"""v_daily_raw AS (
  SELECT CAST(user_id AS BIGINT) AS campaign_id, CAST(ts AS DATE) AS date,
    CAST(COUNT(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS impressions,
    CAST(COUNT(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks,
    CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS conversions,
    CAST(SUM(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS spend,
    CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS revenue
  FROM events GROUP BY 1, 2),
v_daily AS (
  SELECT *, {ratio_zero('clicks', 'impressions', 6)} AS ctr,
            {ratio_zero('spend', 'clicks', 4)} AS cpc,
            {ratio_zero('revenue', 'spend', 4)} AS roas
  FROM v_daily_raw)"""

V_TRENDS = """v_trends_raw AS (
  SELECT event_type AS keyword, CAST(ts AS DATE) AS date, COUNT(*) AS n FROM events GROUP BY 1, 2),
v_trends AS (
  SELECT keyword, date, CAST(FLOOR(100 * n / MAX(n) OVER (PARTITION BY keyword)) AS BIGINT) AS interest
  FROM v_trends_raw)"""

V_FORECASTS = """v_fc_raw AS (
  SELECT campaign_id, date,
    COUNT(clicks) OVER w AS n, SUM(clicks) OVER w AS s1, SUM(clicks * clicks) OVER w AS s2
  FROM v_daily WINDOW w AS (PARTITION BY campaign_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
v_forecasts AS (
  SELECT campaign_id, date AS forecast_date, 'clicks' AS metric,
    CAST(s1 AS DOUBLE) / n AS predicted_value,
    CAST(s1 AS DOUBLE) / n - 1.28 * (SQRT(CAST(n * s2 - s1 * s1 AS DOUBLE)) / n) AS lower_bound,
    CAST(s1 AS DOUBLE) / n + 1.28 * (SQRT(CAST(n * s2 - s1 * s1 AS DOUBLE)) / n) AS upper_bound
  FROM v_fc_raw WHERE n > 0)"""

_FC_METRICS = ("clicks", "conversions", "spend", "revenue")
V_ALL_FC = """v_allfc0 AS (SELECT campaign_id, date, COUNT(*) OVER w AS n, """ + ", ".join(
    f"CAST(SUM(CAST({m} AS DECIMAL(18,2))) OVER w AS DOUBLE) / COUNT(*) OVER w AS {m}" for m in _FC_METRICS) + """
  FROM v_daily WINDOW w AS (PARTITION BY campaign_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
v_allfc AS (""" + " UNION ALL ".join(
    f"SELECT campaign_id, date AS forecast_date, '{m}' AS metric, {m} AS predicted_value, CAST(date - 1 AS TIMESTAMP) AS created_at "
    "FROM v_allfc0 WHERE n > 0" for m in _FC_METRICS) + ")"

V_ADS = """v_ads AS (
  SELECT CAST(doc_id AS BIGINT) AS ad_id, source AS advertiser_name, lang AS platform, text AS ad_copy,
    source || ' ad ' || CAST(doc_id AS VARCHAR) AS headline, 'Shop now' AS cta,
    CAST(doc_id % 7 AS VARCHAR) AS category, DATE '2024-01-01' AS first_seen,
    CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS last_seen,
    doc_id % 30 >= 7 AS is_active,
    CASE WHEN n_chars < 2000 THEN 'low' WHEN n_chars < 20000 THEN 'medium' ELSE 'high' END AS spend_tier
  FROM documents)"""

V_CLICKS = """v_clicks AS (
  SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
    CAST(l_returnflag = 'R' AS INTEGER) AS label,
    CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
    CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax,
    CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice,
    p_brand, p_type, p_name, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

V_SCORED = """v_scored AS (
  SELECT l_orderkey, l_linenumber, label,
    LEAST(GREATEST((l_quantity + 10.0 * l_discount) / 52.0, 0.0), 1.0) AS score
  FROM v_clicks)"""

V_REWARDS = """v_rewards AS (
  SELECT CAST(ts AS DATE) AS round, event_type AS arm,
    CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS reward
  FROM events GROUP BY 1, 2)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


# the whole period of the stored metrics
_ALL = "(SELECT MIN(date) FROM v_daily) AND (SELECT MAX(date) FROM v_daily)"
DR = ("DATE '2024-01-01'", "DATE '2024-01-30'")

ORACLE: dict[str, str] = {}
_S, _E = DR
_RS = "DATE '2024-01-16'"

ORACLE["V_daily_metrics"] = with_views(V_DAILY) + "SELECT * FROM v_daily"

ORACLE["A6_campaign_summary"] = with_views(V_CAMPAIGNS, V_DAILY) + f"""
, per AS (
  SELECT campaign_id, {csum('impressions')} AS impressions, {csum('clicks')} AS clicks,
    {msum('spend')} AS spend, {csum('conversions')} AS conversions, {msum('revenue')} AS revenue
  FROM v_daily WHERE date BETWEEN {_S} AND {_E} GROUP BY campaign_id)
SELECT p.campaign_id, c.campaign_name, c.platform, impressions, clicks,
  {ratio_null('clicks', 'impressions', 4)} AS ctr, spend,
  {ratio_null('spend', 'clicks', 2)} AS avg_cpc, conversions,
  {ratio_null('conversions', 'clicks', 4)} AS conv_rate, revenue,
  {ratio_null('revenue', 'spend', 2)} AS roas
FROM per p JOIN v_campaigns c ON p.campaign_id = c.campaign_id
ORDER BY spend DESC, p.campaign_id"""

ORACLE["A1_date_range"] = with_views(V_DAILY) + "SELECT MIN(date) AS min_date, MAX(date) AS max_date FROM v_daily"


def _kpi_sql(cond: str, p: str = "") -> str:
    w = (lambda c: f"CASE WHEN {cond} THEN {c} END")
    return (f"{msum(w('spend'))} AS {p}total_spend, {msum(w('revenue'))} AS {p}total_revenue, "
            f"{csum(w('conversions'))} AS {p}total_conversions, {csum(w('clicks'))} AS {p}total_clicks, "
            f"{csum(w('impressions'))} AS {p}total_impressions, "
            f"COUNT(DISTINCT {w('campaign_id')}) AS {p}active_campaigns")


def _kpi_ratio_sql(p: str = "") -> str:
    return (f"{ratio_case(p + 'total_revenue', p + 'total_spend', 2)} AS {p}overall_roas, "
            f"{ratio_case(p + 'total_clicks', p + 'total_impressions', 4)} AS {p}overall_ctr")


ORACLE["A2_kpis"] = with_views(V_DAILY) + f"""
, a AS (SELECT {_kpi_sql('TRUE')} FROM v_daily WHERE date BETWEEN {_S} AND {_E})
SELECT *, {_kpi_ratio_sql()} FROM a"""


def _signed_pct(x: str) -> str:
    return (f"(CASE WHEN ({x}) < 0 THEN '-' ELSE '+' END) || printf('%.1f', {rnd(f'ABS({x})', 1)}) || '%'")


ORACLE["A3_kpis_comparison"] = with_views(V_DAILY) + f"""
, a AS (SELECT {_kpi_sql(f'date BETWEEN {_RS} AND {_E}')},
               {_kpi_sql("date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'", 'prev_')}
        FROM v_daily WHERE date BETWEEN DATE '2024-01-01' AND {_E}),
b AS (SELECT *, {_kpi_ratio_sql()}, {_kpi_ratio_sql('prev_')} FROM a)
SELECT {_RS} AS start_date, {_E} AS end_date, DATE '2024-01-01' AS prev_start_date,
  DATE '2024-01-15' AS prev_end_date,
  total_spend, total_revenue, total_conversions, total_clicks, total_impressions, active_campaigns,
  overall_roas, overall_ctr, prev_total_spend, prev_total_conversions, prev_overall_roas,
  CASE WHEN prev_total_spend <> 0 THEN '$' || (CASE WHEN total_spend - prev_total_spend < 0 THEN '-' ELSE '+' END)
       || format('{{:,}}', CAST({rnd('ABS(total_spend - prev_total_spend)', 0)} AS BIGINT)) || ' vs prior' END AS spend_delta,
  CASE WHEN prev_overall_roas <> 0 THEN {_signed_pct('(overall_roas - prev_overall_roas) / prev_overall_roas * 100')} END AS roas_delta,
  CASE WHEN prev_total_conversions <> 0 THEN {_signed_pct('(total_conversions - prev_total_conversions) / prev_total_conversions * 100')} END AS conversions_delta
FROM b"""

ORACLE["A4_daily_spend_by_platform"] = with_views(V_CAMPAIGNS, V_DAILY) + f"""
SELECT d.date, c.platform, {msum('d.spend')} AS spend
FROM v_daily d JOIN v_campaigns c ON d.campaign_id = c.campaign_id
WHERE d.date BETWEEN {_S} AND {_E} GROUP BY d.date, c.platform ORDER BY d.date, c.platform"""

ORACLE["A5_daily_roas"] = with_views(V_DAILY) + f"""
, a AS (SELECT date, {msum('spend')} AS spend, {msum('revenue')} AS revenue
        FROM v_daily WHERE date BETWEEN {_S} AND {_E} GROUP BY date)
SELECT date, spend, revenue, {ratio_case('revenue', 'spend', 2)} AS roas FROM a ORDER BY date"""

ORACLE["A7_forecast_summary"] = with_views(V_CAMPAIGNS, V_DAILY, V_ALL_FC) + f"""
, f AS (SELECT campaign_id, metric, COUNT(*) AS forecast_days, MIN(forecast_date) AS first_date,
          MAX(forecast_date) AS last_date, SUM(predicted_value) AS s, MAX(created_at) AS generated_at
        FROM v_allfc GROUP BY campaign_id, metric)
SELECT f.campaign_id, c.campaign_name, c.platform, metric, forecast_days, first_date, last_date,
  {rnd('s / forecast_days', 1)} AS avg_predicted, generated_at
FROM f JOIN v_campaigns c ON f.campaign_id = c.campaign_id"""

ORACLE["A8_platform_share"] = with_views(V_CAMPAIGNS, V_DAILY) + f"""
, per AS (SELECT c.platform, {msum('d.spend')} AS spend FROM v_daily d JOIN v_campaigns c
          ON d.campaign_id = c.campaign_id WHERE d.date BETWEEN {_ALL} GROUP BY c.platform),
tot AS (SELECT *, CAST(SUM(CAST(spend AS DECIMAL(18,2))) OVER () AS DOUBLE) AS total FROM per)
SELECT upper(substr(platform, 1, 1)) || lower(substr(platform, 2)) AS platform_label, platform, spend,
  CASE WHEN total > 0 THEN {rnd('spend / total * 100', 4)} ELSE 0.0 END AS share_pct FROM tot"""

ORACLE["A9_ad_counts"] = with_views(V_ADS) + """
SELECT COUNT(*) AS n_ads, COUNT(DISTINCT advertiser_name) AS n_advertisers,
  COUNT(DISTINCT platform) AS n_platforms, COUNT(DISTINCT category) AS n_categories FROM v_ads"""

ORACLE["A27_table_counts"] = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS n_rows FROM {n}"
    for n in ["customer", "orders", "lineitem", "events", "documents"])

ORACLE["A28_latest_snapshot"] = with_views(V_ADS) + """
SELECT ad_id, advertiser_name, platform, last_seen FROM v_ads
WHERE last_seen = (SELECT MAX(last_seen) FROM v_ads) ORDER BY ad_id"""

ORACLE["A29_distinct_advertisers"] = with_views(V_ADS) + \
    "SELECT DISTINCT advertiser_name FROM v_ads ORDER BY advertiser_name"

ORACLE["A30_click_log_summary"] = with_views(V_CLICKS) + f"""
SELECT COUNT(*) AS n_rows, CAST(SUM(label) AS BIGINT) AS n_clicks,
  {rnd('CAST(SUM(label) AS DOUBLE) / COUNT(*)', 6)} AS click_rate FROM v_clicks"""

_FVA = """
SELECT f.campaign_id, f.forecast_date AS date, f.predicted_value, f.lower_bound, f.upper_bound,
  CAST(m.clicks AS DOUBLE) AS actual_value
FROM v_forecasts f JOIN v_daily m ON f.campaign_id = m.campaign_id AND f.forecast_date = m.date
WHERE f.metric = 'clicks'"""

ORACLE["J4_forecast_vs_actual"] = with_views(V_DAILY, V_FORECASTS) + _FVA

ORACLE["A35_axis_range"] = with_views(V_DAILY, V_FORECASTS) + f"""
, p AS ({_FVA}),
r AS (SELECT LEAST(MIN(actual_value), MIN(predicted_value)) AS lo,
             GREATEST(MAX(actual_value), MAX(predicted_value)) AS hi FROM p)
SELECT lo - (hi - lo) * 0.05 AS range_low, hi + (hi - lo) * 0.05 AS range_high FROM r"""

ORACLE["P2_filter_ads"] = with_views(V_ADS) + """
SELECT ad_id, advertiser_name, platform, category, last_seen FROM v_ads WHERE platform = 'en'"""

ORACLE["P3_keyword_series"] = with_views(V_TRENDS) + """
SELECT keyword, date, interest FROM v_trends WHERE keyword IN ('click', 'purchase') ORDER BY keyword, date"""

ORACLE["P4_campaign_series"] = with_views(V_DAILY) + "SELECT * FROM v_daily WHERE campaign_id = 7 ORDER BY date"

ORACLE["T1_sorted_campaigns"] = with_views(V_CAMPAIGNS) + \
    "SELECT * FROM v_campaigns ORDER BY platform, campaign_name, campaign_id"

ORACLE["T7_first_keywords"] = with_views(V_TRENDS) + \
    "SELECT DISTINCT keyword FROM v_trends ORDER BY keyword LIMIT 3"

ORACLE["U4_distinct_platforms"] = with_views(V_CAMPAIGNS) + \
    "SELECT DISTINCT platform FROM v_campaigns ORDER BY platform"

# ── Phase 2 ──────────────────────────────────────────────────────────
_RN = "ROW_NUMBER() OVER (PARTITION BY campaign_id ORDER BY date DESC)"

ORACLE["W1_moving_average"] = with_views(V_DAILY) + """
SELECT campaign_id, date, clicks,
  CASE WHEN COUNT(*) OVER (PARTITION BY campaign_id) >= 7 THEN
    AVG(clicks) OVER (PARTITION BY campaign_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS clicks_ma7
FROM v_daily"""

ORACLE["W2_last_rows"] = with_views(V_DAILY) + f"""
SELECT campaign_id, date, clicks FROM (SELECT *, {_RN} AS rn FROM v_daily) WHERE rn <= 14"""

ORACLE["W3_rows_slice"] = with_views(V_DAILY) + f"""
SELECT campaign_id, date, spend FROM (SELECT *, {_RN} AS rn FROM v_daily) WHERE rn BETWEEN 15 AND 28"""

ORACLE["W4_fill_forward_backward"] = with_views(V_DAILY) + """
, x AS (SELECT campaign_id, date, CASE WHEN spend > 0 THEN roas END AS r FROM v_daily)
SELECT campaign_id, date, COALESCE(
  LAST_VALUE(r IGNORE NULLS) OVER (PARTITION BY campaign_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  FIRST_VALUE(r IGNORE NULLS) OVER (PARTITION BY campaign_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) AS roas_filled FROM x"""

ORACLE["W9_tail_split"] = with_views(V_DAILY) + f"""
, x AS (SELECT campaign_id, date, clicks, {_RN} AS rn, COUNT(*) OVER (PARTITION BY campaign_id) AS n_rows FROM v_daily)
SELECT campaign_id, date, clicks, n_rows, CAST(LEAST(15, FLOOR(n_rows / 4)) AS INTEGER) AS test_days,
  rn <= LEAST(15, FLOOR(n_rows / 4)) AS is_test FROM x"""

ORACLE["W10_first_ads_per_group"] = with_views(V_ADS) + """
SELECT ad_id, category, advertiser_name FROM (
  SELECT ad_id, category, advertiser_name, ROW_NUMBER() OVER (PARTITION BY category ORDER BY ad_id) AS rn FROM v_ads)
WHERE rn <= 3"""

_WEEKS = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
ORACLE["A12_calendar_pivot"] = with_views(V_DAILY) + """
, x AS (SELECT dayname(date) AS dow, CAST(date_trunc('week', date) AS DATE) AS wk, clicks FROM v_daily),
days AS (SELECT * FROM (VALUES """ + ", ".join(f"('{d}', {i})" for i, d in enumerate(_DAYS)) + """) t(dow, dow_index))
SELECT days.dow, days.dow_index, """ + ", ".join(
    f"CAST(SUM(CASE WHEN wk = DATE '{w}' THEN clicks END) AS BIGINT) AS \"{w}\"" for w in _WEEKS) + """
FROM days LEFT JOIN x ON days.dow = x.dow GROUP BY days.dow, days.dow_index"""

ORACLE["A13_recent_base_metrics"] = with_views(V_DAILY) + f"""
, x AS (SELECT *, {_RN} AS rn, COUNT(*) OVER (PARTITION BY campaign_id) AS n_rows FROM v_daily),
a AS (SELECT campaign_id, COUNT(*) AS n_days, SUM(impressions) AS total_impressions, SUM(clicks) AS total_clicks,
        SUM(conversions) AS total_conversions, CAST(SUM(CAST(spend AS DECIMAL(18,2))) AS DOUBLE) AS total_spend,
        CAST(SUM(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
      FROM x WHERE rn <= 30 AND n_rows >= 14 GROUP BY campaign_id)
SELECT campaign_id, n_days, CAST(total_impressions AS BIGINT) AS total_impressions,
  CAST(total_clicks AS BIGINT) AS total_clicks, CAST(total_conversions AS BIGINT) AS total_conversions,
  total_spend, total_revenue,
  total_impressions / n_days AS base_impressions,
  COALESCE(CAST(total_clicks AS DOUBLE) / NULLIF(CAST(total_impressions AS DOUBLE), 0), 0.01) AS base_ctr,
  CAST(total_spend AS DOUBLE) / NULLIF(CAST(total_clicks AS DOUBLE), 0) AS base_cpc,
  COALESCE(CAST(total_conversions AS DOUBLE) / NULLIF(CAST(total_clicks AS DOUBLE), 0), 0.01) AS base_conv_rate,
  COALESCE(total_revenue / NULLIF(CAST(total_conversions AS DOUBLE), 0), 100.0) AS base_aov,
  total_revenue / NULLIF(total_spend, 0) AS current_roas
FROM a WHERE total_spend <> 0 AND total_clicks <> 0"""

_A14 = f"""
, x AS (SELECT *, {_RN} AS rn, COUNT(*) OVER (PARTITION BY campaign_id) AS n_rows FROM v_daily),
a AS (SELECT campaign_id, MAX(n_rows) AS n_rows,
   CAST(SUM(CASE WHEN rn <= 14 THEN CAST(spend AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS r_spend,
   CAST(SUM(CASE WHEN rn <= 14 THEN CAST(revenue AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS r_rev,
   SUM(CASE WHEN rn <= 14 THEN conversions ELSE 0 END) AS r_conv,
   SUM(CASE WHEN rn <= 14 THEN clicks ELSE 0 END) AS r_clicks,
   CAST(SUM(CASE WHEN rn > 14 THEN CAST(spend AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS p_spend,
   CAST(SUM(CASE WHEN rn > 14 THEN CAST(revenue AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS p_rev
  FROM x WHERE rn <= 28 GROUP BY campaign_id),
b AS (SELECT *, CASE WHEN r_spend > 0 THEN r_rev / r_spend ELSE 0.0 END AS r_roas,
             CASE WHEN p_spend > 0 THEN p_rev / p_spend ELSE 0.0 END AS p_roas FROM a),
c AS (SELECT *, CASE WHEN n_rows >= 28 AND p_roas > 0 THEN (r_roas - p_roas) / p_roas * 100 ELSE 0.0 END AS pct FROM b),
t14 AS (SELECT c.campaign_id, v.campaign_name, v.platform, {rnd('r_spend', 2)} AS spend_14d,
  {rnd('r_rev', 2)} AS revenue_14d, CAST(r_conv AS BIGINT) AS conversions_14d, CAST(r_clicks AS BIGINT) AS clicks_14d,
  {rnd('r_roas', 2)} AS roas_14d,
  CASE WHEN pct > 5 THEN 'improving' WHEN pct < -5 THEN 'declining' ELSE 'stable' END AS trend,
  {rnd('pct', 1)} AS trend_pct
  FROM c JOIN v_campaigns v ON c.campaign_id = v.campaign_id)"""

ORACLE["A14_roas_trend_14"] = with_views(V_CAMPAIGNS, V_DAILY) + _A14 + " SELECT * FROM t14"

_A15 = f"""
, x15 AS (SELECT *, {_RN} AS rn, COUNT(*) OVER (PARTITION BY campaign_id) AS n_rows FROM v_daily),
a15 AS (SELECT campaign_id,
    CAST(SUM(CASE WHEN rn <= 14 THEN CAST(roas AS DECIMAL(28,4)) END) AS DOUBLE) / COUNT(*) FILTER (WHERE rn <= 14) AS recent_roas,
    CAST(SUM(CASE WHEN rn > 14 THEN CAST(roas AS DECIMAL(28,4)) END) AS DOUBLE) / COUNT(*) FILTER (WHERE rn > 14) AS prior_roas
  FROM x15 WHERE rn <= 28 AND n_rows >= 28 GROUP BY campaign_id),
t15 AS (SELECT campaign_id, {rnd('recent_roas', 6)} AS recent_roas, {rnd('prior_roas', 6)} AS prior_roas,
   {rnd('(recent_roas - prior_roas) / prior_roas * 100', 1)} AS trend_pct,
   CASE WHEN (recent_roas - prior_roas) / prior_roas * 100 > 2 THEN 'improving'
        WHEN (recent_roas - prior_roas) / prior_roas * 100 < -2 THEN 'declining' ELSE 'stable' END AS direction
  FROM a15 WHERE prior_roas > 0)"""

ORACLE["A15_roas_mean_trend"] = with_views(V_DAILY) + _A15 + " SELECT * FROM t15"

ORACLE["A16_keyword_momentum"] = with_views(V_TRENDS) + f"""
, x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY keyword ORDER BY date DESC) AS rn,
          COUNT(*) OVER (PARTITION BY keyword) AS n_rows FROM v_trends),
a AS (SELECT keyword, SUM(CASE WHEN rn <= 7 THEN interest END) / 7 AS r,
        SUM(CASE WHEN rn > 7 THEN interest END) / 7 AS p FROM x WHERE rn <= 14 AND n_rows >= 14 GROUP BY keyword)
SELECT keyword, {rnd('r', 1)} AS recent_interest, {rnd('(r - p) / (p + 1) * 100', 1)} AS change_pct FROM a"""

_A17 = f"""
, f17 AS (SELECT campaign_id, metric, SUM(predicted_value) AS s, COUNT(*) AS forecast_days FROM v_forecasts GROUP BY 1, 2),
t17 AS (SELECT campaign_id, metric, {rnd('s / forecast_days', 1)} AS avg_predicted, forecast_days FROM f17)"""

ORACLE["A17_forecast_means"] = with_views(V_DAILY, V_FORECASTS) + _A17 + " SELECT * FROM t17"

ORACLE["A18_mean_interest_by_date"] = with_views(V_TRENDS) + \
    "SELECT date, AVG(CAST(interest AS DOUBLE)) AS search_trend FROM v_trends GROUP BY date"

_M14 = with_views(V_CAMPAIGNS, V_DAILY, V_ALL_FC) + _A14 + _A15 + _A17.replace("v_forecasts", "v_allfc") + f"""
, ln14 AS (SELECT *, campaign_name || ' (' || platform || '): ROAS=' || printf('%.1f', {rnd('roas_14d', 1)}) || 'x, Spend=$'
      || format('{{:,}}', CAST({rnd('spend_14d', 0)} AS BIGINT)) || ', Conv=' || CAST(conversions_14d AS VARCHAR)
      || ', Trend=' || trend || ' (' || (CASE WHEN trend_pct < 0 THEN '-' ELSE '+' END)
      || printf('%.1f', {rnd('ABS(trend_pct)', 1)}) || '%)' AS line FROM t14),
m14 AS (SELECT ln14.* EXCLUDE (line), t15.trend_pct AS roas_mean_trend_pct, t15.direction AS roas_mean_direction,
    {", ".join(f"f.forecast_{m}_avg" for m in _FC_METRICS)}, line
  FROM ln14 LEFT JOIN t15 ON ln14.campaign_id = t15.campaign_id
  LEFT JOIN (SELECT campaign_id, {", ".join(f"MAX(avg_predicted) FILTER (metric = '{m}') AS forecast_{m}_avg" for m in _FC_METRICS)}
             FROM t17 GROUP BY campaign_id) f ON ln14.campaign_id = f.campaign_id)"""

_K14 = [("1 spend", "'Spend: $' || " + "format('{:,}', CAST(" + rnd("total_spend", 0) + " AS BIGINT))"),
        ("2 revenue", "'Revenue: $' || " + "format('{:,}', CAST(" + rnd("total_revenue", 0) + " AS BIGINT))"),
        ("3 roas", f"'ROAS: ' || printf('%.2f', {rnd('overall_roas', 2)}) || 'x'"),
        *[(f"{i} {name}", f"'{text}: ' || format('{{:,}}', CAST({c} AS BIGINT))") for i, name, text, c in (
            (4, "conversions", "Conversions", "total_conversions"), (5, "clicks", "Clicks", "total_clicks"),
            (6, "impressions", "Impressions", "total_impressions"), (7, "campaigns", "Campaigns with data", "active_campaigns"))]]
ORACLE["M14_digest_lines"] = _M14.replace("WITH ", "WITH " + V_TRENDS + ",\n", 1) + f"""
, k0 AS (SELECT {_kpi_sql("TRUE")} FROM v_daily),
k AS (SELECT *, {_kpi_ratio_sql()} FROM k0),
x16 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY keyword ORDER BY date DESC) AS rn,
          COUNT(*) OVER (PARTITION BY keyword) AS n_rows FROM v_trends),
a16 AS (SELECT keyword, SUM(CASE WHEN rn <= 7 THEN interest END) / 7 AS r,
        SUM(CASE WHEN rn > 7 THEN interest END) / 7 AS p FROM x16 WHERE rn <= 14 AND n_rows >= 14 GROUP BY keyword),
t16 AS (SELECT keyword, {rnd('r', 1)} AS recent, {rnd('(r - p) / (p + 1) * 100', 1)} AS pct FROM a16)
SELECT '1 period' AS section, 'dates' AS item,
  'Period: ' || CAST(MIN(date) AS VARCHAR) || ' to ' || CAST(MAX(date) AS VARCHAR) AS line FROM v_daily
""" + "".join(f"UNION ALL SELECT '2 kpis', '{i}', {c} FROM k\n" for i, c in _K14) + f"""
UNION ALL SELECT '3 campaigns', CAST(campaign_id AS VARCHAR), line FROM ln14
UNION ALL SELECT '4 forecasts', CAST(campaign_id AS VARCHAR) || '/' || metric, metric || ': '
  || printf('%.1f', {rnd('avg_predicted', 1)}) || ' a day over ' || CAST(forecast_days AS VARCHAR) || ' days' FROM t17
UNION ALL SELECT '5 keywords', keyword, keyword || ': interest ' || printf('%.1f', {rnd('recent', 1)}) || ' ('
  || CASE WHEN pct < 0 THEN '-' ELSE '+' END || printf('%.1f', {rnd('ABS(pct)', 1)}) || '%)' FROM t16"""

ORACLE["M14_portfolio_digest"] = _M14 + " SELECT * FROM m14"

ORACLE["A34_portfolio_health"] = _M14 + """
SELECT CASE WHEN COALESCE(BOOL_OR(roas_14d < 1.0 AND trend = 'declining'), FALSE) THEN 'critical' ELSE 'normal' END
  AS portfolio_health, COUNT(*) FILTER (WHERE roas_14d < 1.0 AND trend = 'declining') AS n_critical,
  COUNT(*) AS n_campaigns FROM m14"""

# ── Phase 4: decide ──────────────────────────────────────────────────
_EPS = "CAST('1e-10' AS DOUBLE)"
_PRIOR = f"CAST('{1.0 / (1.0 + 1e-10)!r}' AS DOUBLE)"

ORACLE["A31_normal_posterior"] = with_views(V_DAILY) + f"""
, a AS (SELECT campaign_id, SUM(1.0 / ((roas * 0.2 + 0.1) * (roas * 0.2 + 0.1) + {_EPS})) AS p,
          SUM(1.0 / ((roas * 0.2 + 0.1) * (roas * 0.2 + 0.1) + {_EPS}) * roas) AS ws, COUNT(*) AS n_obs
        FROM v_daily GROUP BY campaign_id)
SELECT campaign_id, {rnd(f'(0.0 + ws) / ({_PRIOR} + p)', 4)} AS mean,
  {rnd(f'1.0 / SQRT({_PRIOR} + p)', 4)} AS uncertainty, n_obs FROM a"""


def _beta_sql(keys: str) -> str:
    return f"""SELECT {keys}, COUNT(*) FILTER (WHERE CAST(label AS BOOLEAN)) AS successes,
    COUNT(*) FILTER (WHERE NOT CAST(label AS BOOLEAN)) AS failures FROM v_clicks GROUP BY {keys}"""


def _beta_out(keys: str) -> str:
    al, be = "(1.0 + successes)", "(1.0 + failures)"
    return (f"SELECT {keys}, successes, failures, {rnd(f'{al} / ({al} + {be})', 4)} AS mean, "
            f"{rnd(f'SQRT({al} * {be} / (({al} + {be}) * ({al} + {be}) * ({al} + {be} + 1)))', 4)} AS uncertainty, "
            f"successes + failures AS n_obs")


ORACLE["A32_beta_posterior"] = with_views(V_CLICKS) + f", b AS ({_beta_sql('p_brand')}) {_beta_out('p_brand')} FROM b"

ORACLE["A33_best_arm_confidence"] = with_views(V_CLICKS) + f"""
, b AS ({_beta_sql('l_linestatus, p_type')}),
bel AS ({_beta_out('l_linestatus, p_type')} FROM b),
r AS (SELECT *, ROW_NUMBER() OVER w AS rk, LEAD(mean) OVER w AS nxt FROM bel
      WINDOW w AS (PARTITION BY l_linestatus ORDER BY mean DESC, p_type)),
t AS (SELECT *, CASE WHEN nxt IS NULL THEN 0.0 ELSE (mean - nxt) / (ABS(mean) + {_EPS}) END AS g FROM r WHERE rk = 1)
SELECT l_linestatus, p_type AS best_arm, mean AS best_mean, n_obs AS best_n_obs, {rnd('g', 6)} AS relative_gap,
  CASE WHEN g > 0.15 AND n_obs >= 20 THEN 'high' WHEN g > 0.05 AND n_obs >= 10 THEN 'medium' ELSE 'low' END AS confidence
FROM t"""

_A13 = f"""
, x13 AS (SELECT *, {_RN} AS rn, COUNT(*) OVER (PARTITION BY campaign_id) AS n_rows FROM v_daily),
s13 AS (SELECT campaign_id, COUNT(*) AS n_days, SUM(impressions) AS total_impressions, SUM(clicks) AS total_clicks,
        SUM(conversions) AS total_conversions, CAST(SUM(CAST(spend AS DECIMAL(18,2))) AS DOUBLE) AS total_spend,
        CAST(SUM(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
      FROM x13 WHERE rn <= 30 AND n_rows >= 14 GROUP BY campaign_id),
a13 AS (SELECT campaign_id, n_days, total_impressions / n_days AS base_impressions,
  COALESCE(CAST(total_clicks AS DOUBLE) / NULLIF(CAST(total_impressions AS DOUBLE), 0), 0.01) AS base_ctr,
  CAST(total_spend AS DOUBLE) / NULLIF(CAST(total_clicks AS DOUBLE), 0) AS base_cpc,
  COALESCE(CAST(total_conversions AS DOUBLE) / NULLIF(CAST(total_clicks AS DOUBLE), 0), 0.01) AS base_conv_rate,
  COALESCE(total_revenue / NULLIF(CAST(total_conversions AS DOUBLE), 0), 100.0) AS base_aov,
  total_revenue / NULLIF(total_spend, 0) AS current_roas
  FROM s13 WHERE total_spend <> 0 AND total_clicks <> 0),
lv AS (SELECT CAST(m AS DOUBLE) AS bid_multiplier FROM (VALUES ('0.8'), ('0.9'), ('0.95'), ('1.0'), ('1.05'), ('1.1'), ('1.2')) t(m)),
g0 AS (SELECT a13.*, lv.bid_multiplier, a13.base_impressions * SQRT(lv.bid_multiplier) AS exp_impressions FROM a13, lv),
g1 AS (SELECT *, exp_impressions * base_ctr AS exp_clicks FROM g0),
g2 AS (SELECT *, exp_clicks * (base_cpc * bid_multiplier) AS exp_spend, exp_clicks * base_conv_rate AS exp_conversions FROM g1),
g3 AS (SELECT *, exp_conversions * base_aov AS exp_revenue FROM g2),
grid AS (SELECT *, exp_revenue - exp_spend AS exp_profit,
   CASE WHEN exp_spend > 0 THEN exp_revenue / exp_spend ELSE 0.0 END AS exp_roas FROM g3)"""

ORACLE["M11_bid_response_grid"] = with_views(V_DAILY) + _A13 + " SELECT campaign_id, bid_multiplier, " + ", ".join(
    f"{rnd(c, 6)} AS {c}" for c in
    ("exp_impressions", "exp_clicks", "exp_spend", "exp_revenue", "exp_profit", "exp_roas")) + " FROM grid"

_M10 = with_views(V_CAMPAIGNS, V_DAILY, V_FORECASTS) + _A13 + _A15 + f"""
, rk AS (SELECT grid.*, c.campaign_name, c.platform, ROW_NUMBER() OVER w AS r, LEAD(exp_profit) OVER w AS nxt
         FROM grid JOIN v_campaigns c ON grid.campaign_id = c.campaign_id
         WINDOW w AS (PARTITION BY grid.campaign_id ORDER BY exp_profit DESC, bid_multiplier)),
best AS (SELECT *, CASE WHEN nxt IS NULL THEN 0.0 ELSE (exp_profit - nxt) / (ABS(exp_profit) + {_EPS}) END AS g,
           {rnd('(bid_multiplier - 1.0) * 100', 1)} AS chg,
           CASE platform WHEN 'google' THEN 3.0 WHEN 'meta' THEN 2.5 WHEN 'amazon' THEN 3.5 ELSE 3.0 END AS tgt
         FROM rk WHERE r = 1),
fc AS (SELECT DISTINCT campaign_id, TRUE AS has_fc FROM v_forecasts),
b2 AS (SELECT best.*, CASE WHEN g > 0.15 AND n_days >= 20 THEN 'high' WHEN g > 0.05 AND n_days >= 10 THEN 'medium' ELSE 'low' END AS confidence,
         CASE WHEN ABS(chg) < 3.0 THEN 'hold' WHEN chg > 0 THEN 'increase' ELSE 'decrease' END AS act,
         t15.trend_pct AS tp, t15.direction AS dir, fc.has_fc
       FROM best LEFT JOIN t15 ON best.campaign_id = t15.campaign_id LEFT JOIN fc ON best.campaign_id = fc.campaign_id),
bids AS (SELECT campaign_id, campaign_name, platform, {rnd('current_roas', 2)} AS current_roas,
  act AS recommended_action, CASE WHEN act = 'hold' THEN 0.0 ELSE chg END AS recommended_change_pct,
  CASE WHEN act = 'hold' THEN 1.0 ELSE bid_multiplier END AS recommended_multiplier,
  {rnd('exp_roas', 2)} AS expected_roas_after, confidence,
  concat_ws(' ',
    'Current ROAS is ' || printf('%.1f', {rnd('current_roas', 1)}) || 'x (' || CASE WHEN current_roas >= tgt THEN 'above' ELSE 'below' END
      || ' ' || printf('%.1f', {rnd('tgt', 1)}) || 'x target).',
    CASE WHEN tp IS NOT NULL THEN 'Performance is ' || dir || ' (' || CASE WHEN tp < 0 THEN '-' ELSE '+' END
      || printf('%.1f', {rnd('ABS(tp)', 1)}) || '% ROAS change over 14 days).' END,
    CASE WHEN has_fc THEN 'Demand forecast factored into optimization.' END,
    CASE WHEN act = 'increase' THEN 'The bid-response model recommends increasing bid by '
           || printf('%.0f', {rnd('ABS(chg)', 0)}) || '% (expected ROAS: '
           || printf('%.1f', {rnd('exp_roas', 1)}) || 'x). Confidence is ' || confidence || ' based on the profit gap to the next bid level.'
         WHEN act = 'decrease' THEN 'The bid-response model recommends decreasing bid by '
           || printf('%.0f', {rnd('ABS(chg)', 0)}) || '% to improve efficiency (expected ROAS: '
           || printf('%.1f', {rnd('exp_roas', 1)}) || 'x).'
         ELSE 'Current bid level is near-optimal. No adjustment recommended.' END) AS reasoning
  FROM b2)"""

ORACLE["M10_bid_recommendations"] = _M10 + " SELECT * FROM bids"

ORACLE["M10_platform_targets"] = _M10.replace("c_mktsegment AS platform", "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'google' "
    "WHEN 'BUILDING' THEN 'meta' WHEN 'FURNITURE' THEN 'amazon' ELSE lower(c_mktsegment) END AS platform") + " SELECT * FROM bids"

ORACLE["T4_top_bid_rows"] = _M10 + """
, top AS (SELECT * FROM bids ORDER BY platform, campaign_name, campaign_id LIMIT 8)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY platform, campaign_name, campaign_id) AS INTEGER) AS priority, campaign_id, campaign_name,
  recommended_action, confidence FROM top"""

_A6 = f"""
, per6 AS (
  SELECT campaign_id, {csum('impressions')} AS impressions, {csum('clicks')} AS clicks,
    {msum('spend')} AS spend, {csum('conversions')} AS conversions, {msum('revenue')} AS revenue
  FROM v_daily WHERE date BETWEEN {_ALL} GROUP BY campaign_id),
a6 AS (SELECT p.campaign_id, c.campaign_name, c.platform, spend, revenue,
  {ratio_null('revenue', 'spend', 2)} AS roas
  FROM per6 p JOIN v_campaigns c ON p.campaign_id = c.campaign_id)"""

_M12_BODY = f"""
, b12 AS (SELECT *, COALESCE(roas, 0.0) AS r0 FROM a6),
b13 AS (SELECT *, 30.0 / ((r0 * 0.2 + 0.1) * (r0 * 0.2 + 0.1) + {_EPS}) AS w FROM b12),
b14 AS (SELECT *, (w * r0) / ({_PRIOR} + w) AS bm FROM b13),
b15 AS (SELECT *, GREATEST(bm - (SELECT MIN(bm) FROM b14) + 0.1, 0.1) AS sh FROM b14),
tots AS (SELECT SUM(sh) AS tsh, CAST(SUM(CAST(spend AS DECIMAL(18,2))) AS DOUBLE) AS tsp, COUNT(*) AS n FROM b15),
b16 AS (SELECT b15.*, tots.tsp / (SELECT date_diff('day', MIN(date), MAX(date)) + 1 FROM v_daily) AS budget,
   CASE WHEN tots.tsp > 0 THEN spend / tots.tsp ELSE 1.0 / tots.n END AS cur_exact, sh / tots.tsh AS rec_exact FROM b15, tots),
b17 AS (SELECT *, {rnd('cur_exact', 4)} AS current_share, {rnd('rec_exact', 4)} AS recommended_share,
   {rnd('cur_exact * budget', 2)} AS current_daily, {rnd('rec_exact * budget', 2)} AS recommended_daily FROM b16),
alloc AS (SELECT campaign_id, campaign_name, r0 AS roas, {rnd('bm', 4)} AS belief_mean, {rnd('budget', 2)} AS total_daily_budget,
  current_share, recommended_share, current_daily, recommended_daily,
  {rnd('recommended_daily - current_daily', 2)} AS change FROM b17)"""
_M12 = with_views(V_CAMPAIGNS, V_DAILY) + _A6 + _M12_BODY

ORACLE["M12_budget_allocation"] = _M12 + " SELECT * FROM alloc"
ORACLE["A36_current_allocation"] = _M12 + " SELECT campaign_id, current_share, current_daily, total_daily_budget FROM alloc"

_SHIFTS_BODY = f"""
, inc AS (SELECT *, ROW_NUMBER() OVER (ORDER BY change DESC, campaign_id) AS pair_rank FROM alloc WHERE change > total_daily_budget * 0.03),
dec AS (SELECT *, ROW_NUMBER() OVER (ORDER BY change ASC, campaign_id) AS pair_rank FROM alloc WHERE change < -total_daily_budget * 0.03),
pr AS (SELECT inc.pair_rank, inc.campaign_id AS to_campaign, inc.campaign_name AS to_campaign_name, inc.roas AS to_roas,
         dec.campaign_id AS from_campaign, dec.campaign_name AS from_campaign_name, dec.roas AS from_roas,
         {rnd('LEAST(inc.change, ABS(dec.change))', 2)} AS amount, inc.total_daily_budget
       FROM inc JOIN dec ON inc.pair_rank = dec.pair_rank),
shifts AS (SELECT pair_rank, from_campaign, from_campaign_name, to_campaign, to_campaign_name, amount,
  'Shift $' || printf('%.0f', {rnd('amount', 0)}) || '/day from ' || from_campaign_name || ' (ROAS '
   || printf('%.1f', {rnd('from_roas', 1)}) || 'x) to ' || to_campaign_name || ' (ROAS ' || printf('%.1f', {rnd('to_roas', 1)})
   || 'x). The posterior indicates higher expected returns.' AS reasoning,
  CASE WHEN ABS(to_roas - from_roas) > 1.0 THEN 'high' ELSE 'medium' END AS confidence
  FROM pr WHERE amount >= total_daily_budget * 0.02)"""
_SHIFTS = _M12 + _SHIFTS_BODY

ORACLE["M12_budget_shifts"] = _SHIFTS + " SELECT * FROM shifts"

_CHOICES = with_views(V_REWARDS) + """
, arms AS (SELECT arm, CAST(DENSE_RANK() OVER (ORDER BY arm) - 1 AS INTEGER) AS arm_no FROM (SELECT DISTINCT arm FROM v_rewards)),
rr AS (SELECT 'round_robin' AS policy, d.round, arms.arm FROM
        (SELECT DISTINCT round, CAST(date_diff('day', (SELECT MIN(round) FROM v_rewards), round) % (SELECT COUNT(*) FROM arms) AS INTEGER) AS arm_no
         FROM v_rewards) d JOIN arms ON d.arm_no = arms.arm_no),
ftl0 AS (SELECT *, COALESCE(SUM(CAST(reward AS DECIMAL(18,2))) OVER (PARTITION BY arm ORDER BY round
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM v_rewards),
ftl AS (SELECT 'follow_the_leader' AS policy, round, arm FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY round ORDER BY bef DESC, arm) AS rk FROM ftl0) WHERE rk = 1),
choices AS (SELECT * FROM rr UNION ALL SELECT * FROM ftl),
best AS (SELECT round, MAX(CAST(reward AS DECIMAL(18,2))) AS b FROM v_rewards GROUP BY round),
got AS (SELECT c.policy, c.round, c.arm, r.reward, best.b FROM choices c JOIN v_rewards r ON c.round = r.round AND c.arm = r.arm
        JOIN best ON c.round = best.round),
rep AS (SELECT policy, round, arm, CAST(reward AS DOUBLE) AS reward, CAST(b AS DOUBLE) AS oracle_reward,
  CAST(SUM(CAST(reward AS DECIMAL(18,2))) OVER w AS DOUBLE) AS cumulative_reward,
  CAST(SUM(b) OVER w AS DOUBLE) AS cumulative_oracle,
  CAST(SUM(b) OVER w - SUM(CAST(reward AS DECIMAL(18,2))) OVER w AS DOUBLE) AS cumulative_regret
  FROM got WINDOW w AS (PARTITION BY policy ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

ORACLE["W5_policy_replay"] = _CHOICES + " SELECT * FROM rep"

ORACLE["M13_policy_summary"] = _CHOICES + f"""
, per AS (SELECT policy, CAST(SUM(CAST(reward AS DECIMAL(18,2))) AS DOUBLE) AS total_reward,
           CAST(SUM(CAST(oracle_reward AS DECIMAL(18,2))) AS DOUBLE) AS oracle_total, COUNT(*) AS n_rounds FROM rep GROUP BY policy),
ba AS (SELECT arm FROM v_rewards GROUP BY arm ORDER BY SUM(CAST(reward AS DECIMAL(18,2))) DESC, arm DESC LIMIT 1)
SELECT policy, n_rounds, total_reward, oracle_total, {rnd('oracle_total - total_reward', 2)} AS final_regret,
  (SELECT arm FROM ba) AS oracle_best_arm FROM per"""

ORACLE["A37_arm_pull_counts"] = _CHOICES + """
, cnt AS (SELECT policy, arm, COUNT(*) AS n FROM choices GROUP BY policy, arm),
pol AS (SELECT DISTINCT policy FROM choices)
SELECT pol.policy, arms.arm, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS pulls
FROM pol CROSS JOIN arms LEFT JOIN cnt ON cnt.policy = pol.policy AND cnt.arm = arms.arm"""

# segments: platform and whole power of e of the campaign's spend
_SEG = f"""
, per6 AS (SELECT campaign_id, {msum('spend')} AS spend, {msum('revenue')} AS revenue
  FROM v_daily WHERE date BETWEEN {_ALL} GROUP BY campaign_id),
sg0 AS (SELECT c.platform || '/' || CAST(CAST(FLOOR(LN(GREATEST(p.spend, 1.0))) AS BIGINT) AS VARCHAR) AS campaign_id, p.spend, p.revenue
  FROM per6 p JOIN v_campaigns c ON p.campaign_id = c.campaign_id),
sg AS (SELECT campaign_id, {msum('spend')} AS spend, {msum('revenue')} AS revenue FROM sg0 GROUP BY campaign_id),
a6 AS (SELECT campaign_id, campaign_id AS campaign_name, spend, revenue, {ratio_null('revenue', 'spend', 2)} AS roas FROM sg)"""
ORACLE["M12_segment_allocation"] = with_views(V_CAMPAIGNS, V_DAILY) + _SEG + _M12_BODY + " SELECT * FROM alloc"
ORACLE["M12_segment_shifts"] = with_views(V_CAMPAIGNS, V_DAILY) + _SEG + _M12_BODY + _SHIFTS_BODY + " SELECT * FROM shifts"

_RECOMMENDED = _M10 + _SEG + _M12_BODY + _SHIFTS_BODY + """
SELECT CAST(campaign_id AS VARCHAR) AS campaign_id, 'bid_adjustment' AS action_type,
  to_json({'action': recommended_action, 'change_pct': recommended_change_pct,
           'multiplier': recommended_multiplier, 'expected_roas': expected_roas_after}) AS action_detail,
  reasoning, confidence, 'pending' AS status FROM bids
UNION ALL
SELECT CAST(to_campaign AS VARCHAR) AS campaign_id, 'budget_reallocation' AS action_type,
  to_json({'from': from_campaign, 'to': to_campaign, 'amount': amount}) AS action_detail,
  reasoning, confidence, 'pending' AS status FROM shifts"""
# the shifts between campaigns too: names inside the subquery are its own
ORACLE["U2_recommendation_log"] = _RECOMMENDED + """
UNION ALL
SELECT CAST(to_campaign AS VARCHAR) AS campaign_id, 'budget_reallocation' AS action_type,
  to_json({'from': from_campaign, 'to': to_campaign, 'amount': amount}) AS action_detail,
  reasoning, confidence, 'pending' AS status FROM (WITH one AS (SELECT 1)""" + _A6 + _M12_BODY + _SHIFTS_BODY + " SELECT * FROM shifts) c"

_CH = f"""
, per6 AS (SELECT campaign_id, {msum('spend')} AS spend, {msum('revenue')} AS revenue
  FROM v_daily WHERE date BETWEEN {_ALL} GROUP BY campaign_id),
ch AS (SELECT c.platform, {msum('p.spend')} AS spend, {msum('p.revenue')} AS revenue
  FROM per6 p JOIN v_campaigns c ON p.campaign_id = c.campaign_id GROUP BY c.platform),
a6 AS (SELECT platform AS campaign_id, platform AS campaign_name, spend, revenue,
  {ratio_null('revenue', 'spend', 2)} AS roas FROM ch)"""

ORACLE["M12_channel_allocation"] = with_views(V_CAMPAIGNS, V_DAILY) + _CH + _M12_BODY + " SELECT * FROM alloc"
ORACLE["M12_channel_shifts"] = with_views(V_CAMPAIGNS, V_DAILY) + _CH + _M12_BODY + _SHIFTS_BODY + " SELECT * FROM shifts"

# ── Phase 5: forecast ────────────────────────────────────────────────
V_SERIES = """v_series_w AS (
  SELECT 'priority:' || o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, CAST(COUNT(*) AS DOUBLE) AS n,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1, 2
  UNION ALL
  SELECT 'event:' || event_type, CAST(ts AS DATE), CAST(COUNT(*) AS DOUBLE),
    CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) FROM events GROUP BY 1, 2),
v_series AS (SELECT series, date, 'n' AS metric, n AS value FROM v_series_w
  UNION ALL SELECT series, date, 'amount' AS metric, amount AS value FROM v_series_w)"""

_K = "series, metric"
_LIN = with_views(V_SERIES) + f"""
, p0 AS (SELECT series, metric, date, value AS y, ROW_NUMBER() OVER (PARTITION BY {_K} ORDER BY date DESC) AS rn,
    COUNT(*) OVER (PARTITION BY {_K}) AS n_rows FROM v_series),
p1 AS (SELECT *, CAST(LEAST(15, FLOOR(n_rows / 4)) AS INTEGER) AS test_days FROM p0 WHERE n_rows >= 30),
p2 AS (SELECT *, rn <= test_days AS is_test, date_diff('day', MIN(date) OVER (PARTITION BY {_K}), date) AS t,
    GREATEST(y, 1.0) AS y_fit, dayname(date) AS dow FROM p1),
fit AS (SELECT {_K},
    REGR_SLOPE(CASE WHEN NOT is_test THEN y_fit END, CASE WHEN NOT is_test THEN t END) AS bt_slope,
    REGR_INTERCEPT(CASE WHEN NOT is_test THEN y_fit END, CASE WHEN NOT is_test THEN t END) AS bt_icpt,
    REGR_SLOPE(y_fit, t) AS slope, REGR_INTERCEPT(y_fit, t) AS icpt,
    MIN(date) AS first_date, MAX(date) AS last_date, MAX(t) AS last_t FROM p2 GROUP BY {_K}),
p3 AS (SELECT p2.*, fit.bt_slope, fit.bt_icpt, fit.slope, fit.icpt,
    y_fit - (fit.bt_icpt + fit.bt_slope * t) AS bt_res, y_fit - (fit.icpt + fit.slope * t) AS res
    FROM p2 JOIN fit USING (series, metric)),
eff AS (SELECT {_K}, dow, AVG(CASE WHEN NOT is_test THEN bt_res END) AS bt_eff, AVG(res) AS eff FROM p3 GROUP BY {_K}, dow),
p4 AS (SELECT p3.*, (bt_icpt + bt_slope * t) + COALESCE(eff.bt_eff, 0.0) AS bt_pred,
    (icpt + slope * t) + eff.eff AS fitted FROM p3 LEFT JOIN eff USING (series, metric, dow)),
sd AS (SELECT {_K}, STDDEV_POP(CASE WHEN NOT is_test THEN y_fit - bt_pred END) AS bt_sd,
    STDDEV_POP(y_fit - fitted) AS sd FROM p4 GROUP BY {_K}),
p5 AS (SELECT p4.*, sd.bt_sd, sd.sd FROM p4 JOIN sd USING (series, metric)),
backtest AS (SELECT series, metric, date, y AS actual, {rnd('bt_pred', 4)} AS predicted,
    {rnd('bt_pred - 1.28 * bt_sd', 4)} AS lower, {rnd('bt_pred + 1.28 * bt_sd', 4)} AS upper FROM p5 WHERE is_test),
hist AS (SELECT series, metric, date, y AS actual, {rnd('fitted', 4)} AS predicted,
    {rnd('fitted - 1.28 * sd', 4)} AS lower, {rnd('fitted + 1.28 * sd', 4)} AS upper, FALSE AS is_forecast FROM p5),
fut0 AS (SELECT fit.*, sd.sd, h, CAST(fit.last_date + CAST(h AS INTEGER) AS DATE) AS date
    FROM fit JOIN sd USING (series, metric), range(1, 15) r(h)),
fut1 AS (SELECT fut0.*, date_diff('day', first_date, date) AS t, dayname(date) AS dow FROM fut0),
fut AS (SELECT f.series, f.metric, f.date, CAST(NULL AS DOUBLE) AS actual,
    (icpt + slope * t) + COALESCE(e.eff, 0.0) AS fp, sd FROM fut1 f LEFT JOIN eff e USING (series, metric, dow)),
forecast AS (SELECT * FROM hist UNION ALL SELECT series, metric, date, actual, {rnd('fp', 4)} AS predicted,
    {rnd('fp - 1.28 * sd', 4)} AS lower, {rnd('fp + 1.28 * sd', 4)} AS upper, TRUE AS is_forecast FROM fut)"""

# least squares on the day and one regressor, by the normal equations of centred rows; a
# regressor without variance of its own beside the day has the coefficient 0
def _two(pre: str, rows: str) -> str:
    m = {c: f"AVG({c}) FILTER ({rows})" for c in ("t", "s", "y_fit")}
    g = lambda a, b: f"COVAR_POP({a}, {b}) FILTER ({rows})"
    return ", ".join([f"{m[c]} AS {pre}m_{c}" for c in m] + [
        f"{g('t', 't')} AS {pre}tt, {g('t', 's')} AS {pre}ts, {g('s', 's')} AS {pre}ss, "
        f"{g('t', 'y_fit')} AS {pre}ty, {g('s', 'y_fit')} AS {pre}sy"])


def _solved(pre: str) -> str:
    own = f"({pre}ss - {pre}ts * {pre}ts / {pre}tt)"
    b1 = f"(CASE WHEN {own} > 1e-9 * {pre}ss THEN ({pre}sy - {pre}ts / {pre}tt * {pre}ty) / {own} ELSE 0.0 END)"
    b0 = f"(({pre}ty - {pre}ts * {b1}) / {pre}tt)"
    return (f"{b0} AS {pre}slope, {b1} AS {pre}b1, "
            f"{pre}m_y_fit - {b0} * {pre}m_t - {b1} * {pre}m_s AS {pre}icpt")


_X_TREND = """, x_avg AS (SELECT date, AVG(CAST(interest AS DOUBLE)) AS st FROM v_trends
    WHERE keyword IN (SELECT keyword FROM (SELECT DISTINCT keyword FROM v_trends) ORDER BY keyword LIMIT 3) GROUP BY date),
x_series AS (SELECT v.*, COALESCE(LAST_VALUE(st IGNORE NULLS) OVER (PARTITION BY series, metric ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FIRST_VALUE(st IGNORE NULLS) OVER (PARTITION BY series, metric
      ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS s
    FROM v_series v LEFT JOIN x_avg USING (date))"""
_LIN_X = with_views(V_SERIES, V_TRENDS) + _X_TREND + f"""
, p0 AS (SELECT series, metric, date, value AS y, s, ROW_NUMBER() OVER (PARTITION BY {_K} ORDER BY date DESC) AS rn,
    COUNT(*) OVER (PARTITION BY {_K}) AS n_rows FROM x_series),
p1 AS (SELECT *, rn <= CAST(LEAST(15, FLOOR(n_rows / 4)) AS INTEGER) AS is_test FROM p0 WHERE n_rows >= 30),
p2 AS (SELECT *, CAST(date_diff('day', MIN(date) OVER (PARTITION BY {_K}), date) AS DOUBLE) AS t,
    GREATEST(y, 1.0) AS y_fit, dayname(date) AS dow FROM p1),
fit0 AS (SELECT {_K}, MIN(date) AS first_date, MAX(date) AS last_date, arg_max(s, date) AS s_last,
    arg_max(s, date) FILTER (NOT is_test) AS s_head, {_two('', 'TRUE')}, {_two('bt_', 'NOT is_test')} FROM p2 GROUP BY {_K}),
fit AS (SELECT {_K}, first_date, last_date, s_last, s_head, {_solved('')}, {_solved('bt_')} FROM fit0),
p3 AS (SELECT p2.*, fit.* EXCLUDE (series, metric), y_fit - (bt_icpt + bt_slope * t + bt_b1 * s) AS bt_res,
    y_fit - (icpt + slope * t + b1 * s) AS res FROM p2 JOIN fit USING (series, metric)),
eff AS (SELECT {_K}, dow, AVG(bt_res) FILTER (NOT is_test) AS bt_eff, AVG(res) AS eff FROM p3 GROUP BY {_K}, dow),
p4 AS (SELECT p3.*, icpt + slope * t + b1 * s + eff.eff AS fitted, bt_res - COALESCE(eff.bt_eff, 0.0) AS bt_left,
    bt_icpt + bt_slope * t + bt_b1 * s_head + COALESCE(eff.bt_eff, 0.0) AS bt_pred
    FROM p3 LEFT JOIN eff USING (series, metric, dow)),
sd AS (SELECT {_K}, STDDEV_POP(bt_left) FILTER (NOT is_test) AS bt_sd, STDDEV_POP(y_fit - fitted) AS sd FROM p4 GROUP BY {_K}),
ahead AS (SELECT f.*, CAST(last_date + CAST(h AS INTEGER) AS DATE) AS date FROM fit f, range(1, 15) r(h)),
pred AS (SELECT {_K}, date, y AS actual, fitted, FALSE AS is_forecast FROM p4
  UNION ALL SELECT a.series, a.metric, a.date, NULL, icpt + slope * date_diff('day', first_date, a.date) + b1 * s_last
    + COALESCE(e.eff, 0.0), TRUE FROM ahead a LEFT JOIN eff e ON e.series = a.series AND e.metric = a.metric
    AND e.dow = dayname(a.date))"""
ORACLE["M1_regressor_forecast"] = _LIN_X + f""" SELECT series, metric, date, actual, {rnd('fitted', 4)} AS predicted,
  {rnd('fitted - 1.28 * sd', 4)} AS lower, {rnd('fitted + 1.28 * sd', 4)} AS upper, is_forecast FROM pred JOIN sd USING (series, metric)"""
ORACLE["M1_regressor_backtest"] = _LIN_X + f""" SELECT series, metric, date, y AS actual, {rnd('bt_pred', 4)} AS predicted,
  {rnd('bt_pred - 1.28 * bt_sd', 4)} AS lower, {rnd('bt_pred + 1.28 * bt_sd', 4)} AS upper
  FROM p4 JOIN sd USING (series, metric) WHERE is_test"""
ORACLE["M1_linear_forecast"] = _LIN + " SELECT * FROM forecast"
ORACLE["M1_linear_backtest"] = _LIN + " SELECT * FROM backtest"
ORACLE["A20_forecast_evaluation"] = _LIN + f"""
, ev AS (SELECT {_K}, COUNT(*) AS test_days,
    AVG(CASE WHEN actual <> 0 THEN ABS((actual - predicted) / actual) END) AS m,
    AVG(ABS(actual - predicted)) AS mae0, SQRT(AVG((actual - predicted) * (actual - predicted))) AS rmse0,
    AVG(CAST((actual >= lower AND actual <= upper) AS DOUBLE)) AS cov FROM backtest GROUP BY {_K}),
ev2 AS (SELECT {_K}, test_days, {rnd('COALESCE(m * 100, 0.0)', 2)} AS mape, {rnd('mae0', 2)} AS mae,
    {rnd('rmse0', 2)} AS rmse, {rnd('cov', 4)} AS coverage FROM ev)
SELECT *, mape < 20 AS mape_good, coverage >= 0.70 AS coverage_good FROM ev2"""
ORACLE["A19_weekly_profile"] = _LIN + f"""
, days AS (SELECT * FROM (VALUES {", ".join(f"('{d}', {i})" for i, d in enumerate(_DAYS))}) t(dow, dow_index)),
g AS (SELECT DISTINCT series, metric FROM eff)
SELECT g.series, g.metric, days.dow, days.dow_index, {rnd('COALESCE(eff.eff, 0.0)', 2)} AS effect
FROM g CROSS JOIN days LEFT JOIN eff ON eff.series = g.series AND eff.metric = g.metric AND eff.dow = days.dow"""
ORACLE["A19_trend_direction"] = _LIN + f"""
SELECT {_K}, {rnd('icpt', 2)} AS trend_start, {rnd('icpt + slope * (last_t + 14)', 2)} AS trend_end,
  CASE WHEN slope * (last_t + 14) > 0 THEN 'up' ELSE 'down' END AS direction FROM fit"""

_U3 = " UNION ALL ".join(
    f"SELECT campaign_id, date, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM v_daily"
    for m in ("clicks", "conversions", "spend", "revenue"))
ORACLE["U3_metric_series"] = with_views(V_DAILY) + _U3
ORACLE["M1_rejected_series"] = with_views(V_DAILY) + f"""
SELECT campaign_id, metric, COUNT(*) AS n_rows FROM ({_U3}) GROUP BY campaign_id, metric HAVING COUNT(*) < 30"""

_J7 = with_views(
    V_CAMPAIGNS.replace("c_name AS campaign_name", "c_name || ' ' || (['Gaming Laptop', 'Headphones', '4K Monitor', "
                        "'Laptop and Monitor', 'Chairs', 'Earbuds'])[c_custkey % 6 + 1] AS campaign_name"),
    V_TRENDS.replace("event_type AS keyword", "CASE event_type WHEN 'view' THEN 'laptop' WHEN 'click' THEN 'headphones' "
                     "WHEN 'purchase' THEN 'computer monitor' ELSE event_type END AS keyword")) + """
, trig AS (SELECT * FROM (VALUES ('laptop', 'laptop'), ('headphone', 'headphones'), ('monitor', 'computer monitor'),
    ('earbud', 'wireless earbuds'), ('keyboard', 'gaming keyboard')) t(trig, keyword)),
hits AS (SELECT c.campaign_id, t.keyword FROM v_campaigns c JOIN trig t ON contains(lower(c.campaign_name), t.trig)),
dflt AS (SELECT keyword FROM (SELECT DISTINCT keyword FROM v_trends) ORDER BY keyword LIMIT 3),
m0 AS (SELECT * FROM hits UNION ALL SELECT c.campaign_id, d.keyword FROM v_campaigns c CROSS JOIN dflt d
       WHERE c.campaign_id NOT IN (SELECT campaign_id FROM hits)),
kmap AS (SELECT DISTINCT campaign_id, keyword FROM m0 WHERE keyword IN (SELECT keyword FROM v_trends))"""
ORACLE["J7_trend_keywords"] = _J7 + " SELECT campaign_id, keyword FROM kmap"

ORACLE["J5_trend_regressor"] = _J7.replace("WITH ", "WITH " + V_DAILY + ",\n", 1) + """
, reg AS (SELECT k.campaign_id, t.date, AVG(CAST(t.interest AS DOUBLE)) AS search_trend
          FROM kmap k JOIN v_trends t ON k.keyword = t.keyword GROUP BY 1, 2),
lst AS (SELECT campaign_id, MAX(date) AS last FROM v_daily GROUP BY campaign_id),
rows0 AS (SELECT campaign_id, date, clicks, FALSE AS is_forecast FROM v_daily
  UNION ALL SELECT campaign_id, CAST(last + CAST(h AS INTEGER) AS DATE), CAST(NULL AS BIGINT), TRUE FROM lst, range(1, 15) r(h)),
j AS (SELECT r.*, reg.search_trend AS st FROM rows0 r LEFT JOIN reg ON r.campaign_id = reg.campaign_id AND r.date = reg.date)
SELECT campaign_id, date, clicks, is_forecast, COALESCE(
  LAST_VALUE(st IGNORE NULLS) OVER (PARTITION BY campaign_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  FIRST_VALUE(st IGNORE NULLS) OVER (PARTITION BY campaign_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) AS search_trend FROM j"""

# ── Phase 6: learn and text ──────────────────────────────────────────
_P = 2147483647


def _pmod(x: str) -> str:
    return f"((({x}) % {_P}) + {_P}) % {_P}"


def portable_hash_sql(cols, seed: int = 42) -> str:
    x = str(seed % _P)
    for c in cols:
        x = _pmod(f"CAST({x} AS BIGINT) * 1000003 + {_pmod(f'CAST({c} AS BIGINT)')}")
    x = _pmod(f"({x}) * 48271")
    return _pmod(f"({x}) * 69621")


_CLICK_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice",
               "p_brand", "p_type", "p_name", "l_linestatus"]
_SPLIT = with_views(V_CLICKS) + f"""
, h AS (SELECT *, {portable_hash_sql(['l_orderkey', 'l_linenumber'])} AS hh FROM v_clicks),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY hh, l_orderkey, l_linenumber, {", ".join(sorted(_CLICK_COLS))}) AS rk,
        COUNT(*) OVER (PARTITION BY label) AS n FROM h),
r2 AS (SELECT *, CEIL(n * CAST(0.15 AS DOUBLE)) AS n_test FROM r),
r3 AS (SELECT *, CEIL((n - n_test) * CAST(0.176 AS DOUBLE)) AS n_val FROM r2),
spl AS (SELECT * EXCLUDE (hh, rk, n, n_test, n_val),
  CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM r3)"""

ORACLE["M3_stratified_split"] = _SPLIT + " SELECT l_orderkey, l_linenumber, label, split FROM spl"

_CAT = ["p_brand", "p_type", "p_name", "l_linestatus"]
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]
_VOCAB = _SPLIT + """
, lng AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, COALESCE(CAST({c} AS VARCHAR), '__MISSING__') AS value FROM spl WHERE split = 'train'"
    for c in _CAT) + """),
cnt AS (SELECT col, value, COUNT(*) AS n FROM lng GROUP BY col, value),
vocab AS (SELECT col AS "column", value, CAST(ROW_NUMBER() OVER (PARTITION BY col ORDER BY n DESC, value) AS INTEGER) AS code, n
          FROM cnt QUALIFY code <= 10000)"""

ORACLE["A21_vocabulary"] = _VOCAB + " SELECT * FROM vocab"

ORACLE["M2_transform"] = _VOCAB + """
SELECT spl.l_orderkey, spl.l_linenumber, spl.label, spl.split, """ + ", ".join(
    f"{rnd(f'ln(1 + ABS(COALESCE(CAST(spl.{c} AS DOUBLE), 0.0)))', 9)} AS {c}" for c in _NUM) + ", " + ", ".join(
    f"COALESCE(v_{c}.code, 0) AS {c}" for c in _CAT) + " FROM spl " + " ".join(
    f"""LEFT JOIN (SELECT value, code FROM vocab WHERE "column" = '{c}') v_{c}
        ON COALESCE(CAST(spl.{c} AS VARCHAR), '__MISSING__') = v_{c}.value""" for c in _CAT)

ORACLE["S2_read_click_log"] = with_views(V_CLICKS) + "SELECT label, " + ", ".join(_NUM + _CAT) + " FROM v_clicks"
_S2_COLS = ["label"] + _NUM + _CAT
ORACLE["S2_sampled_click_log"] = with_views(V_CLICKS) + f"""
SELECT {", ".join(_S2_COLS)} FROM v_clicks ORDER BY CAST('0x' || substr(md5(concat_ws('|', '42', {", ".join(
    f"COALESCE(CAST({c} AS VARCHAR), '')" for c in _S2_COLS)})), 1, 8) AS BIGINT) // 2, {", ".join(sorted(_S2_COLS))} LIMIT 20000"""

_LL_EPS = "CAST('2.220446049250313e-16' AS DOUBLE)"
_LL_HI = f"CAST('{1 - 2.220446049250313e-16!r}' AS DOUBLE)"
ORACLE["A22_binary_metrics"] = with_views(V_CLICKS, V_SCORED) + f"""
, g AS (SELECT score AS s, CAST(SUM(label) AS BIGINT) AS pos, CAST(COUNT(*) - SUM(label) AS BIGINT) AS neg
        FROM v_scored GROUP BY score),
c AS (SELECT *, SUM(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
        SUM(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g),
tt AS (SELECT CAST(SUM(pos) AS BIGINT) AS P, CAST(SUM(neg) AS BIGINT) AS N FROM g),
a AS (SELECT SUM(neg * (CAST(cp - pos AS DOUBLE) + CAST(pos AS DOUBLE) / 2.0)) AS auc,
        SUM(CASE WHEN pos > 0 THEN pos * (CAST(cp AS DOUBLE) / CAST(cp + cn AS DOUBLE)) END) AS ap FROM c),
ll AS (SELECT AVG(-(label * ln(p) + (1 - label) * ln(1 - p))) AS ll
       FROM (SELECT label, LEAST(GREATEST(score, {_LL_EPS}), {_LL_HI}) AS p FROM v_scored))
SELECT {rnd('auc / CAST(P * N AS DOUBLE)', 4)} AS auc_roc, {rnd('ap / CAST(P AS DOUBLE)', 4)} AS pr_auc,
  {rnd('ll', 4)} AS log_loss, {rnd('CAST(P AS DOUBLE) / CAST(P + N AS DOUBLE)', 4)} AS base_rate,
  CAST(P + N AS BIGINT) AS test_size FROM a, tt, ll"""

ORACLE["A23_calibration"] = with_views(V_CLICKS, V_SCORED) + f"""
, b AS (SELECT CAST(LEAST(FLOOR(score * 10), 9) AS INTEGER) AS bin, score, label FROM v_scored),
t AS (SELECT bin, COUNT(*) AS n, AVG(score) AS mp, AVG(CAST(label AS DOUBLE)) AS fp FROM b GROUP BY bin),
e AS (SELECT SUM(n / (SELECT COUNT(*) FROM v_scored) * ABS(fp - mp)) AS ece FROM t)
SELECT bin, n, {rnd('mp', 4)} AS mean_predicted, {rnd('fp', 4)} AS fraction_positive, {rnd('ece', 4)} AS ece FROM t, e"""


def _stop_sql() -> str:
    from adlens.functions.text import ENGLISH_STOP_WORDS
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"


_TFIDF = with_views(V_ADS) + f"""
, tok AS (SELECT ad_id AS doc_id, list_filter(regexp_extract_all(lower(COALESCE(ad_copy, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
            lambda x: NOT list_contains({_stop_sql()}, x)) AS t FROM v_ads),
trm AS (SELECT doc_id, CASE WHEN len(t) < 2 THEN t ELSE
          list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END AS terms FROM tok),
tc AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM trm) GROUP BY doc_id, term),
nd AS (SELECT COUNT(*) AS n FROM v_ads),
st AS (SELECT term, COUNT(*) AS df, SUM(tf) AS corpus_tf FROM tc GROUP BY term),
kept AS (SELECT st.* FROM st, nd WHERE df >= CASE WHEN nd.n > 10 THEN 2 ELSE 1 END AND df <= nd.n * CAST(0.85 AS DOUBLE)),
vocab AS (SELECT term, CAST(ROW_NUMBER() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index, df, CAST(corpus_tf AS BIGINT) AS corpus_tf
          FROM (SELECT * FROM kept ORDER BY corpus_tf DESC, term LIMIT 500)),
w AS (SELECT tc.doc_id, tc.term, (1.0 + ln(CAST(tc.tf AS DOUBLE)))
         * (ln((CAST(1 AS DOUBLE) + nd.n) / (CAST(1 AS DOUBLE) + vocab.df)) + 1.0) AS raw
      FROM tc JOIN vocab ON tc.term = vocab.term CROSS JOIN nd),
weights AS (SELECT doc_id, term, raw / SQRT(SUM(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w),
cat AS (SELECT ad_id AS doc_id, category FROM v_ads),
gs AS (SELECT category, COUNT(*) AS n_docs FROM cat GROUP BY category),
mw AS (SELECT c.category, w.term, SUM(w.weight) / gs.n_docs AS mean_weight
       FROM weights w JOIN cat c ON w.doc_id = c.doc_id JOIN gs ON c.category = gs.category
       GROUP BY c.category, w.term, gs.n_docs),
tops AS (SELECT category, list(term ORDER BY r) AS top_terms FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY ROUND(mean_weight, 12) DESC, term) AS r FROM mw)
         WHERE r <= 10 GROUP BY category)"""

ORACLE["M6_tfidf_weights"] = _TFIDF + f" SELECT doc_id, term, {rnd('weight', 9)} AS weight FROM weights"
ORACLE["M6_vocabulary"] = _TFIDF + " SELECT term, term_index, df, corpus_tf FROM vocab"
ORACLE["A25_mean_tfidf_per_group"] = _TFIDF + f" SELECT category, term, {rnd('mean_weight', 9)} AS mean_weight FROM mw"
ORACLE["T3_top_terms"] = _TFIDF + " SELECT category, top_terms FROM tops"


def _label_kw_sql() -> str:
    from adlens.operators.text import LABEL_KEYWORDS
    return ", ".join(f"('{lbl}', '{k}')" for lbl, ks in LABEL_KEYWORDS.items() for k in ks)


ORACLE["J11_label_scores"] = _TFIDF + f"""
, kw AS (SELECT * FROM (VALUES {_label_kw_sql()}) t(label, keyword)),
tt AS (SELECT category, unnest(top_terms) AS term FROM tops)
SELECT category, label, COUNT(DISTINCT keyword) AS score FROM tt CROSS JOIN kw
WHERE contains(term, keyword) OR contains(keyword, term) GROUP BY category, label"""

def _fold_sql() -> str:
    """Labels of the groups in order, one recursion step a group."""
    from adlens.operators.text import LABEL_KEYWORDS
    place = " ".join(f"WHEN '{lbl}' THEN {i}" for i, lbl in enumerate(LABEL_KEYWORDS))
    first = "COALESCE(list_filter(g.liked, lambda x: NOT list_contains(r.taken, x))[1], 'Other')"
    label = f"CASE WHEN list_contains(r.taken, {first}) THEN {first} || ' (2)' ELSE {first} END"
    return f"""
, kw AS (SELECT * FROM (VALUES {_label_kw_sql()}) t(label, keyword)),
tt AS (SELECT category, unnest(top_terms) AS term FROM tops),
js AS (SELECT category, label, COUNT(DISTINCT keyword) AS score FROM tt CROSS JOIN kw
  WHERE contains(term, keyword) OR contains(keyword, term) GROUP BY category, label),
lk AS (SELECT category, list(label ORDER BY score DESC, CASE label {place} END) AS liked FROM js GROUP BY category),
gr AS (SELECT category, ROW_NUMBER() OVER (ORDER BY category) AS pos, COALESCE(liked, CAST([] AS VARCHAR[])) AS liked
  FROM (SELECT DISTINCT category FROM v_ads) LEFT JOIN lk USING (category)),
fold AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS label, CAST([] AS VARCHAR[]) AS taken
  UNION ALL SELECT g.pos, g.category, {label}, list_append(r.taken, {label}) FROM fold r JOIN gr g ON g.pos = r.pos + 1),
lb AS (SELECT category, label FROM fold WHERE pos > 0),
nads AS (SELECT category, COUNT(*) AS n_ads FROM v_ads GROUP BY category)"""


_M9 = _TFIDF.replace("WITH ", "WITH RECURSIVE ", 1) + _fold_sql()
ORACLE["M9_group_labels"] = _M9 + " SELECT category, label FROM lb"
ORACLE["M9_group_summary"] = _M9 + """
SELECT category, n_ads, top_terms, label FROM nads LEFT JOIN tops USING (category) JOIN lb USING (category)"""
ORACLE["S16_store_cluster_results"] = _M9 + """
, new AS (SELECT CAST(category AS BIGINT) AS cluster_id, label AS cluster_label, top_terms, n_ads, DATE '2024-01-31' AS analysis_date
  FROM nads LEFT JOIN tops USING (category) JOIN lb USING (category)),
ids AS (SELECT DISTINCT CAST(category AS BIGINT) AS cluster_id FROM v_ads)
SELECT * FROM new
UNION ALL SELECT cluster_id, 'Stale', ['old'], CAST(1 AS BIGINT), DATE '2024-01-30' FROM ids
UNION ALL SELECT cluster_id + 100, 'Stale', ['old'], CAST(1 AS BIGINT), DATE '2024-01-31' FROM ids"""

ORACLE["A26_group_sizes"] = with_views(V_ADS) + "SELECT category, COUNT(*) AS n_ads FROM v_ads GROUP BY category"

ORACLE["A10_crosstab"] = with_views(V_ADS) + "SELECT advertiser_name, " + ", ".join(
    f"COUNT(*) FILTER (WHERE platform = '{p}') AS {p}" for p in ("de", "en", "es", "fr")) + \
    " FROM v_ads GROUP BY advertiser_name"

ORACLE["A11_dominant"] = with_views(V_ADS) + """
, c AS (SELECT advertiser_name, platform, COUNT(*) AS n FROM v_ads GROUP BY 1, 2)
SELECT advertiser_name, platform AS dominant_platform, n FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY advertiser_name ORDER BY n DESC, platform) AS r FROM c) WHERE r = 1"""

# ── Phase 3: ingest and sinks ────────────────────────────────────────
_UPL = with_views(V_CAMPAIGNS, V_DAILY) + f"""
, up AS (SELECT CAST(d.campaign_id AS VARCHAR) AS campaign_id, d.date, impressions, clicks, conversions, spend,
           CASE WHEN d.date >= DATE '2024-01-25' THEN revenue * 2 ELSE revenue END AS revenue, c.campaign_name
         FROM v_daily d JOIN v_campaigns c ON d.campaign_id = c.campaign_id),
upr AS (SELECT *, {ratio_zero('clicks', 'impressions', 6)} AS ctr, {ratio_zero('spend', 'clicks', 4)} AS cpc,
          {ratio_zero('revenue', 'spend', 4)} AS roas FROM up)"""

# the last file of the upload: of the rows of one day the fifth part loads, with a clamped spend
_BAD = """, bad AS (SELECT CAST(d.campaign_id AS VARCHAR) AS campaign_id, d.campaign_id % 5 AS k, DATE '2024-02-05' AS date, impressions,
    clicks, conversions, CAST(0.0 AS DOUBLE) AS spend, revenue, c.campaign_name, ROW_NUMBER() OVER (ORDER BY d.campaign_id) AS row
  FROM v_daily d JOIN v_campaigns c ON d.campaign_id = c.campaign_id WHERE d.date = DATE '2024-01-05')"""
_RATIOS = (f"{ratio_zero('clicks', 'impressions', 6)} AS ctr, {ratio_zero('spend', 'clicks', 4)} AS cpc, "
           f"{ratio_zero('revenue', 'spend', 4)} AS roas")
ORACLE["S5_validate_upload"] = with_views(V_CAMPAIGNS, V_DAILY) + _BAD + f"""
, up AS (SELECT CAST(d.campaign_id AS VARCHAR) AS campaign_id, d.date, impressions, clicks, conversions, spend, revenue,
           c.campaign_name FROM v_daily d JOIN v_campaigns c ON d.campaign_id = c.campaign_id),
both_ AS (SELECT * FROM up UNION ALL SELECT campaign_id, date, impressions, clicks, conversions, spend, revenue * 2, campaign_name
          FROM up WHERE date >= DATE '2024-01-25'
          UNION ALL SELECT campaign_id, date, impressions, clicks, conversions, spend, revenue, campaign_name FROM bad WHERE k = 4)
SELECT campaign_id, date, impressions, clicks, conversions, spend, revenue, {_RATIOS},
  campaign_name, 'google' AS platform, CAST(0.0 AS DOUBLE) AS daily_budget FROM both_"""

ORACLE["S6_upsert_metrics"] = _UPL + _BAD + f"""
SELECT campaign_id, date, impressions, clicks, conversions, spend, revenue, ctr, cpc, roas FROM upr
UNION ALL SELECT campaign_id, date, impressions, clicks, conversions, spend, revenue, {_RATIOS} FROM bad WHERE k = 4
UNION ALL SELECT CAST(campaign_id AS VARCHAR), CAST(date - INTERVAL 12 MONTH AS DATE), impressions, clicks, conversions, spend, revenue,
  ctr, cpc, roas FROM v_daily WHERE date < DATE '2024-01-16'"""

ORACLE["S7_upsert_campaigns"] = with_views(V_CAMPAIGNS, V_DAILY) + """
, seen AS (SELECT DISTINCT campaign_id FROM v_daily)
SELECT CAST(c.campaign_id AS VARCHAR) AS campaign_id, c.campaign_name,
  CASE WHEN s.campaign_id IS NULL THEN c.platform ELSE 'google' END AS platform, 'active' AS status,
  CASE WHEN s.campaign_id IS NULL THEN c.daily_budget ELSE 0.0 END AS daily_budget
FROM v_campaigns c LEFT JOIN seen s ON c.campaign_id = s.campaign_id"""

ORACLE["S8_ingestion_report"] = with_views(V_CAMPAIGNS, V_DAILY) + _BAD + """
, n AS (SELECT COUNT(*) + COUNT(*) FILTER (WHERE date >= DATE '2024-01-25') AS total,
          COUNT(DISTINCT campaign_id) AS nc FROM v_daily),
w AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE k = 4) AS ok FROM bad),
e AS (SELECT row, 'Row ' || CAST(row AS VARCHAR) || ': ' || CASE k WHEN 0 THEN 'missing campaign id' WHEN 1 THEN 'invalid date'
        WHEN 2 THEN 'invalid count' ELSE 'invalid amount' END AS text FROM bad WHERE k <> 4 ORDER BY row LIMIT 20)
SELECT 'partial' AS status, 'google' AS platform_detected, n.total + w.total AS rows_total, n.total + w.ok AS rows_loaded,
  w.total - w.ok AS rows_skipped, w.ok AS rows_clamped, nc AS n_campaigns,
  (SELECT list(text ORDER BY row) FROM e) AS errors FROM n, w"""

_COMP = """
SELECT ad_id, advertiser_name, platform, ad_copy, headline, cta, category, first_seen, last_seen, is_active, spend_tier
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ad_id ORDER BY headline, category, cta, spend_tier) AS rn FROM (
SELECT sha256(concat_ws(chr(1), advertiser_name, lower(upper(platform)), ad_copy)) AS ad_id, advertiser_name,
  lower(upper(platform)) AS platform, ad_copy, {headline} AS headline, {cta} AS cta, category,
  DATE '{seen}' AS first_seen, DATE '{seen}' AS last_seen, TRUE AS is_active, lower(upper(spend_tier)) AS spend_tier
FROM v_ads WHERE ad_copy IS NOT NULL AND trim(ad_copy) <> '')) WHERE rn = 1"""

ORACLE["S9_competitor_ingest"] = with_views(V_ADS) + _COMP.format(headline="headline", cta="''", seen="2024-01-31")
ORACLE["S10_competitor_upsert"] = with_views(V_ADS) + f"""
, o AS ({_COMP.format(headline="headline", cta="''", seen="2024-01-31").replace("FROM v_ads WHERE", "FROM v_ads WHERE category <> '1' AND")}),
n AS ({_COMP.format(headline="headline || ' v2'", cta="'Buy now'", seen="2024-02-01").replace("FROM v_ads WHERE", "FROM v_ads WHERE category <> '2' AND")})
SELECT COALESCE(o.ad_id, n.ad_id) AS ad_id, COALESCE(o.advertiser_name, n.advertiser_name) AS advertiser_name,
  COALESCE(o.platform, n.platform) AS platform, COALESCE(n.ad_copy, o.ad_copy) AS ad_copy, COALESCE(n.headline, o.headline) AS headline,
  COALESCE(o.cta, n.cta) AS cta, COALESCE(o.category, n.category) AS category, COALESCE(o.first_seen, n.first_seen) AS first_seen,
  COALESCE(n.last_seen, o.last_seen) AS last_seen, COALESCE(n.is_active, o.is_active) AS is_active,
  COALESCE(n.spend_tier, o.spend_tier) AS spend_tier FROM o FULL JOIN n ON o.ad_id = n.ad_id"""

ORACLE["S11_trends_wide_to_long"] = with_views(V_TRENDS) + "SELECT keyword, date, interest FROM v_trends"
ORACLE["S12_upsert_trends"] = with_views(V_TRENDS) + \
    "SELECT keyword, date, interest + CASE WHEN date >= DATE '2024-01-15' THEN 2 ELSE 0 END AS interest FROM v_trends"

_S15_ROWS = {"campaigns": "v_campaigns", "daily_metrics": "v_daily", "forecasts": "v_allfc", "recommendations": "v_campaigns",
             "search_trends": "v_trends", "competitor_ads": "(SELECT * FROM v_ads WHERE ad_copy IS NOT NULL)",
             "competitor_clusters": "(SELECT DISTINCT category FROM v_ads)"}
ORACLE["S15_truncate"] = with_views(V_CAMPAIGNS, V_DAILY, V_ALL_FC, V_TRENDS, V_ADS) + " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, COUNT(*) AS rows_before, " + ("COUNT(*)" if name.startswith("competitor") else "CAST(0 AS BIGINT)")
    + f" AS rows_after FROM {rows}" for name, rows in _S15_ROWS.items())

ORACLE["S17_export_csv"] = with_views(V_CAMPAIGNS, V_DAILY) + """
SELECT d.campaign_id, d.date, impressions, clicks, conversions, spend, revenue, c.campaign_name, c.platform
FROM v_daily d JOIN v_campaigns c ON d.campaign_id = c.campaign_id"""

ORACLE["S18_json_roundtrip"] = ORACLE["M12_budget_allocation"]

ORACLE["S21_preview"] = with_views(V_CAMPAIGNS) + "SELECT * FROM v_campaigns ORDER BY campaign_id LIMIT 5"

ORACLE["F8_parse_replies"] = """
SELECT CAST(event_id AS BIGINT) AS reply_id,
  TRY_CAST(json_extract_string(trim(regexp_replace(regexp_replace(trim(
     CASE WHEN event_id % 2 = 0 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE props END),
     '^```[A-Za-z]*\\s*', ''), '\\s*```$', '')), '$.k') AS INTEGER) AS k
FROM events"""

_S14 = _RECOMMENDED.replace(
    "'pending' AS status FROM bids", "'pending' AS status, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM bids").replace(
    "'pending' AS status FROM shifts", "'pending' AS status, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM shifts") + """
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), 'bid_adjustment', '{}', '', 'medium', 'pending', TIMESTAMP '2024-01-15 00:00:00' FROM customer"""
ORACLE["S14_store_recommendations"] = _S14
ORACLE["T2_recent_recommendations"] = "WITH lg AS (" + _S14 + """)
SELECT lg.campaign_id, c.campaign_name, c.platform, lg.action_type, lg.action_detail, lg.reasoning, lg.confidence, lg.status, lg.created_at
FROM lg LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS campaign_id, c_name AS campaign_name, c_mktsegment AS platform
                   FROM customer) c ON lg.campaign_id = c.campaign_id
ORDER BY lg.created_at DESC, lg.campaign_id, lg.action_type, lg.action_detail LIMIT 20"""


def _lin_for(views: str, source: str, keys: str) -> str:
    body = _LIN[len(with_views(V_SERIES)):]
    body = body.replace("FROM v_series", f"FROM {source}").replace(
        "series, metric", keys).replace("USING (series, metric", f"USING ({keys}").replace(
        "SELECT series, metric,", f"SELECT {keys},").replace("SELECT f.series, f.metric,", "SELECT f.campaign_id, f.metric,")
    return views + body


ORACLE["S13_store_forecasts"] = _lin_for(
    with_views(V_DAILY, V_FORECASTS) + """, clk AS (SELECT campaign_id, date, metric, value FROM (SELECT campaign_id, date, CAST(clicks AS DOUBLE) AS clicks,
      CAST(conversions AS DOUBLE) AS conversions, CAST(spend AS DOUBLE) AS spend, CAST(revenue AS DOUBLE) AS revenue FROM v_daily)
    UNPIVOT (value FOR metric IN (clicks, conversions, spend, revenue)))""",
    "clk", "campaign_id, metric") + """
, newf AS (SELECT CAST(campaign_id AS BIGINT) AS campaign_id, date AS forecast_date, metric, predicted AS predicted_value,
             lower AS lower_bound, upper AS upper_bound FROM forecast WHERE is_forecast),
keys AS (SELECT DISTINCT campaign_id, metric FROM newf)
SELECT * FROM v_forecasts f WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.campaign_id = f.campaign_id AND k.metric = f.metric)
UNION ALL SELECT * FROM newf"""
ORACLE["STREAM_daily_metrics"] = ORACLE["V_daily_metrics"]

ORACLE["P6_has_rows"] = with_views(V_DAILY, V_FORECASTS, V_ADS) + """
SELECT EXISTS (SELECT 1 FROM v_daily) AS has_metrics, EXISTS (SELECT 1 FROM v_forecasts) AS has_forecasts,
  EXISTS (SELECT 1 FROM v_ads) AS has_ads"""

ORACLE["P9_single_or_portfolio"] = with_views(V_DAILY, V_FORECASTS) + \
    "SELECT *, 'single' AS scope FROM v_forecasts WHERE campaign_id = 7"

ORACLE["T5_priority_order"] = _M10 + """
, top AS (SELECT campaign_id, CAST(ROW_NUMBER() OVER (ORDER BY platform, campaign_name, campaign_id) AS INTEGER) AS priority
          FROM (SELECT * FROM bids ORDER BY platform, campaign_name, campaign_id LIMIT 8))
SELECT b.campaign_id, top.priority FROM bids b LEFT JOIN top ON b.campaign_id = top.campaign_id"""

ORACLE["T6_numeric_arm_order"] = with_views(V_DAILY) + _A13 + f"""
SELECT CAST(bid_multiplier AS VARCHAR) AS arm, COUNT(*) AS n_campaigns,
  {rnd('CAST(SUM(CAST(exp_profit > 0 AS INTEGER)) AS DOUBLE) / COUNT(*)', 4)} AS share_profitable
FROM grid GROUP BY bid_multiplier"""

ORACLE["F3_parse_multiple"] = with_views(V_CAMPAIGNS, V_DAILY) + _A6 + f"""
SELECT campaign_id, printf('%.1f', {rnd('roas', 1)}) || 'x' AS roas_text,
  TRY_CAST(replace(printf('%.1f', {rnd('roas', 1)}) || 'x', 'x', '') AS DOUBLE) AS roas_value FROM a6"""

ORACLE["F6_join_top_terms"] = _TFIDF + " SELECT category, array_to_string(top_terms[1:3], ', ') AS top_3 FROM tops"

ORACLE["P8_optional_filters"] = with_views(V_ADS) + \
    "SELECT ad_id, advertiser_name, platform, category, spend_tier FROM v_ads WHERE category = '3' AND spend_tier = 'low'"
ORACLE["F2_campaign_labels"] = with_views(V_CAMPAIGNS) + """
SELECT campaign_id, upper(substr(platform, 1, 1)) || lower(substr(platform, 2)) AS platform_label,
  upper(substr(platform, 1, 1)) || lower(substr(platform, 2)) || ' Active' AS segment_label, campaign_name AS short_name FROM v_campaigns"""
ORACLE["F10_date_labels"] = with_views(V_DAILY) + """
SELECT DISTINCT date, strftime(date, '%b %d') AS label, dayname(date) AS weekday, CAST(date_trunc('week', date) AS DATE) AS week_start FROM v_daily"""

# standard normal draws: Box-Muller on the first and the next 13 hex digits of an md5
_U = "((CAST('0x' || substr(h, {}, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"
ORACLE["J9_sampled_allocation"] = with_views(V_CAMPAIGNS, V_DAILY) + _A6 + f"""
, b AS (SELECT campaign_id, COALESCE(roas, 0.0) AS r, 30.0 / ((COALESCE(roas, 0.0) * 0.2 + 0.1) * (COALESCE(roas, 0.0) * 0.2 + 0.1) + {_EPS}) AS w FROM a6),
c AS (SELECT campaign_id, (w * r) / ({_PRIOR} + w) AS mu, 1.0 / SQRT({_PRIOR} + w) AS sd FROM b),
d AS (SELECT c.*, s.s, md5(concat_ws('|', '42', CAST(campaign_id AS VARCHAR), CAST(s.s AS VARCHAR))) AS h FROM c, range(0, 1000) s(s)),
x AS (SELECT campaign_id, s, mu + sd * (SQRT(-2.0 * LN({_U.format(1)})) * COS(2.0 * CAST('3.141592653589793' AS DOUBLE) * {_U.format(14)})) AS x FROM d),
p AS (SELECT s, MIN(x) AS lo, SUM(x) - COUNT(*) * (MIN(x) - 0.1) AS tot FROM x GROUP BY s),
sh AS (SELECT campaign_id, SUM((x - lo + 0.1) / tot) / 1000 AS share FROM x JOIN p USING (s) GROUP BY campaign_id)
SELECT campaign_id, {rnd('share', 4)} AS recommended_share FROM sh"""

ORACLE["M5_model_checks"] = _SPLIT + f"""
, n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM spl WHERE split = 'test')
SELECT item, CASE WHEN item IN ('loaded model differs', 'negative importances') THEN CAST(0 AS DOUBLE)
  WHEN item = 'importance total' THEN CAST(1 AS DOUBLE) WHEN item = 'features' THEN CAST({len(_NUM + _CAT)} AS DOUBLE) ELSE n END AS value
FROM n, (SELECT unnest(['tree rows', 'tree scores in range', 'loaded model differs', 'hashed rows', 'hashed scores in range', 'features',
  'negative importances', 'importance total', 'rows in calibration bins']) AS item)"""
