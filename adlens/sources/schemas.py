"""Table schemas with their column defaults.

A default is SQL text in the field's metadata, under the key that Spark itself uses for
column defaults; ``with_defaults`` applies it when a writer's frame lacks the
column.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_KEY = "CURRENT_DEFAULT"
NOW = "localtimestamp()"
_STR, _LONG, _DOUBLE, _DATE, _TIME = T.StringType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampNTZType()


def _field(name: str, kind: T.DataType, default: str | None = None, required: bool = False) -> T.StructField:
    return T.StructField(name, kind, not required, {DEFAULT_KEY: default} if default is not None else None)


CAMPAIGNS = T.StructType([
    _field("campaign_id", _STR, required=True), _field("campaign_name", _STR, required=True),
    _field("platform", _STR, required=True), _field("status", _STR, "'active'"),
    _field("daily_budget", _DOUBLE, "0.0"), _field("created_at", _TIME, NOW)])

DAILY_METRICS = T.StructType([
    _field("campaign_id", _STR, required=True), _field("date", _DATE, required=True),
    *[_field(c, _LONG, "0") for c in ("impressions", "clicks", "conversions")],
    *[_field(c, _DOUBLE, "0.0") for c in ("spend", "revenue", "ctr", "cpc", "roas")]])

RECOMMENDATIONS = T.StructType([
    _field("id", _LONG), _field("campaign_id", _STR), _field("created_at", _TIME, NOW),
    _field("action_type", _STR, required=True), _field("action_detail", _STR, required=True),   # JSON text
    _field("reasoning", _STR, required=True), _field("confidence", _STR, required=True),
    _field("status", _STR, "'pending'"), _field("llm_provider", _STR), _field("llm_model", _STR)])

FORECASTS = T.StructType([
    _field("id", _LONG), _field("campaign_id", _STR, required=True), _field("forecast_date", _DATE, required=True),
    _field("metric", _STR, required=True), _field("predicted_value", _DOUBLE, required=True),
    _field("lower_bound", _DOUBLE), _field("upper_bound", _DOUBLE), _field("created_at", _TIME, NOW)])

SEARCH_TRENDS = T.StructType([
    _field("keyword", _STR, required=True), _field("date", _DATE, required=True),
    _field("interest", _LONG, required=True), _field("fetched_at", _TIME, NOW)])

COMPETITOR_ADS = T.StructType([
    _field("ad_id", _STR, required=True), _field("advertiser_name", _STR, required=True),
    _field("platform", _STR, required=True), _field("ad_copy", _STR, required=True),
    *[_field(c, _STR, "''") for c in ("headline", "cta", "category")], _field("first_seen", _DATE), _field("last_seen", _DATE),
    _field("is_active", T.BooleanType(), "true"), _field("spend_tier", _STR, "'medium'"), _field("created_at", _TIME, NOW)])

COMPETITOR_CLUSTERS = T.StructType([
    _field("cluster_id", _LONG, required=True), _field("cluster_label", _STR, required=True),
    _field("top_terms", T.ArrayType(_STR), required=True), _field("n_ads", _LONG, required=True),
    _field("analysis_date", _DATE, required=True), _field("created_at", _TIME, NOW)])

#: Every stored table, and those that a reset empties (competitor data stays).
TABLES = {"campaigns": CAMPAIGNS, "daily_metrics": DAILY_METRICS, "recommendations": RECOMMENDATIONS, "forecasts": FORECASTS,
          "search_trends": SEARCH_TRENDS, "competitor_ads": COMPETITOR_ADS, "competitor_clusters": COMPETITOR_CLUSTERS}
RESET = ("search_trends", "forecasts", "recommendations", "daily_metrics", "campaigns")


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, in its order and types.  A column that ``df`` lacks takes its default, or
    NULL without one (an error if it is required); a NULL that is there stays, and columns beyond the schema go."""
    lacking = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    if lacking:
        raise ValueError("no value for the required columns " + ", ".join(lacking))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.expr(f.metadata.get(DEFAULT_KEY, "NULL"))).cast(
        f.dataType).alias(f.name) for f in schema])
