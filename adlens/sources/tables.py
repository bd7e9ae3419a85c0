"""Driver tables and the stand-in views built from them (FIXTURES.md part B).

Each view is a lazy DataFrame over ``spark.read.parquet`` so that Catalyst
prunes columns and pushes filters into the scan.  The same definitions exist
as SQL text in ``adlens.oracle`` for the DuckDB oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlens.functions.ratios import MONEY, ratio_zero
from adlens.session import spread

TABLE_NAMES = ("region nation customer supplier part orders lineitem events "
               "documents embeddings pages benchmark labels conversations").split()

# Fixed values of the stand-in views (FIXTURES.md part B).
EPOCH = "2024-01-01"          # first day of the events table
FORECAST_METRICS = ("clicks", "conversions", "spend", "revenue")
SPEND_TIER_BANDS = (2000, 20000)  # n_chars < 2000 low, < 20000 medium, else high


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, daily_path: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # a stored, date-partitioned daily table (plans.materialize) replaces
        # the per-query derivation from events when given
        self.daily_path = daily_path

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ── v_campaigns ────────────────────────────────────────────────
    @cached_property
    def campaigns(self) -> DataFrame:
        c = self.t("customer")
        return c.select(
            F.col("c_custkey").cast("bigint").alias("campaign_id"),
            F.col("c_name").alias("campaign_name"),
            F.col("c_mktsegment").alias("platform"),
            F.lit("active").alias("status"),
            F.col("c_acctbal").cast("double").alias("daily_budget"),
        )

    # ── v_daily ────────────────────────────────────────────────────
    @cached_property
    def daily(self) -> DataFrame:
        """The daily fact table: stored when ``daily_path`` is set, else derived."""
        if self.daily_path:
            return self.spark.read.parquet(self.daily_path).select(*self.derived_daily.columns)
        return self.derived_daily

    @cached_property
    def derived_daily(self) -> DataFrame:
        """One row per (campaign, day): counts, money and rule-(a) ratios."""
        e = self.t("events")
        et = F.col("event_type")
        money = F.col("value").cast(MONEY)
        zero = F.lit(0).cast(MONEY)
        agg = (
            e.groupBy(F.col("user_id").cast("bigint").alias("campaign_id"),
                      F.to_date("ts").alias("date"))
            .agg(
                F.count_if(et == "view").cast("bigint").alias("impressions"),
                F.count_if(et == "click").cast("bigint").alias("clicks"),
                F.count_if(et == "purchase").cast("bigint").alias("conversions"),
                F.sum(F.when(et == "click", money).otherwise(zero)).cast("double").alias("spend"),
                F.sum(F.when(et == "purchase", money).otherwise(zero)).cast("double").alias("revenue"),
            )
        )
        return agg.select(
            "*",
            ratio_zero("clicks", "impressions", 6).alias("ctr"),
            ratio_zero("spend", "clicks", 4).alias("cpc"),
            ratio_zero("revenue", "spend", 4).alias("roas"),
        )

    # ── v_trends ───────────────────────────────────────────────────
    @cached_property
    def trends(self) -> DataFrame:
        """keyword = event_type; interest = floor(100 * count / max count of keyword)."""
        e = self.t("events")
        per_day = e.groupBy(F.col("event_type").alias("keyword"),
                            F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("keyword")
        return per_day.select(
            "keyword", "date",
            F.floor(F.lit(100) * F.col("n") / F.max("n").over(w)).cast("bigint").alias("interest"),
        )

    # ── v_forecasts ────────────────────────────────────────────────
    @cached_property
    def forecasts(self) -> DataFrame:
        """Stored forecast stand-in: clicks, mean of the 7 preceding rows, ±1.28σ."""
        d = self.daily.select("campaign_id", "date", "clicks")
        w = Window.partitionBy("campaign_id").orderBy("date").rowsBetween(-7, -1)
        n = F.count("clicks").over(w)
        s1 = F.sum("clicks").over(w)
        s2 = F.sum(F.col("clicks") * F.col("clicks")).over(w)
        x = d.select("campaign_id", "date", n.alias("n"), s1.alias("s1"), s2.alias("s2"))
        mean = F.col("s1").cast("double") / F.col("n")
        sd = F.sqrt((F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")) / F.col("n")
        return x.where(F.col("n") > 0).select(
            "campaign_id",
            F.col("date").alias("forecast_date"),
            F.lit("clicks").alias("metric"),
            mean.alias("predicted_value"),
            (mean - F.lit(1.28) * sd).alias("lower_bound"),
            (mean + F.lit(1.28) * sd).alias("upper_bound"),
        )

    @cached_property
    def all_forecasts(self) -> DataFrame:
        """Stored forecasts of four metrics: the mean of the 7 preceding rows, made on the day before."""
        d = self.daily.select("campaign_id", "date", *[F.col(m).cast("decimal(18,2)").alias(m) for m in FORECAST_METRICS])
        w = Window.partitionBy("campaign_id").orderBy("date").rowsBetween(-7, -1)
        d = d.select("campaign_id", "date", F.count(F.lit(1)).over(w).alias("n"), *[
            (F.sum(m).over(w).cast("double") / F.count(F.lit(1)).over(w)).alias(m) for m in FORECAST_METRICS])
        long = d.where("n > 0").unpivot(["campaign_id", "date"], list(FORECAST_METRICS), "metric", "predicted_value")
        return long.select("campaign_id", F.col("date").alias("forecast_date"), "metric", "predicted_value",
                           F.date_sub("date", 1).cast("timestamp_ntz").alias("created_at"))

    # ── v_ads ──────────────────────────────────────────────────────
    @cached_property
    def ads(self) -> DataFrame:
        """Ad copy is tokenised row by row: spread a file with few row groups
        over all cores first (no-op for inputs that arrive in many splits)."""
        d = self.t("documents")
        lo, hi = SPEND_TIER_BANDS
        return spread(d, "doc_id").select(
            F.col("doc_id").cast("bigint").alias("ad_id"),
            F.col("source").alias("advertiser_name"),
            F.col("lang").alias("platform"),
            F.col("text").alias("ad_copy"),
            F.concat_ws(" ", F.col("source"), F.lit("ad"), F.col("doc_id").cast("string")).alias("headline"),
            F.lit("Shop now").alias("cta"),
            (F.col("doc_id") % 7).cast("string").alias("category"),
            F.lit(EPOCH).cast("date").alias("first_seen"),
            F.date_add(F.lit(EPOCH).cast("date"), (F.col("doc_id") % 30).cast("int")).alias("last_seen"),
            (F.col("doc_id") % 30 >= 7).alias("is_active"),
            F.when(F.col("n_chars") < lo, "low").when(F.col("n_chars") < hi, "medium")
             .otherwise("high").alias("spend_tier"),
        )

    # ── v_clicks ───────────────────────────────────────────────────
    @cached_property
    def clicks(self) -> DataFrame:
        """Wide click log: label, 6 numeric and 4 categorical columns.

        The parts grow with the input: both sides are shuffled, and no part goes through the driver."""
        li = self.t("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus")
        p = self.t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").hint("shuffle_hash")
        j = li.join(p, li.l_partkey == p.p_partkey, "inner")
        return j.select(
            F.col("l_orderkey").cast("bigint").alias("l_orderkey"),
            F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"),
            F.col("l_quantity").cast("double").alias("l_quantity"),
            F.col("l_extendedprice").cast("double").alias("l_extendedprice"),
            F.col("l_discount").cast("double").alias("l_discount"),
            F.col("l_tax").cast("double").alias("l_tax"),
            F.col("p_size").cast("double").alias("p_size"),
            F.col("p_retailprice").cast("double").alias("p_retailprice"),
            "p_brand", "p_type", "p_name", "l_linestatus",
        )

    # ── v_scored ───────────────────────────────────────────────────
    @cached_property
    def scored(self) -> DataFrame:
        """Fixed score column so evaluation metrics are checked without training."""
        s = (F.col("l_quantity") + F.lit(10.0) * F.col("l_discount")) / F.lit(52.0)
        return self.clicks.select(
            "l_orderkey", "l_linenumber", "label",
            F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("score"))

    # ── v_rewards ──────────────────────────────────────────────────
    @cached_property
    def rewards(self) -> DataFrame:
        """(round, arm, reward): daily value per event type; arm_id 0..4 by name."""
        e = self.t("events")
        r = e.groupBy(F.to_date("ts").alias("round"), F.col("event_type").alias("arm")).agg(
            F.sum(F.col("value").cast(MONEY)).cast("double").alias("reward"))
        return r

    # ── v_replies ──────────────────────────────────────────────────
    @cached_property
    def replies(self) -> DataFrame:
        e = self.t("events")
        fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
        return e.select(
            F.col("event_id").cast("bigint").alias("reply_id"),
            F.when(F.col("event_id") % 2 == 0, fenced).otherwise(F.col("props")).alias("text"))

    # ── vectors ────────────────────────────────────────────────────
    @cached_property
    def vectors(self) -> DataFrame:
        return self.t("embeddings")

    # ── v_labelled ─────────────────────────────────────────────────
    @cached_property
    def labelled(self) -> DataFrame:
        lab = self.t("labels")
        d = self.t("documents").select("doc_id", "text", "lang", "source", "n_chars")
        j = lab.join(d, "doc_id")
        return j.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("quality").cast("int").alias("label"),
            F.col("n_chars").cast("double").alias("n_chars"),
            F.size(F.split(F.trim(F.col("text")), r"\s+")).cast("double").alias("n_words"),
            "lang", "source")

    # ── v_series ───────────────────────────────────────────────────
    @cached_property
    def series(self) -> DataFrame:
        """Long series table (series, metric, date, value).

        long: orders per priority and order date (count, total price);
        short: events per type and day (count, value) — 30 rows each.
        """
        o = self.t("orders")
        lo = o.groupBy(F.concat(F.lit("priority:"), F.col("o_orderpriority")).alias("series"),
                       F.to_date("o_orderdate").alias("date")).agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("amount"))
        e = self.t("events")
        sh = e.groupBy(F.concat(F.lit("event:"), F.col("event_type")).alias("series"),
                       F.to_date("ts").alias("date")).agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(F.col("value").cast(MONEY)).cast("double").alias("amount"))
        return lo.unionByName(sh).unpivot(["series", "date"], ["n", "amount"], "metric", "value")
