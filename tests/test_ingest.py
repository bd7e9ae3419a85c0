"""S1-S12 edge rows (FIXTURES Part C) on small literal frames."""

import pytest
from pyspark.sql import functions as F

from adlens.sources import ingest as IN

INTERNAL = ["campaign_id", "campaign_name", "platform", "date", "impressions", "clicks",
            "conversions", "spend", "revenue"]


def upload(spark, rows, cols=INTERNAL):
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))
    return df.withColumn("_row_idx", F.struct(F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"),
                                              F.monotonically_increasing_id().alias("pos")))


def test_detect_platform():
    assert IN.detect_platform(["Campaign", "Day", "Impressions", "Clicks", "Cost", "Conv. value", "Avg. CPC"]) == "google"
    assert IN.detect_platform(["Campaign name", "Day", "Impressions", "Link clicks", "Amount spent (USD)"]) == "meta"
    assert IN.detect_platform(["Campaign Name", "Spend", "Sales"]) == "amazon"
    assert IN.detect_platform(["Orders", "ACOS"]) == "amazon"
    assert IN.detect_platform(["campaign_id", "platform", "date", "impressions", "clicks"]) == "unknown"
    # meta is checked before google
    assert IN.detect_platform(["Link clicks", "Conv. value"]) == "meta"


def test_google_header_without_value_columns(spark):
    cols = ["Campaign", "Campaign ID", "Day", "Impressions", "Clicks", "Cost", "Conversions"]
    df = upload(spark, [("Brand", "c1", "2025-04-01", "100", "5", "2.5", "1")], cols)
    n = IN.normalize_columns(df, IN.detect_platform(cols) if "Conv. value" in cols else "google")
    good = IN.good_rows(IN.validate(n, "google")).collect()
    assert len(good) == 1 and good[0]["revenue"] == 0.0 and good[0]["platform"] == "google"


def test_three_good_rows_and_a_bad_date(spark):
    rows = [("c1", "A", "google", "2025-04-01", "100", "10", "1", "5.0", "20.0"),
            ("c1", "A", "google", "2025-04-02", "120", "12", "2", "6.0", "30.0"),
            ("c2", "B", "meta", "2025-04-01", "50", "5", "0", "2.5", "0.0"),
            ("c2", "B", "meta", "not-a-date", "50", "5", "0", "2.5", "0.0")]
    res = IN.ingest(spark, upload(spark, rows))
    rep = res["report"].first()
    assert (rep["rows_total"], rep["rows_loaded"], rep["rows_skipped"]) == (4, 3, 1)
    assert rep["status"] == "partial" and len(rep["errors"]) == 1 and "invalid date" in rep["errors"][0]
    assert res["metrics"].count() == 3


@pytest.mark.parametrize("field,value,reason", [
    ("campaign_id", "   ", "missing campaign id"),
    ("campaign_id", None, "missing campaign id"),
    ("date", None, "invalid date"),
    ("impressions", "1,234", "invalid count"),
    ("clicks", None, "invalid count"),
    ("platform", "tiktok", "invalid platform: tiktok"),
])
def test_rejects(spark, field, value, reason):
    row = dict(zip(INTERNAL, ["c1", "A", "google", "2025-04-01", "100", "10", "1", "5.0", "20.0"]))
    row[field] = value
    v = IN.validate(IN.normalize_columns(upload(spark, [tuple(row[c] for c in INTERNAL)]), "unknown"), "unknown")
    assert v.first()["reject_reason"] == reason


def test_coercions_and_clamping(spark):
    rows = [("c1", "A", "unknown", "2025-04-01", "12.7", "-3", "1", None, "NaN"),
            ("c2", "B", "google", "2025-04-01", "10", "1", "1", "-2.0", "4.0")]
    v = IN.validate(IN.normalize_columns(upload(spark, rows), "unknown"), "unknown")
    g = {r["campaign_id"]: r for r in IN.good_rows(v).collect()}
    assert g["c1"]["impressions"] == 12 and g["c1"]["clicks"] == 0
    assert g["c1"]["spend"] == 0.0 and g["c1"]["revenue"] == 0.0
    assert g["c2"]["spend"] == 0.0 and g["c2"]["roas"] == 0.0
    rep = IN.ingestion_report(v, "unknown").first()
    assert rep["rows_clamped"] == 2 and rep["status"] == "success"
    camps = {r["campaign_id"]: r["platform"] for r in IN.campaigns_from_batch(IN.good_rows(v), "unknown").collect()}
    assert camps["c1"] == "google"          # 'unknown' becomes google


def test_duplicates_last_row_wins_and_first_name(spark):
    rows = [("c1", "First name", "google", "2025-04-01", "100", "10", "1", "5.0", "20.0"),
            ("c1", "Second name", "google", "2025-04-01", "200", "20", "2", "6.0", "30.0")]
    res = IN.ingest(spark, upload(spark, rows))
    m = res["metrics"].collect()
    assert len(m) == 1 and m[0]["impressions"] == 200
    assert res["campaigns"].first()["campaign_name"] == "First name"
    assert res["report"].first()["rows_loaded"] == 2     # duplicates still count as loaded


def test_upsert_twice_is_idempotent_and_across_files(spark):
    rows = [("c1", "A", "google", "2025-04-01", "100", "10", "1", "5.0", "20.0")]
    first = IN.ingest(spark, upload(spark, rows))
    again = IN.ingest(spark, upload(spark, rows), first["metrics"], first["campaigns"])
    assert sorted(map(tuple, again["metrics"].collect())) == sorted(map(tuple, first["metrics"].collect()))
    newer = [("c1", "A", "google", "2025-04-01", "999", "10", "1", "5.0", "20.0")]
    third = IN.ingest(spark, upload(spark, newer), again["metrics"], again["campaigns"])
    assert [r["impressions"] for r in third["metrics"].collect()] == [999]


def test_empty_upload_is_success(spark):
    res = IN.ingest(spark, upload(spark, []))
    rep = res["report"].first()
    assert rep["status"] == "success" and rep["rows_total"] == 0 and rep["errors"] == []


def test_competitor_aliases_and_edge_rows(spark):
    df = spark.createDataFrame(
        [("Acme", "copy wins", "text loses", "Title 1", "GOOGLE", "HIGH"),
         ("Acme", None, "x", "t", "google", "low"),
         ("Beta", "   ", "x", "t", "google", "low")],
        "` Brand ` string, copy string, text string, Title string, channel string, budget_tier string")
    ads = IN.ingest_competitor_ads(df, seen="2025-01-01").collect()
    assert len(ads) == 1
    a = ads[0]
    assert a["ad_copy"] == "copy wins" and a["advertiser_name"] == "Acme"
    assert a["platform"] == "google" and a["spend_tier"] == "high" and a["headline"] == "Title 1"
    canon = spark.createDataFrame([("Zed", "hello")], "advertiser_name string, ad_copy string")
    assert IN.ingest_competitor_ads(canon).first()["advertiser_name"] == "Zed"
    with pytest.raises(ValueError):
        IN.ingest_competitor_ads(spark.createDataFrame([("x",)], "brand string"))


def test_competitor_partial_update(spark):
    v1 = spark.createDataFrame([("Acme", "Save big", "H1", "Shop")], "brand string, text string, title string, cta string")
    v2 = spark.createDataFrame([("Acme", "Save big", "H2", "Buy")], "brand string, text string, title string, cta string")
    a = IN.ingest_competitor_ads(v1, seen="2025-01-01")
    b = IN.ingest_competitor_ads(v2, seen="2025-02-01")
    r = IN.upsert_competitor_ads(a, b).collect()
    assert len(r) == 1
    assert r[0]["headline"] == "H2" and r[0]["cta"] == "Shop"
    assert str(r[0]["first_seen"]) == "2025-01-01" and str(r[0]["last_seen"]) == "2025-02-01"


def test_trends_wide_to_long(spark):
    wide = spark.createDataFrame([("2025-01-01", 10, 20, False), ("2025-01-02", 30, None, True)],
                                 "date string, laptop int, headphones int, isPartial boolean")
    long = IN.trends_wide_to_long(wide)
    assert sorted((r["keyword"], str(r["date"]), r["interest"]) for r in long.collect()) == [
        ("headphones", "2025-01-01", 20), ("laptop", "2025-01-01", 10), ("laptop", "2025-01-02", 30)]
