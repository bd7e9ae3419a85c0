"""Stored tables (S6, S15, S16, S20), merges that prune, and row numbers of uploads."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from adlens.operators import learn as L
from adlens.operators import reports as R
from adlens.operators import text as TX
from adlens.session import shared_path
from adlens.sources import ingest as IN
from adlens.sources import schemas as S
from adlens.sources import sinks as SK

DAY = dt.date(2025, 1, 1)


def store(spark):
    return SK.Store(spark, shared_path(spark, "store"), f"t_{uuid.uuid4().hex[:10]}")


def test_defaults_fill_only_what_is_missing(spark):
    df = spark.createDataFrame([("c1", "A", "google", None)], "campaign_id string, campaign_name string, platform string, status string")
    r = S.with_defaults(df.withColumn("extra", F.lit(1)), S.CAMPAIGNS).first()
    assert r["status"] is None and r["daily_budget"] == 0.0 and r["created_at"] is not None and "extra" not in r
    ads = spark.createDataFrame([("a", "x", "google", "copy")], "ad_id string, advertiser_name string, platform string, ad_copy string")
    r = S.with_defaults(ads, S.COMPETITOR_ADS).first()
    assert (r["headline"], r["is_active"], r["spend_tier"], r["first_seen"]) == ("", True, "medium", None)
    rec = spark.createDataFrame([("c", "t", "{}", "", "low")], "campaign_id string, action_type string, action_detail string, "
                                                             "reasoning string, confidence string")
    r = S.with_defaults(rec, S.RECOMMENDATIONS).first()
    assert r["status"] == "pending" and r["llm_provider"] is None and r["id"] is None
    with pytest.raises(ValueError, match="ad_copy"):
        S.with_defaults(ads.drop("ad_copy"), S.COMPETITOR_ADS)


def metrics(spark, rows):
    return spark.createDataFrame(rows, "campaign_id string, date date, clicks bigint, _row_idx int")


def test_a_table_is_upserted_while_it_is_read(spark):
    st = store(spark)
    assert st.read("daily_metrics").count() == 0
    st.upsert("daily_metrics", metrics(spark, [("a", DAY, 1, 0), ("b", DAY, 2, 1)]), ["campaign_id", "date"], "_row_idx")
    old = st.read("daily_metrics").inputFiles()
    out = st.upsert("daily_metrics", metrics(spark, [("b", DAY, 3, 0), ("b", DAY, 4, 1), ("c", DAY, 5, 0)]), ["campaign_id", "date"], "_row_idx")
    assert {r["campaign_id"]: r["clicks"] for r in out.collect()} == {"a": 1, "b": 4, "c": 5}
    assert out.columns == S.DAILY_METRICS.names and out.first()["roas"] == 0.0
    assert not set(old) & set(out.inputFiles())          # new files; the old ones were not changed
    assert spark.read.parquet(*old).count() == 2
    # running the same batch again changes nothing
    again = st.upsert("daily_metrics", metrics(spark, [("b", DAY, 4, 1), ("c", DAY, 5, 0)]), ["campaign_id", "date"], "_row_idx")
    assert {r["campaign_id"]: r["clicks"] for r in again.collect()} == {"a": 1, "b": 4, "c": 5}


def test_a_failed_replacement_leaves_the_table(spark):
    st = store(spark)
    st.replace("search_trends", spark.createDataFrame([("k", DAY, 5)], "keyword string, date date, interest bigint"))
    bad = st.read("search_trends").withColumn("interest", F.expr("raise_error('no')").cast("bigint"))
    with pytest.raises(Exception, match="no"):
        st.replace("search_trends", bad)
    assert [r["interest"] for r in st.read("search_trends").collect()] == [5]


def test_reset_empties_five_tables(spark):
    st = store(spark)
    st.replace("campaigns", spark.createDataFrame([("c", "C", "meta")], "campaign_id string, campaign_name string, platform string"))
    st.append("competitor_ads", spark.createDataFrame([("a", "x", "google", "copy")], "ad_id string, advertiser_name string, "
                                                                                       "platform string, ad_copy string"))
    st.append("competitor_ads", st.read("competitor_ads").withColumn("ad_id", F.lit("b")))
    st.reset()
    got = {r["table_name"]: r["n_rows"] for r in st.counts().collect()}
    assert got == {**dict.fromkeys(S.TABLES, 0), "competitor_ads": 2}
    st.append("campaigns", spark.createDataFrame([("d", "D", "meta")], "campaign_id string, campaign_name string, platform string"))
    assert st.read("campaigns").count() == 1


def test_cluster_snapshots_are_upserted(spark):
    st = store(spark)
    rows = lambda label, ids: spark.createDataFrame([(i, label, ["t"], 2) for i in ids], "cluster_id int, label string, top_terms array<string>, n_ads int")
    for label, ids, day in (("one", [1, 2], "2025-01-01"), ("two", [1, 2], "2025-01-02"), ("three", [2, 3], "2025-01-02")):
        st.upsert("competitor_clusters", SK.store_cluster_results(None, rows(label, ids), day), ["cluster_id", "analysis_date"])
    got = {(r["cluster_id"], str(r["analysis_date"])): r["cluster_label"] for r in st.read("competitor_clusters").collect()}
    assert got == {(1, "2025-01-01"): "one", (2, "2025-01-01"): "one", (1, "2025-01-02"): "two", (2, "2025-01-02"): "three",
                   (3, "2025-01-02"): "three"}


def test_newest_time_of_stored_forecasts(spark):
    fc = spark.createDataFrame([("c", "clicks", DAY, 2.0, dt.datetime(2025, 1, 1, 6)), ("c", "clicks", DAY, 4.0, dt.datetime(2025, 1, 2, 6))],
                               "campaign_id string, metric string, forecast_date date, predicted_value double, created_at timestamp_ntz")
    camps = spark.createDataFrame([("c", "C", "meta")], "campaign_id string, campaign_name string, platform string")
    r = R.forecast_summary(fc, camps).first()
    assert r["generated_at"] == dt.datetime(2025, 1, 2, 6) and r["avg_predicted"] == 3.0
    assert R.forecast_summary(fc.drop("created_at"), camps).first()["generated_at"] is None


@pytest.mark.parametrize("listed", [4096, 1])
def test_a_merge_reads_only_the_days_it_touches(spark, monkeypatch, listed):
    monkeypatch.setattr(SK, "MAX_LISTED", listed)
    path = shared_path(spark, "pruned")
    days = [DAY + dt.timedelta(days=i) for i in range(20)]
    SK.merge_into_partitioned(spark, path, metrics(spark, [("a", d, 1, 0) for d in days]), ["campaign_id", "date"])
    seen, merge = [], SK.upsert_last_wins

    def watched(target, *args):
        seen.append(sorted(r["date"] for r in target.select("date").distinct().collect()))
        rows = target.select("clicks", "date")
        rows.collect()
        scan = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        seen.append(scan.metrics().apply("numFiles").value() if listed > 1 else None)
        return merge(target, *args)

    monkeypatch.setattr(SK, "upsert_last_wins", watched)
    out = SK.merge_into_partitioned(spark, path, metrics(spark, [("a", days[3], 7, 0), ("b", days[4], 8, 0)]), ["campaign_id", "date"])
    assert seen[0] == [days[3], days[4]] and seen[1] in (2, None)       # two of twenty files were opened
    assert {(r["campaign_id"], r["date"]): r["clicks"] for r in out.where(F.col("date").isin(days[2], days[3], days[4])).collect()} == {
        ("a", days[2]): 1, ("a", days[3]): 7, ("a", days[4]): 1, ("b", days[4]): 8}
    assert out.count() == 21


HEAD = "campaign_id,campaign_name,platform,date,impressions,clicks,conversions,spend,revenue\n"


def line(i, day="2025-01-01"):
    return f"c{i},C,google,{day},1,1,1,1,1\n"


def test_row_numbers_with_many_files_in_a_partition(spark, tmp_path):
    for f in range(6):
        (tmp_path / f"u{f}.csv").write_text(HEAD + "".join(line(i, "never" if i == f else "2025-01-01") for i in range(6)))
    up = IN.read_upload(spark, str(tmp_path)).coalesce(1)
    assert up.rdd.getNumPartitions() == 1
    assert IN.ingest(spark, up)["report"].first()["errors"] == [f"Row {f + 1}: invalid date" for f in range(6)]


def test_row_numbers_in_a_file_that_is_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "".join(line(i, "never" if i in (0, 700, 1999) else "2025-01-01") for i in range(2000)))
    (tmp_path / "b.csv").write_text(HEAD + line(1) + line(2, "never"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        up = IN.read_upload(spark, str(tmp_path))
        assert up.rdd.getNumPartitions() > 3
        errors = IN.ingest(spark, up)["report"].first()["errors"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [e.split(":")[0] for e in errors] == ["Row 1", "Row 701", "Row 2000", "Row 2"]


def test_labels_by_preference_in_order(spark):
    scores = spark.createDataFrame([(3, "Price & Deals", 5), (3, "Lifestyle & Brand", 5), (1, "Price & Deals", 1), (2, "Price & Deals", 9),
                                    (7, "Urgency & Scarcity", 0)], "cluster int, label string, score bigint")
    groups = spark.createDataFrame([(i,) for i in (7, 1, 2, 3, 9, 1)], "cluster int")
    got = {r["cluster"]: r["label"] for r in TX.assign_labels(scores, groups).collect()}
    assert got == {1: "Price & Deals", 2: "Other", 3: "Lifestyle & Brand", 7: "Other (2)", 9: "Other (2)"}
    many = spark.createDataFrame([(i,) for i in range(300)], "cluster int")     # no limit on the number of groups
    assert TX.assign_labels(scores.limit(0), many).where("label = 'Other (2)'").count() == 299
    assert TX.assign_labels(scores, groups.limit(0)).collect() == []


def test_model_comes_back_with_its_scores_and_metadata(spark):
    rows = [(float(i % 7), float(i % 3), int(i % 7 > 3), "val" if i % 5 == 0 else "train") for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, label int, split string")
    model = L.train_gbt(df, ["a", "b"], max_iter=5)
    path = shared_path(spark, "model")
    SK.save_model(model, path, {"features": ["a", "b"]})
    score = lambda m: sorted(map(tuple, L.score(m, df, ["a", "b"]).collect()))
    assert score(SK.load_model(path)) == score(model)
    assert SK.load_metadata(spark, path) == json.loads('{"features": ["a", "b"]}')
    assert SK.load_metadata(spark, path + "-none") is None
