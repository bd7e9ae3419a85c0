"""Structured Streaming: the daily fact table and upload ingestion as streams.

* ``daily_metrics_stream`` — events -> watermark -> 1-day tumbling windows
  per campaign -> the same measures and rule-(a) ratios as the batch view.
  Update mode: a window's row is re-emitted while late events arrive, and the
  state of a day is dropped once the watermark passes it (bounded state).
* ``run_daily_metrics`` — drives that stream with ``foreachBatch``: every
  micro-batch is merged into the date-partitioned table with last-row-wins
  by (campaign_id, date), rewriting only the days the batch touches
  (``sinks.merge_into_partitioned``).  Replaying an epoch after a failure
  merges the same rows again, so the sink is idempotent.
* ``run_upload_stream`` — CSV exports dropped in a folder go through the
  batch ingest path (detect, validate, quarantine, upsert) per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.ratios import MONEY, ratio_zero
from adlens.sources import ingest as IN
from adlens.sources import sinks as SK

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of event parquet files (a folder or a glob).

    Event times are wall-clock (TIMESTAMP_NTZ); the watermark needs an
    instant, so the wall clock is read as UTC explicitly (independent of the
    session time zone)."""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    ts = F.col("ts")
    utc = F.make_timestamp_ltz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
                               F.second(ts), F.lit("UTC"))
    return r.parquet(path).withColumn("ts", utc)


def daily_metrics_stream(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    et = F.col("event_type")
    money = F.col("value").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    agg = (events.withWatermark("ts", watermark)
           .groupBy(F.col("user_id").cast("bigint").alias("campaign_id"), F.window("ts", "1 day").alias("w"))
           .agg(F.count_if(et == "view").cast("bigint").alias("impressions"),
                F.count_if(et == "click").cast("bigint").alias("clicks"),
                F.count_if(et == "purchase").cast("bigint").alias("conversions"),
                F.sum(F.when(et == "click", money).otherwise(zero)).cast("double").alias("spend"),
                F.sum(F.when(et == "purchase", money).otherwise(zero)).cast("double").alias("revenue")))
    # the day of a UTC-aligned window, from epoch seconds (no session time zone)
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return agg.select(
        "campaign_id", day.alias("date"), "impressions", "clicks", "conversions",
        "spend", "revenue",
        ratio_zero("clicks", "impressions", 6).alias("ctr"),
        ratio_zero("spend", "clicks", 4).alias("cpc"),
        ratio_zero("revenue", "spend", 4).alias("roas"))


def _merge_writer(table_path: str, keys: list[str]):
    def merge(batch: DataFrame, epoch_id: int) -> None:
        SK.merge_into_partitioned(batch.sparkSession, table_path,
                                  batch.withColumn("_row_idx", F.lit(epoch_id)), keys, "date")
    return merge


def run_daily_metrics(spark: SparkSession, events_path: str, table_path: str, checkpoint_path: str,
                      watermark: str = "2 days", max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the daily-metrics stream until the input is consumed; return the table."""
    stream = daily_metrics_stream(read_events_stream(spark, events_path, max_files_per_trigger), watermark)
    q = (stream.writeStream.outputMode("update")
         .foreachBatch(_merge_writer(table_path, ["campaign_id", "date"]))
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(table_path).select(*stream.columns)


def run_upload_stream(spark: SparkSession, upload_dir: str, header: list[str], table_path: str,
                      rejects_path: str, checkpoint_path: str, platform: str | None = None) -> DataFrame:
    """Ingest every CSV dropped into ``upload_dir`` (all with the given header)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    src = IN.with_position(spark.readStream.schema(schema).option("header", True).csv(upload_dir))
    keys = ["campaign_id", "date"]

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        b = IN.with_row_index(batch)
        p = platform or IN.detect_platform(header)
        v = IN.validate(IN.normalize_columns(b, p), p).persist()
        good = IN.good_rows(v)
        cols = ["campaign_id", "date", "impressions", "clicks", "conversions", "spend", "revenue",
                "ctr", "cpc", "roas"]
        SK.merge_into_partitioned(spark, table_path, good.select("_row_idx", *cols), keys, "date")
        IN.rejects(v).withColumn("epoch", F.lit(epoch_id)).drop("_row_idx").write.mode("overwrite") \
            .parquet(f"{rejects_path.rstrip('/')}/epoch={epoch_id}")
        v.unpersist()

    q = (src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(table_path)
