"""Sinks and table maintenance: S13-S19.

Parquet has no MERGE: every "upsert" builds the merged DataFrame and the
caller writes it to a *new* path (``write_table``), never over the path it
is reading from.  Written tables live under the shared checkpoint folder
(``spark.checkpoint.dir``), which also cuts lineage for later jobs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from adlens.operators.reports import table_counts
from adlens.sources import schemas as S
from adlens.sources.ingest import upsert_by_key, upsert_last_wins


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def store_forecasts(existing: DataFrame, forecast: DataFrame, key_col: str = "campaign_id",
                    metric: str | None = None) -> DataFrame:
    """Replace every (series, metric) key present in ``forecast`` by its
    future rows only (``is_forecast``)."""
    fut = forecast.where(F.col("is_forecast"))
    if metric is not None:
        fut = fut.withColumn("metric", F.lit(metric))
    new = fut.select(F.col(key_col).alias("campaign_id"), F.col("date").alias("forecast_date"), "metric",
                     F.col("predicted").alias("predicted_value"), F.col("lower").alias("lower_bound"),
                     F.col("upper").alias("upper_bound"))
    keys = new.select("campaign_id", "metric").distinct()
    kept = existing.join(keys, ["campaign_id", "metric"], "left_anti")
    return kept.unionByName(new.select(*existing.columns))


def store_recommendations(log: DataFrame | None, recs: DataFrame, created_at=None) -> DataFrame:
    """Append recommendations with defaults (bid_adjustment, medium,
    pending); ``action_detail`` is JSON text; ``created_at`` is TIMESTAMP_NTZ."""
    # a wall-clock time without zone, like the original table's TIMESTAMP default
    ts = F.lit(created_at).cast("timestamp_ntz") if created_at is not None else F.localtimestamp()
    r = recs.select(
        F.col("campaign_id").cast("string").alias("campaign_id"),
        F.coalesce(F.col("action_type"), F.lit("bid_adjustment")).alias("action_type"),
        F.coalesce(F.col("action_detail"), F.lit("{}")).alias("action_detail"),
        F.coalesce(F.col("reasoning"), F.lit("")).alias("reasoning"),
        F.coalesce(F.col("confidence"), F.lit("medium")).alias("confidence"),
        F.lit("pending").alias("status"), ts.alias("created_at"))
    return r if log is None else log.unionByName(r)


class Store:
    """The stored tables (S20) as external Parquet tables of one catalog database.

    A table's files are never changed: ``replace`` writes the new rows, with the schema's
    defaults, to a new folder and then points the table there, so an upsert or a reset may
    read the very table that it replaces, and a job that fails leaves the old table in place.
    """

    def __init__(self, spark: SparkSession, folder: str, database: str, tables=None):
        self.spark, self.folder, self.database, self.tables = spark, folder.rstrip("/"), database, dict(tables or S.TABLES)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{self.folder}'")

    def _name(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    def read(self, name: str) -> DataFrame:
        """The rows now stored; an empty frame before the first write."""
        if not self.spark.catalog.tableExists(self._name(name)):
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.table(self._name(name))

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        S.with_defaults(df, self.tables[name]).write.parquet(path)
        if self.spark.catalog.tableExists(self._name(name)):
            self.spark.sql(f"ALTER TABLE {self._name(name)} SET LOCATION '{path}'")
            self.spark.catalog.refreshTable(self._name(name))
        else:
            plain = T.StructType([T.StructField(f.name, f.dataType) for f in self.tables[name]])
            self.spark.catalog.createTable(self._name(name), path=path, source="parquet", schema=plain)
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Adds rows: files beside those that are there."""
        if not self.spark.catalog.tableExists(self._name(name)):
            return self.replace(name, df)
        S.with_defaults(df, self.tables[name]).write.insertInto(self._name(name))
        self.spark.catalog.refreshTable(self._name(name))
        return self.read(name)

    def upsert(self, name: str, batch: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
        """Rows of ``batch`` replace stored rows with their keys; with
        ``order_col`` the last row of each key counts, else keys are unique in the batch."""
        new = S.with_defaults(batch, self.tables[name])
        if order_col is None:
            return self.replace(name, upsert_by_key(self.read(name), new, keys))
        new = S.with_defaults(batch, T.StructType([*self.tables[name], batch.schema[order_col]]))
        return self.replace(name, upsert_last_wins(self.read(name), new, keys, order_col))

    def reset(self) -> None:
        """Empties the five campaign tables; the competitor tables are not touched."""
        for name in S.RESET:
            self.replace(name, self.spark.createDataFrame([], self.tables[name]))

    def counts(self) -> DataFrame:
        """(table_name, n_rows) of every table."""
        return table_counts({name: self.read(name) for name in sorted(self.tables)})


def store_cluster_results(existing: DataFrame | None, clusters: DataFrame, analysis_date) -> DataFrame:
    """Upsert (cluster_id, analysis_date) rows; top terms stay an array."""
    new = clusters.select(F.col("cluster_id").cast("bigint").alias("cluster_id"),
                          F.col("label").alias("cluster_label"), "top_terms",
                          F.col("n_ads").cast("bigint").alias("n_ads"),
                          F.lit(analysis_date).cast("date").alias("analysis_date"))
    if existing is None:
        return new
    return upsert_by_key(existing, new, ["cluster_id", "analysis_date"])


def export_metrics_csv(metrics: DataFrame, campaigns: DataFrame, path: str) -> str:
    """Metrics without stored ratios, one CSV folder per platform (with a
    header); the combined export is the parent folder."""
    m = metrics.drop("ctr", "cpc", "roas").join(
        campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id")
    m.write.mode("overwrite").partitionBy("platform").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema=None, multiline: bool = False) -> DataFrame:
    """JSON (a multi-line document when ``multiline``)."""
    r = spark.read.option("multiLine", multiline)
    return (r.schema(schema) if schema is not None else r).json(path)


def save_model(model, path: str, metadata: dict | None = None) -> str:
    """Model + preprocessing pipeline, overwrite, plus metadata JSON."""
    model.write().overwrite().save(f"{path}/model")
    if metadata is not None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(metadata),)], "metadata string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/metadata")
    return path


def load_model(path: str):
    """Load a saved PipelineModel."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(f"{path}/model")


def load_metadata(spark: SparkSession, path: str) -> dict | None:
    """Metadata only (one small text row), or None when absent."""
    try:
        row = spark.read.text(f"{path}/metadata").first()
    except Exception:  # no metadata written
        return None
    return json.loads(row[0]) if row else None


#: Partition values that a merge lists one by one.
MAX_LISTED = 4_096


def merge_into_partitioned(spark: SparkSession, table_path: str, batch: DataFrame, keys: list[str],
                           partition_col: str = "date", order_col: str = "_row_idx") -> DataFrame:
    """Upsert ``batch`` into a parquet table partitioned by ``partition_col``,
    rewriting only the partitions the batch touches (dynamic partition
    overwrite) instead of the whole table.

    The values of ``partition_col`` in the batch, at most as many as the table gets
    partitions, come to the driver and are the scan's partition filter: up to MAX_LISTED
    as a literal list, more as their least and greatest value (a semi-join drops the rest).  The
    touched partitions are merged with last-row-wins, checkpointed (so the write never
    reads the files it replaces) and written back.  A batch whose columns are not the
    table's is refused.  Re-running the same batch gives the same partitions, so a
    retried job is idempotent.
    """
    from pyspark.errors import AnalysisException

    from adlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    data_cols = [c for c in batch.columns if c != order_col]
    # evaluated once: the days, the merge and a retried write read the same rows
    batch = batch.checkpoint(eager=True)
    try:
        current = spark.read.parquet(table_path)
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        current = spark.createDataFrame([], batch.select(*data_cols).schema)  # first write
    if set(current.columns) != set(data_cols):
        raise ValueError(f"the batch's columns {sorted(data_cols)} are not the table's {sorted(current.columns)}")
    touched = batch.select(partition_col).distinct()
    values = [r[0] for r in touched.limit(MAX_LISTED + 1).collect()]
    if len(values) <= MAX_LISTED:
        pruned = F.col(partition_col).isin([v for v in values if v is not None])
        if None in values:
            pruned = pruned | F.col(partition_col).isNull()
        current = current.where(pruned)
    else:
        low, high = touched.agg(F.min(partition_col), F.max(partition_col)).first()
        current = current.where(F.col(partition_col).between(low, high) | F.col(partition_col).isNull())
        current = current.join(touched, current[partition_col].eqNullSafe(touched[partition_col]), "left_semi")
    current = current.select(*data_cols)
    merged = upsert_last_wins(current, batch, keys, order_col).checkpoint(eager=True)
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(table_path))
    return spark.read.parquet(table_path)
