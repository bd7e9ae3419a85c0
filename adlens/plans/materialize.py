"""Build the daily fact table once, instead of deriving it per report.

At scale the reports read a stored, date-partitioned daily table; this job
builds (or extends) it from the events table with the same measures as the
stand-in view, one range of days at a time.  Only the touched date partitions
are rewritten (``sinks.merge_into_partitioned``), so re-running a day is
idempotent and old days are never rewritten.  ``Tables(..., daily_path=...)``
then reads it with partition pruning on ``date``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.sources import sinks as SK
from adlens.sources.tables import Tables


def build_daily_table(t: Tables, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Aggregate events of [start, end] (all days when None) into ``path``."""
    daily = t.derived_daily
    if start is not None:
        daily = daily.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        daily = daily.where(F.col("date") <= F.lit(end).cast("date"))
    batch = daily.withColumn("_row_idx", F.lit(0))
    return SK.merge_into_partitioned(t.spark, path, batch, ["campaign_id", "date"], "date")
