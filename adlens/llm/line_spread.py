"""Line dedup by spread over sites: lines that many sites carry are removed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import join_salted, save

BLANK = " \t\r\f\u000b"


def _lines(rows: DataFrame) -> DataFrame:
    """(key columns, at, line) of every line, trimmed."""
    return rows.select("*", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn(
        "line", F.btrim("line", F.lit(BLANK)))


def line_spread(df: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = 5,
                min_chars: int = 20, lg_k: int = 8) -> DataFrame:
    """(hash, sites, exact) of the lines that at least ``min_sites`` sites carry.

    Lines are trimmed; shorter ones than ``min_chars`` are left alone.  One
    aggregation merges a HyperLogLog sketch of the sites per 128-bit line hash, with
    partial sketches before the shuffle.  Estimates that are farther from
    ``min_sites`` than four standard errors (and one site) decide; the lines between get an
    exact distinct count.  ``sites`` is that count, or the estimate.
    """
    rows = df.select(F.col(site_col).cast("string").alias("site"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = _lines(rows).where(F.char_length("line") >= min_chars).select(
        F.unhex(F.md5("line")).alias("hash"), "site")
    spread = save(lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n"),
                                            F.hll_sketch_agg("site", lg_k).alias("sketch"))
                  .where(F.col("n") >= min_sites)
                  .select("hash", F.hll_sketch_estimate("sketch").alias("sites")), "line-sketches")
    margin = max(1.0, 4 * 1.04 / math.sqrt(1 << lg_k) * min_sites)
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("hash")
    exact = join_salted(lines, near, "hash", ["site"], "inner").groupBy("hash", "site").agg(
        F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count("site").alias("sites"))
    sure = spread.where(F.col("sites") > min_sites + margin).select("hash", "sites", F.lit(False).alias("exact"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select(
        "hash", "sites", F.lit(True).alias("exact")))


def drop_boilerplate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                     min_sites: int = 5, min_chars: int = 20, lg_k: int = 8) -> DataFrame:
    """One row per document: id, n_lines, n_removed, text without the lines that
    at least ``min_sites`` sites carry.

    The lines found are joined back over salted keys (a line may fill a third
    of the table) and come to each text as its own list of places.  Null text
    counts as empty (one empty line); a null site counts as no site; null ids
    and repeated rows are cleaned like others.  An empty table gives an
    empty result; other columns are ignored.
    """
    common = save(line_spread(df, site_col, text_col, min_sites, min_chars, lg_k), "line-common")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal texts have equal places: the text's hash is the key
    docs = docs.withColumn("key", F.unhex(F.md5("text")))
    places = _lines(docs).where(F.char_length("line") >= min_chars).select(
        "key", "at", F.unhex(F.md5("line")).alias("hash"))
    gone = save(join_salted(places, common.select("hash"), "hash", ["key", "at"], "inner")
                .groupBy("key").agg(F.collect_set("at").alias("gone")), "line-places")
    out = join_salted(docs, gone, "key", ["id"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    return out.select(
        F.col("id").alias(id_col), F.size(lines).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("bigint").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
