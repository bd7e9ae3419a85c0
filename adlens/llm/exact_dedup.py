"""Exact dedup: 128-bit content hash, then a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import join_salted, save


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "min", content_hash=None, salts: int = 32) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by (MD5 of the text, text): the hash deals the rows, the
    text itself as the second key is the byte comparison, and both combine
    before the shuffle, so a text that fills a third of the table is one row
    per task.  Only groups of several rows are joined back, over salted keys.
    If two different texts ever share a hash, their rows are compared by text
    in a path of their own.

    ``keep`` is "min" or "max": which id of a group stays.  ``content_hash``
    replaces the hash (a function of a column, giving a binary column).

    Null text counts as empty.  A null id never wins over an id; a group with
    null ids only keeps them all (keep_id null).  Repeated rows count in
    group_size; all rows that carry the winning id are kept.  Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    best = {"min": F.min, "max": F.max}[keep]
    hash_of = content_hash or (lambda c: F.unhex(F.md5(c)))
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("_id"), text.alias("_t")).select(
        "_id", "_t", hash_of(F.col("_t")).alias("_h"))
    texts = base.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
    groups = save(
        texts.groupBy("_h").agg(F.sum("_n").alias("_n"), best("_keep").alias("_keep"),
                                F.count(F.lit(1)).alias("_texts"))
        .where(F.col("_n") > 1), "exact-groups")
    rows = base.select("_id", "_h", F.unhex(F.sha2(F.col("_t"), 256)).alias("_sha"))
    out = join_salted(rows, groups, "_h", ["_id"], "left", salts)
    if not groups.where(F.col("_texts") > 1).isEmpty():
        clash = groups.where(F.col("_texts") > 1).select("_h")
        hit = save(base.join(clash, "_h", "left_semi"), "exact-clashes")
        own = hit.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"),
                                          F.lit(1).cast("bigint").alias("_texts"))
        own = own.withColumn("_k", F.struct("_h", "_t")).drop("_h", "_t")
        hit = hit.select("_id", "_h", F.unhex(F.sha2(F.col("_t"), 256)).alias("_sha"),
                         F.struct("_h", "_t").alias("_k"))
        settled = join_salted(hit, own, "_k", ["_id"], "left", salts).select(*out.columns)
        out = out.where(F.coalesce(F.col("_texts"), F.lit(1)) == 1).unionByName(settled)
    solo = F.col("_n").isNull()
    keep_id = F.when(solo, F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce(F.col("_n"), F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))


def keep_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               keep: str = "min") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; of several rows
    with the winning id and text (repeated rows) any one stays."""
    result = save(exact_dedup(df, id_col, text_col, keep).select(F.col(id_col).alias("_id"), "kept", "text_sha256"),
                  "exact-result")
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)

    def of(rows: DataFrame, how: str, frame: DataFrame) -> DataFrame:
        ids = rows.select("_id", "text_sha256").distinct()
        return frame.join(ids, frame[id_col].eqNullSafe(ids["_id"]) & (sha == ids["text_sha256"]), how)

    out = of(result.where(~F.col("kept")), "left_anti", df)
    twice = result.where("kept").groupBy("_id", "text_sha256").count().where("count > 1")
    if twice.isEmpty():
        return out
    one = of(twice, "left_semi", out).withColumn("_sha", sha).dropDuplicates([id_col, "_sha"]).drop("_sha")
    return of(twice, "left_anti", out).unionByName(one)
