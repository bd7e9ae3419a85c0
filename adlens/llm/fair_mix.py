"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.functions.ranking import global_row_number, global_running_sums
from adlens.llm.common import WORD, join_salted, save


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, cycle=(1, 2, 3), budget: int | None = None,
                   epochs: int = 3) -> DataFrame:
    """(key, source_size, before, target) for every source key.

    Sources weigh ``cycle`` in the order of their keys and share ``budget``
    words (default: all there are).  A target stops at ``epochs`` times its
    source; what is over goes to the others by weight until none is above.
    Only one pair of sums per round comes to the driver.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    per = global_row_number(per, "key", "rank")
    pattern = F.array(*[F.lit(int(c)) for c in cycle])
    per = save(per.select("key", "source_size", F.element_at(
        pattern, (F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1).cast("int"))
        .cast("bigint").alias("weight")), "mix-sources")
    before = global_running_sums(per, "key", ["source_size"])
    cap = F.col("source_size") * epochs
    total = per.agg(F.sum("source_size")).first()[0] or 0
    budget = total if budget is None else budget
    level = None  # words per unit of weight of the sources below their cap, as (words, weights)
    while True:
        over = F.lit(False) if level is None else F.lit(float(level[0])) * F.col("weight") / F.lit(
            float(max(level[1], 1))) > cap
        row = per.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        new = (budget - (row[0] or 0), row[1] or 0)
        if new == level:
            break
        level = new
    share = F.lit(float(level[0])) * F.col("weight") / F.lit(float(max(level[1], 1)))
    return before.select("key", "source_size",
                         (F.col("cum_source_size") - F.col("source_size")).alias("before"),
                         F.when(share > cap, cap.cast("double")).otherwise(share).alias("target"))


def _source_key(source: Column) -> Column:
    """Sort key of a source: null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _draw(ident: Column, seed: int) -> Column:
    """Place of a document in the shuffled order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))


def fair_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", cycle=(1, 2, 3), budget: int | None = None,
             epochs: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    Each source's documents are shuffled by a keyed hash of the id and queue
    up ``epochs`` times.  A copy's virtual finish time is the number of words
    of its source up to and with it, divided by the source's target.  All
    copies are range-sorted by that time and taken while their running total
    stays within the budget; ``taken`` counts the words of a document's taken
    copies.  Running sums are taken per range partition with offsets, so no
    source is gathered in one task, and the cut is one row, with which every
    document then settles its own copies.

    Null text has size 0 and takes nothing; a null source is a source of its
    own, ordered last; null ids and repeated rows queue like others (equal
    rows are interchangeable).  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    rows = _served(df, id_col, text_col, source_col, cycle, budget, epochs, seed)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _served(df: DataFrame, id_col: str, text_col: str, source_col: str, cycle, budget, epochs: int, seed: int) -> DataFrame:
    """``fair_mix`` with the key and draw of each row."""
    slim = df.select(F.col(id_col).alias("id"), _source_key(F.col(source_col)).alias("key"),
                     word_count(F.col(text_col)).alias("size"))
    slim = save(slim.withColumn("draw", _draw(F.col("id"), seed)), "mix-sizes")
    targets = save(source_targets(slim, cycle, budget, epochs), "mix-targets")
    run = global_running_sums(slim, ["key", "draw", "id", "size"], ["size"])
    rows = save(join_salted(run, targets, "key", ["draw"], "inner").select(
        "id", "key", "size", "draw", "source_size", "target",
        (F.col("cum_size") - F.col("before")).alias("upto")), "mix-queue")
    if budget is None:
        budget = targets.agg(F.sum("source_size")).first()[0] or 0

    def place(epoch: Column) -> Column:
        time = (F.col("source_size") * epoch + F.col("upto")).cast("double") / F.col("target")
        return F.struct(time.alias("time"), F.col("key"), epoch.cast("int").alias("epoch"),
                        F.col("upto"), F.col("draw"))

    copies = rows.where("size > 0 and target > 0").select(
        "size", F.explode(F.array(*[place(F.lit(e)) for e in range(epochs)])).alias("at"))
    copies = copies.select("size", "at.*")
    order = ["time", "key", "epoch", "upto", "draw"]
    queue = global_running_sums(copies, order, ["size"])
    cut = queue.where(F.col("cum_size") <= budget).agg(F.max(F.struct(*order)).alias("at")).first()[0]
    if cut is None:
        taken = F.lit(0)
    else:
        last = F.struct(*[F.lit(cut[c]).cast(t).alias(c) for c, t in zip(
            order, ["double", "string", "int", "bigint", "string"])])
        served = [F.when(place(F.lit(e)) <= last, 1).otherwise(0) for e in range(epochs)]
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0),
                       F.col("size") * sum(served[1:], served[0])).otherwise(0)
    return rows.select("id", "key", "draw", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def take_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                cycle=(1, 2, 3), budget: int | None = None, epochs: int = 3, seed: int = 7) -> DataFrame:
    """Rows of ``df`` that ``fair_mix`` takes, once per taken copy, all columns kept.

    In each pass through a source's queue the mix serves the documents before one place.  One
    row per source with these places goes to the documents, which settle their
    copies beside their text: texts do not move unless the table of sources is too large for
    Catalyst to broadcast.  Rows of one source that are equal in id and size share a place: a pass that
    takes only some of them takes none, so the budget holds.  Documents without a word are not taken.
    """
    rows = _served(df, id_col, text_col, source_col, cycle, budget, epochs, seed).where("size > 0")
    at = F.struct("draw", "id", "size")
    ends = save(rows.groupBy("key").agg(*[
        F.min(F.when(F.col("taken") < F.col("size") * (e + 1), at)).alias(f"_end{e}") for e in range(epochs)])
        .withColumnRenamed("key", "_mix_key"), "mix-ends")
    ident = F.col(id_col)
    docs = df.withColumn("_mix_key_of", _source_key(F.col(source_col))).withColumn(
        "_mix_at", F.struct(_draw(ident, seed).alias("draw"), ident.alias("id"), word_count(F.col(text_col)).alias("size")))
    out = docs.join(ends, F.col("_mix_key_of") == F.col("_mix_key"))
    passes = [F.when(F.col(f"_end{e}").isNull() | (F.col("_mix_at") < F.col(f"_end{e}")), 1).otherwise(0) for e in range(epochs)]
    out = out.where(F.col("_mix_at")["size"] > 0).withColumn("_copies", sum(passes[1:], passes[0]))
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*df.columns)
