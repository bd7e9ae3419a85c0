"""Global row numbers without an unpartitioned window.

``row_number() over (order by x)`` with no partition key moves every row into
one task.  ``global_row_number`` instead range-sorts the rows across all
partitions, numbers rows inside each partition, and adds the number of rows
in all earlier partitions (a table with one row per partition).  The sorted
frame is checkpointed to the shared checkpoint folder first, so both passes
see the same partitions and a lost executor does not renumber anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """1..N over a *unique* total order (include a key column as tie-break)."""
    ensure_checkpoint_dir(df.sparkSession)
    order = [order] if isinstance(order, str) else list(order)
    s = (df.orderBy(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = s.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    s = s.drop("_mid").checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: small by construction, so the running sum is cheap
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    out = s.join(F.broadcast(offs), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_local") + 1).cast("bigint")).drop(
        "_pid", "_local", "_off")


def global_running_sums(df: DataFrame, order, cols, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``cols`` in a unique global order.

    Same shape as ``global_row_number``: range sort, running sums inside each
    partition, plus the totals of all earlier partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    order = [order] if isinstance(order, str) else list(order)
    s = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("*", *[F.sum(c).over(w).alias(f"_loc_{c}") for c in cols])
    tot = s.groupBy("_pid").agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_tot_{c}").over(wo), F.lit(0)).alias(f"_off_{c}")
                                for c in cols])
    out = s.join(F.broadcast(offs), "_pid")
    return out.select(*df.columns, *[(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(f"{prefix}{c}")
                                     for c in cols])


def top_k_per_group(df: DataFrame, group, order, k: int, bucket_cols, buckets: int = 64,
                    name: str = "rank") -> DataFrame:
    """Exact top-k rows per group without sorting a whole group in one task.

    Rows are spread over ``buckets`` sub-groups by a hash of ``bucket_cols``;
    the local top k of every sub-group is kept, and only those (at most
    k * buckets per group) are ranked per group.  Any global top-k row is in
    its sub-group's top k, so the result is exact.
    """
    group = [group] if isinstance(group, str) else list(group)
    order = [order] if isinstance(order, (str,)) else list(order)
    bucket_cols = [bucket_cols] if isinstance(bucket_cols, str) else list(bucket_cols)
    b = df.withColumn("_bk", F.pmod(F.xxhash64(*bucket_cols), F.lit(buckets)))
    local = Window.partitionBy(*group, "_bk").orderBy(*order)
    b = b.withColumn("_lr", F.row_number().over(local)).where(F.col("_lr") <= k).drop("_lr", "_bk")
    final = Window.partitionBy(*group).orderBy(*order)
    return b.withColumn(name, F.row_number().over(final)).where(F.col(name) <= k)


#: A rank selection counts a 31-bit draw in so many buckets.
SELECT_BITS = 16
#: Copies of one row are repeated in pieces of so many.
_PIECE = 1 << 14


def part_by_rank(df: DataFrame, group, draw, order, cuts, name: str = "part") -> DataFrame:
    """Adds the number of cuts below each row's rank inside its group: 0 for
    ranks up to the first cut, 1 up to the second, and so on.

    Rows of a group are ranked by ``draw`` (an integer column expression in [0, 2**31)),
    then by the columns ``order``, then by all others by name.  ``cuts`` makes the cut ranks, in
    ascending order, from the column of the group's row count.

    No row is sorted but those near a cut: a histogram of the draws (one row per
    group and bucket) tells the bucket that holds each cut; rows of other buckets get
    their part by comparing buckets, in place.  The rows of the cut buckets, a few
    ten-thousandths of all, are ranked; equal ones are counted first, so that a row with any
    number of copies is one.  Groups are few (labels): their table of cuts is broadcast.
    Rows whose group is null are dropped.
    """
    group = [group] if isinstance(group, str) else list(group)
    cols = df.columns
    d = df.withColumn("_draw", draw)
    d = d.withColumn("_bucket", F.coalesce(F.shiftright("_draw", 31 - SELECT_BITS), F.lit(-1)))
    hist = d.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*group, "_bucket", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                       F.sum("_rows").over(Window.partitionBy(*group)).alias("_n"))
    at = [F.col("_before") < c.cast("bigint") for c in cuts(F.col("_n"))]
    holds = [below & (F.col("_before") + F.col("_rows") >= c.cast("bigint")) for below, c in zip(at, cuts(F.col("_n")))]
    table = hist.groupBy(*group).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(h, F.col("_bucket"))).alias(f"_bucket{i}") for i, h in enumerate(holds)],
        *[F.max(F.when(h, F.col("_before"))).alias(f"_before{i}") for i, h in enumerate(holds)])
    # a cut at rank 0 lies before all buckets, one beyond the last rank after all of them
    ends = cuts(F.col("_n"))
    table = table.select(*group, *[F.col(f"_before{i}") for i in range(len(ends))], *[
        c.cast("bigint").alias(f"_cut{i}") for i, c in enumerate(ends)], *[
        F.coalesce(f"_bucket{i}", F.when(c < 1, F.lit(-2)).otherwise(F.lit(1 << SELECT_BITS))).alias(f"_bucket{i}")
        for i, c in enumerate(ends)])
    d = d.join(F.broadcast(table), group)
    cut_bucket = [F.col("_bucket") == F.col(f"_bucket{i}") for i in range(len(ends))]
    inside = cut_bucket[0]
    for c in cut_bucket[1:]:
        inside = inside | c
    far = d.where(~inside).select(*cols, sum(((F.col("_bucket") > F.col(f"_bucket{i}")).cast("int")
                                              for i in range(len(ends))), F.lit(0)).alias(name))
    rest = [F.col(c) for c in order] + [F.col(c) for c in sorted(cols) if c not in order and c not in group]
    extra = [c for c in table.columns if c not in group]
    near = d.where(inside).groupBy(*cols, "_draw", "_bucket", *extra).agg(F.count(F.lit(1)).alias("_copies"))
    upto = Window.partitionBy(*group, "_bucket").orderBy("_draw", *rest).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_rank", F.coalesce(F.sum("_copies").over(upto), F.lit(0)))
    # copies of the row up to each cut, then those of each part
    held = [F.when(F.col("_bucket") < F.col(f"_bucket{i}"), F.col("_copies")).when(
        F.col("_bucket") > F.col(f"_bucket{i}"), F.lit(0)).otherwise(F.least(F.greatest(
            F.col(f"_cut{i}") - F.col(f"_before{i}") - F.col("_rank"), F.lit(0)), F.col("_copies"))) for i in range(len(ends))]
    held = [F.lit(0), *held, F.col("_copies")]
    parts = F.array(*[F.struct(F.lit(i).alias("part"), (b - a).cast("bigint").alias("n"))
                      for i, (a, b) in enumerate(zip(held, held[1:]))])
    near = near.select(*cols, F.explode(F.filter(parts, lambda x: x["n"] > 0)).alias("_p"))
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_p.n") - 1, F.lit(_PIECE).cast("bigint")))
    near = near.select(*cols, "_p", pieces.alias("_at"))
    repeat = F.array_repeat(F.lit(0), F.least(F.lit(_PIECE), F.col("_p.n") - F.col("_at")).cast("int"))
    near = near.select(*cols, F.col("_p.part").alias(name), F.explode(repeat).alias("_one")).drop("_one")
    return far.unionByName(near)


def row_draw(seed: int, *cols):
    """A 31-bit draw fixed by the seed and the values of ``cols``, that any SQL engine with
    md5 can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), 1)


def lowest_draws(df: DataFrame, n: int, draw, order=()) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer): those with the lowest draws, ties by ``order`` and
    then by all columns.  Two passes, no sort of the whole."""
    one = df.withColumn("_all", F.shiftright(draw, 31).cast("int"))    # one group: 0, though no constant to the planner
    picked = part_by_rank(one, "_all", draw, list(order), lambda total: [F.least(total, F.lit(n))], "_part")
    return picked.where("_part = 0").select(*df.columns)


# Park-Miller modulus; all products below stay under 2^63.
_P = 2147483647


def portable_hash(*cols, seed: int = 42):
    """A deterministic 31-bit hash of integer columns that any SQL engine can
    repeat: fold with x = (x*1000003 + c) mod P, then two Lehmer steps."""
    x = F.lit(seed % _P).cast("bigint")
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        x = F.pmod(x * 1000003 + F.pmod(c.cast("bigint"), F.lit(_P)), F.lit(_P))
    x = F.pmod(x * 48271, F.lit(_P))
    return F.pmod(x * 69621, F.lit(_P))


_TWO52 = float(1 << 52)


def hashed_normal(seed: int, *cols):
    """A standard normal draw fixed by (seed, cols): Box-Muller on two uniforms of 52 bits
    each, the first and the next 13 digits of an md5.  Recomputing a lost partition gives
    the same numbers whatever the row order, and any SQL engine with md5 can repeat them."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    u1, u2 = ((F.conv(F.substring(text, at, 13), 16, 10).cast("bigint").cast("double") + 0.5) / _TWO52 for at in (1, 14))
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * 3.141592653589793 * u2)
