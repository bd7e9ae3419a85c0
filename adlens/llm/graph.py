"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import hot_bound, join_hot, save


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link, root the smallest node of its
    component (nodes are longs; links with a null or to itself are ignored).

    Large-star and small-star steps alternate: every node's neighbours are
    moved to its smallest neighbour until each component is a star, that is,
    until no node is both a centre and a neighbour of one.  A hub's links are
    dealt over salted keys; each round is written to the shared folder, and
    only its hubs (fewer than 512) and whether to go on come to the driver.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    rows = e.count()  # no step makes more
    while True:
        roles = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")),
                                           F.struct(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("to")))).alias("x")).select("x.*")
        roles = roles.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"),
                                          F.max(F.col("to").isNull()).alias("centre"), F.count(F.lit(1)).alias("held"))
        seen = roles.agg(F.max(F.expr("lo < hi or (centre and lo is not null)")).alias("open"),
                         F.collect_list(F.when(F.col("held") > hot_bound(2 * rows), F.col("node"))).alias("hubs")).first()
        if not seen["open"]:
            break
        hubs = lambda: seen["hubs"]
        # a link's larger end moves to the smallest neighbour of the smaller end, if that has a smaller one
        lower = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = join_hot(e, lower, rows, "v", ["u"], hubs).select("u", F.coalesce("m", "v").alias("v"))
        large = large.groupBy("u", "v").agg(F.count(F.lit(1))).select("u", "v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # the smallest neighbour's own row becomes the link of the node to it
        moved = join_hot(large, least, rows, "u", ["v"], hubs, "inner").select(
            F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        e = save(moved, "small-star")
    one = e.groupBy("u").agg(F.min("v").alias("v"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return one.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
