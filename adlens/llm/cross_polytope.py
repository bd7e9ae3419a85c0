"""Nearest neighbours by inner product with cross-polytope hashing.

Vectors are scaled by the largest norm and given one more coordinate, which
makes them unit vectors whose cosine with a query orders them by inner product.
A table's hash is the nearest signed axis after a pseudo-rotation (three rounds
of random signs and a fast Hadamard transform).  A query probes the cells of its
nearest axes in every table; inside a cell its inner products with the cell's
vectors are one matrix product, of which the best few are kept.  Candidates of all
cells are then reranked by their exact score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import join_salted, save, sorted_groups

#: Vectors of a cell that meet the queries of a cell at once.
CELL_BLOCK = 16_384


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two)."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(math.sqrt(n))


def rotate(x: np.ndarray, seed: tuple) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1, 1], dtype=np.float32), x.shape[1]))
    return x


def unit_points(v: np.ndarray, width: int, norm: float) -> np.ndarray:
    """Points on the unit sphere; the coordinate after the vector's fills up
    the length."""
    x = np.zeros((len(v), width), dtype=np.float32)
    x[:, :v.shape[1]] = v / norm
    x[:, v.shape[1]] = np.sqrt(np.maximum(0, 1 - (v / norm) ** 2 @ np.ones(v.shape[1])))
    return x


def unit_queries(v: np.ndarray, width: int) -> np.ndarray:
    x = np.zeros((len(v), width), dtype=np.float32)
    x[:, :v.shape[1]] = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    return x


def axis_codes(x: np.ndarray, table: int, levels: list[int], seed: int) -> np.ndarray:
    """Cell of each point in a table: the nearest signed axis of each level."""
    code = np.zeros(len(x), dtype=np.int64)
    for level, axes in enumerate(levels):
        r = rotate(x, (seed, table, level))[:, :axes]
        axis = np.argmax(np.abs(r), axis=1)
        code = code * (2 * axes) + 2 * axis + (r[np.arange(len(r)), axis] < 0)
    return code


def probe_codes(x: np.ndarray, table: int, levels: list[int], seed: int, probes: int) -> np.ndarray:
    """The ``probes`` cells of each query whose axes are nearest in sum."""
    cost, code = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1), np.int64)
    for level, axes in enumerate(levels):
        r = rotate(x, (seed, table, level))[:, :axes]
        full = np.concatenate([r, -r], axis=1)
        many = min(probes, 2 * axes)
        best = np.argsort(-full, axis=1, kind="stable")[:, :many]
        value = np.take_along_axis(full, best, axis=1)
        own = 2 * (best % axes) + best // axes
        cost = (cost[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * (2 * axes) + own[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(-cost, axis=1, kind="stable")[:, :probes]
        cost, code = np.take_along_axis(cost, keep, axis=1), np.take_along_axis(code, keep, axis=1)
    return code


def index_shape(n: int, width: int, tables: int, probes: int, cell: int = 8192) -> tuple[list[int], int, int]:
    """(axes of each level, tables, probes) for n vectors.

    Cells hold about ``cell`` vectors at most on even data: beyond that, a
    second level (and third, ...) with as many axes as are needed is hashed
    too, with more tables, since two near vectors then have to agree twice (to
    the power 0.41 of the added cells, the exponent at cosine 0.42).  Few
    vectors get more probes, so that about a thousand candidates are met.
    """
    levels, cells = [width], 2 * width
    while n > cells * cell:
        axes = min(width, max(2, math.ceil(n / cells / cell / 2)))
        levels.append(axes)
        cells *= 2 * axes
    tables = math.ceil(tables * (cells / (2 * width)) ** 0.41)
    probes = min(cells, max(probes, math.ceil(1000 * cells / (tables * max(n, 1)))))
    return levels, tables, probes


def _matrix(col, dim: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    out = np.zeros((len(col), dim))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(col.offsets.to_numpy())
    if len(col) and (sizes == dim).all():
        return flat.reshape(len(col), dim).astype(np.float64)
    out[np.repeat(np.arange(len(col)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _cells(classes: DataFrame, dim: int, width: int, norm: float, levels, tables: int, probes: int,
           seed: int) -> DataFrame:
    """(tab, cell, kind, cid, v): kind 1 once per table, kind 0 (queries) once
    per probed cell."""
    schema = pa.schema([("tab", pa.int32()), ("cell", pa.int64()), ("kind", pa.int32()),
                        ("cid", pa.int64()), ("v", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                cid, vecs = part.column(0), part.column(1)
                ask = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                v = _matrix(vecs, dim)
                points, queries = unit_points(v, width, norm), unit_queries(v[ask], width)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(v), t, np.int32)), pa.array(axis_codes(points, t, levels, seed)),
                        pa.array(np.ones(len(v), np.int32)), cid, vecs], schema=schema)
                    if len(ask):
                        codes = probe_codes(queries, t, levels, seed, probes)
                        who = pa.array(np.repeat(ask, codes.shape[1]))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(codes.size, t, np.int32)), pa.array(codes.ravel()),
                            pa.array(np.zeros(codes.size, np.int32)), cid.take(who), vecs.take(who)], schema=schema)

    return classes.select("cid", "v", "asks").mapInArrow(
        run, "tab int, cell long, kind int, cid long, v array<float>")


def _search(cells: DataFrame, dim: int, best: int) -> DataFrame:
    """(q, found): of every query and cell, the ``best`` classes of the cell by
    inner product, as an array of (neg, cid).

    Cells with more than CELL_BLOCK vectors or queries are split into pairs of
    blocks, so a group of rows is bounded however hot a cell is.
    """
    load = cells.groupBy("tab", "cell").agg(
        F.ceil(F.sum(1 - F.col("kind")) / CELL_BLOCK).cast("int").alias("qs"),
        F.ceil(F.sum("kind") / CELL_BLOCK).cast("int").alias("ps")).where("qs > 0 and ps > 0")
    rows = cells.join(load, ["tab", "cell"])
    mine, parts = F.when(F.col("kind") == 0, F.col("qs")).otherwise(F.col("ps")), F.when(
        F.col("kind") == 0, F.col("ps")).otherwise(F.col("qs"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid"), mine).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("tab", "cell", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")).alias("qb"),
                       F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own")).alias("pb"),
                       "kind", "cid", "v")
    rows = rows.repartition("tab", "cell", "qb", "pb").sortWithinPartitions("tab", "cell", "qb", "pb", "kind", "cid")

    def run(batches):
        for group in sorted_groups(batches, 4):
            kind = group["kind"].to_numpy()
            cid, n = group["cid"].to_numpy(), int((kind == 0).sum())
            if not n or n == len(kind):
                continue
            v = _matrix(group["v"], dim)
            points, names = v[n:], cid[n:]
            for a in range(0, n, 512):
                score = v[a:min(n, a + 512)] @ points.T
                k = min(best, score.shape[1])
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                neg = -np.take_along_axis(score, top, axis=1)
                pairs = pa.StructArray.from_arrays([pa.array(neg.ravel()), pa.array(names[top].ravel())], ["neg", "cid"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, neg.size + 1, k, dtype=np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([pa.array(cid[a:a + len(score)]), lists], ["q", "found"])

    return rows.mapInArrow(run, "q long, found array<struct<neg:double,cid:long>>")


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = 16, probes: int = 8, seed: int = 11) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of every vector
    whose id is divisible by ``every``, by inner product in double precision.

    Equal vectors are indexed and searched once; each keeps its k + 1 smallest
    ids, which is all that can appear in a result.  Queries that meet too few
    candidates are answered against all classes in blocks.

    Vectors that are null, zero or hold null or non-finite components take no part,
    nor do null ids.  An id with several vectors counts with the smallest; repeated
    rows count once.  A shorter vector counts as padded with zeros.  Ties go
    to the smaller id.  An empty table gives an empty result; other
    columns are ignored.
    """
    spark = df.sparkSession
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    # -0.0 + 0.0 is 0.0: equal vectors are equal arrays
    rows = rows.where("id is not null and v is not null").where(
        ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(
        F.exists(v, lambda x: x != 0)).withColumn("v", F.transform(v, lambda x: x + F.lit(0).cast("float")))
    rows = save(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("asks", F.col("id") % every == 0), "ann-rows")
    by_vector = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    kept = kept.withColumn("cid", F.element_at("ids", 1))
    asked = rows.groupBy("v").agg(F.min("id").alias("cid"), F.max("asks").alias("asks")).select("cid", "asks")
    classes = save(kept.join(asked, "cid"), "ann-classes")
    stats = classes.agg(F.count(F.lit(1)), F.max(F.size("v")),
                        F.max(F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)"))).first()
    n, dim = stats[0], stats[1] or 1
    norm, width = math.sqrt(stats[2] or 1.0) * (1 + 1e-6), 1 << dim.bit_length()
    levels, tables, probes = index_shape(n, width, tables, probes)
    few = 2 * (k + 1)

    def merged(found: DataFrame) -> DataFrame:
        """The best classes of each query over all its cells (bounded lists)."""
        one = found.select("q", F.explode("found").alias("x")).groupBy("q", "x.cid").agg(F.min("x.neg").alias("neg"))
        place = F.row_number().over(Window.partitionBy("q").orderBy("neg", "cid"))
        return one.withColumn("r", place).where(F.col("r") <= few).select("q", "cid")

    cells = _cells(classes, dim, width, norm, levels, tables, probes, seed)
    found = save(merged(_search(save(cells, "ann-cells"), dim, few)), "ann-found")
    names = classes.select("cid", "v", "ids")
    enough = min(k, max(0, rows.count() - 1))
    got = found.join(classes.select("cid", F.size("ids").alias("m")), "cid").groupBy("q").agg(F.sum("m").alias("m"))
    short = classes.where("asks").join(got.where(F.col("m") > enough).select(F.col("q").alias("cid")), "cid", "left_anti")
    short = save(short.select("cid", "v"), "ann-short")
    if not short.isEmpty():
        blocks = max(1, math.ceil(n / CELL_BLOCK))
        every_block = short.select(F.lit(-1).alias("tab"), F.explode(F.expr(
            f"sequence(0L, {blocks - 1}L)")).alias("cell"), F.lit(0).alias("kind"), "cid", "v")
        dealt = classes.select(F.lit(-1).alias("tab"), F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("cell"),
                               F.lit(1).alias("kind"), "cid", "v")
        scan = merged(_search(save(every_block.unionByName(dealt), "ann-scan"), dim, few))
        found = save(found.unionByName(scan).distinct(), "ann-found")
    scored = found.join(names, "cid").join(names.select(F.col("cid").alias("q"), F.col("v").alias("qv")), "q")
    dot = F.expr("aggregate(zip_with(v, qv, (x, y) -> coalesce(cast(x as double) * y, 0D)), 0D, (a, x) -> a + x)")
    spread = scored.select("q", dot.alias("score"), F.explode("ids").alias("id"))
    place = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    lists = spread.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("best"))
    asking = rows.where("asks").select("id", "v")
    named = join_salted(asking, names.select("v", F.col("cid").alias("q")), "v", ["id"], "inner").select("id", "q")
    results = join_salted(named, lists, "q", ["id"], "inner")
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)
    out = results.select(F.col("id").alias("query_id"), F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
