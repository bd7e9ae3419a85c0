"""Hard negatives: rows of another label that score nearly as high as a positive.

Components are integers (floor of a scale times the component), and scores are
inner products of integers, taken exactly in a residue number system: the component
matrices of two blocks are reduced modulo several small primes, multiplied in single
precision (every partial sum stays below 2**24, so no product rounds), and the
signed scores come back from the residues by Chinese remaindering.  As many primes are
used as the largest score needs.

Anchors and rows meet in blocks: first anchors with the rows of their label, which
gives the positives and the window of each; then anchors with all blocks of rows,
of which the best of each window are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import save, sorted_groups

#: Primes below 2**8, largest first: products of balanced residues are at most 125 ** 2.
PRIMES = [p for p in range(255, 2, -2) if all(p % q for q in range(3, 16, 2))]
#: Rows and anchors of a block; least number of blocks, so that small tables are dealt too.
BLOCK, ANCHORS, LEAST_BLOCKS = 16_384, 65_536, 24
#: Squared length from which a vector takes no part (scores of all others fit 63 bits).
MAX_SQUARE = 2.0 ** 61


def moduli(bound: float) -> list[int]:
    """Primes whose product exceeds twice the bound of a score, in absolute value."""
    out, product = [], 1
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > 2 * bound + 1:
            return out
    raise ValueError("scores too large for the residue system")


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p in [-(p - 1) / 2, (p - 1) / 2]."""
    return (x + p // 2) % p - p // 2


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues modulo p of a @ b.T, by products in single precision."""
    step = ((1 << 24) - 1) // (p // 2) ** 2
    total = np.zeros((len(a), len(b)), dtype=np.int32)
    x, y = balanced(a, p).astype(np.float32), balanced(b, p).astype(np.float32)
    for k in range(0, a.shape[1], step):
        total = balanced(total + (x[:, k:k + step] @ y[:, k:k + step].T).astype(np.int32), p)
    return total


def exact_product(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """a @ b.T of integers, where no value exceeds half the product of the primes.

    Mixed-radix digits from balanced residues add up to the signed value at once; sums
    are taken modulo 2**64, in which the value itself fits.
    """
    digits: list[np.ndarray] = []
    value = np.zeros((len(a), len(b)), dtype=np.int64)
    scale = 1
    for k, p in enumerate(primes):
        digit, weight = residue_product(a, b, p), 1
        for q, d in zip(primes[:k], digits):
            digit = balanced(digit - d * (weight % p), p)
            weight *= q
        digit = balanced(digit * pow(weight % p, -1, p), p).astype(np.int32)
        digits.append(digit)
        with np.errstate(over="ignore"):
            value += digit.astype(np.int64) * np.uint64(scale % (1 << 64)).astype(np.int64)
        scale *= p
    return value


def _integers(col, dim: int) -> np.ndarray:
    """Rows of a list column of integers, padded with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, sizes = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if dim and (sizes == dim).all():
        return flat.reshape(len(col), dim)
    out = np.zeros((len(col), dim), dtype=np.int32)
    out[np.repeat(np.arange(len(col)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def integer_rows(df: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, q, square) of the rows that take part."""
    def run(batches):
        for batch in batches:
            col = batch.column(2)
            sizes = np.diff(col.offsets.to_numpy())
            x = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            q = np.floor(scale * x)
            row = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(row, weights=~np.isfinite(x), minlength=len(sizes)) > 0
            q[~np.isfinite(q)] = 2.0 ** 31
            square = np.bincount(row, weights=q * q, minlength=len(sizes))
            good = ~bad & (square < MAX_SQUARE)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes * good)]).astype(np.int32)),
                                             pa.array(q[good[row]].astype(np.int32)))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep),
                                              lists.filter(keep), pa.array(square[good])], ["id", "label", "q", "square"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"),
                     F.col(vec_col).cast("array<double>").alias("v")).where(
        "id is not null and label is not null and v is not null and not exists(v, x -> x is null)")
    return rows.mapInArrow(run, "id long, label int, q array<int>, square double")


def _meet(rows: DataFrame, keys: list[str], dim: int, primes: list[int], choose, schema: str) -> DataFrame:
    """Runs ``choose`` on every group of ``keys``: rows (kind 1) sorted by id, and a
    hundred anchors (kind 0) at a time with their exact scores."""
    def run(batches):
        for group in sorted_groups(batches, len(keys)):
            kind = group["kind"].to_numpy()
            n = int((kind == 0).sum())
            if not n or n == len(kind):
                continue
            asks, others = group.slice(0, n), group.slice(n)
            a, b = _integers(asks["q"], dim), _integers(others["q"], dim)
            ids, labels = others["id"].to_numpy(), others["label"].to_numpy()
            for k in range(0, n, 128):
                part = asks.slice(k, 128)
                out = choose(part, exact_product(a[k:k + 128], b, primes), ids, labels)
                if out is not None:
                    yield out

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "id")
    return dealt.mapInArrow(run, schema)


def _first(scores: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` highest scores, ties to the first place."""
    if len(scores) > many:
        edge = np.partition(scores, len(scores) - many)[len(scores) - many]
        above, equal = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        place = np.concatenate([above, equal[:many - len(above)]])
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((place, -scores[place]))]


def _positives(many: int):
    def choose(part, scores, ids, labels):
        out = []
        for anchor, label, row in zip(part["id"].to_pylist(), part["label"].to_pylist(), scores):
            at = np.flatnonzero((labels == label) & (ids != anchor))
            at = at[_first(row[at], many)]
            out.append((np.full(len(at), anchor, dtype=np.int64), ids[at], row[at]))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_id", "positive_id", "positive_score"])
    return choose


def _negatives(many: int):
    def choose(part, scores, ids, labels):
        out = []
        for anchor, label, row, windows in zip(part["id"].to_pylist(), part["label"].to_pylist(), scores,
                                               part["windows"].to_pylist()):
            low, high = min(w["low"] for w in windows), max(w["high"] for w in windows)
            at = np.flatnonzero((labels != label) & (row >= low) & (row <= high))
            s = row[at]
            for w in windows:
                mine = np.flatnonzero((s >= w["low"]) & (s <= w["high"]))
                mine = at[mine[_first(s[mine], many)]]
                out.append((np.full(len(mine), anchor, dtype=np.int64), np.full(len(mine), w["positive_id"], dtype=np.int64),
                            np.full(len(mine), w["positive_score"], dtype=np.int64), ids[mine], row[mine]))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [
            "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return choose


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is divisible by ``every``.  An anchor's positives are its
    first other rows of the same label, its negatives for each positive the first
    rows of another label with low * p <= 100 * s <= high * p; higher scores
    come first, ties by smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part,
    nor vectors whose scaled squared length reaches 2**61 (so components fit 32 bits, scores a
    long).  An id with several rows counts once, with its smallest label and vector;
    a shorter vector counts as padded with zeros.  Anchors without positives, and positives
    without negatives, give no row.  An empty table gives an empty result; other columns are
    ignored.
    """
    spark = df.sparkSession
    rows = integer_rows(df, scale, id_col, vec_col, label_col)
    rows = save(rows.groupBy("id").agg(F.min(F.struct("label", "q", "square")).alias("x")).select("id", "x.*"), "negatives-rows")
    count, dim, square = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max("square")).first()
    dim, primes = dim or 0, moduli((square or 0.0) * (1 + 1e-9) + 1)
    asks = rows.where(F.col("id") % every == 0)
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")

    # anchors and rows of a label, in blocks; the table of labels has their counts
    load = save(rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("pb"),
                                          F.ceil(F.count_if(F.col("id") % every == 0) / ANCHORS).cast("int").alias("qb")).where(
        "qb > 0"), "negatives-labels")
    split = F.greatest(F.col("pb"), F.least(F.lit(LEAST_BLOCKS), F.lit(int(count or 0) // 512 + 1)))
    own = rows.join(load, "label")
    mine = own.select("label", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qblock"), deal(split).alias("pblock"),
                      F.lit(1).alias("kind"), "id", "q")
    asked = own.where(F.col("id") % every == 0).select(
        "label", deal(F.col("qb")).alias("qblock"), F.explode(F.sequence(F.lit(0), split - 1)).alias("pblock"),
        F.lit(0).alias("kind"), "id", "q")
    near = _meet(mine.unionByName(asked), ["label", "qblock", "pblock"], dim, primes, _positives(positives),
                 "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)

    # windows without overflow: ceil and floor of share * score / 100
    part = lambda share, up: F.expr(
        f"{share} * ((positive_score - pmod(positive_score, 100)) div 100) + "
        f"({share} * pmod(positive_score, 100) + {up}) div 100")
    windows = near.select("anchor_id", F.struct("positive_id", "positive_score", part(low, 99).alias("low"),
                                                part(high, 0).alias("high")).alias("w")).where("w.low <= w.high")
    windows = save(windows.groupBy("anchor_id").agg(F.collect_list("w").alias("windows")), "negatives-windows")

    blocks = max(-(-int(count or 0) // BLOCK), min(LEAST_BLOCKS, int(count or 0) // 512 + 1))
    groups = max(1, -(-(int(count or 0) // every + 1) // ANCHORS))
    none = F.lit(None).cast(windows.schema["windows"].dataType).alias("windows")
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qblock"),
                             deal(F.lit(blocks)).alias("pblock"), F.lit(1).alias("kind"), "id", "label", "q", none)
    anchors = asks.join(windows, asks["id"] == windows["anchor_id"]).select(
        deal(F.lit(groups)).alias("qblock"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("pblock"),
        F.lit(0).alias("kind"), "id", "label", "q", "windows")
    found = _meet(candidates.unionByName(anchors), ["qblock", "pblock"], dim, primes, _negatives(negatives),
                  "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
