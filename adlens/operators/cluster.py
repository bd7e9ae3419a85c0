"""M7/M8 on sparse rows: KMeans with all restarts in one scan per step, and PCA from one
aggregation.

A row is (doc_id, idx, val), the places and values that are not 0.  Tasks turn a few
thousand rows at a time into a matrix; what leaves a task is a partial sum per centre, or
per row of the Gram matrix, whose size depends on the vocabulary and k alone, and is added up
by key before it reaches the driver.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are a matrix at once.
ROWS = 2_048


def _ship_by_value() -> None:
    """Python workers need NumPy and Arrow, not this package on their path."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def matrices(batches, dim: int):
    """(slice of the batch, its rows as a dense matrix)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            idx, val = part.column(part.schema.get_field_index("idx")), part.column(part.schema.get_field_index("val"))
            x = np.zeros((part.num_rows, dim))
            row = np.repeat(np.arange(part.num_rows), np.diff(idx.offsets.to_numpy()))
            x[row, idx.flatten().to_numpy()] = val.flatten().to_numpy()
            yield part, x


def uniforms(h: np.ndarray, stream: int) -> np.ndarray:
    """Uniform draws in (0, 1) of 64-bit hashes, a new one for each stream."""
    x = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (stream + 1)) % (1 << 64))
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return np.maximum(d, 0.0)


def sum_vectors(table: pa.Table) -> pa.Table:
    """One row of the rows of a key: their n, cost and vec added up."""
    vec = np.stack([np.asarray(v) for v in table["vec"].to_pylist()]).sum(0)
    return pa.Table.from_arrays([table["key"].slice(0, 1), pa.array([float(table["n"].to_numpy().sum())]),
                                 pa.array([float(table["cost"].to_numpy().sum())]), pa.array([vec.tolist()], pa.list_(pa.float64()))],
                                ["key", "n", "cost", "vec"])


_PART = "key int, n double, cost double, vec array<double>"


def _parts(keys, n, cost, vec) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(n, pa.float64()), pa.array(cost, pa.float64()),
                                       pa.array([v.tolist() for v in vec], pa.list_(pa.float64()))], ["key", "n", "cost", "vec"])


def _added(parts: DataFrame) -> list:
    return parts.groupBy("key").applyInArrow(sum_vectors, _PART).collect()


def _first_centres(rows: DataFrame, dim: int, k: int, restarts: int) -> np.ndarray:
    """k centres for every restart: one row at random, then rows with a probability in
    proportion to the squared distance to the nearest centre so far.  The row with the least
    -ln(u) / distance is such a draw, and a least value merges across tasks."""
    centres = np.zeros((restarts, 0, dim))
    for step in range(k):
        have = centres.copy()

        def race(batches):
            best: dict[int, tuple[float, list]] = {}
            for part, x in matrices(batches, dim):
                h = part.column(part.schema.get_field_index("h")).to_numpy()
                for r in range(restarts):
                    far = squares(x, have[r]).min(1) if step else np.ones(len(x))
                    key = -np.log(uniforms(h, r * k + step)) / np.where(far > 1e-12, far, 1e-300)
                    i = int(np.argmin(key))
                    if r not in best or key[i] < best[r][0]:
                        best[r] = (float(key[i]), x[i].copy())
            if best:
                yield _parts(list(best), [b[0] for b in best.values()], [0.0] * len(best), [b[1] for b in best.values()])

        won = rows.mapInArrow(race, _PART).groupBy("key").agg(F.min(F.struct("n", "vec")).alias("x")).select("key", "x.vec").collect()
        chosen = np.zeros((restarts, 1, dim))
        for r in won:
            chosen[r["key"], 0] = r["vec"]
        centres = np.concatenate([centres, chosen], axis=1)
    return centres


def kmeans(sparse: DataFrame, dim: int, k: int, restarts: int = 10, seed: int = 42, max_iter: int = 50, tol: float = 1e-4):
    """M7: (doc_id, cluster) and the centres of the best of ``restarts`` runs by cost, with k = min(k, n).

    Every step of all runs that still move is one scan of the stored rows.  Draws are hashes of
    (seed, id), so a rerun gives the same clusters.  Fewer than 3 documents is an error."""
    _ship_by_value()
    dim = max(dim, 1)
    rows = sparse.select("doc_id", "idx", "val", F.xxhash64(F.lit(seed), "doc_id").alias("h")).persist()
    n = rows.count()
    if n < 3:
        rows.unpersist()
        raise ValueError(f"Need at least 3 ads to cluster, got {n}")
    k = min(k, n)
    centres, cost, moving = _first_centres(rows, dim, k, restarts), np.full(restarts, np.inf), list(range(restarts))
    for _ in range(max_iter):
        now, runs = centres[moving].reshape(-1, dim), list(moving)

        def step(batches):
            sums, count, spent = np.zeros((len(now), dim)), np.zeros(len(now)), np.zeros(len(now))
            for _, x in matrices(batches, dim):
                d = squares(x, now).reshape(len(x), len(runs), k)
                near = d.argmin(2) + np.arange(len(runs))[None, :] * k
                for r in range(len(runs)):
                    own = np.zeros((len(x), k))
                    own[np.arange(len(x)), near[:, r] - r * k] = 1
                    sums[r * k:(r + 1) * k] += own.T @ x
                count += np.bincount(near.ravel(), minlength=len(now))
                spent += np.bincount(near.ravel(), weights=d.min(2).ravel(), minlength=len(now))
            some = np.flatnonzero(count)
            if len(some):
                yield _parts(some, count[some], spent[some], sums[some])

        new, total = now.copy(), np.zeros(len(runs))
        for r in _added(rows.mapInArrow(step, _PART)):
            new[r["key"]] = np.array(r["vec"]) / r["n"]
            total[r["key"] // k] += r["cost"]
        shift = np.sqrt(((new - now) ** 2).sum(1)).reshape(len(runs), k).max(1)
        for i, r in enumerate(runs):
            cost[r], centres[r] = total[i], new[i * k:(i + 1) * k]
        moving = [r for i, r in enumerate(runs) if shift[i] > tol]
        if not moving:
            break
    # runs that end alike differ by rounding only: the first of them counts
    best = centres[int(np.argmin(np.round(cost / max(float(cost.min()), 1e-12), 9)))]

    def assign(batches):
        for part, x in matrices(batches, dim):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(squares(x, best).argmin(1).astype(np.int32))], ["doc_id", "cluster"])

    kind = sparse.schema["doc_id"].dataType.simpleString()
    # the stored rows are read once more, here; the caller keeps the result
    return rows.mapInArrow(assign, f"doc_id {kind}, cluster int"), best


def principal_axes(sparse: DataFrame, dim: int, m: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """M8: (mean, axes, their shares of the variance) of the rows.  The covariance is the Gram matrix
    less the outer product of the mean, so sparse rows are never centred.  An axis' largest
    component is positive."""
    _ship_by_value()
    dim = max(dim, 1)

    def gram(batches):
        total, n, sums = np.zeros((dim, dim)), 0, np.zeros(dim)
        for _, x in matrices(batches, dim):
            total, n, sums = total + x.T @ x, n + len(x), sums + x.sum(0)
        if n:
            yield _parts(range(dim + 1), [float(n)] * (dim + 1), [0.0] * (dim + 1), [*total, sums])

    got = {r["key"]: (r["n"], np.array(r["vec"])) for r in _added(sparse.select("doc_id", "idx", "val").mapInArrow(gram, _PART))}
    m = min(m, dim)
    if not got:
        return np.zeros(dim), np.zeros((dim, m)), np.zeros(m)
    n, mean = got[dim][0], got[dim][1] / got[dim][0]
    cov = np.stack([got[i][1] for i in range(dim)]) / n - np.outer(mean, mean)
    value, vector = np.linalg.eigh(cov)
    axes = vector[:, ::-1][:, :m]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(m)] < 0, -1.0, 1.0)
    total = max(float(np.trace(cov)), 1e-300)
    return mean, axes, np.maximum(value[::-1][:m], 0.0) / total


def project(sparse: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """M8: (doc_id, x, y) of the centred rows on two axes (0 on an axis that is not there)."""
    _ship_by_value()
    dim, offset = len(mean), mean @ axes

    def run(batches):
        for part, x in matrices(batches, dim):
            xy = np.zeros((len(x), 2))
            xy[:, :axes.shape[1]] = x @ axes - offset
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], ["doc_id", "x", "y"])

    kind = sparse.schema["doc_id"].dataType.simpleString()
    return sparse.select("doc_id", "idx", "val").mapInArrow(run, f"doc_id {kind}, x double, y double")
