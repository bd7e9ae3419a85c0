"""KMeans in one scan per step (M7) and PCA of sparse rows (M8)."""

import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.linalg import Vectors

from adlens.operators import cluster as C


def sparse(spark, x):
    rows = [(f"d{i}", np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id string, idx array<int>, val array<double>").repartition(3)


def blobs(n=60, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(scale=0.05, size=(n, 6))
    x[np.arange(n), np.arange(n) % 3] += 5.0
    return x * (r.random((n, 6)) > 0.1) + 5.0 * np.eye(6)[np.arange(n) % 3] * 0.01


def brute_cost(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in set(labels.tolist()))


def test_clusters_of_separate_groups(spark):
    x = blobs()
    got, centres = C.kmeans(sparse(spark, x), 6, 3, restarts=5)
    label = {r["doc_id"]: r["cluster"] for r in got.collect()}
    labels = np.array([label[f"d{i}"] for i in range(60)])
    assert len(label) == 60 and len(set(labels.tolist())) == 3
    for c in range(3):      # a centre is the mean of its rows, a row's cluster its nearest centre
        assert centres[c] == pytest.approx(x[labels == c].mean(0), abs=1e-4)
    assert (C.squares(x, centres).argmin(1) == labels).all()
    again = {r["doc_id"]: r["cluster"] for r in C.kmeans(sparse(spark, x).repartition(7), 6, 3, restarts=5)[0].collect()}
    assert again == label


def test_best_of_the_restarts_and_few_rows(spark):
    x = np.random.default_rng(3).random((40, 6))
    costs = [brute_cost(x, np.array([dict(map(tuple, C.kmeans(sparse(spark, x), 6, 4, restarts=r)[0].collect()))[f"d{i}"]
                                     for i in range(40)])) for r in (1, 8)]
    assert costs[1] <= costs[0] + 1e-9
    few, _ = C.kmeans(sparse(spark, np.eye(3)), 3, 5, restarts=2)
    assert len({r["cluster"] for r in few.collect()}) == 3
    same, _ = C.kmeans(sparse(spark, np.ones((6, 2))), 2, 3, restarts=2)      # equal rows: one cluster has all
    assert len({r["cluster"] for r in same.collect()}) == 1
    with pytest.raises(ValueError):
        C.kmeans(sparse(spark, np.eye(2)), 2, 2)


def test_axes_equal_the_library(spark):
    x = blobs(80, 4)
    mean, axes, shares = C.principal_axes(sparse(spark, x), 6)
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], ["v"])
    model = PCA(k=2, inputCol="v", outputCol="o").fit(df)
    theirs = model.pc.toArray()
    assert mean == pytest.approx(x.mean(0)) and shares.tolist() == pytest.approx(model.explainedVariance.toArray().tolist())
    assert np.abs((axes * theirs).sum(0)).tolist() == pytest.approx([1.0, 1.0])
    xy = {r["doc_id"]: (r["x"], r["y"]) for r in C.project(sparse(spark, x), mean, axes).collect()}
    for i in range(80):
        assert xy[f"d{i}"] == pytest.approx(tuple((x[i] - x.mean(0)) @ axes))
    assert C.project(sparse(spark, np.zeros((3, 1))), *C.principal_axes(sparse(spark, np.zeros((3, 1))), 0)[:2]).count() == 3
