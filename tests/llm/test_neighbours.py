"""Recall of the nearest neighbours against brute force."""


import numpy as np


from pagemill.llm import neighbours


def recall(spark, x, **how):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, vectors array<float>")
    got = {(r[0], r[1]) for r in neighbours.nearest(df, 5, **how).select("vec_id", "neighbour").collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    true = {(i, int(j)) for i, row in enumerate(np.argsort(-c, axis=1)[:, :5]) for j in row}
    assert len(got) == len(true)
    return len(got & true) / len(true)


def test_vectors_without_clusters(spark):
    x = np.random.default_rng(1).normal(size=(4000, 64)).astype(np.float32)
    assert recall(spark, x) > 0.999


def test_scan_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SCAN_BLOCK", 300)
    x = np.random.default_rng(2).normal(size=(1000, 64)).astype(np.float32)
    assert recall(spark, x) > 0.999


def test_index_searches_as_far_as_measured(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SCAN_GAIN", 0)
    monkeypatch.setattr(neighbours, "CANDIDATES", 20)
    x = np.random.default_rng(3).normal(size=(1500, 64)).astype(np.float32)
    assert recall(spark, x) >= 0.9
