"""Whitening against a dense decomposition."""

import numpy as np
import pytest

pytest.importorskip("docflow.llm")
from docflow.llm import whitening  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def brute(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    dev = [sum(int(v) ** 2 for v in row) for row in n * x.astype(object) - s]
    return dev, values, c @ vecs[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def held(rows, vectors, k=8):
    dev, values, white, share = brute(list(vectors.values()), k)
    at = {v: i for i, v in enumerate(vectors)}
    assert len(rows) == len(vectors) * k and {r["n"] for r in rows} == {len(vectors)}
    sign = {}
    for r in rows:
        i, c = at[r["vec_id"]], r["component"] - 1
        assert r["deviation"] == dev[i] and abs(r["explained"] / share[c] - 1) < 1e-6 and r["identity_error"] < 1e-6
        if abs(white[i, c]) > 1e-3:
            sign.setdefault(c, np.sign(white[i, c] * r["whitened"]))
        assert abs(r["whitened"] * sign.get(c, 1) - white[i, c]) < 1e-6


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    vectors = {r[0]: list(r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    held(whitening.op11_whitening(spark, sf).collect(), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = {i: rng.normal(size=10).astype(np.float32).tolist() for i in range(50)}
    rows = [(i, v, None, "c") for i, v in good.items()] + [(100, None, 1, None), (101, [], 1, None), (102, [1.0] * 9 + [None], 1, None), (103, [float("nan")] * 10, 1, None), (104, [float("inf")] + [0.0] * 9, 1, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    held(whitening.whitened(frame).collect(), good)
    assert whitening.whitened(frame.limit(0)).count() == 0
    alike = spark.createDataFrame([(i, [0.25] * 10, 0, "") for i in range(20)] + [(None, [0.25] * 10, 0, "")], SCHEMA)
    assert whitening.whitened(alike).count() == 0
    twice = whitening.whitened(frame.unionByName(frame)).collect()
    assert len(twice) == 2 * 8 * len(good) and {r["n"] for r in twice} == {2 * len(good)}
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA))


def test_few_dimensions(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 3)).astype(np.float32)
    good = {i: [*map(float, r)] for i, r in enumerate(base)}
    held(whitening.whitened(spark.createDataFrame([(i, v, 0, "") for i, v in good.items()], SCHEMA)).collect(), good, 3)
    flat = {i: [*v, 0.5, 0.5] for i, v in good.items()}  # two dimensions without variance
    got = whitening.whitened(spark.createDataFrame([(i, v, 0, "") for i, v in flat.items()], SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and len(got) == 3 * len(flat)


def test_breakdown_and_repeated_values(spark):
    """Equal eigenvalues, more of them than directions of a block; breakdown after one pass."""
    rows = [(i, [(1.0 if j == i % 24 else 0.0) for j in range(24)], 0, "") for i in range(240)]
    vectors = whitening.integers(spark.createDataFrame(rows, SCHEMA), "embedding")
    w = whitening.fit(vectors, 30, block=4)
    assert len(w.values) == 23 and np.allclose(w.values, w.values[0]) and np.abs(w.vectors.T @ w.vectors - np.eye(23)).max() < 1e-10
    assert whitening.identity_error(vectors, w) < 1e-8


def test_converges_early(spark):
    """With a gap in the values, residuals end the passes before the space is full."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 120)) * np.array([2.0**-k for k in range(10)] + [1e-3] * 110) * 30
    vectors = whitening.integers(spark.createDataFrame([(i, [*map(float, r)], 0, "") for i, r in enumerate(x.astype(np.float32))], SCHEMA), "embedding")
    w = whitening.fit(vectors, residual=1e-10)
    dense = np.linalg.eigvalsh(np.cov((np.floor(1024 * x.astype(np.float32).astype(float))).T, bias=True))[::-1]
    assert w.passes < 15 and np.allclose(w.values, dense[:8], rtol=1e-9)


def test_wide_values(spark):
    x = np.array([[3e9, 1.0], [2.0, 5.0], [4.0, -3.0]])
    got = whitening.whitened(spark.createDataFrame([(i, [*map(float, r)]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    n, v = 3, np.floor(1024 * x).astype(np.int64) + 100_000
    exact = [sum(int(a) ** 2 for a in row) for row in n * v.astype(object) - v.sum(0)]
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: e if e < 2**63 else None for i, e in enumerate(exact)}
