import numpy as np
import pytest

from tidemark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x long, row long, c string, task int, whitened string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "y", 4, "z") for i, v in rows], SCHEMA).repartition(4)


def usable(rows, dims):
    return [(i, [float(np.float32(c)) for c in v]) for i, v in rows
            if v and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]


def brute(rows, dims, k):
    """Sorted (vec_id, n, deviation) and the model by plain numpy."""
    rows = usable(rows, dims)
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = ((n * x - s) ** 2).sum(axis=1)
    c = ((n * x - s) / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return rows, n, dev, c, values[::-1][:k], vectors[:, ::-1][:, :k]


def check(spark, rows, dims, k=8, **how):
    found, model = W.whiten(table(spark, rows), **how)
    got = W.component_rows(found, model).collect()
    kept, n, dev, c, values, vectors = brute(rows, dims, k)
    assert len(got) == len(kept) * min(k, dims)
    assert all(r["n"] == n and r["identity_error"] < 1e-6 for r in got)
    assert sorted((str(i), int(d)) for (i, _), d in zip(kept, dev)) == sorted(
        (str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1)
    for m in range(min(k, dims)):
        one = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == m + 1)
        plain = c @ vectors[:, m] / np.sqrt(values[m])
        best = min((sorted((str(i), int(d), s * w) for (i, _), d, w in zip(kept, dev, plain)) for s in (1, -1)),
                   key=lambda t: max(abs(a[2] - b[2]) for a, b in zip(one, t)))
        assert [a[2] for a in one] == pytest.approx([b[2] for b in best], abs=1e-7)
        share = {r["explained"] for r in got if r["component"] == m + 1}
        assert len(share) == 1 and share.pop() == pytest.approx(values[m] / np.trace(c.T @ c / n), rel=1e-6)


def sample(n, dims=12, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, dims)) * np.linspace(1, 4, dims) @ r.normal(size=(dims, dims)) / 8).astype(np.float32)


BAD = [(1, None), (2, []), (3, [None] + [1.0] * 11), (4, [float("nan")] * 12), (5, [float("inf")] * 12), (6, [1.0, 2.0])]


def test_whitening_equals_numpy(spark):
    x = sample(500)
    rows = [(100 + i, v.tolist()) for i, v in enumerate(x)] + BAD
    rows += [(None, x[3].tolist()), (100, x[4].tolist()), (100, x[4].tolist()), (7, [0.0] * 12)]      # null and repeated ids
    rows += [(2000 + i, x[0].tolist()) for i in range(200)]                                            # a hot vector
    check(spark, rows, 12)
    check(spark, rows, 12, block_rows=16, slab_rows=100)                                               # several slabs and blocks


def test_whitening_few_dimensions_and_offsets(spark):
    check(spark, [(i, v.tolist()) for i, v in enumerate(sample(60, dims=3, seed=2))], 3)
    check(spark, [(i, (v + 5000).tolist()) for i, v in enumerate(sample(60, dims=3, seed=3))], 3)       # far from the origin


def test_whitening_degenerate(spark):
    assert W.component_rows(*W.whiten(table(spark, []))).collect() == []
    assert W.component_rows(*W.whiten(table(spark, BAD[:3]))).collect() == []
    got = W.component_rows(*W.whiten(table(spark, [(1, [0.5] * 4), (2, [0.5] * 4)]))).collect()
    assert len(got) == 8 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] == 0 for r in got)
    line = [(i, [float(i), 0.0, 0.0]) for i in range(5)]                    # one live component of three
    got = W.component_rows(*W.whiten(table(spark, line))).collect()
    assert all((r["whitened"] is not None) == (r["component"] == 1) for r in got)
    assert {r["explained"] for r in got if r["component"] == 1} == {1.0} and got[0]["identity_error"] < 1e-9


def test_whitening_beyond_64_bits(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    got = {r["vec_id"]: r["deviation"] for r in W.component_rows(*W.whiten(table(spark, rows))).collect()}
    assert got[1] == got[2] == (1 << 63) - 1
    assert got[3] == (3 * 102_048 - 303_072) ** 2            # huge entries of either sign cancel in the sums


def test_exact_deviation_in_decimals(spark):
    x = [[10 ** 12 + 7, 3], [-10 ** 12, 5], [4, -9]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, x array<long>")
    n, sums = 3, [sum(v[d] for v in x) for d in range(2)]
    exact = [sum((n * v[d] - sums[d]) ** 2 for d in range(2)) for v in x]
    for least, most in ((-10 ** 12, 10 ** 12 + 7), (-(1 << 62), 1 << 62)):       # long differences, decimals
        diff = W.centred(n, sums, least, most)
        got = rows.select("vec_id", W.squared_deviation(diff, n, 2, least, most).alias("d")).collect()
        assert [r["d"] for r in sorted(got)] == [min(e, (1 << 63) - 1) for e in exact]
