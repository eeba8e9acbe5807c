import numpy as np
import pytest

from tidemark.llm.ann_partitions import (balanced_parts, best_rows, bins_of, fit_index, nearest_by_partitions,
                                         neighbour_graph)
from tidemark.llm.impact_topk import impact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, part string, qb int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y", 2) for i, v in rows], SCHEMA)


def clustered(n, dims=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(12, dims))[r.integers(0, 12, n)] + 0.6 * r.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


AWKWARD = [(None, [1.0] * 16), (9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16),
           (9004, [float("inf")] + [0.0] * 15), (9005, [None] + [1.0] * 15), (9006, [1.0] * 3)]


def brute(rows, every, k, score):
    usable = {}
    for i, v in rows:
        if i is None or not v or len(v) != 16 or any(c is None or not np.isfinite(c) for c in v):
            continue
        usable[i] = min(usable.get(i, v), v)
    out = {}
    for q in usable:
        if q % every == 0:
            got = sorted((-score(usable[q], v), i) for i, v in usable.items() if i != q)[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return out


def by_query(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def whole(v):
    return [int(np.floor(256 * float(c))) for c in v]


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(x) * float(y)
    return total


def test_impact_top_k_is_exact(spark):
    x = clustered(700)
    rows = [(int(i), x[i].tolist()) for i in range(700)] + AWKWARD
    rows += [(2000 + i, x[0].tolist()) for i in range(60)] + [(10, x[10].tolist())]           # ties, a repeated row
    expected = brute(rows, 50, 5, lambda a, b: sum(p * q for p, q in zip(whole(a), whole(b))))
    got = by_query(impact_top_k(table(spark, rows), every=50, k=5, row_block=128, query_block=4))
    assert got == expected
    assert by_query(impact_top_k(table(spark, rows[:3]), every=1, k=5)) == brute(rows[:3], 1, 5, lambda a, b: sum(
        p * q for p, q in zip(whole(a), whole(b))))
    assert impact_top_k(table(spark, [])).collect() == []
    huge = [(i, [3e38 if i % 2 else -3e38] * 16) for i in range(4)]
    assert {r["score"] for r in impact_top_k(table(spark, huge), every=1, k=5).collect()} == {(1 << 63) - 1, -(1 << 63)}


@pytest.mark.parametrize("sign", [1, -1])
def test_impact_index_on_hard_data(sign):
    from tidemark.llm.impact_topk import ImpactIndex
    r = np.random.default_rng(5)
    for n, dims, high in ((300, 8, 4), (500, 32, 200), (40, 3, 1)):
        c = sign * r.integers(-high, high + 1, (n, dims)).astype(float)
        if sign > 0:
            c = np.abs(c)                                  # all impacts positive, or all negative for -q
        index = ImpactIndex(np.arange(n), c)
        for q in (c[3], -c[3], np.zeros(dims)):
            rows, score = index.top(3, q, 7)
            expected = sorted((-float(v @ q), i) for i, v in enumerate(c) if i != 3)[:7]
            assert list(zip((-score).tolist(), rows.tolist())) == expected


def test_learned_partitions_recall_and_ties(spark):
    x = clustered(3000)
    rows = [(int(i), x[i].tolist()) for i in range(3000)] + AWKWARD + [(5000 + i, x[20].tolist()) for i in range(200)]
    found = by_query(nearest_by_partitions(table(spark, rows), every=20, k=20, sample_rows=1500, rows_per_part=250,
                                           block_rows=300))
    expected = brute([r for r in rows if r[0] != 9002], 20, 20, dot)
    assert set(found) == set(expected) and all(len(v) == 20 for v in found.values())
    hits = [len({i for _, i, _ in found[q]} & {i for _, i, _ in expected[q]}) / 20 for q in expected]
    assert np.mean(hits) >= 0.9
    assert found[20] == expected[20]                       # 200 copies: the smallest ids, equal scores
    for q, v in found.items():
        assert [r for r, *_ in v] == list(range(1, 21))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(v, v[1:]))


def test_learned_partitions_return_all_of_few(spark):
    x = clustered(15)
    rows = [(int(i), x[i].tolist()) for i in range(15)]
    got = by_query(nearest_by_partitions(table(spark, rows), every=5, k=20, rows_per_part=4, sample_rows=10))
    assert got == brute(rows, 5, 20, dot)
    assert nearest_by_partitions(table(spark, [])).collect() == []
    assert nearest_by_partitions(table(spark, rows[:1]), every=1).collect() == []


def test_parts_are_balanced():
    x = clustered(1000).astype(float)
    label = balanced_parts(x, neighbour_graph(x, 10), 7)
    sizes = np.bincount(label, minlength=7)
    assert sizes.min() >= 1000 // 7 - 2 and sizes.max() <= 1000 // 7 + 3
    cut = (label[:, None] != label[neighbour_graph(x, 10)]).mean()
    assert cut < 0.6 * (1 - 1 / 7)                         # far fewer edges than a random cut


def test_best_rows_in_small_cells():
    x = clustered(120).astype(float)
    a = best_rows(np.arange(30), x[:30], np.arange(120), x, 9, cells=200)
    b = best_rows(np.arange(30), x[:30], np.arange(120), x, 9)
    assert a.equals(b.combine_chunks()) or a.to_pylist() == b.to_pylist()


@pytest.mark.parametrize("n", [500, 2000, 20_000])
def test_several_parts_and_measured_recall_at_every_size(spark, n):
    x = clustered(n)
    every = n // 50
    rows = [(int(i), x[i].tolist()) for i in range(n)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    ann = fit_index(vectors, sample_rows=4096)
    assert ann.partitions.count > 2 and ann.held.sum() == n
    assert ann.recall >= 0.95 and 0 < ann.visited <= 1
    found = by_query(nearest_by_partitions(table(spark, rows), every=every, sample_rows=4096))
    wide = x.astype(float)
    assert set(found) == set(range(0, n, every))
    hits = []
    for q, v in found.items():
        s = wide @ wide[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20].tolist()) & {i for _, i, _ in v}) / 20)
    assert np.mean(hits) >= 0.9


def test_two_levels_of_parts(spark):
    x = clustered(2400)
    rows = [(int(i), x[i].tolist()) for i in range(2400)] + [(5000 + i, x[20].tolist()) for i in range(400)]
    ann = fit_index(spark.createDataFrame(rows, "id long, vec array<double>"), sample_rows=900, rows_per_part=60, fanout=8)
    assert ann.partitions.count > 8 and max(ann.partitions.sizes) > 1 and ann.held.sum() == 2800
    p = ann.partitions(x[:50].astype(float))
    assert p.shape == (50, ann.partitions.count) and np.allclose(p.sum(axis=1), 1)
    found = by_query(nearest_by_partitions(table(spark, rows), every=20, sample_rows=900, rows_per_part=60, fanout=8,
                                           block_rows=150))
    expected = brute(rows, 20, 20, dot)
    assert set(found) == set(expected)
    assert np.mean([len({i for _, i, _ in found[q]} & {i for _, i, _ in expected[q]}) / 20 for q in expected]) >= 0.9


def test_bins_hold_neighbouring_parts():
    first, count = bins_of(np.array([3, 4, 30, 2, 9, 0, 5]), 10)
    assert first.tolist() == [0, 0, 1, 4, 5, 5, 6] and count.tolist() == [1, 1, 3, 1, 1, 1, 1]
