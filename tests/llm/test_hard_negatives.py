import numpy as np
import pytest

from tidemark.llm.hard_negatives import Index, Search, bounds, coarser, hard_negatives, levels, norms, summaries

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, block int, kind string, summary string, low long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x", 2, "y", "z", 3) for i, v, y in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives=10):
    ok = {}
    for i, v, y in rows:
        if i is None or y is None or not v or len(v) != 40 or any(c is None or not np.isfinite(c) for c in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        ok[i] = min(ok.get(i, (list(v), y)), (list(v), y))
    whole = {i: [int(np.floor(256 * np.float64(c))) for c in v] for i, (v, _) in ok.items()}
    out = set()
    for a in ok:
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(whole[a], w)) for i, w in whole.items() if i != a}
        best = sorted((-s, i) for i, s in score.items() if ok[i][1] == ok[a][1])[:positives]
        for s, p in best:
            s = -s
            fit = sorted((-t, i) for i, t in score.items() if ok[i][1] != ok[a][1] and 30 * s <= 100 * t <= 90 * s)
            out |= {(a, p, r + 1, i, s, -t) for r, (t, i) in enumerate(fit[:negatives])}
    return out


def vectors(n, seed=0, dims=40):
    r = np.random.default_rng(seed)
    x = r.normal(size=(9, dims))[r.integers(0, 9, n)] + 0.8 * r.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_hard_negatives_equal_brute_force(spark):
    x = vectors(900)
    rows = [(int(i), x[i].tolist(), int(i * 7919 % 10)) for i in range(900)]
    rows += [(3000 + i, x[5].tolist(), 3) for i in range(150)]                     # a large group of copies, ties
    rows += [(20, x[20].tolist(), 0), (20, x[21].tolist(), 0), (4000, [0.0] * 40, 1), (-700, x[7].tolist(), 2)]
    rows += [(None, x[0].tolist(), 1), (9100, None, 1), (9200, x[3].tolist(), None), (9300, [], 1), (9400, [1.0] * 3, 1),
             (9500, [float("nan")] * 40, 1), (9600, [float("inf")] + [0.0] * 39, 1), (9700, [None] + [0.5] * 39, 1)]
    got = [tuple(r) for r in hard_negatives(table(spark, rows), row_block=256).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_hard_negatives_small_and_empty(spark):
    assert hard_negatives(table(spark, [])).collect() == []
    assert hard_negatives(table(spark, [(100, [1.0] * 40, 1)])).collect() == []
    rows = [(100, [1.0] * 40, 1), (101, [0.5] * 40, 1), (102, [0.3] * 40, 2), (103, [0.4] * 40, 3)]
    assert {tuple(r) for r in hard_negatives(table(spark, rows)).collect()} == brute(rows)
    huge = [(100, [3e38] * 40, 1), (101, [3e38] * 40, 1), (102, [1e36] + [0.0] * 39, 2), (103, [1e-20] * 40, 3)]
    assert hard_negatives(table(spark, huge)).count() == 0    # both sides count as the largest long


@pytest.mark.parametrize("dims", [3, 8, 20, 40, 64])
def test_bounds_hold_at_every_level(dims):
    r = np.random.default_rng(dims)
    rows, ask = (np.floor(256 * r.normal(size=(n, dims))) for n in (200, 30))
    counts = levels(dims)
    a, b = summaries(ask, counts[-1]), summaries(rows, counts[-1])
    exact = ask @ rows.T
    width = []
    for s in reversed(counts):
        low, _, high = bounds(a, b, 1e-9 * norms(ask)[:, None] * norms(rows)[None, :] + 0.5)
        assert (low <= exact).all() and (exact <= high).all()
        assert np.allclose(a, summaries(ask, s))
        width.append((high - low).mean())
        if s != counts[0]:
            a, b = coarser(a, dims, s // 2), coarser(b, dims, s // 2)
    assert width == sorted(width)                             # finer segments bound more closely


def test_smooth_vectors_are_mostly_pruned():
    r = np.random.default_rng(1)
    steps = np.repeat(r.normal(size=(4000, 8)), 8, axis=1)     # each segment nearly constant
    x = np.floor(256 * (steps + 0.02 * r.normal(size=steps.shape)))
    index = Index(np.arange(4000), np.zeros(4000, int), x, summaries(x, 32))
    s = Search(index, np.arange(20), x[:20], summaries(x[:20], 32), np.ones((20, 4000), bool), [[(-(1 << 62), 1 << 62)]] * 20, 5)
    s.refine()
    assert s.alive.sum() < 0.02 * 20 * 4000
    for a, _, rows, _ in s.results():
        best = sorted((-int(v), i) for i, v in enumerate(x @ x[a]) if i != a)[:5]
        assert rows.tolist() == [i for _, i in best]
