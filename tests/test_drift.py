import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as dr


def _frame(spark, xs, cs):
    return spark.createDataFrame([(float(x), c) for x, c in zip(xs, cs)], "x double, c string")


def _brute_wasserstein(u, v):
    allv = np.sort(np.concatenate([u, v]))
    deltas = np.diff(allv)
    uc = np.searchsorted(np.sort(u), allv[:-1], "right") / len(u)
    vc = np.searchsorted(np.sort(v), allv[:-1], "right") / len(v)
    return float(np.sum(np.abs(uc - vc) * deltas))


def test_identical_distributions_no_drift(spark):
    xs = list(range(50)) * 30
    cs = ["a", "b", "c"] * 500
    ref = _frame(spark, xs, cs)
    per = {r["column_name"]: r for r in dr.column_drift(ref, ref, ["x"], ["c"], with_pvalues=True).collect()}
    assert per["x"]["wasserstein_norm"] == pytest.approx(0.0)
    assert per["c"]["jensen_shannon"] == pytest.approx(0.0, abs=1e-9)
    assert not per["x"]["drift_detected"] and not per["c"]["drift_detected"]


def test_wasserstein_ks_against_numpy(spark):
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=1500), rng.normal(0.3, 1.2, size=1200)
    ref = spark.createDataFrame([(float(x),) for x in u], "x double")
    cur = spark.createDataFrame([(float(x),) for x in v], "x double")
    vc = dr.value_counts_by_side(ref, cur, ["x"], "double")
    r = dr.numeric_tests(vc, n_cols=1).first()
    assert r["wasserstein_norm"] == pytest.approx(_brute_wasserstein(u, v) / max(np.std(u), 0.001), rel=1e-9)
    allv = np.sort(np.concatenate([u, v]))
    ks = np.max(np.abs(np.searchsorted(np.sort(u), allv, "right") / len(u)
                       - np.searchsorted(np.sort(v), allv, "right") / len(v)))
    assert r["ks_statistic"] == pytest.approx(ks)
    assert 0.0 <= r["ks_pvalue"] < 0.05


def test_disjoint_categories_js_and_chi(spark):
    ref = _frame(spark, [0] * 2000, ["a"] * 2000)
    cur = _frame(spark, [0] * 2000, ["b"] * 2000)
    vc = dr.value_counts_by_side(ref, cur, ["c"], "string")
    r = dr.categorical_tests(vc, n_cols=1).first()
    p, q = np.array([1.0, 1e-4]), np.array([1e-4, 1.0])
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    js = math.sqrt(0.5 * np.sum(p * np.log(p / m)) + 0.5 * np.sum(q * np.log(q / m)))
    assert r["jensen_shannon"] == pytest.approx(js)
    assert math.isinf(r["chi_square"]) and r["chi_pvalue"] == 0.0


def test_chi_square_pvalue_known(spark):
    from tidemark.functions.stats import chi2_sf_np
    # chi2 sf(3.84, 1) ~ 0.05, sf(5.991, 2) ~ 0.05, sf(0, k) = 1
    got = chi2_sf_np(np.array([3.841458820694124, 5.991464547107979, 0.0]), np.array([1.0, 2.0, 3.0]))
    assert got == pytest.approx([0.05, 0.05, 1.0], rel=1e-6)


@pytest.mark.parametrize("share,drift,level", [(0.0, False, "OK"), (0.01, True, "INFO"), (0.02, True, "WARNING"),
                                                (0.039, True, "WARNING"), (0.04, True, "CRITICAL")])
def test_alert_levels_at_thresholds(spark, share, drift, level):
    df = spark.createDataFrame([(share, drift)], "s double, d boolean")
    assert df.select(dr.alert_level(F.col("s"), F.col("d"), 0.02)).first()[0] == level


def test_retrain_decisions(spark):
    df = spark.createDataFrame([(0.01, True, False), (0.01, False, False), (0.05, False, False),
                                (0.0, False, True)], "s double, first boolean, failed boolean")
    train, reason = dr.retrain_decision(F.col("s"), 0.02, F.col("first"), True, F.col("failed"))
    out = [(r[0], r[1]) for r in df.select(train, reason).collect()]
    assert out == [(True, "first_split"), (False, "drift_below_threshold"),
                   (True, "drift_above_threshold"), (True, "drift_check_failed")]


def test_drift_by_split_equals_per_split_runs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for y in range(2010, 2014):
        for i in range(300):
            rows.append((y, float(rng.normal(y - 2010, 1.0)), ["a", "b", "c"][(i + y) % 3 if y < 2012 else i % 2]))
    df = spark.createDataFrame(rows, "year int, x double, c string")
    cat = spark.createDataFrame([(k + 1, 2010, 2010 + k) for k in range(4)], "split_id int, start_year int, end_year int")
    per = {(r["split_id"], r["column_name"]): r for r in
           dr.drift_by_split(df, cat, "year", ["x"], ["c"], 1).collect()}
    ref = df.where("year = 2010")
    for k in range(1, 5):
        cur = df.where(f"year between 2010 and {2009 + k}")
        single = {r["column_name"]: r for r in dr.column_drift(ref, cur, ["x"], ["c"], with_pvalues=False).collect()}
        for c in ("x", "c"):
            assert per[(k, c)]["drift_score"] == pytest.approx(single[c]["drift_score"], rel=1e-9, abs=1e-12)
            assert per[(k, c)]["drift_detected"] == single[c]["drift_detected"]
    assert per[(4, "x")]["drift_detected"]                       # the mean moves by a std per year


def test_drift_by_split_subset_and_categorical_only(spark):
    rng = np.random.default_rng(9)
    rows = [(y, float(rng.normal(y - 2010, 1.0)), ["a", "b", "c"][i % (2 + (y % 2))])
            for y in range(2010, 2014) for i in range(200)]
    df = spark.createDataFrame(rows, "year int, x double, c string")
    cat = spark.createDataFrame([(k + 1, 2010, 2010 + k) for k in range(4)], "split_id int, start_year int, end_year int")
    full = {(r["split_id"], r["column_name"]): r["drift_score"] for r in
            dr.drift_by_split(df, cat, "year", ["x"], ["c"], 1).collect()}
    # only the new splits (the reference split is not among them)
    sub = {(r["split_id"], r["column_name"]): r["drift_score"] for r in
           dr.drift_by_split(df, cat, "year", ["x"], ["c"], 1, splits=[3, 4]).collect()}
    assert set(sub) == {(s, c) for s in (3, 4) for c in ("x", "c")}
    for key, v in sub.items():
        assert v == pytest.approx(full[key], rel=1e-12, abs=1e-15)
    cat_only = {(r["split_id"], r["column_name"]): r for r in
                dr.drift_by_split(df, cat, "year", [], ["c"], 1).collect()}
    assert len(cat_only) == 4
    for (s, c), r in cat_only.items():
        assert r["stattest"] == "jensenshannon"
        assert r["drift_score"] == pytest.approx(full[(s, c)], rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("n_ref", [400, 1001])
def test_size_rule_holds_on_every_path(spark, n_ref):
    """The reference side's size chooses the test, whatever flag or path."""
    rng = np.random.default_rng(11)
    rows = [(y, float(rng.normal(0.1 * (y - 2010))), float(i % 3), float(i % 2), "abc"[(i * (y - 2009)) % 3], "ab"[i % 2])
            for y, n in ((2010, n_ref), (2011, 900)) for i in range(n)]
    df = spark.createDataFrame(rows, "year int, x double, few double, flag double, c string, b string")
    cat = spark.createDataFrame([(1, 2010, 2010), (2, 2010, 2011)], "split_id int, start_year int, end_year int")
    num, text = ["x", "few", "flag"], ["c", "b"]
    small = {"x": "ks", "few": "chisquare", "flag": "z", "c": "chisquare", "b": "z"}
    large = {c: "wasserstein" if c == "x" else "jensenshannon" for c in small}
    ref = df.where("year = 2010")
    key = lambda rs: {r["column_name"]: (r["stattest"], round(r["drift_score"], 9), r["drift_detected"]) for r in rs}
    full = key(dr.column_drift(ref, df, num, text, with_pvalues=True).collect())
    bare = dr.column_drift(ref, df, num, text, with_pvalues=False, size_rule=True)
    assert not {"chi_pvalue", "z_pvalue"} & set(bare.columns)
    assert {c: v[0] for c, v in full.items()} == (small if n_ref <= 1000 else large)
    assert key(bare.collect()) == full
    assert key(dr.drift_by_split(df, cat, "year", num, text, 1, size_rule=True).where("split_id = 2").collect()) == full


def test_drift_columns_query_follows_the_size_rule(spark):
    """sf0.001 has fewer than 1,000 reference rows."""
    import __spark_entry__ as E
    got = {r["stattest"] for r in E.queries()["drift_columns"](spark, "/root/testdata/sf0.001").collect()}
    assert got <= {"ks", "chisquare", "z"} and "ks" in got


def test_alert_texts(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.01), (2, 0.02), (3, 0.0399), (1, 0.0625), (4, 0.5)], "n int, share double")
    message, advice = dr.alert_text(F.col("n"), F.col("share"), F.col("share") > 0)
    got = [(r[0], r[1].split(" - ")[0]) for r in df.select(message, advice).collect()]
    assert got == [("No data drift detected", "Continue monitoring"),
                   ("Data drift detected in 1 columns (1.0%)", "MINOR DRIFT (<2%)"),
                   ("Data drift detected in 2 columns (2.0%)", "DRIFT DETECTED (≥2%)"),
                   ("Data drift detected in 3 columns (4.0%)", "DRIFT DETECTED (≥2%)"),
                   ("Data drift detected in 1 columns (6.2%)", "SEVERE DRIFT DETECTED (>4%)"),
                   ("Data drift detected in 4 columns (50.0%)", "SEVERE DRIFT DETECTED (>4%)")]


def test_exact_ks_pvalues_against_all_orders():
    """Every order of the pooled rows, for up to 10 rows."""
    from itertools import combinations

    from tidemark.functions.stats import ks_exact_np
    for m, n in ((1, 1), (3, 2), (4, 4), (5, 3), (2, 8), (5, 5), (6, 4)):
        seen = []
        for mine in combinations(range(m + n), m):
            x = np.cumsum([i in mine for i in range(m + n)])
            seen.append(np.max(np.abs(x / m - (np.arange(1, m + n + 1) - x) / n)))
        seen = np.array(seen)
        for d in np.unique(np.round(seen, 12)):
            want = np.mean(seen >= d - 1e-9)
            assert ks_exact_np(float(d), m, n) == pytest.approx(want, abs=1e-12)
            assert ks_exact_np(float(d), n, m) == pytest.approx(want, abs=1e-12)
    assert ks_exact_np(0.0, 7, 9) == 1.0 and ks_exact_np(1.0, 0, 5) == 1.0


def test_exact_ks_pvalues_from_tables_and_in_the_limit():
    from tidemark.functions.stats import ks_exact_np
    # critical values of the two-sample test for equal sizes: P(D >= c / n) is at most 5 % first at c
    for n, c in ((5, 5), (8, 6), (10, 7), (15, 8), (20, 9), (25, 10)):
        assert ks_exact_np(c / n, n, n) <= 0.05 < ks_exact_np((c - 1) / n, n, n)
    m, n, d = 1000, 9000, 0.045
    en = m * n / (m + n)
    limit = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * en * d * d) for k in range(1, 50))
    d = round(d * 9000) / 9000
    assert ks_exact_np(d, m, n) == pytest.approx(limit, rel=0.05)


def test_numeric_tests_use_the_exact_pvalue_for_small_samples(spark):
    from tidemark.functions.stats import ks_exact_np
    u, v = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [3.5, 4.5, 5.5, 6.5, 7.5, 8.5, 9.5]
    vc = dr.value_counts_by_side(_frame(spark, u, ["a"] * 6), _frame(spark, v, ["a"] * 7), ["x"], "double")
    r = dr.numeric_tests(vc, n_cols=1).first()
    assert r["ks_pvalue"] == pytest.approx(ks_exact_np(r["ks_statistic"], 6, 7), abs=1e-12)
    rough = dr.numeric_tests(vc, dr.DriftOptions(exact_ks_rows=0), n_cols=1).first()
    assert rough["ks_pvalue"] != pytest.approx(r["ks_pvalue"], abs=1e-3)


def test_all_splits_order_each_value_once_and_agree_with_each_split(spark, monkeypatch):
    """Numeric values of many splits are one row each, also where a split lacks some of them."""
    from pyspark.sql import functions as F
    from tidemark.operators import drift as dr
    rows = [(y, float((i * i + 7 * y) % 83) + (500.0 if y == 3 and i == 0 else 0.0), float(i % (2 + (y > 1)))) for y in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "year int, a double, few double")
    catalog = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3)], "split_id int, start_year int, end_year int")
    fed, prefix = [], dr.ordered_prefix
    monkeypatch.setattr(dr, "ordered_prefix", lambda vc, *a, **k: fed.append(vc.count()) or prefix(vc, *a, **k))
    got = {(r["split_id"], r["column_name"]): r for r in dr.drift_by_split(df, catalog, "year", ["a", "few"], [], 1, size_rule=False).collect()}
    assert fed == [df.select("a").distinct().count() + df.select("few").distinct().count()]
    for split in (1, 2, 3):
        want = dr.column_drift(df.where("year = 1"), df.where(F.col("year") <= split), ["a", "few"], [], with_pvalues=False)
        for w in want.collect():
            r = got.pop((split, w["column_name"]))
            assert (r["stattest"], r["drift_detected"]) == (w["stattest"], w["drift_detected"])
            assert abs(r["drift_score"] - w["drift_score"]) < 1e-12
    assert not got
