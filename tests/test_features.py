import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators.clean import align_to_schema
from tidemark.operators.ordered import exact_quantiles


def test_median_even_size_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (4.0,), (None,)], "x double")
    m = ft.fit_medians(df, ["x"]).first()["median"]
    assert m == pytest.approx(3.0)


def test_exact_quantile_matches_numpy_with_hot_value(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25), rng.exponential(size=300) * 50])
    df = spark.createDataFrame([(float(v),) for v in vals], "value double").withColumn("g", F.lit("a"))
    for q in (0.5, 0.9, 0.01):
        got = exact_quantiles(df, ["g"], "value", q, ranges=16).first()["value"]
        assert got == pytest.approx(float(np.quantile(vals, q)), rel=1e-12, abs=1e-12)


def test_mode_tie_smallest_and_nulls_ignored(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert ft.fit_modes(df, ["c"]).first()["mode"] == "a"


def test_fit_apply_constant_column_and_unseen_category(spark):
    train = spark.createDataFrame([(1.0, 5.0, "x"), (3.0, 5.0, "y"), (None, 5.0, "y")], "a double, k double, c string")
    test = spark.createDataFrame([(None, 5.0, "z"), (0.0, 5.0, "y")], "a double, k double, c string")
    m = ft.fit(train, ["a", "k"], ["c"])
    assert m.medians["a"] == 2.0 and m.modes["c"] == "y"
    assert m.dummy_columns == ["c_y"]
    out = m.transform(test).collect()
    # constant column -> std 0 -> divided by 1
    assert [r["k"] for r in out] == [0.0, 0.0]
    # unseen category 'z' -> all zeros; a supplied 0 is kept (only NULL is filled)
    assert [r["c_y"] for r in out] == [0, 1]
    mean, std = m.scaler["a"]
    assert out[0]["a"] == pytest.approx((2.0 - mean) / std)
    assert out[1]["a"] == pytest.approx((0.0 - mean) / std)


def test_params_roundtrip(spark):
    train = spark.createDataFrame([(1.0, "x"), (3.0, "y")], "a double, c string")
    m = ft.fit(train, ["a"], ["c"])
    row = m.params_frame(spark).first()
    m2 = ft.FeatureModel.from_params(row, ["a"], ["c"])
    assert m2.medians == m.medians and m2.vocabulary == m.vocabulary and m2.dummy_columns == m.dummy_columns


def test_align_to_schema(spark):
    df = spark.createDataFrame([(1, 2)], "b int, extra int")
    out = align_to_schema(df, ["a", "b"])
    assert out.columns == ["a", "b"] and tuple(out.first()) == (0, 1)


def test_wide_vocabulary_is_encoded_sparsely(spark):
    """20,000 categories: modes still come, the first sorted category is dropped, unseen and NULL have no ones."""
    from pyspark.sql import functions as F
    from tidemark.operators import features as ft
    names = [f"v{i:05d}" for i in range(20_000)]
    rows = [(n, 1.0) for n in names] + [("v00007", 2.0)] * 3
    train = spark.createDataFrame(rows, "c string, x double")
    model = ft.fit(train, ["x"], ["c"])
    assert model.modes == {"c": "v00007"} and model.wide_vocabulary is not None
    probe = spark.createDataFrame([("v00000", 1.0), ("v00001", 1.0), ("v19999", 1.0), ("new", 1.0), (None, 1.0)], "c string, x double")
    got = model.encode(probe).select("c_vec.size", "c_vec.ones").collect()
    assert {r["size"] for r in got} == {19_999}
    assert sorted(r["ones"] for r in got) == [[], [], [], [0], [19_998]]
    small = ft.fit_vocabulary(train.where(F.col("c") < "v00100"), ["c"]).orderBy("position").collect()
    assert [(r["value"], r["position"]) for r in small] == [(n, i) for i, n in enumerate(names[:100])]
