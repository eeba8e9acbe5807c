import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile as pf


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i % 7, math.exp(rng.gauss(0, 2)) + 1e6 if i % 11 else None, f"v{int(rng.paretovariate(0.6)) % 3000}" if i % 5 else None)
            for i in range(20_000)]
    return spark.createDataFrame(data, "part int, x double, s string").cache()


def test_merged_parts_equal_the_whole(rows):
    whole = {r["column_name"]: r for r in pf.profile_of_sketches(pf.column_sketches(rows, ["x"], ["s"])).collect()}
    parts = pf.column_sketches(rows, ["x"], ["s"], by=["part"])
    merged = {r["column_name"]: r for r in pf.profile_of_sketches(pf.merge_sketches(parts)).collect()}
    exact = {r["column_name"]: r for r in pf.column_profile(rows, ["x"]).collect()}["x"]
    for p in (whole["x"], merged["x"]):
        assert (p["n_values"], p["n_nulls"], p["min_value"], p["max_value"]) == (
            exact["n_values"], exact["n_nulls"], exact["min_value"], exact["max_value"])
        assert p["mean_value"] == pytest.approx(exact["mean_value"], rel=1e-12)
        assert p["std_value"] == pytest.approx(exact["std_value"], rel=1e-9)
        assert p["n_distinct"] == pytest.approx(exact["n_distinct"], rel=0.06)
    n_texts = rows.select("s").distinct().where("s IS NOT NULL").count()
    for p in (whole["s"], merged["s"]):
        assert p["n_distinct"] == pytest.approx(n_texts, rel=0.06) and p["n_nulls"] == 4000


def test_quantile_rank_error(rows):
    probs = (0.01, 0.25, 0.5, 0.75, 0.99)
    p = pf.profile_of_sketches(pf.merge_sketches(pf.column_sketches(rows, ["x"], by=["part"])), probs).first()
    xs = sorted(r["x"] for r in rows.where(F.col("x").isNotNull()).select("x").collect())
    for q, v in zip(probs, p["quantiles"]):
        below = sum(x < v for x in xs) / len(xs)
        assert abs(below - q) < 0.02


def test_empty_parts_and_missing_values(spark):
    df = spark.createDataFrame([(1, None, None), (1, float("nan"), None), (2, 3.0, "a"), (2, 5.0, "a")], "part int, x double, s string")
    parts = pf.column_sketches(df, ["x"], ["s"], by=["part"])
    got = {(r["part"], r["column_name"]): r for r in pf.profile_of_sketches(parts).collect()}
    assert (got[1, "x"]["n_values"], got[1, "x"]["n_nulls"], got[1, "x"]["quantiles"], got[1, "x"]["n_distinct"]) == (0, 2, None, 0)
    x = {r["column_name"]: r for r in pf.profile_of_sketches(pf.merge_sketches(parts)).collect()}["x"]
    assert (x["n_values"], x["n_nulls"], x["mean_value"], x["n_distinct"]) == (2, 2, 4.0, 2)
    assert x["std_value"] == pytest.approx(math.sqrt(2))
    none = pf.profile_of_sketches(pf.column_sketches(df.limit(0), ["x"], ["s"])).collect()
    assert [(r["n_values"], r["n_nulls"], r["quantiles"]) for r in none] == [(0, 0, None)] * 2


def test_top_values(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", None), ("b", "y"), ("c", "z")], "p string, q string")
    got = [(r["column_name"], r["rank"], r["value"], r["n_rows"]) for r in
           pf.top_values(df, ["p", "q"], 2).orderBy("column_name", "rank").collect()]
    assert got == [("p", 1, "a", 2), ("p", 2, "b", 2), ("q", 1, "x", 2), ("q", 2, "y", 1)]
