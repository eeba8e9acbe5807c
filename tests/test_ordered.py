import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators.ordered import exact_quantiles, ordered_prefix, sorted_ranges

R = random.Random(6)
SHAPES = {
    "log-normal": [math.exp(R.gauss(0, 4)) for _ in range(4000)],
    "one far outlier": [float(i) for i in range(3999)] + [1e300],
    "two clusters": [1e-9 * i for i in range(2000)] + [1e9 + i for i in range(2000)],
}


@pytest.mark.parametrize("name", SHAPES)
def test_no_range_is_crowded(spark, name):
    """With equal-width buckets nearly all of these values fall into one."""
    df = spark.createDataFrame([(v,) for v in SHAPES[name]], "value double")
    sizes = [r["count"] for r in sorted_ranges(df, ["value"], ranges=16).groupBy("_b").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * 4000 / 16


@pytest.mark.parametrize("name", SHAPES)
def test_prefix_and_quantiles_on_skewed_values(spark, name):
    values = SHAPES[name]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "g string, value double")
    for q in (0.0, 0.37, 0.5, 1.0):
        got = {r["g"]: r["value"] for r in exact_quantiles(df, ["g"], "value", q, ranges=16).collect()}
        assert got["b"] == 1.0 and got["a"] == pytest.approx(float(np.quantile(values, q)), rel=1e-12)
    counts = df.groupBy("g", "value").agg(F.count("*").alias("n"))
    rows = [r for r in ordered_prefix(counts, ["g"], "value", ["n"], ranges=16).collect() if r["g"] == "a"]
    order = sorted(set(values))
    rows.sort(key=lambda r: r["value"])
    assert [r["value"] for r in rows] == order
    assert [r["next_value"] for r in rows] == [*order[1:], None]
    total, cum = 0, []
    for v in order:
        total += values.count(v)
        cum.append(total)
    assert [r["cum_n"] for r in rows] == cum


def test_auc_with_one_far_score(spark):
    r = random.Random(2)
    rows = [(r.random() ** 8, int(r.random() < 0.4)) for _ in range(700)] + [(1e12, 1)]
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    exact = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    got = ev.roc_auc(spark.createDataFrame(rows, "s double, y int"), "y", "s", ranges=7).first()["roc_auc"]
    assert got == pytest.approx(exact, rel=1e-12)


def test_vocabulary_with_a_common_prefix(spark):
    values = [f"CUSTOMER-{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(v, "x") for v in values], "a string, b string").repartition(5)
    got = {(r["column_name"], r["value"]): r["position"] for r in ft.fit_vocabulary(df, ["a", "b"]).collect()}
    assert got == {("a", v): i for i, v in enumerate(values)} | {("b", "x"): 0}
