import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import model as ml
from tidemark.operators import registry as rg


def _runs_events(spark, f1s):
    m = spark.createDataFrame([(i + 1, f) for i, f in enumerate(f1s)], "split_id int, f1_score double")
    m = m.select("split_id", "f1_score", *[F.lit(0.0).alias(c) for c in ("accuracy", "precision", "recall", "roc_auc")])
    runs = rg.runs_from_metrics(m, "split_id", "m")
    events = rg.promotion_events(rg.champion_challenger(runs))
    return runs, events


def test_reference_split_follows_production(spark):
    runs, events = _runs_events(spark, [0.5, 0.7, 0.6])
    assert dr.reference_split_id(rg.current_state(events), runs) == 2
    empty = spark.createDataFrame([], rg.EVENT_SCHEMA)
    assert dr.reference_split_id(rg.current_state(empty), runs, default=1) == 1


def test_input_signature_roundtrip(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, x double")
    sig = rg.input_signature(df, 5, ["k"])
    assert len(sig["input_example"]) == 5 and '"k":0' in sig["input_example"][0]
    assert rg.check_signature(df.drop("x"), sig["schema_json"]) == ["x"]


def test_model_search_ranks_families(spark):
    df = spark.createDataFrame([(float(i % 17), float(i % 5), int(i % 17 > 8)) for i in range(120)],
                               "a double, b double, y int")
    ranked = ml.model_search(df, ["a", "b"], "y", folds=2)
    names = [n for n, _ in ranked]
    assert set(names) == {"LogisticRegression", "DecisionTreeClassifier", "RandomForestClassifier",
                          "GBTClassifier", "LinearSVC"}
    assert ranked[0][1] >= ranked[-1][1]


def test_split_of_a_run_is_not_its_version(spark):
    m = spark.createDataFrame([(1, 3, 0.5), (2, 3, 0.7), (3, 4, 0.6)], "at int, split_id int, f1_score double")
    m = m.select("*", *[F.lit(0.0).alias(c) for c in ("accuracy", "precision", "recall", "roc_auc")])
    runs = rg.runs_from_metrics(m, "at", "m", param_cols=("at",))
    assert {r["version"]: (r["params"]["split_id"], r["params"]["at"]) for r in runs.collect()} == {
        1: ("3", "1"), 2: ("3", "2"), 3: ("4", "3")}
    state = rg.current_state(rg.promotion_events(rg.champion_challenger(runs)))
    assert dr.reference_split_id(state, runs) == 3
    assert rg.runs_from_metrics(m.drop("split_id"), "at", "m").first()["params"] == {}


def test_folds_are_stratified_to_the_row(spark):
    rows = [(i, i % 7 == 0) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame([(k, None if y is None else int(y)) for k, y in rows], "k int, y int")
    got = ml.stratified_folds(df, "y", ["k"], 3).collect()
    assert sorted(r["k"] for r in got) == list(range(200))
    for y in (0, 1):
        sizes = [sum(r["y"] == y and r["fold"] == f for r in got) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1
    again = ml.stratified_folds(df.repartition(5), "y", ["k"], 3).collect()
    assert {r["k"]: r["fold"] for r in again} == {r["k"]: r["fold"] for r in got}


def test_grid_search_equals_the_exhaustive_loop(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    import random
    r = random.Random(4)
    rows = [(i, a := r.random(), b := r.random(), int((a - 0.5) * (b - 0.5) + 0.05 * r.gauss(0, 1) > 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y int")
    grids = {LogisticRegression(labelCol="y", maxIter=10): {"regParam": [0.0, 1.0]},
             DecisionTreeClassifier(labelCol="y", seed=1): {"maxDepth": [1, 4], "minInstancesPerNode": [2]}}
    found = ml.grid_search(df, ["a", "b"], "y", ["k"], grids, folds=3)
    folds = ml.stratified_folds(df.withColumn("y", F.col("y").cast("double")), "y", ["k"], 3)
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(folds).cache()
    area, best = BinaryClassificationEvaluator(labelCol="y"), {}
    for name, params, est in ml.candidates_of(grids):
        scores = [area.evaluate(est.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))) for f in range(3)]
        best[name, str(params)] = sum(scores) / 3
    assert {(n, str(p)): pytest.approx(v, abs=1e-9) for n, p, v in found.candidates} == best
    winner = max(best, key=best.get)
    assert (found.candidates[0][0], str(found.candidates[0][1])) == winner and winner[0] == "DecisionTreeClassifier"
    assert type(found.model.stages[-1]).__name__ == "DecisionTreeClassificationModel"
    table = rg.RegistryTable(spark, str(tmp_path / "registry"))
    table.log(found.runs(spark, "m"), "place")
    table.log(found.runs(spark, "m"), "place")
    logged = table.state()[1].orderBy("version").collect()
    assert [x["version"] for x in logged] == list(range(1, 9))
    assert logged[0]["metrics"]["areaUnderROC"] == logged[4]["metrics"]["areaUnderROC"] == found.candidates[0][2]
    assert table.state()[2].count() == 0                   # nothing is promoted


def _rows(spark, n=300):
    return spark.createDataFrame([(i, float(i % 17), float(i % 5), int(i % 17 > 8)) for i in range(n)],
                                 "k int, a double, b double, y int")


def test_fits_read_vectors_that_were_made_once(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    made, read = [], []
    assemble = ml.VectorAssembler.transform
    monkeypatch.setattr(ml.VectorAssembler, "transform", lambda self, d, *p: made.append(1) or assemble(self, d, *p))
    for family in (DecisionTreeClassifier, LogisticRegression):
        fit = family.fit
        monkeypatch.setattr(family, "fit", lambda self, d, *p, fit=fit: read.append(d) or fit(self, d, *p))
    found = ml.grid_search(_rows(spark), ["a", "b"], "y", ["k"], {
        LogisticRegression(labelCol="y", maxIter=5): {"regParam": [0.0, 1.0]}, DecisionTreeClassifier(labelCol="y"): {"maxDepth": [2]}})
    assert len(made) == 1                                  # before: once for every fit and every scoring
    assert len(read) == 3 * 3 + 1
    for d in read:
        assert d.columns == ["y", "features", "_fold"] and d.inputFiles() and "UDF" not in d._jdf.queryExecution().toString()
    assert found.model.transform(_rows(spark)).where("prediction <> y").isEmpty()      # the winner takes raw rows


def test_all_fold_cuts_come_from_the_same_passes(spark, monkeypatch):
    from tidemark.operators import ordered
    calls, cuts = [], ordered.hash_cuts
    monkeypatch.setattr(ordered, "hash_cuts", lambda *a, **k: calls.append(1) or cuts(*a, **k))
    assert ml.stratified_folds(_rows(spark), "y", ["k"], 5).groupBy("fold").count().count() == 5
    assert len(calls) == 1


def test_parts_of_a_group_equal_a_full_sort(spark):
    from tidemark.operators.ordered import cut_parts
    rows = [(g, h, i) for g in (0, 1) for i, h in enumerate(["aa", "ab", "ab", "ab", "b0", "b0", "c1", "f0"] * (g + 1))]
    df = spark.createDataFrame(rows, "g int, h string, i int").repartition(3)
    for cuts in ([(0, [0, 2, 3]), (1, [3, 5, 16])], [(0, [1, 4, 8]), (1, [2, 8, 8])], [(0, []), (1, [])]):
        got = cut_parts(df, F.col("h"), ["g"], cuts, "part").collect()
        assert len(got) == len(rows)
        for g, at in cuts:
            hashes = sorted(h for x, h, _ in rows if x == g)
            want = sorted((h, sum(n <= r for n in at)) for r, h in enumerate(hashes))
            assert sorted((x["h"], x["part"]) for x in got if x["g"] == g) == want


def test_areas_are_exact_and_of_one_class_as_in_the_evaluator(spark):
    import random
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    r = random.Random(3)
    rows = [(a := r.random(), float(f if f < 2 else a + r.gauss(0, 0.5) > 0.5), f) for f in (0, 1, 2) for _ in range(20 if f < 2 else 2500)]
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame(rows, "a double, y double, _fold int")).cache()
    model = LogisticRegression(labelCol="y", maxIter=5).fit(data)
    got = ml._areas(data, "y", "_fold", {(f, i): model for f in (0, 1, 2) for i in (0, 1)})
    assert sorted(got) == [(f, i) for f in (0, 1, 2) for i in (0, 1)]
    evaluator = BinaryClassificationEvaluator(labelCol="y")
    for f in (0, 1):
        assert got[f, 0] == got[f, 1] == evaluator.evaluate(model.transform(data.where(F.col("_fold") == f)))
    up, down = [a for a, y, f in rows if f == 2 and y], [a for a, y, f in rows if f == 2 and not y]
    exact = sum(x > z for x in up for z in down) / (len(up) * len(down))
    assert got[2, 0] == pytest.approx(exact if model.coefficients[0] > 0 else 1 - exact, abs=1e-12)


def test_fits_run_side_by_side_only_where_cores_are_idle(spark):
    cores = spark.sparkContext.defaultParallelism
    assert ml.fits_at_once(spark.range(100).repartition(2 * cores), 4) == 1
    assert ml.fits_at_once(spark.range(100).repartition(cores), 4) == 2
    assert ml.fits_at_once(spark.range(100).coalesce(1), 4) == min(4, 2 * cores)
    assert ml.fits_at_once(spark.range(100).coalesce(1), 1) == 1


def test_a_fold_without_rows_is_refused(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    with pytest.raises(ValueError, match="at fold . is empty"):
        ml.grid_search(_rows(spark, 2), ["a", "b"], "y", ["k"], {DecisionTreeClassifier(labelCol="y"): {}}, folds=5)
