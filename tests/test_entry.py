import duckdb
import pytest

import __spark_entry__ as E
from tidemark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns[:3] == ["split_id", "years", "split_name"] and len(rows) >= 1


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["cumulative_split_summary", "encoded_features", "drift_report",
                                  "binary_metrics", "windowed_latency", "registry_promotions",
                                  # batch equals stream (T2, T3, T4) and exact kNN vs brute force
                                  "stream_windowed_latency", "stream_latency_alerts",
                                  "stream_request_validation", "knn_neighbors", "request_validation",
                                  "request_scoring", "stream_request_scoring"])
def test_query_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    a = sorted((tuple(r[c] for c in sorted(cols)) for r in df.collect()), key=repr)
    b = sorted((tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    assert a == b


def test_stream_scoring_equals_batch_scoring(spark):
    q = E.queries()
    key = lambda r: tuple(r[c] for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    a = {key(r): (r["prediction"], round(r["probability"], 9)) for r in q["stream_scoring"](spark, SF).collect()}
    b = {key(r): (r["prediction"], round(r["probability"], 9)) for r in q["simple_scoring"](spark, SF).collect()}
    assert len(a) > 0 and a == b


class _Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["gbt_test_metrics", "simple_scoring", "stream_scoring", "train_and_promote"])
def test_model_queries_fit_the_reference_configuration(spark, monkeypatch, name):
    """Every registered model query fits the reference's 200 trees of depth 9."""
    from tidemark.operators import model as ml
    from tidemark.sources.artefacts import ModelStore
    seen = []

    def fit(train, feature_cols, label, **overrides):
        gbt = ml.gbt_pipeline(feature_cols, label, **overrides).getStages()[1]
        seen.append({k: gbt.getOrDefault(k) for k in ml.REFERENCE_GBT})
        raise _Stop

    monkeypatch.setattr(ml, "fit", fit)
    monkeypatch.setattr(ModelStore, "find", lambda self, key: None)      # as if nothing had been fitted before
    with pytest.raises(_Stop):
        E.queries()[name](spark, SF)
    assert seen == [ml.REFERENCE_GBT] and (seen[0]["maxIter"], seen[0]["maxDepth"]) == (200, 9)
