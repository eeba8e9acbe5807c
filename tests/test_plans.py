"""Plan-level checks: pruning, pushdown and constant parameters."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tidemark.operators import features as ft
from tidemark.operators import splits as sp
from tidemark.session import scratch_path

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_view_prunes_year_partitions(spark):
    p = scratch_path(spark, "by-year")
    spark.range(0, 600).select((F.col("id") % 6 + 2010).cast("int").alias("year"), "id") \
        .write.partitionBy("year").parquet(p)
    df = spark.read.parquet(p)
    cat = spark.createDataFrame([(2, 2010, 2011)], "split_id int, start_year int, end_year int")
    rows = sp.split_rows(df, cat, 2, "year")
    plan = _plan(rows)
    assert "PartitionFilters" in plan and "2011" in plan
    assert rows.count() == 200


def test_telemetry_scan_prunes_and_pushes(spark):
    plan = _plan(E.queries()["latency_p95"](spark, SF))
    assert "PushedFilters: [In(event_type" in plan.replace("\n", " ") or "In(event_type" in plan
    assert "ReadSchema: struct<event_type:string,value:double>" in plan


def test_fitted_parameters_are_literals(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b")], "x double, c string")
    m = ft.fit(train, ["x"], ["c"])
    out = m.transform(train)
    plan = _plan(out)
    assert "Join" not in plan and "Subquery" not in plan      # parameters are constants
    assert "2.0" in plan                                      # the fitted median, folded in
