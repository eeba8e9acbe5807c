import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import splits as sp


def _reference_quotas(counts, test_size):
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    cont = {k: c * n_train / n for k, c in counts.items()}
    fl = {k: math.floor(v) for k, v in cont.items()}
    need = n_train - sum(fl.values())
    for k in sorted(cont, key=lambda k: (-(cont[k] - fl[k]), k))[:need]:
        fl[k] += 1
    return {k: counts[k] - fl[k] for k in counts}


@pytest.mark.parametrize("counts", [{0: 7, 1: 3}, {0: 778, 1: 222}, {0: 5, 1: 5, 2: 1}, {0: 1}])
def test_class_quotas_and_exact_split(spark, counts):
    rows = [(i, k) for k, c in counts.items() for i in range(c)]
    df = spark.createDataFrame([(j, k) for j, (_, k) in enumerate(rows)], "id long, y int")
    want = _reference_quotas(counts, 0.2)
    got = {r["y"]: r["test_quota"] for r in sp.class_quotas(df, "y", 0.2).collect()}
    assert got == want
    s = sp.stratified_split(df, "y", ["id"], 0.2, 42)
    per = {r["y"]: r["n"] for r in s.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert {k: per.get(k, 0) for k in counts} == want


def test_split_deterministic_under_repartition(spark):
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = sp.stratified_split(df, "y", ["id"]).where("is_test").select("id")
    b = sp.stratified_split(df.repartition(7), "y", ["id"]).where("is_test").select("id")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


def test_skewed_class_split_exact(spark):
    # one class holds almost all rows -- still exact sizes
    df = spark.range(0, 20000).select("id", (F.col("id") < 17).cast("int").alias("y"))
    s = sp.stratified_split(df, "y", ["id"], 0.2, 7)
    per = {r["y"]: r["n"] for r in s.where("is_test").groupBy("y").count().withColumnRenamed("count", "n").collect()}
    assert per == _reference_quotas({0: 19983, 1: 17}, 0.2)


def test_cumulative_summary_and_next_split(spark):
    data = [(2008, 1), (2008, 0), (2009, 0), (2010, 1), (2010, 1), (2011, 0)]
    df = spark.createDataFrame(data, "year int, y int")
    s = sp.cumulative_split_summary(df, 10, "year", "y", 2008, 2010).orderBy("split_id").collect()
    assert [r["train_samples"] for r in s] == [2, 3, 5]
    assert [r["years"] for r in s] == ["2008", "2008-2009", "2008-2010"]
    assert s[2]["share_positive"] == pytest.approx(0.6)
    cat = spark.createDataFrame([(1, 2008, 2008)], "split_id int, start_year int, end_year int")
    nxt = sp.next_split(cat, df, "year").first()
    assert (nxt["status"], nxt["split_id"], nxt["end_year"], nxt["years"]) == ("created", 2, 2009, "2008-2009")
    done = spark.createDataFrame([(4, 2008, 2011)], "split_id int, start_year int, end_year int")
    assert sp.next_split(done, df, "year").first()["status"] == "complete"
    bad = spark.createDataFrame([(2, 2008, 2030)], "split_id int, start_year int, end_year int")
    assert sp.next_split(bad, df, "year").first()["status"] == "missing_year"
    empty = spark.createDataFrame([], "split_id int, start_year int, end_year int")
    first = sp.next_split(empty, df, "year").first()
    assert (first["status"], first["split_id"], first["end_year"]) == ("created", 1, 2008)


def test_positional_cut_exact(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "k")
    c = sp.positional_cut(df, ["k"], 0.8, 42)
    assert c.where("first_part").count() == 800


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagging_does_not_shuffle_full_rows(spark):
    from tidemark.operators import sampling as sm
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("y"), F.repeat(F.lit("wide"), 50).alias("w"))
    for out in (sp.stratified_split(df, "y", ["id"]), sp.positional_cut(df, ["id"]), sm.seeded_sample(df, 100, ["id"])):
        assert "hashpartitioning" not in _plan(out) and "rangepartitioning" not in _plan(out)
        out.collect()


def test_hash_cuts_equal_a_full_sort(spark):
    from tidemark.operators.ordered import hash_cuts
    import hashlib
    rows = [(i % 3, hashlib.md5(str(i // 2).encode()).hexdigest()) for i in range(900)]      # hashes come in pairs or more
    rows += [(1, "7" * 32)] * 500                                                            # a hot hash
    df = spark.createDataFrame(rows, "g int, _h string")
    for share in (0.0, 0.01, 0.5, 0.77, 1.0, 3.0):
        quotas = [(g, int(share * sum(r[0] == g for r in rows))) for g in range(3)]
        for boundary in (200_000, 5):
            got = {r[0]: r[1:] for r in hash_cuts(df, ["g"], quotas, digits=1, boundary_rows=boundary)}
            for g, quota in quotas:
                order = sorted(h for k, h in rows if k == g)
                if quota:
                    cut = order[min(quota, len(order)) - 1]
                    assert got[g] == (cut, min(quota, len(order)) - sum(h < cut for h in order), order.count(cut))
                else:
                    assert g not in got


def test_exact_sizes_with_repeated_keys(spark):
    """A key held by most rows: the cut falls among equal hashes."""
    df = spark.createDataFrame([(7, i % 2, i) for i in range(800)] + [(i, i % 2, i) for i in range(200)], "k long, y int, v int")
    s = sp.stratified_split(df, "y", ["k"], 0.2, 42)
    assert s.count() == 1000 and s.columns == ["k", "y", "v", "is_test"]
    assert s.where("is_test").groupBy("y").count().collect() and s.where("is_test").count() == 200
    assert sp.positional_cut(df, ["k"], 0.8).where("first_part").count() == 800
    assert s.select("k", "y", "v").exceptAll(df).isEmpty() and df.exceptAll(s.select("k", "y", "v")).isEmpty()


def test_wide_split_joins_once_and_writes_no_hashes(spark, monkeypatch):
    """Missing shares, class sizes and the cut read the joined rows from one written table; hashes are never written."""
    from conftest import SF_SMALL
    from tidemark.operators import ordered
    from tidemark.plans import fixtures as fx
    from tidemark.plans import preprocess as pp
    seen, written = [], []
    split, cut = pp.stratified_split, ordered.cut_lineage
    monkeypatch.setattr(pp, "stratified_split", lambda df, *a, **k: seen.append(df) or split(df, *a, **k))
    monkeypatch.setattr(ordered, "cut_lineage", lambda df, name="cut": written.append(name) or cut(df, name))
    out = pp.split_obs_wide(spark, SF_SMALL)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "hashes" not in written
    o = fx.read_table(spark, SF_SMALL, "orders").join(fx.read_table(spark, SF_SMALL, "customer"), F.expr("o_custkey = c_custkey"))
    want = fx.obs(spark, SF_SMALL).join(o, F.expr("l_orderkey = o_orderkey")).select(*fx.OBS_KEY, "o_orderpriority", "c_mktsegment")
    got = out.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
