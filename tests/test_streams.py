"""Replay after failures (T1) and late steps."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.sources import io as sio
from tidemark.streaming import alerts
from tidemark.streaming.arrivals import SplitDecisionWriter


def _batches(spark):
    rows = [(y, float(i % (3 + y - 2000)), "ab"[i % 2], int(i % 3 == 0)) for y in range(2000, 2003) for i in range(60)]
    df = spark.createDataFrame(rows, "year int, x double, c string, target int")
    return [df.where(F.col("year") == y) for y in range(2000, 2003)]


def _writer(base):
    return SplitDecisionWriter(str(base), "year", "target", ["x"], ["c"], 10)


def _state(spark, base):
    cat = sio.read_catalog(spark, f"{base}/catalog").select("split_id", "end_year", "train_samples").collect()
    dec = spark.read.parquet(f"{base}/decisions").drop("batch_id").collect()
    return sorted(map(tuple, cat)), sorted(map(str, dec))


@pytest.mark.parametrize("broken", ["append_catalog", "split_decisions"])
def test_replayed_batches_give_equal_catalog_and_decisions(spark, tmp_path, monkeypatch, broken):
    batches = _batches(spark)
    clean = _writer(tmp_path / "clean")
    for i, b in enumerate(batches):
        clean(b, i)
    clean.flush(spark)
    fn = _writer(tmp_path / "broken")
    owner = sio if broken == "append_catalog" else dr
    real = getattr(owner, broken)

    def fails(*a, **k):
        if broken == "append_catalog":
            real(*a, **k)                                  # fails after its write
        raise RuntimeError("lost")

    for i, b in enumerate(batches):
        monkeypatch.setattr(owner, broken, fails)
        if i:                                              # the first batch completes no year
            with pytest.raises(RuntimeError, match="lost"):
                fn(b, i)
        monkeypatch.setattr(owner, broken, real)
        fn(b, i)
        fn(b, i)                                           # and a replay after success
    fn.flush(spark)
    fn.flush(spark)
    assert _state(spark, tmp_path / "broken") == _state(spark, tmp_path / "clean")
    assert len(_state(spark, tmp_path / "clean")[1]) == 3


def test_incremental_counts_equal_the_whole_table(spark, tmp_path):
    """Two years in one batch, a year over two batches, late rows of the reference and of other years."""
    rows = [(y, float(i % (3 + y - 2000)), "abc"[i % (2 + y % 2)], int(i % 3 == 0)) for y in range(2000, 2006) for i in range(40)]
    late = [(2000, 50.0, "z", 1), (2002, 70.0, "z", 0), (None, 1.0, "a", 1), (2003, None, None, 1)]
    take = lambda *ys: [r for r in rows if r[0] in ys]
    batches = [take(2000, 2001), take(2002)[:10], take(2002)[10:] + take(2003), late, take(2004) + late[:1], take(2005)]
    schema = "year int, x double, c string, target int"
    fn, arrived, decided = _writer(tmp_path / "t1"), [], {}
    for i, b in enumerate([*batches, None]):
        if b is None:
            fn.flush(spark)
        else:
            arrived += b
            fn(spark.createDataFrame(b, schema), i)
        known = {r["split_id"]: r for r in spark.read.parquet(f"{tmp_path}/t1/decisions").collect()}
        new = sorted(set(known) - set(decided))
        if new:                                            # against all rows that have arrived by now
            table = spark.createDataFrame(arrived, schema)
            cat = sio.read_catalog(spark, f"{tmp_path}/t1/catalog")
            per = dr.drift_by_split(table, cat, "year", ["x"], ["c"], 1, splits=new, size_rule=True)
            want = {r["split_id"]: r for r in dr.split_decisions(per, 1).collect()}
            for s in new:
                for c in ("number_of_drifted_columns", "share_of_drifted_columns", "severity", "retrain", "decision_reason"):
                    assert known[s][c] == want[s][c]
            counts = {r["split_id"]: (r["end_year"], r["train_samples"]) for r in cat.collect()}
            for s in new:
                assert counts[s][1] == sum(r[0] is not None and r[0] <= counts[s][0] for r in arrived)
        decided = known
    assert len(decided) == 6
    # a running sum holds every row of its years that had arrived
    held = spark.read.parquet(f"{tmp_path}/t1/upto/num/end_year=2005").agg(F.sum("n")).first()[0]
    assert held == sum(r[0] is not None and r[1] is not None for r in arrived)
    # the next batch reads its own counts and the running sum only
    seen = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/t1/years").selectExpr("year y", "batch_id b").collect()]
    plan = fn._since(spark, "num", seen, 2005, 2004, 4).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("end_year=2004" in r["f"] or "batch_id=5" in r["f"] for r in plan)


class _State:
    exists, value = False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value


def _run(batches):
    state, fn, out = _State(), alerts._islands(60), []
    for rows in batches:
        got = list(fn(("e",), [pd.DataFrame(rows, columns=["step_ts", "firing_cond"])], state))
        out += [tuple(r) for r in got[0].itertuples(index=False)]
    return out


def test_late_steps_are_reported_and_never_open_a_run():
    out = _run([[(0, True), (60, True), (120, False)], [(60, True), (30, True), (180, True)], [(90, True), (240, True)]])
    assert [r[1:] for r in out if r[3] == 0] == [(60, 60, 0), (30, 30, 0), (90, 90, 0)] or \
        sorted(r[1:] for r in out if r[3] == 0) == [(30, 30, 0), (60, 60, 0), (90, 90, 0)]
    runs = {}
    for _, start, end, n in out:
        if n:
            runs[start] = max(runs.get(start, (0, 0)), (end, n))
    assert runs == {0: (60, 2), 180: (240, 2)}


def test_readers_of_alert_rows(spark):
    df = spark.createDataFrame([("e", 0, 60, 2), ("e", 30, 30, 0)], alerts.OUT_SCHEMA)
    assert [r["start_ts"] for r in alerts.latest_runs(df, 60).collect()] == [0]
    assert [tuple(r) for r in alerts.late_steps(df).collect()] == [("e", 30)]
