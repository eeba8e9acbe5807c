import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import registry as rg
from tidemark.operators import telemetry as tm


def test_champion_challenger_and_archive(spark):
    m = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.5), (4, 0.7)], "k int, f1_score double")
    m = m.select("k", "f1_score", *[F.lit(0.0).alias(c) for c in ("accuracy", "precision", "recall", "roc_auc")])
    runs = rg.runs_from_metrics(m, "k", "m")
    dec = {r["version"]: r for r in rg.champion_challenger(runs).collect()}
    assert [dec[v]["is_better"] for v in (1, 2, 3, 4)] == [True, False, False, True]   # equal F1 is not better
    assert dec[4]["improvement_pct"] == pytest.approx(40.0)
    events = rg.promotion_events(rg.champion_challenger(runs))
    st = {r["version"]: r for r in rg.current_state(events).collect()}
    assert [st[v]["stage"] for v in (1, 2, 3, 4)] == ["Archived", "None", "None", "Production"]
    assert st[4]["tags"]["is_production"] == "True" and st[1]["tags"]["is_production"] == "False"
    prod = rg.production_model(rg.current_state(events), runs).first()
    assert prod["version"] == 4
    # archive-all: already archived keeps an existing tag, others are overwritten
    tagged = events.unionByName(spark.createDataFrame(
        [("m", 1, 100, None, {"archived": "old"})], rg.EVENT_SCHEMA))
    state = rg.current_state(tagged)
    arch = rg.archive_all(state, F.lit("2024-01-01T00:00:00"), F.lit(1000))
    fin = {r["version"]: r for r in rg.current_state(tagged.unionByName(arch)).collect()}
    assert all(fin[v]["stage"] == "Archived" for v in fin)
    assert fin[1]["tags"]["archived"] == "old" and fin[2]["tags"]["archived"] == "true"
    assert fin[4]["tags"]["archived_at"] == "2024-01-01T00:00:00"


def test_histogram_quantile_rules(spark):
    h = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 20), ("a", float("inf"), 20),
                               ("b", 1.0, 0), ("b", 2.0, 1), ("b", float("inf"), 10),
                               ("c", 1.0, 0), ("c", 2.0, 0), ("c", float("inf"), 0)],
                              "endpoint string, le double, cum_count long")
    got = {r["endpoint"]: r["quantile"] for r in tm.histogram_quantile(h, 0.5).collect()}
    assert got["a"] == pytest.approx(1.0)      # rank 10 reached in the first bucket: 0 + 1 * 10/10
    assert got["b"] == 2.0                     # falls into +Inf -> last finite upper bound
    assert got["c"] is None                    # no observations


def test_alert_islands_hold(spark):
    rows = [("e", t, True) for t in (60, 120, 180)] + [("e", 300, True), ("e", 360, False)]
    cond = spark.createDataFrame(rows, "endpoint string, step_ts long, firing_cond boolean")
    isl = sorted(tm.alert_islands(cond, 60, 120).collect(), key=lambda r: r["start_ts"])
    assert [(r["start_ts"], r["end_ts"], r["fired"]) for r in isl] == [(60, 180, True), (300, 300, False)]
    assert isl[0]["first_firing_ts"] == 180


def test_instant_rate_reset(spark):
    s = spark.createDataFrame([("e", 60, 10), ("e", 120, 16), ("e", 180, 4)], "endpoint string, sample_ts long, counter long")
    r = tm.instant_rate(s).first()
    assert r["last_sample_ts"] == 180 and r["irate"] == pytest.approx(4 / 60)


def test_windowed_latency_rate(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 30)
    log = spark.createDataFrame([(t0, "a", 3.0), (t0 + dt.timedelta(minutes=2), "a", 0.05)],
                                "ts timestamp_ntz, endpoint string, duration double")
    w = tm.windowed_latency(log).orderBy("window_start").collect()
    assert len(w) == 7 and max(r["rate"] for r in w) == pytest.approx(2 / 300)


def _log(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t0 + dt.timedelta(seconds=s) if s is not None else None, e, d) for s, e, d in rows],
                                 "ts timestamp_ntz, endpoint string, duration double")


@pytest.mark.parametrize("window, slide, length, step", [("5 minutes", "1 minute", 300, 60), ("5 minutes", "2 minutes", 300, 120),
                                                         ("90 seconds", "1 minute", 90, 60), ("1 minute", "1 minute", 60, 60)])
def test_windows_from_panes_equal_windows_over_the_log(spark, window, slide, length, step):
    rows = [(i * 37 % 1500, "ab"[i % 3 == 0], (i * 7 % 23) / 2) for i in range(200)] + [(None, "a", 1.0), (10, "a", None)]
    got = {(r["window_start"], r["endpoint"]): (r["rate"], r["p_quantile"], r["window_end"])
           for r in tm.windowed_latency(_log(spark, rows), 0.95, window, slide).collect()}
    want = {}
    t0 = dt.datetime(2024, 1, 1)
    for s, e, d in rows:
        if s is None:
            continue
        k = s // step
        while k * step > s - length:
            want.setdefault((t0 + dt.timedelta(seconds=k * step), e), []).append(d)
            k -= 1
    assert set(got) == set(want)
    for key, ds in want.items():
        les = [*tm.LATENCY_BUCKETS, float("inf")]
        seen = [d for d in ds if d is not None]
        if not seen:
            assert got[key][:2] == (pytest.approx(len(ds) / length), None)
            continue
        cum = [sum(d <= le for d in seen) for le in les]
        i = next(i for i, c in enumerate(cum) if c >= 0.95 * len(seen))
        lo, below = (les[i - 1], cum[i - 1]) if i else (0.0, 0)
        q = lo if les[i] == float("inf") else lo + (les[i] - lo) * (0.95 * len(seen) - below) / (cum[i] - below)
        assert got[key][0] == pytest.approx(len(ds) / length) and got[key][1] == pytest.approx(q)
        assert got[key][2] - key[0] == dt.timedelta(seconds=length)


def test_windowed_latency_aggregates_the_log_before_it_is_expanded(spark):
    plan = tm.windowed_latency(_log(spark, [(1, "a", 1.0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    lines = [ln for ln in plan.splitlines() if "Generate" in ln or "Aggregate" in ln]
    assert ["Generate" in ln for ln in lines] == [False, True, False]      # sum over windows, panes to windows, log to panes


def test_production_gauge_is_the_highest_version_of_the_moment(spark):
    """Against a replay of every moment: overlapping, returning and re-promoted versions, two models."""
    rng = random.Random(3)
    events, seq = [], 0
    for m in ("m", "n"):
        t = 0
        for _ in range(120):
            t, seq = t + rng.randint(0, 3), seq + 1
            events.append((m, rng.randint(1, 9), seq, rng.choice(["Production", "Archived", None, "None", "Production"]), t))
    ev = spark.createDataFrame(events, "model_name string, version int, seq long, stage string, event_ts long")
    runs = spark.createDataFrame([(m, v, {"f1_score": v / 10}) for m in "mn" for v in range(1, 10)],
                                 "model_name string, version int, metrics map<string,double>")
    got = {}
    for r in rg.production_gauge(ev, runs).collect():
        for t in range(r["start_ts"], r["end_ts"] if r["end_ts"] is not None else 500):
            assert (r["model_name"], t) not in got
            got[r["model_name"], t] = (r["version"], r["value"])
    for m in ("m", "n"):
        for t in range(500):
            stage = {}
            for model, v, _, s, at in events:
                if model == m and at <= t and s is not None:
                    stage[v] = s
            live = [v for v, s in stage.items() if s == "Production"]
            assert got.get((m, t)) == ((max(live), max(live) / 10) if live else None)


def test_gauge_alerts_equal_alerts_over_listed_steps(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(60):
        a, t = t + rng.choice([0, 0, 0, 7]), t + rng.randint(8, 40)
        rows.append(("m", a, None if i == 59 else t, rng.random()))
    until = t + 100
    got = tm.gauge_alerts(spark.createDataFrame(rows, "model_name string, start_ts long, end_ts long, value double"),
                          lambda v: v < 0.6, 10, 40, until)
    steps = [("m", s, v < 0.6) for s in range(0, until + 1, 10) for _, a, e, v in rows if a <= s and (e is None or s < e)]
    want = tm.alert_islands(spark.createDataFrame(steps, "model_name string, step_ts long, firing_cond boolean"), 10, 40, ("model_name",))
    cols = ["start_ts", "end_ts", "n_steps", "held_seconds", "fired", "first_firing_ts"]
    a, b = (sorted(map(tuple, d.select(*cols).collect())) for d in (got, want))
    assert a == b and {r[4] for r in a} == {True, False}
