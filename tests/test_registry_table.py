import pytest
from pyspark.sql import functions as F

from tidemark.operators import registry as rg


def _run(spark, f1, name="m"):
    return spark.createDataFrame([(name, {"split_id": "1"}, {"f1_score": f1}, {"report": "text"})],
                                 "model_name string, params map<string,string>, metrics map<string,double>, texts map<string,string>")


def _stages(table):
    _, runs, events = table.state()
    return {r["version"]: r["stage"] for r in rg.current_state(events).collect()}, runs


def test_champion_challenger_archive_on_the_table(spark, tmp_path):
    table = rg.RegistryTable(spark, str(tmp_path))
    assert table.state()[0] == 0
    for f1 in (0.5, 0.4, 0.5, 0.7):                            # first wins, worse, equal, better
        table.register(_run(spark, f1))
    stages, runs = _stages(table)
    assert stages == {1: "Archived", 2: "None", 3: "None", 4: "Production"}
    last = runs.where("version = 4").first()
    assert last["params"]["is_better"] == "true" and last["params"]["production_version_before"] == "1"
    assert last["metrics"]["improvement_pct"] == pytest.approx(40.0) and last["texts"] == {"report": "text"}
    table.archive_all(F.lit("2024-01-01T00:00:00"))
    table.archive_all(F.lit("2025-01-01T00:00:00"))            # again: later numbers, first tags stay
    _, _, events = table.state()
    state = rg.current_state(events).collect()
    assert {r["stage"] for r in state} == {"Archived"}
    assert {r["tags"]["archived_at"] for r in state} == {"2024-01-01T00:00:00"}
    seqs = [r["seq"] for r in events.select("seq").collect()]
    assert len(seqs) == len(set(seqs))
    table.register(_run(spark, 0.1))                           # no production model: the next one wins
    assert _stages(table)[0][5] == "Production"


def test_two_promoters_cannot_both_win(spark, tmp_path):
    """Both compare with the same champion; the slower one must meet the faster one's result."""
    table, other = rg.RegistryTable(spark, str(tmp_path)), rg.RegistryTable(spark, str(tmp_path))
    table.register(_run(spark, 0.5))
    publish, tries = table._publish, []

    def late(commit, runs, events):
        if not tries:
            other.register(_run(spark, 0.8))                   # publishes the same commit number first
        tries.append(commit)
        return publish(commit, runs, events)

    table._publish = late
    table.register(_run(spark, 0.7))
    assert tries == [2, 3]
    stages, runs = _stages(table)
    assert stages == {1: "Archived", 2: "Production", 3: "None"}
    f1 = {r["version"]: r["metrics"]["f1_score"] for r in runs.collect()}
    assert f1 == {1: 0.5, 2: 0.8, 3: 0.7}


def test_models_have_their_own_versions(spark, tmp_path):
    table = rg.RegistryTable(spark, str(tmp_path))
    for name in ("a", "b", "a"):
        table.register(_run(spark, 0.5, name))
    _, runs, _ = table.state()
    assert sorted((r["model_name"], r["version"]) for r in runs.collect()) == [("a", 1), ("a", 2), ("b", 1)]
