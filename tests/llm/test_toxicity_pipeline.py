import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import SCHEMA, rows_of
from tests.llm.test_duplicates_secrets import fingerprint, groups, plain_redacted
from tidemark.llm.mixing import source_mix
from tidemark.llm.toxic_segments import SIZE, Model, extreme_value, features, logistic, score_texts, segments, toxicity


def plain_segments(values):
    """Maximal-scoring segments by their recursive definition: the best of a
    range, then left and right of it (shortest of equals)."""
    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += values[b]
                if total > 1e-12 and (found is None or total > found[2] + 1e-12):
                    found = (a, b, total)
        return [] if found is None else [*best(lo, found[0]), found, *best(found[1] + 1, hi)]
    return best(0, len(values))


def test_segments_equal_the_definition():
    r = random.Random(2)
    for _ in range(300):
        at = [i for i in range(25) if r.random() < 0.4]
        score = [r.choice([0.5, 1.0, 2.0, 3.5]) + r.random() / 100 for _ in at]
        values = [-0.7] * 25
        for i, s in zip(at, score):
            values[i] = s
        got = segments(at, score, 0.7)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(values)]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in plain_segments(values)])
    assert segments([], []) == []


def test_segments_are_linear():
    n = 200_000
    got = segments(list(range(0, 3 * n, 3)), [0.5] * n, 0.3)
    assert len(got) == n or len(got) == 1


def test_extreme_value_law_is_recovered():
    r = np.random.default_rng(1)
    n = r.integers(20, 2000, 20_000)
    rate, log_k = extreme_value(np.maximum((np.log(n) - 1.0 + r.gumbel(size=len(n))) / 0.8, 1e-3), n)
    assert rate == pytest.approx(0.8, abs=0.05) and log_k == pytest.approx(-1.0, abs=0.15)


def test_logistic_converges():
    x = np.random.default_rng(0).normal(size=(4000, 2))
    y = (np.random.default_rng(1).random(4000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0] - 1)))).astype(float)
    w, _ = logistic(x, y)
    assert w == pytest.approx([-1, 2, -1], abs=0.2)


def toxic_corpus(n=2500):
    r = random.Random(8)
    plain = ["word%d" % i for i in range(300)]
    bad = ["vilescum", "trashful", "idiotic", "loserish"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        text = [r.choice(plain) for _ in range(r.randrange(5, 120))]
        if toxic:
            at = r.randrange(len(text))
            text[at:at] = r.choices(bad, k=4)
        docs.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark, empty_df):
    docs, labels = toxic_corpus()
    docs += [(None, "vilescum", "s"), (5000, None, "s"), (5001, "", "s"), (3, docs[3][1], "s")]
    marks = spark.createDataFrame(labels + [(0, 1, None), (1, 1, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(rows_of(docs), SCHEMA)
    rows = toxicity(frame, marks).collect()
    assert len(rows) == len(docs)
    truth = {i: t for i, _, t in labels}
    for r in rows:
        held = zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])
    assert right >= 0.97
    text = {i: t for i, t, _ in docs}
    for r in held:
        if r["predicted"] and truth[r["doc_id"]]:
            assert any("scum" in (p := text[r["doc_id"]][s["start"]:s["end"]]) or "trash" in p or "idiot" in p or "loser" in p
                       for s in r["segments"])
    # labels of held-out rows and the other columns change nothing
    flipped = marks.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end toxic")
    again = toxicity(frame.selectExpr("doc_id", "text", "'zz' lang", "'q' source"), flipped).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in rows)
    assert toxicity(empty_df, marks).collect() == []


def test_passages_of_either_half_and_of_any_letter(spark):
    """A passage is reported where lower case changes the length of a word, and
    where only one half's weights know it."""
    tables = np.zeros((2, SIZE), np.float32)
    for half, word, weight in ((0, "vilescum", 20.0), (1, "trashful", 15.0), (0, "\u0130stanbulx".lower(), 20.0)):
        tables[half, features([word])[0]] = weight
    model = Model(tables, coef=(0.0, 1.0, 1.0, 1.0))
    filler = " plain" * 200 + " "
    text = "\u0130stanbul " + "\u0130" * 70 + filler + "VileScum" + filler + "trashful" + filler + "\u0130stanbulX"
    got = score_texts(spark.createDataFrame([(1, text), (2, "VILESCUM trashful vilescum")], "doc_id long, text string"), model)
    found = {r["doc_id"]: r["segments"] for r in got.collect()}
    assert [text[s["start"]:s["end"]] for s in found[1]][-3:] == ["VileScum", "trashful", "\u0130stanbulX"]
    assert [(s["start"], s["end"]) for s in found[2]] == [(0, 26)]             # both halves' segments, merged
    assert found[2][0]["score"] == pytest.approx(40.0 - 0.3)


def test_toxicity_without_labels(awkward_df, spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity(awkward_df, none).collect()} == {0.5}


def test_pipeline_stages_against_plain_python(spark, tmp_path, library):
    docs, labels = toxic_corpus(500)
    docs = [(i, t + (" password: hunter2222" if i % 50 == 1 else ""), ["hot", "b", "c"][i % 3 if i % 2 else 0]) for i, t, _ in docs]
    docs += [(1000 + i, docs[7][1], "b") for i in range(40)] + [(None, None, None), (2000, "", "c"), (2000, "", "c")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want_columns = now.columns
    plain = lambda frame: sorted(((r["doc_id"], r["text"], r["source"]) for r in frame.collect()), key=repr)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = plain(now)
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "encoding":
            assert after.columns == want_columns
        if name == "toxicity":
            kept = plain(after)
            gone = {d[0] for d in before} - {d[0] for d in kept}
            toxic = {i for i, _, t in labels if t}
            assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 0.01 * len(docs)
        elif name == "near_duplicates":
            prints = {t: fingerprint(t) for _, t, _ in before}
            root = groups(sorted(set(prints.values())), lambda a, b: bin(a ^ b).count("1") <= 2)
            low = {}
            for i, t, _ in before:
                low.setdefault(root[prints[t]], []).append(i)
            expected = [min((x for x in ids if x is not None), default=None) for ids in low.values()]
            assert sorted((d[0] for d in plain(after)), key=repr) == sorted(expected, key=repr)
        elif name == "secrets":
            assert plain(after) == sorted(((i, plain_redacted(t), s) for i, t, s in before), key=repr)
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] is not None)
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in source_mix(now).collect()}
            assert plain(after) == sorted((d for d in before for _ in range(copies[d[0]])), key=repr)
        else:
            expected = []
            for i, t, _ in before:
                ids = library.encode(t or "", add_special_tokens=False).ids
                expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
            got = after.select("doc_id", "n_tokens", "ids_sha256").collect()
            assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
        now = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "encoding"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
