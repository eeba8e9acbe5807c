import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import bottom_k as B


def words_of(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sketch(texts, k=B.K):
    data = [t.encode() for t in texts]
    return B.Hasher().sketches(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), k)


def brute(docs):
    """(doc_id, text) -> sorted rows (doc_id, n_chars, edited sha, exact near_edited, exact near_next)."""
    rows = sorted(((i is None, -(i or 0), hashlib.sha256((t or "").encode()).hexdigest(), i, t or "") for i, t in docs),
                  key=lambda r: r[:3])
    out = []
    for n, (*_, i, t) in enumerate(rows):
        follower = rows[(n + 1) % len(rows)][4]
        half = len(t) // 2
        edited = t[:len(t) - half] + follower[:half]
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(),
                    jaccard(words_of(t), words_of(edited)), jaccard(words_of(t), words_of(follower))))
    return sorted(out)


def check(frame, docs, loose=0.15):
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in frame.collect())
    expected = brute(docs)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    sizes = {len(words_of(t or "")) for _, t in docs}
    for g, e in zip(got, expected):
        assert g[3:] == pytest.approx(e[3:], abs=1e-12 if max(sizes) < B.K // 2 else loose)


def test_awkward_documents(awkward_df, awkward):
    docs = [(i, t) for i, t, _ in awkward]
    for range_bytes in (B.RANGE_BYTES, 700, 1):
        check(B.edited_fingerprints(awkward_df, range_bytes=range_bytes), docs)


def test_equal_texts_equal_fingerprints_and_reruns(awkward_df, awkward):
    by_text = {i: t for i, t, _ in awkward if i is not None}
    rows = B.edited_fingerprints(awkward_df, range_bytes=900).collect()
    again = B.edited_fingerprints(awkward_df.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    seen = {}
    for r in rows:
        if r["doc_id"] is not None:
            assert seen.setdefault(by_text[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    assert len(set(seen.values())) >= len({frozenset(words_of(t)) for t in seen})


def test_empty_and_single_and_all_equal(spark, empty_df):
    assert B.edited_fingerprints(empty_df).collect() == []
    for docs in ([(7, "one two three four five six")], [(None, None)], [(3, "same row here")] * 500 + [(2, "")] * 40):
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
        for size in (B.RANGE_BYTES, 1):
            check(B.edited_fingerprints(frame, range_bytes=size), docs)


def test_half_null_ids(spark):
    r = random.Random(1)
    docs = [(None if i % 2 else i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(30)))) for i in range(400)]
    check(B.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), range_bytes=2000), docs)


def test_shingles_do_not_cross_texts_or_depend_on_slices():
    texts = ["a b c d e f g", "A  b\tc\nd e f g", "", "  ", "x", "a b c d e f", "naïve 中文 😀 don't", "f g a b c d e"]
    got = sketch(texts)
    assert np.array_equal(got[0], got[1]) and [len(s) for s in got] == [3, 3, 0, 0, 1, 2, 1, 3]
    for t, s in zip(texts, got):
        assert np.array_equal(s, sketch([t])[0])
    B.SLICE_BYTES, kept = 3, B.SLICE_BYTES
    try:
        assert all(np.array_equal(a, b) for a, b in zip(got, sketch(texts)))
    finally:
        B.SLICE_BYTES = kept


def test_estimates_against_exact_sets():
    r = random.Random(2)
    for overlap in (0.0, 0.2, 0.5, 0.9, 1.0):
        a = [str(r.randrange(10 ** 9)) for _ in range(20_000)]
        b = a[:int(len(a) * overlap)] + [str(r.randrange(10 ** 9)) for _ in range(int(len(a) * (1 - overlap)))]
        x, y = sketch([" ".join(a), " ".join(b)])
        one, two = words_of(" ".join(a)), words_of(" ".join(b))
        assert B.resemblance(x, y) == pytest.approx(jaccard(one, two), abs=0.12)
        assert B.containment(x, y) == pytest.approx(len(one & two) / len(one), abs=0.2)
        assert B.distinct(x) == pytest.approx(len(one), rel=0.25)


def test_merging_parts_is_the_sketch_of_the_whole(spark):
    r = random.Random(4)
    rows = [(i, "hot" if i % 3 else r.choice(["a", "b", None]), " ".join(r.choice("abcdefghijklm") for _ in range(40)))
            for i in range(600)] + [(9000, "empty", None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(8)
    for held in (10_000, 1):
        got = {x["key"]: x for x in B.merge_by(frame, "source", held=held).collect()}
        assert set(got) == {"hot", "a", "b", None, "empty"}
        for key, found in got.items():
            parts = sketch([t or "" for _, s, t in rows if s == key])
            assert np.array_equal(B.from_bytes(found["sketch"]), np.unique(np.concatenate(parts))[:B.K])
    single = {x["doc_id"]: x["sketch"] for x in B.fingerprints(frame).collect()}
    assert np.array_equal(B.from_bytes(single[5]), sketch([rows[5][2]])[0])
