import hashlib
import random
import re

import pytest

from tests.llm.conftest import SCHEMA, rows_of
from tidemark.llm.components import components
from tidemark.llm.covering_lsh import keep_one_per_component, links, masks, near_duplicate_components, signed
from tidemark.llm.secret_ledger import BASE_RULES, Rule, digest, redact, secret_findings


def groups(items, linked):
    """Brute-force component (smallest item) of each item."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in items}


def fingerprint(text):
    import xxhash
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    r = random.Random(radius)
    for _ in range(2000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, radius)))
        assert any(not diff & m for m in masks(radius))


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("limit", [1000, 1])
def test_links_have_the_components_of_all_pairs(spark, radius, limit):
    """Also for crowded buckets (limit 1: no pair is ever formed)."""
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(25)}
    prints = sorted(signed(p) for p in prints)
    distance = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    expected = groups(prints, lambda a, b: distance(a, b) <= radius)
    made = links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, pair_limit=limit)
    assert all(distance(u, v) <= radius for u, v in made.collect())
    got = {p: p for p in prints} | {n: m for n, m in components(made).collect()}
    assert got == expected


def test_components_of_a_long_chain_and_no_edges(spark):
    r = random.Random(1)
    names = r.sample(range(10_000), 300)
    edges = [(names[i], names[i + 1]) for i in range(200)] + [(names[250], names[251])]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert set(got) == {x for e in edges for x in e}
    assert {got[n] for n in names[:201]} == {min(names[:201])} and got[names[251]] == min(names[250:252])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, awkward_df, empty_df, awkward):
    prints = {t: fingerprint(t) for _, t, _ in awkward}
    root = groups(sorted(set(prints.values())), lambda a, b: bin(a ^ b).count("1") <= 2)
    low = {}
    for i, t, _ in awkward:
        if i is not None:
            low[root[prints[t]]] = min(i, low.get(root[prints[t]], i))
    expected = [(i, format(prints[t], "016x"), low.get(root[prints[t]])) for i, t, _ in awkward]
    got = near_duplicate_components(awkward_df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert near_duplicate_components(empty_df).collect() == []
    kept = keep_one_per_component(awkward_df)
    assert kept.columns == awkward_df.columns
    assert sorted(root[prints[r["text"]]] for r in kept.collect()) == sorted(set(root[prints[t]] for _, t, _ in awkward))
    assert keep_one_per_component(empty_df).collect() == []


def test_one_id_with_texts_of_several_components(spark):
    """Each component keeps one row, also where an id repeats with unrelated texts."""
    x, y = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    z = "completely other words stand in this line"
    docs = [(3, x, "a"), (5, x, "b"), (5, y, "c"), (5, y, "d"), (7, z, "e"), (7, y, "f"), (None, z, "g"), (None, x, "h")]
    assert len({fingerprint(t) for t in (x, y, z)}) == 3
    keep = lambda rows, n: sorted(map(tuple, keep_one_per_component(
        spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect()))
    got = keep(docs, 3)
    assert [r[:2] for r in got] == [(3, x), (5, y), (7, z)]
    assert keep(docs[::-1], 5) == got                                          # not the order of the rows


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def plain_digest(i, text):
    s = plain_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
    n = [sum(k == name for _, _, k, _ in s) for name in ("assign", "access", "hex")]
    return (i, *n, joined, hashlib.sha256(joined.encode()).hexdigest())


def plain_redacted(text):
    out, at = "", 0
    for a, _, _, b in plain_spans(text):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return out + text[at:] if text is not None else None


def test_secret_spans(awkward_df, empty_df, awkward):
    found, ledger = secret_findings(awkward_df)
    got = digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "spans", "base_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_digest(i, t) for i, t, _ in awkward), key=repr)
    assert ledger.count() == 3 * len({t or "" for _, t, _ in awkward})
    assert digest(secret_findings(empty_df)[0]).collect() == []


def test_ledger_scans_only_unseen_pairs(spark, awkward):
    first = spark.createDataFrame(rows_of(awkward[:40]), SCHEMA)
    both = spark.createDataFrame(rows_of(awkward), SCHEMA)
    _, ledger = secret_findings(first)
    found, after = secret_findings(both, ledger)
    assert after.count() == 3 * len({t or "" for _, t, _ in awkward})          # no pair twice
    assert sorted(map(tuple, digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "spans", "base_sha256").collect()),
                  key=repr) == sorted((plain_digest(i, t) for i, t, _ in awkward), key=repr)
    newer = (*BASE_RULES[:2], Rule("hex", r"[0-9a-f]+", 0, 32, version=2))
    _, third = secret_findings(both, after, newer)
    fresh = third.exceptAll(after)
    assert {(r["rule"], r["version"]) for r in fresh.select("rule", "version").distinct().collect()} == {("hex", 2)}


def test_redaction(awkward_df, awkward):
    found, _ = secret_findings(awkward_df)
    got = redact(awkward_df, found)
    assert got.columns == awkward_df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(
        ((i, plain_redacted(t)) for i, t, _ in awkward), key=repr)


def test_named_ledger_scans_only_new_blobs(spark, awkward, tmp_path):
    from tidemark.llm.secret_ledger import read_ledger, scan_with_ledger
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame(rows_of(awkward[:30]), SCHEMA)
    both = spark.createDataFrame(rows_of(awkward), SCHEMA)
    _, fresh = scan_with_ledger(first, path)
    old = {t or "" for _, t, _ in awkward[:30]}
    assert fresh.count() == 3 * len(old)
    found, fresh = scan_with_ledger(both, path)
    assert fresh.count() == 3 * len({t or "" for _, t, _ in awkward} - old)
    assert sorted(map(tuple, digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "spans", "base_sha256").collect()),
                  key=repr) == sorted((plain_digest(i, t) for i, t, _ in awkward), key=repr)
    _, fresh = scan_with_ledger(both, path)
    assert fresh.count() == 0
    fresh = read_ledger(spark, path)
    fresh.write.mode("append").parquet(path)                                # a run that was repeated
    assert read_ledger(spark, path).count() == 3 * len({t or "" for _, t, _ in awkward})


def test_overlapping_spans_and_many_matches(spark):
    texts = ["token=" + "deadbeef" * 4 + " rest", "deadbeef" * 3 + "api_key=abcdefgh tail", "é😀 secret: abcdefgh,AKIA" + "Q" * 18 + "中",
             "AKIA" + "Z" * 20 + "AKIA" + "Y" * 20, "password=hunter22" * 3, "secret=abcdef", "x\n" * 5 + "passwd : 'zzzzzz'\n",
             "é token=abcdef1 中" * 20_000]
    docs = [(i, t, "a") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows_of(docs), SCHEMA)
    found, _ = secret_findings(frame)
    got = digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "spans", "base_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(plain_digest(i, t) for i, t, _ in docs)
    assert {r["doc_id"]: r["text"] for r in redact(frame, found).collect()} == {i: plain_redacted(t) for i, t, _ in docs}


def test_work_grows_with_the_matches(spark):
    """Twice the matches in one text take about twice the time, scan and redaction alike."""
    import time
    took = []
    for n in (2_000, 40_000, 80_000):
        frame = spark.createDataFrame([(1, "token=abcdef1 and words " * n)], "doc_id long, text string")
        began = time.perf_counter()
        found, _ = secret_findings(frame)
        found.write.format("noop").mode("overwrite").save()
        redact(frame, found).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    assert took[2] < 3 * took[1] + 5 and took[2] < 90
