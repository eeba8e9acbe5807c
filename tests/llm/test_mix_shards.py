import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import SCHEMA, rows_of
from tidemark.llm.kd_shards import kd_shards
from tidemark.llm.mixing import apply_mix, share_out, source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_by_hand():
    # weights 5, 2, 1, 5 for a, b, é, null; b and é stop at 3 times their size
    got = share_out({"b": 10, None: 500, "a": 480, "é": 10}, (5, 2, 1), 3)
    assert got["b"] == 30 and got["é"] == 30
    assert got["a"] == pytest.approx(470) and got[None] == pytest.approx(470)
    assert share_out({}, (5, 2, 1), 3) == {}
    assert share_out({"a": 0}, (5, 2, 1), 3) == {"a": 0}


def test_source_mix(spark, empty_df):
    docs = [(i, " ".join(["w"] * (1 + i * i % 37)), ["hot", "b", "c", None][0 if i % 3 == 0 else i % 4]) for i in range(600)]
    docs += [(1000, " ".join(["long"] * 5000), "b"), (None, "a b c", "c"), (1001, None, "hot"), (1002, " \n", "b")]
    frame = spark.createDataFrame(rows_of(docs), SCHEMA)
    rows = source_mix(frame).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows if r["doc_id"] is not None) == sorted(
        (i, len(WORD.findall(t or ""))) for i, t, _ in docs if i is not None)
    total, taken, target = Counter(), Counter(), {}
    for r in rows:
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in {r["size"] * k for k in range(4)}
    assert target == pytest.approx(share_out(total, (5, 2, 1), 3))
    for s in total:
        assert abs(taken[s] - target[s]) <= max(2, 0.002 * target[s]), s
    again = source_mix(frame.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    mixed = apply_mix(frame)
    assert mixed.columns == frame.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    assert source_mix(empty_df).collect() == [] and apply_mix(empty_df).collect() == []


def test_mix_of_awkward_rows(awkward_df, awkward):
    rows = source_mix(awkward_df).collect()
    assert len(rows) == len(awkward)
    assert apply_mix(awkward_df).count() == sum(r["copies"] for r in rows)


def check_shards(rows, docs, shards, spread):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs), key=repr)
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(held) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if spread:
        assert len(held) == shards and max(held.values()) <= spread * sum(held.values()) / shards


def test_kd_shards(spark, awkward_df, empty_df, awkward):
    docs = [(i, f"text {i % 400} " * (1 + i * 7 % 61), "a") for i in range(2000)] + [(None, None, None)] * 3
    frame = spark.createDataFrame(rows_of(docs), SCHEMA)
    rows = kd_shards(frame, 16).collect()
    check_shards(rows, docs, 16, 1.15)
    homes = defaultdict(set)
    for r in rows:
        homes[r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())       # small groups of equal texts stay together
    check_shards(kd_shards(awkward_df, 16).collect(), awkward, 16, None)
    assert kd_shards(empty_df, 16).collect() == []
    check_shards(kd_shards(frame, 5).collect(), docs, 5, 1.15)
    assert max(r["shard"] for r in kd_shards(frame, target_bytes=60_000).collect()) >= 4


def test_a_hot_group_is_split(spark):
    """One text with a third of all rows: larger than a shard, so it is cut by row."""
    docs = [(i, "the same hot text " * 4, "a") for i in range(700)] + [(1000 + i, f"other text number {i} " * 4, "b") for i in range(1300)]
    rows = kd_shards(spark.createDataFrame(rows_of(docs), SCHEMA), 16).collect()
    check_shards(rows, docs, 16, 1.15)


def identical_half():
    """1,000 rows equal in everything with a null id, and as many distinct ones."""
    return [(None, "one boilerplate text that fills half the table", "a")] * 1000 + [
        (i, f"text number {i} " + "w " * (i % 11), "b") for i in range(1000)]


def test_mix_takes_any_number_of_identical_rows(spark):
    docs = identical_half()
    frame = spark.createDataFrame(rows_of(docs), SCHEMA).repartition(6)
    rows = source_mix(frame).collect()
    assert len(rows) == 2000
    for s in "ab":
        mine = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.01)
    again = source_mix(frame.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    mixed = Counter((r["doc_id"], r["source"]) for r in apply_mix(frame).collect())
    expected = Counter()
    for r in rows:
        expected[r["doc_id"], r["source"]] += r["copies"]
    assert mixed == Counter({k: n for k, n in expected.items() if n})


def test_shards_divide_identical_rows(spark):
    docs = identical_half()
    rows = kd_shards(spark.createDataFrame(rows_of(docs), SCHEMA).repartition(6), 16).collect()
    check_shards(rows, docs, 16, 1.05)
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["size"]
    assert min(held.values()) >= 0.95 * sum(held.values()) / 16
    only = [(7, "same", "a")] * 1600
    check_shards(kd_shards(spark.createDataFrame(rows_of(only), SCHEMA).repartition(4), 16).collect(), only, 16, 1.05)


def brute_fill(sizes, hashes, gap):
    """Which rows the fill takes, by walking all rows in hash order."""
    taken, after, target = set(), -1, gap
    order = sorted(range(len(sizes)), key=lambda i: hashes[i])
    longest = max(sizes, default=0)
    while True:
        walked = [i for i in order if hashes[i] > after and sizes[i] <= longest]
        if not walked:
            break
        for i in walked:
            if sizes[i] > gap:
                after, longest = hashes[i], int(gap)
                break
            taken.add(i)
            gap -= sizes[i]
        else:
            break
        if gap <= 1e-4 * target or not longest:
            break
    return taken, gap


def test_mix_equals_a_walk_in_hash_order(spark):
    from pyspark.sql import functions as F
    from tidemark.llm.mixing import Search, narrow, taken_by_rules, RULES
    import random
    r = random.Random(8)
    rows = [("s", r.randrange(1, 60), r.randrange(1 << 62)) for _ in range(900)]
    frame = spark.createDataFrame(rows, "source string, size long, h long")
    whole = sum(x[1] for x in rows)
    for gap in (0.3 * whole, 0.77 * whole, 12.0):
        search = {"s": Search(gap, gap)}
        while search["s"].open():
            narrow(frame, search)
        plan = spark.createDataFrame([(search["s"].rules,)], RULES)
        got = frame.crossJoin(plan).filter(taken_by_rules()).select("h").collect()
        expected, left = brute_fill([x[1] for x in rows], [x[2] for x in rows], gap)
        assert {g["h"] for g in got} == {rows[i][2] for i in expected}
        assert search["s"].gap == pytest.approx(left)
