import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm.pfor import BLOCK, pack, read_block, token_id_files, unpack
from tidemark.llm.pretoken import Encoder
from tidemark.llm.spec_bpe import MergeTable, SpeculativeEncoder, bpe_round_trip
from tidemark.llm.token_counts import Chunks, token_counts

LETTERS = list(" \t\n\r\x0b  '’strevmldaeino01½Ⅷéßñ中!?.,-_<|>\x00\x85😀") + ["<|endoftext|>", "'ll", "'re", " the", "tion"]


def fuzz(n, size, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randrange(size))) for _ in range(n)] + [
        "", "a" * 700, " " * 300, "'" * 40, "<|endoftext|>" * 3, "-" * 129, "ab" * 90]


def ids_of(encoder, texts):
    return [ids[a:b].tolist() for ids, off in encoder.encode(texts) for a, b in zip(off[:-1], off[1:])]


@pytest.mark.parametrize("kind", [Encoder, SpeculativeEncoder])
@pytest.mark.parametrize("batch", [2_000_000, 60])
def test_ids_equal_the_library(kind, batch, tokenizer, library):
    texts = fuzz(1500, 70)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(kind(tokenizer, batch_chars=batch, max_words=500), texts) == expected


def test_pair_check_equals_exact_merging(tokenizer):
    m, r = MergeTable(tokenizer), random.Random(4)
    ids = [r.randrange(256, 50256) if r.random() < 0.6 else r.randrange(256) for _ in range(4000)]
    a, b = np.array(ids[::2]), np.array(ids[1::2])
    expected = [m.exact(m.bytes_of[x] + m.bytes_of[y]) == [x, y] for x, y in zip(a, b)]
    assert m.compatible(a, b).tolist() == expected
    w = b"incomprehensibilities" * 4
    assert m._merge_long([m.id_of[w[i:i + 1]] for i in range(len(w))]) == m._merge_short([m.id_of[w[i:i + 1]] for i in range(len(w))])


@pytest.mark.parametrize("chunk,overlap", [(30, 10), (17, 3), (1, 1), (100, 40)])
def test_overlap_splicing_is_exact(chunk, overlap, tokenizer, library):
    texts = fuzz(400, 400, seed=2)
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Chunks(tokenizer, chunk, overlap, batch_chars=5000).counts(texts) == expected


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 7])
@pytest.mark.parametrize("high", [1, 2, 50_257, 1 << 32])
def test_patched_blocks_round_trip(n, high):
    x = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    x[::17] = (1 << 32) - 1                                # outliers go to the exception lists
    data = pack(x)
    assert (unpack(data) == x).all() and len(unpack(data)) == n
    for b in range(-(-n // BLOCK)):
        assert (read_block(data, b) == x[b * BLOCK:(b + 1) * BLOCK]).all()


def test_token_id_files(awkward_df, empty_df, awkward, tokenizer, library):
    key = lambda d: (d[0] is not None, d[0] or 0, d[1] or "")
    expected, at = [], 0
    for i, t, _ in sorted(awkward, key=key):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_id_files(awkward_df, tokenizer).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert token_id_files(empty_df, tokenizer).collect() == []


def test_token_counts(awkward_df, empty_df, awkward, tokenizer, library):
    expected = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024)
                       for i, t, _ in awkward), key=repr)
    got = token_counts(awkward_df, tokenizer, chunk_chars=500, overlap=20)
    assert sorted(map(tuple, got.collect()), key=repr) == expected
    assert token_counts(empty_df, tokenizer).collect() == []


def test_bpe_round_trip(awkward_df, empty_df, awkward, tokenizer, library):
    expected = []
    for i, t, _ in awkward:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
    got = bpe_round_trip(awkward_df, tokenizer).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    row = bpe_round_trip(awkward_df.filter("doc_id = 6"), tokenizer, with_text=True).first()
    assert row["decoded"] == next(t for i, t, _ in awkward if i == 6) and len(row["ids"]) == row["n_tokens"]
    assert bpe_round_trip(empty_df, tokenizer).collect() == []


def test_one_null_id_fills_many_tasks(spark, tokenizer, library):
    """Half the rows have no id: the files are ranged by id and text, so no task gets all of them."""
    from tidemark.llm.pfor import read_documents, write_ids
    from tidemark.session import scratch_path
    texts = fuzz(2000, 60, seed=9)
    rows = [(None if i % 2 else i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "hot-ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # small ranges stay apart
    try:
        write_ids(frame, path, tokenizer, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    nulls = [sum(d is None for r in part for d in r["doc_ids"]) for part in
             spark.read.parquet(path).rdd.map(lambda r: (r["part"], r)).groupByKey().map(lambda kv: list(kv[1])).collect()]
    assert sum(nulls) == 1003 and sum(n > 0 for n in nulls) >= 2
    got = sorted((r["n_tokens"], r["ids_crc32"]) for r in read_documents(spark, path).collect())
    ids = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)


def test_distinct_word_table_survives_hash_collisions(tokenizer):
    from tidemark.llm.pretoken import DistinctWordTable
    table = DistinctWordTable(lambda w: [ord(c) for c in w])
    table.up = table.down = np.zeros(1 << 12, np.uint64)       # every word of one length has the same hash
    joined = "abcd" * 50 + "abce"
    starts = np.arange(0, len(joined), 2)
    ids, n = table.ids(table.rows(joined, starts, starts + 2))
    assert ids.tolist() == [ord(c) for c in joined] and (n == 2).all()
