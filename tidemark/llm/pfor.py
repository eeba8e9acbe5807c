"""Token-ID output as patched frame-of-reference blocks.

File format (a table of segments on the shared store; one row each):

* ``part``, ``seq``: the writing task and the segment's number in it;
  (part, seq) ascending is doc_id ascending.
* ``first``: ids of the same ``part`` before this segment.
* ``doc_ids``, ``doc_tokens``: the documents of the segment in order and
  their id counts.  A document never crosses segments.
* ``payload``: bytes, little-endian::

      u32 ids | u32 blocks | u32 start[blocks + 1] | blocks

  ``start`` indexes the blocks, so any block can be read alone.  A block
  holds ``BLOCK`` ids (the last one fewer)::

      u32 minimum | u8 width | u8 0 | u16 exceptions
      packed deltas: width bits each, least significant bit first
      u16 position[exceptions] | u32 delta[exceptions]

The block's minimum is subtracted; ``width`` is the number of bits that
covers the ``PERCENTILE`` of the deltas; wider deltas go whole into the
exception list and their packed slot holds 0.

Documents are range-partitioned by (doc_id, hash of the text), nulls first,
so one repeated or null doc_id may fill many tasks, and sorted inside each
partition, encoded and packed in one pass.  The prefix sum over the
tasks' totals is one number per task.  Nothing else reaches the driver.

Defined results: null text counts as empty (the end id alone); rows that
repeat a doc_id follow each other, ordered by a hash of the text, then the
text; null doc_ids come first; an empty table gives an empty file and no rows; extra
columns of the input are never read.  Memory per task: one slice of
texts, one segment (``SEGMENT_IDS`` ids or one document if longer) and the
word table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import only, scratch_path, text_or_empty
from tidemark.llm.pretoken import Encoder

BLOCK = 512
PERCENTILE = 90
SEGMENT_IDS = 1 << 19

SEGMENTS = "part int, seq int, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary"
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("pad", "u1"), ("exceptions", "<u2")])


def bit_widths(x: np.ndarray) -> np.ndarray:
    """Bits needed for each unsigned 32-bit value (0 for 0)."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values as rows of bytes: ``width`` bits a value, least significant bit first.

    64 values fill ``width`` words of 64 bits, so value j of each 64 has the same word and shift."""
    groups = values.astype(np.uint64).reshape(len(values), BLOCK // 64, 64)
    words = np.zeros((len(values), BLOCK // 64, width), "<u8")
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[:, :, word] |= groups[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, word + 1] |= groups[:, :, j] >> np.uint64(64 - shift)
    return words.reshape(len(values), -1).view(np.uint8)


def from_bits(data: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``to_bits``."""
    words = np.ascontiguousarray(data).view("<u8").reshape(len(data), BLOCK // 64, width)
    out = np.empty((len(data), BLOCK // 64, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, j] = value & mask
    return out.reshape(len(data), BLOCK)


def pack(ids: np.ndarray) -> bytes:
    """One segment's ids as the payload described above."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.array([0, 0, 12], "<u4").tobytes()
    full = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - n)]).astype(np.uint32).reshape(blocks, BLOCK)
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    low = full.min(axis=1)
    delta = full - low[:, None]
    at = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    width = bit_widths(np.partition(delta, at, axis=1)[:, at])
    over = bit_widths(delta) > width[:, None]
    over[-1, size[-1]:] = False                       # padding is not stored
    n_over = over.sum(axis=1)
    packed_bytes = (size * width + 7) // 8
    total = HEAD.itemsize + packed_bytes + 6 * n_over
    head_bytes = 8 + 4 * (blocks + 1)
    starts = head_bytes + np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(int(starts[-1]), np.uint8)
    out[:head_bytes] = np.frombuffer(np.concatenate([[n, blocks], starts]).astype("<u4").tobytes(), np.uint8)
    heads = np.zeros(blocks, HEAD)
    heads["low"], heads["width"], heads["exceptions"] = low, width, n_over
    out[starts[:-1, None] + np.arange(HEAD.itemsize)] = heads.view(np.uint8).reshape(blocks, -1)
    kept = np.where(over, 0, delta)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if not w:
            continue
        data = to_bits(kept[rows], int(w))
        whole = rows[size[rows] == BLOCK]
        out[starts[whole, None] + HEAD.itemsize + np.arange(data.shape[1])] = data[:len(whole)]
        if len(whole) < len(rows):                    # the short last block
            a, k = int(starts[rows[-1]]) + HEAD.itemsize, int(packed_bytes[rows[-1]])
            out[a:a + k] = data[-1][:k]
    for b in np.flatnonzero(n_over):
        pos = np.flatnonzero(over[b])
        a = int(starts[b]) + HEAD.itemsize + int(packed_bytes[b])
        out[a:int(starts[b + 1])] = np.frombuffer(
            pos.astype("<u2").tobytes() + delta[b, pos].astype("<u4").tobytes(), np.uint8)
    return out.tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a segment."""
    raw = np.frombuffer(payload, np.uint8)
    n, blocks = np.frombuffer(payload, "<u4", 2).tolist()
    if not blocks:
        return np.empty(0, np.uint32)
    starts = np.frombuffer(payload, "<u4", blocks + 1, 8).astype(np.int64)
    heads = raw[starts[:-1, None] + np.arange(HEAD.itemsize)].copy().view(HEAD).reshape(-1)
    width, low = heads["width"].astype(np.int64), heads["low"]
    out = np.zeros((blocks, BLOCK), np.uint32)
    last = n - (blocks - 1) * BLOCK
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        k = (BLOCK * w + 7) // 8
        pieces = np.zeros((len(rows), k), np.uint8)
        whole = rows if last == BLOCK else rows[rows < blocks - 1]
        pieces[:len(whole)] = raw[starts[whole, None] + HEAD.itemsize + np.arange(k)]
        if len(whole) < len(rows):
            have = (last * w + 7) // 8
            a = int(starts[blocks - 1]) + HEAD.itemsize
            pieces[-1, :have] = raw[a:a + have]
        out[rows] = from_bits(pieces, int(w))
    for b in np.flatnonzero(heads["exceptions"]):
        k, m = int(heads["exceptions"][b]), last if b == blocks - 1 else BLOCK
        a = int(starts[b]) + HEAD.itemsize + (m * int(width[b]) + 7) // 8
        out[b, np.frombuffer(payload, "<u2", k, a)] = np.frombuffer(payload, "<u4", k, a + 2 * k)
    out += low[:, None]
    return out.reshape(-1)[:n]


def read_block(payload: bytes, block: int) -> np.ndarray:
    """One block's ids, found through the start index."""
    n, blocks = np.frombuffer(payload, "<u4", 2).tolist()
    a, b = np.frombuffer(payload, "<u4", 2, 8 + 4 * block).tolist()
    size = min(BLOCK, n - block * BLOCK)
    head = np.array([size, 1, 16, 16 + b - a], "<u4").tobytes()
    return unpack(head + payload[a:b])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id",
              text_col: str = "text") -> None:
    """Encode every whole text and write the segments in ascending id order."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer), TaskContext.get().partitionId()
        names, sizes, held, n_held, seq, first = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "first": pa.array([first], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "doc_tokens": pa.array([sizes], pa.list_(pa.int64())),
                "payload": pa.array([pack(ids)], pa.binary())})

        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for ids, off in encoder.encode(batch.column(1).to_pylist()):
                n = len(off) - 1
                if end_id is not None:                        # the end id after each document, in one pass
                    ids, off = np.insert(ids, off[1:], end_id), off + np.arange(n + 1)
                lo = 0
                while lo < n:                                 # as many documents as the segment still takes
                    hi = int(np.searchsorted(off, off[lo] + SEGMENT_IDS - n_held, "right")) - 1
                    if hi <= lo and n_held:
                        yield close()
                        seq, first = seq + 1, first + n_held
                        names, sizes, held, n_held = [], [], [], 0
                        continue
                    hi = max(hi, lo + 1)
                    held.append(ids[off[lo]:off[hi]])
                    names += doc_ids[at + lo:at + hi]
                    sizes += np.diff(off[lo:hi + 1]).tolist()
                    n_held += int(off[hi] - off[lo])
                    lo = hi
                at += n
        if names:
            yield close()

    (only(docs, id=id_col, text=text_col)
        .select(F.col("id").cast("long").alias("id"), text_or_empty().alias("text"))
        .withColumn("place", F.xxhash64("text"))
        .repartitionByRange("id", "place").sortWithinPartitions("id", "place", "text").drop("place")
        .mapInArrow(segments, SEGMENTS).write.parquet(path))


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Global position of each writing task's first id (one row per task)."""
    rows = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    out, at = [], 0
    for r in rows:
        out.append((r["part"], at))
        at += r["n"]
    return spark.createDataFrame(out, "part int, part_start long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                end = np.cumsum(row["doc_tokens"])
                begin = end - row["doc_tokens"]
                view = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(begin + row["first"] + row["part_start"], pa.int64()),
                    "n_tokens": pa.array(row["doc_tokens"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(begin, end)], pa.int64())})

    # part_starts has one row per writing task, a size set by the cluster's partitions
    return (spark.read.parquet(path).join(F.broadcast(part_starts(spark, path)), "part")
            .select("part_start", "first", "doc_ids", "doc_tokens", "payload")
            .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_id_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the corpus' ids and return the digest read back from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
