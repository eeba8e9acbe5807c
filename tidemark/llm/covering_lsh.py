"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r, give each of the 64 bit positions a vector from {0,1}^(r+1).
Every non-zero v in {0,1}^(r+1) defines a mask: the positions whose vector
has an odd inner product with v.  The vectors of at most r differing
positions span a space of dimension <= r, so some v is orthogonal to all
of them: in that mask no differing bit is selected and the two masked
fingerprints are equal.  So 2^(r+1) - 1 tables (7 for r = 2) miss no pair
within the radius, for any data.

Positions are dealt to the non-zero vectors in turn, so each mask selects
about 37 of 64 bits.

Work is on distinct fingerprints (copies of a text share one).  In a
bucket of at most ``pair_limit`` fingerprints every pair is compared.  In
a larger bucket no pairs are formed: all its members agree on the mask's
bits, so two of them within distance 2 share, for some bit outside the
mask, the "hub" got by flipping that bit in one of them (or one is the
other's hub).  Members are linked to the smallest fingerprint at each hub
they reach, flipping at most ``radius // 2`` bits on one side and the
rest on the other.  The rows are linear in the bucket's size, nothing is
capped, and no link is lost or invented: two fingerprints at one hub
differ in at most ``radius`` bits.

Defined results: null, empty and white-space texts have fingerprint zero
and are linked like any other; null or repeated doc_ids are kept row by
row (a component's id is its smallest non-null doc_id, null if it has
none); an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, only, text_or_empty, unused
from tidemark.llm.components import components

BITS = 64
#: Fixed values of the fingerprint's definition.
SEED = 42
#: Shingles hashed at a time; bounds memory for very long texts.
SPAN = 1 << 16


def masks(radius: int) -> list[int]:
    """The covering masks as unsigned 64-bit integers."""
    n = 1 << (radius + 1)
    vector = [1 + i % (n - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(vector[i] & v).count("1") % 2) for v in range(1, n)]


def signed(x: int) -> int:
    """An unsigned 64-bit integer as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(data: bytes, shingle: int) -> int:
    """Fingerprint of one UTF-8 text."""
    import xxhash
    words = data.lower().split()                       # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, SPAN):
        part = [b" ".join(words[i:i + shingle]) for i in range(lo, min(n, lo + SPAN))]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", also: tuple = ()) -> DataFrame:
    """(doc_id, fp long) and the long columns ``also`` for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = [signed(simhash(t.as_py(), shingle)) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fp, pa.int64())}
                                             | {c: batch.column(2 + k) for k, c in enumerate(also)})

    return (only(docs, id=id_col, text=text_col, **{c: c for c in also})
            .select(F.col("id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *also)
            .mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{c} long" for c in also]])))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, radius: int, pair_limit: int = 32) -> DataFrame:
    """(u, v) links among distinct fingerprints (column fp) whose components
    are those of all pairs within ``radius`` bits."""
    table = list(enumerate(masks(radius)))
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in table]
    )).alias("b")).select("fp", "b.t", "b.key")
    size = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(keyed.join(size, ["t", "key"]), "buckets")

    small = shared.filter(F.col("n") <= pair_limit)
    a, b = small.select("t", "key", F.col("fp").alias("u")), small.select("t", "key", F.col("fp").alias("v"))
    pairs = a.join(b, ["t", "key"]).filter(F.col("u") > F.col("v")).filter(_distance("u", "v") <= radius)

    # two sides meet at a hub: one flips `near` bits at most, the other the rest
    near = radius // 2
    flips = []
    for t, m in table:
        free = [i for i in range(BITS) if not m >> i & 1]
        reach = [(k, sum(1 << i for i in c)) for k in range(radius - near + 1) for c in combinations(free, k)]
        flips.append(F.when(F.col("t") == t, F.array(*[
            F.struct(F.lit(k).alias("k"), F.lit(signed(x)).alias("x")) for k, x in reach])))
    hubs = (shared.filter(F.col("n") > pair_limit)
            .select("fp", F.explode(F.coalesce(*flips)).alias("f"))
            .select("fp", F.col("f.k").alias("k"), F.col("fp").bitwiseXOR(F.col("f.x")).alias("hub")).distinct())
    low = hubs.filter(F.col("k") <= near).groupBy("hub").agg(F.min("fp").alias("v"))
    starred = hubs.join(low, "hub").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.select("u", "v").unionByName(starred).distinct()


def members(prints: DataFrame, low: Column, radius: int, pair_limit: int = 32) -> DataFrame:
    """(fp, low, root) of every distinct fingerprint; low: the least ``low`` of its rows."""
    if radius < 0 or radius >= BITS:
        raise ValueError("radius must lie in 0..63")
    classes = prints.groupBy("fp").agg(F.min(low).alias("low"))
    roots = components(links(classes.select("fp"), radius, pair_limit))
    return classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicate_components(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                              text_col: str = "text", pair_limit: int = 32) -> DataFrame:
    """doc_id, fp, fingerprint (hex) and component_id for every row."""
    prints = cut_lineage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    member = members(prints, F.col("doc_id"), radius, pair_limit)
    ids = member.groupBy("root").agg(F.min("low").alias("component_id"))
    named = member.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id.

    A null id ranks after all others, by a hash of its text.  Rows of one id
    rank by the hash of their text, then by that of all columns (maps, which
    Spark cannot hash, left out), so an id with texts of several components
    stands for each of them on its own and reruns keep the same rows."""
    key, text_hash, row_hash = unused(docs, "key"), unused(docs, "text_hash"), unused(docs, "row_hash")
    null_id = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text_or_empty(text_col)), 3)
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.select("*", F.coalesce(F.col(f"`{id_col}`").cast("long"), null_id).alias(key),
                        F.xxhash64(text_or_empty(text_col)).alias(text_hash), F.xxhash64(*plain).alias(row_hash))
    rank = [key, text_hash, row_hash]
    prints = cut_lineage(fingerprints(keyed, shingle, key, text_col, (text_hash, row_hash)), "fingerprints")
    kept = (members(prints, F.struct(F.col("doc_id").alias(key), text_hash, row_hash), radius)
            .groupBy("root").agg(F.min("low").alias("low")).select("low.*"))
    return keyed.join(kept, rank, "left_semi").dropDuplicates(rank).select(*[F.col(f"`{c}`") for c in docs.columns])
