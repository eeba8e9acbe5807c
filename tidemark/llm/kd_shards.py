"""Sharding by k-d tree partitioning.

The table is split recursively: each node takes its widest metadata
dimension (its extent relative to the whole table's), finds the weighted
median of the bytes along it, and splits there, until a leaf reaches its
target bytes.  All nodes of a level are searched together, by histograms:
sum the bytes by node and equal-width bucket, run a cumulative sum over a
node's ``2^BITS`` buckets, refine only the bucket with the median.  Rows
that agree in the dimension are ordered further by a hash of the text and,
inside one text, by a hash of the row, so one value, text or group of
copies may hold any share of the bytes and the halves still come out
equal.

Equal texts stay together: the dimensions used for splitting are functions
of the text, and a cut inside a group of equal texts moves to the nearer
end of the group if that costs at most ``SLACK`` of a leaf's target; only
larger groups are cut inside (by the row hash).

The tree has one split fewer than leaves; it goes to the tasks level by level.
The text is read once; the searches read a narrow written table.  To the
driver go one row per node and search step.

Defined results: null text has size 1 (no bytes, plus 1) and the checksum
of no bytes; null or repeated doc_ids are kept row by row (rows equal in
doc_id and text get an occurrence number in the row hash, so they can be
divided like others); an empty table gives no rows; extra
columns are never read.  Slots count from 0 without gaps in each shard, in
hash order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import apart, cut_lineage, only, text_or_empty

BITS = 12
SLACK = 0.05
HASH_MAX = 1 << 62
#: Rows per ranking group when slots are numbered.
SLOT_GROUP = 100_000


@dataclass(frozen=True)
class Split:
    """Rows whose (dimension, text hash, row hash) is below the cut go left."""
    node: int
    dim: str
    value: int
    text: int
    row: int


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow table: doc_id, size, text_crc32, the metadata dimensions and hashes."""
    text = F.col("text")
    spread = lambda c: F.shiftrightunsigned(c, 2)  # noqa: E731  [0, 2^62)
    rows = only(docs, doc_id=id_col, t=text_col).select(F.col("doc_id").cast("long").alias("doc_id"),
                                                        text_or_empty("t").alias("text"))
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.regexp_count(text, F.lit("\n")).cast("long").alias("n_lines"),
        F.coalesce(F.ascii(F.substring(text, 1, 1)), F.lit(0)).cast("long").alias("first_char"),
        spread(F.xxhash64(text)).alias("text_hash"), spread(F.xxhash64("doc_id", text)).alias("row_hash"),
        F.monotonically_increasing_id().alias("at"))


#: Metadata dimensions of a text; any long columns that are functions of it do.
DIMENSIONS = ("n_chars", "n_lines", "first_char")


def placed(rows: DataFrame, tree: dict, dims) -> DataFrame:
    """``rows`` with node: the tree's node a row ends in (root 1, children 2n and 2n + 1).

    One broadcast join a level; a level has at most as many rows as leaves."""
    out = rows.withColumn("node", F.lit(1))
    for level in range(max([0, *(n.bit_length() for n in tree)])):
        splits = [(n, dims.index(s.dim) + 1, s.value, s.text, s.row) for n, s in tree.items() if n.bit_length() == level + 1]
        table = rows.sparkSession.createDataFrame(splits, "at int, dim int, cut long, cut_text long, cut_row long")
        value = F.element_at(F.array(*dims), F.col("dim"))
        left = (value < F.col("cut")) | ((value == F.col("cut")) & (
            (F.col("text_hash") < F.col("cut_text"))
            | ((F.col("text_hash") == F.col("cut_text")) & (F.col("row_hash") < F.col("cut_row")))))
        out = (out.join(F.broadcast(table), F.col("node") == F.col("at"), "left")
               .withColumn("node", F.when(F.col("at").isNull(), F.col("node"))
                           .otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1)))
               .drop("at", "dim", "cut", "cut_text", "cut_row"))
    return out


def _cuts(level: DataFrame, column: str, need: dict) -> dict:
    """Exact weighted cut along ``column`` for each node of ``need``.

    need: node -> (filter value columns already in ``level``: lo, hi, goal).
    Returns node -> (value, bytes below the value, bytes at the value)."""
    spark, done = level.sparkSession, {}
    open_ = {n: [lo, hi, goal, 0] for n, (lo, hi, goal) in need.items()}
    while open_:
        table = F.broadcast(spark.createDataFrame(          # one row per open node
            [(n, lo, hi, max(1, -(-(hi - lo + 1) >> BITS)), float(goal - base)) for n, (lo, hi, goal, base) in open_.items()],
            "n int, lo long, hi long, step long, room double"))
        hist = (level.join(table, F.col("node") == F.col("n")).filter(F.col(column).between(F.col("lo"), F.col("hi")))
                .groupBy("n", F.expr(f"({column} - lo) div step").alias("bucket"), "room")
                .agg(F.sum("size").alias("b"), F.min(column).alias("first"), F.max(column).alias("last")))
        run = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        edge = hist.withColumn("upto", F.sum("b").over(run)).filter("upto >= room").groupBy("n").agg(
            F.min(F.struct("bucket", "first", "last", "b", "upto")).alias("e")).collect()
        for r in edge:
            n, e = r["n"], r["e"]
            lo, hi, goal, base = open_[n]
            base += e["upto"] - e["b"]
            if e["first"] == e["last"]:
                done[n] = (e["first"], base, e["b"])
                del open_[n]
            else:
                open_[n] = [e["first"], e["last"], goal, base]
    return done


def build_tree(rows: DataFrame, leaves: int, dims=DIMENSIONS) -> dict:
    """{node: Split} that cuts the rows' bytes into ``leaves`` near equal leaves."""
    depth = max(0, (leaves - 1).bit_length())
    extent = rows.agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{k}_{d}") for d in dims
                                                      for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if not extent["bytes"] or not depth:
        return {}
    wide = {d: max(1, extent[f"hi_{d}"] - extent[f"lo_{d}"]) for d in dims}
    slack, share, tree = SLACK * extent["bytes"] / leaves, {1: leaves}, {}
    for _ in range(depth):
        here = placed(rows, tree, dims)
        nodes = {r["node"]: r for r in here.groupBy("node").agg(
            F.sum("size").alias("bytes"), *[f(d).alias(f"{k}_{d}") for d in dims
                                            for k, f in (("lo", F.min), ("hi", F.max))]).collect()
                 if share.get(r["node"], 0) > 1}
        pick = {n: max(dims, key=lambda d, r=r: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / wide[d], d)) for n, r in nodes.items()}
        goal = {n: r["bytes"] * (share[n] // 2) / share[n] for n, r in nodes.items()}
        by_dim = F.coalesce(*[F.when(F.col("node").isin([n for n in pick if pick[n] == d]), F.col(d)) for d in dims])
        now = here.withColumn("value", by_dim).filter("value is not null").select(
            "node", "value", "text_hash", "row_hash", "size")
        at = _cuts(now, "value", {n: (nodes[n][f"lo_{pick[n]}"], nodes[n][f"hi_{pick[n]}"], goal[n]) for n in nodes})
        inside = lambda frame, col, keys: frame.join(F.broadcast(frame.sparkSession.createDataFrame(
            [(n, k) for n, k in keys.items()], "m int, k long")), (F.col("node") == F.col("m")) & (F.col(col) == F.col("k"))).drop("m", "k")
        same = inside(now, "value", {n: v for n, (v, _, _) in at.items()})
        at_text = _cuts(same, "text_hash", {n: (0, HASH_MAX, goal[n] - b) for n, (_, b, _) in at.items()})
        deep = {}
        for n, (v, b, _) in at.items():
            t, tb, tw = at_text[n]
            left = goal[n] - b - tb                        # bytes of the group that belong left
            if min(left, tw - left) <= slack:
                deep[n] = Split(n, pick[n], v, t if left * 2 < tw else t + 1, 0)
        cut = {n: at_text[n][0] for n in at if n not in deep}
        if cut:
            one = inside(same, "text_hash", cut)
            rows_at = _cuts(one, "row_hash", {n: (0, HASH_MAX, goal[n] - at[n][1] - at_text[n][1]) for n in cut})
            for n, (h, b, w) in rows_at.items():
                left = goal[n] - at[n][1] - at_text[n][1] - b
                deep[n] = Split(n, pick[n], at[n][0], cut[n], h if left * 2 < w else h + 1)
        for n, s in deep.items():
            tree[n] = s
            share[2 * n], share[2 * n + 1] = share[n] // 2, share[n] - share[n] // 2
    return tree


def shard_of(rows: DataFrame, tree: dict, dims) -> DataFrame:
    """``rows`` with shard: the leaves counted from the left."""
    leaves = {2 * n + side for n in tree for side in (0, 1)} - set(tree) or {1}
    deepest = max(n.bit_length() for n in leaves)
    order = sorted(leaves, key=lambda n: n << (deepest - n.bit_length()))
    table = rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(order)], "leaf int, shard int")
    return placed(rows, tree, dims).join(F.broadcast(table), F.col("node") == F.col("leaf")).drop("leaf", "node")


def numbered(rows: DataFrame, shard: str = "shard", groups: int | None = None) -> DataFrame:
    """``rows`` with slot: 0, 1, ... in each shard, by (row_hash, doc_id, ...).

    Ranks are taken inside hash ranges of a shard and shifted by the sizes
    of the ranges before, so no shard is sorted in one task."""
    if groups is None:
        groups = max(1, rows.count() // SLOT_GROUP)
    width = -(-HASH_MAX // groups)
    ranged = rows.withColumn("range", F.expr(f"row_hash div {width}L"))
    sizes = ranged.groupBy(shard, "range").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(shard).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(shard, "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("shift"))
    rank = F.row_number().over(Window.partitionBy(shard, "range").orderBy("row_hash", "doc_id", "text_crc32"))
    return (ranged.withColumn("rank", rank).join(shift, [shard, "range"])
            .withColumn("slot", (F.col("shift") + F.col("rank") - 1).cast("long")).drop("range", "rank", "shift"))


def kd_shards(docs: DataFrame, shards: int = 16, target_bytes: int | None = None, dims=DIMENSIONS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    ``target_bytes`` sets the number of leaves from the total instead."""
    rows = apart(cut_lineage(measured(docs, id_col, text_col), "shard-sizes"), "row_hash").drop("at")
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    return numbered(shard_of(rows, build_tree(rows, shards, dims), dims)).select("doc_id", "size", "text_crc32", "shard", "slot")
