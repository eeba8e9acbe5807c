"""Exact ranks, prefix sums and quantiles without an unpartitioned window.

An unpartitioned ``Window.orderBy`` moves every row into one task.  The
helpers here rank rows inside *(group, bucket)* partitions, where the
bucket is a coarse, order-preserving prefix of the sort key, and add the
row count of all earlier buckets taken from a small per-bucket count
table.  The result is the exact global rank, computed by many tasks.

Where a bucket is not given by a hash, it is a range between sampled split
points (``sorted_ranges``): the ranges hold similar numbers of rows whatever
the values look like (log-normal, one far outlier, a common prefix).

For quantiles the ranked rows are the *distinct values* with their
multiplicity, so a value held by a third of all rows is one row here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.joins import join_small
from tidemark.session import cut_lineage


def sorted_ranges(df: DataFrame, order_cols, bucket_col: str = "_b", ranges: int | None = None) -> DataFrame:
    """``df``, written, with ``bucket_col``: a row's range in the order of ``order_cols``.

    Spark samples the rows for the split points, so ranges hold similar numbers of rows (rows that agree in
    all order columns share one); ``ranges`` fixes their number, else it follows the shuffle settings."""
    cols = list(order_cols)
    dealt = df.repartitionByRange(*cols) if ranges is None else df.repartitionByRange(ranges, *cols)
    return cut_lineage(dealt.withColumn(bucket_col, F.spark_partition_id()), "ranges")


def bucket_offsets(df: DataFrame, group_cols, bucket_col: str, weight: str | None = None) -> DataFrame:
    """Per (group, bucket): row count (or summed weight) and the total of all earlier buckets."""
    wt = F.col(weight) if weight else F.lit(1)
    counts = df.groupBy(*group_cols, bucket_col).agg(F.sum(wt).cast("long").alias("_bn"))
    w = (Window.partitionBy(*group_cols).orderBy(bucket_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_offset", F.coalesce(F.sum("_bn").over(w), F.lit(0)).cast("long"))


def bucketed_rank(df: DataFrame, group_cols, bucket_col: str, order_cols,
                  rank_col: str = "_rank", n_groups: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number`` within ``group_cols`` ordered by ``(bucket_col, *order_cols)``.

    ``bucket_col`` must be monotone in the ordering (e.g. a prefix of a hash
    string that is itself the first order key).
    """
    group_cols = list(group_cols)
    offsets = bucket_offsets(df, group_cols, bucket_col).select(*group_cols, bucket_col, "_offset")
    wr = Window.partitionBy(*group_cols, bucket_col).orderBy(*order_cols)
    ranked = df.withColumn("_rn", F.row_number().over(wr))
    bound = None if n_groups is None or n_buckets is None else n_groups * n_buckets
    out = join_small(ranked, offsets, on=[*group_cols, bucket_col], bound=bound)
    return out.withColumn(rank_col, (F.col("_offset") + F.col("_rn")).cast("long")).drop("_offset", "_rn")


# Rows of a boundary bucket that are ordered by their whole hash.
BOUNDARY_ROWS = 200_000
HASH_DIGITS = 32


def hash_cuts(hashes: DataFrame, group_cols, quotas: list, digits: int = 4, boundary_rows: int = BOUNDARY_ROWS) -> list:
    """Per group the hash of its ``quota``-th row in hash order: [(*group, hash, taken, tied)].

    ``hashes`` holds the group columns and ``_h`` (hex); ``quotas`` is [(*group, quota)].  Nested histograms:
    rows are counted by group and hash prefix, the prefix in which the quota ends is split by ``digits`` more
    digits, and only when it holds few rows are these counted by their whole hash.  ``taken`` of the ``tied``
    rows with that hash are within the quota.  Groups with quota 0 (or no rows) are left out; a quota beyond
    the group's rows cuts at its last one."""
    g, spark = list(group_cols), hashes.sparkSession
    kinds = hashes.select(*g).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "_p string", "_left long"])
    open_ = [(*q[:-1], "", int(q[-1])) for q in quotas if q[-1] > 0]
    length, whole = digits, False
    while open_:
        edges = spark.createDataFrame(open_, schema)
        key = F.col("_h") if whole else F.substring("_h", 1, length)
        hist = (join_small(hashes, edges, on=g, bound=len(open_)).where(F.startswith("_h", "_p"))
                .groupBy(*g, key.alias("_b"), "_p", "_left").agg(F.count(F.lit(1)).alias("_n")))
        upto = F.sum("_n").over(Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        last = F.lead("_b").over(Window.partitionBy(*g).orderBy("_b")).isNull()
        hits = (hist.withColumn("_u", upto).withColumn("_last", last)
                .where((F.col("_u") - F.col("_n") < F.col("_left")) & ((F.col("_u") >= F.col("_left")) | F.col("_last")))
                .collect())                                    # one row per group
        rows = [(*[r[c] for c in g], r["_b"], min(r["_left"] - (r["_u"] - r["_n"]), r["_n"]), r["_n"]) for r in hits]
        if whole:
            return rows
        open_ = [r[:-1] for r in rows]
        whole = max([r[-1] for r in rows], default=0) <= boundary_rows or length + digits >= HASH_DIGITS
        length += digits
    return []


def flag_first(df: DataFrame, h: Column, group_cols, quotas: list, flag_col: str) -> DataFrame:
    """``df`` with ``flag_col``: whether a row is among the first ``quota`` of its group in the order of ``h``.

    ``h`` is a hex hash of the row's key.  The cut is found on (group, hash) alone (``hash_cuts``: two or three
    passes over those columns, in which hashes are made anew and only their counts are shuffled) and the rows
    are then only compared with it: full-width rows are neither shuffled nor sorted, and nothing is written.  So
    ``df`` should be cheap to read: a table or a written step.  Only rows whose hash is the cut itself, and only
    if they repeat, are numbered.  A row whose group has no quota is dropped."""
    g = list(group_cols) or ["_g"]
    rows = df.withColumn("_h", h) if group_cols else df.withColumn("_h", h).withColumn("_g", F.lit(0))
    quotas = quotas if group_cols else [(0, *q) for q in quotas]
    cuts = hash_cuts(rows.select(*g, "_h"), g, quotas)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*g).schema.fields)
    at = {r[:-3]: r[-3:] for r in cuts}
    table = df.sparkSession.createDataFrame([(*q[:-1], *at.get(tuple(q[:-1]), ("", 0, 0))) for q in quotas],
                                            f"{kinds}, _cut string, _taken long, _tied long")
    rows = join_small(rows, table, on=g, bound=len(quotas))
    within = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (F.col("_taken") == F.col("_tied")))
    names = [*df.columns, flag_col]
    if all(taken == tied for *_, taken, tied in cuts):
        return rows.withColumn(flag_col, within).select(*names)
    shared = (F.col("_h") == F.col("_cut")) & (F.col("_taken") < F.col("_tied"))
    tied = cut_lineage(rows.where(shared).withColumn("_at", F.monotonically_increasing_id()), "ties")
    numbered = bucketed_rank(tied.withColumn("_task", F.shiftright("_at", 33)), g, "_task", ["_at"], "_r")
    return (rows.where(~shared).withColumn(flag_col, within).select(*names)
            .unionByName(numbered.withColumn(flag_col, F.col("_r") <= F.col("_taken")).select(*names)))


def cut_parts(df: DataFrame, h: Column, group_cols, cuts: list, part_col: str) -> DataFrame:
    """``df`` with ``part_col``: the number of its group's cuts that lie before a row in the order of ``h``.

    ``cuts`` is [(*group, [rows before the first cut, before the second, ...])], the same number for each group.
    As ``flag_first``, but all cuts are found in the same passes, and a row's hash is made once in each."""
    g = list(group_cols)
    rows, at = df.withColumn("_h", h), range(len(cuts[0][-1]) if cuts else 0)
    each = rows.select(*g, "_h", F.explode(F.array(*[F.lit(j) for j in at]).cast("array<int>")).alias("_cut_no"))
    found = hash_cuts(each, [*g, "_cut_no"], [(*c[:-1], j, c[-1][j]) for c in cuts for j in at])
    where = {r[:-3]: r[-3:] for r in found}
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*g).schema.fields]
    schema = ", ".join(kinds + [f"_cut_{j} string, _taken_{j} long, _tied_{j} long" for j in at])
    table = df.sparkSession.createDataFrame(
        [(*c[:-1], *[x for j in at for x in where.get((*c[:-1], j), ("", 0, 0))]) for c in cuts], schema)
    rows = join_small(rows, table, on=g, bound=len(cuts))
    tie = [F.col("_h") == F.col(f"_cut_{j}") for j in at]
    shared = reduce(Column.__or__, [tie[j] & (F.col(f"_taken_{j}") < F.col(f"_tied_{j}")) for j in at], F.lit(False))

    def part(rank):
        passed = [~((F.col("_h") < F.col(f"_cut_{j}")) | (tie[j] & (rank <= F.col(f"_taken_{j}")))) for j in at]
        return reduce(Column.__add__, [x.cast("int") for x in passed], F.lit(0)).alias(part_col)

    if all(taken == tied for *_, taken, tied in found):
        return rows.select(*df.columns, part(F.lit(0)))
    tied = cut_lineage(rows.where(shared).withColumn("_at", F.monotonically_increasing_id()), "ties")
    numbered = bucketed_rank(tied.withColumn("_task", F.shiftright("_at", 33)), [*g, "_h"], "_task", ["_at"], "_r")
    return (rows.where(~shared).select(*df.columns, part(F.lit(0)))
            .unionByName(numbered.select(*df.columns, part(F.col("_r")))))


def value_counts(long: DataFrame, group_cols, value_col: str) -> DataFrame:
    """Distinct non-null values per group with their multiplicity ``_c`` (map-side combined)."""
    return (long.where(F.col(value_col).isNotNull())
            .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c")))


def exact_quantiles(long: DataFrame, group_cols, value_col: str, q: float = 0.5,
                    ranges: int | None = None, n_groups: int | None = None) -> DataFrame:
    """Exact interpolated quantile (``percentile``/``quantile_cont`` semantics) per group.

    Returns ``group_cols + [value_col]``.  Work: one aggregation to distinct
    values, a count per range of them, and a sort of only the one or two ranges
    that contain the target ranks.
    """
    g = list(group_cols)
    vc = sorted_ranges(value_counts(long, g, value_col), [*g, value_col], ranges=ranges)
    counts = bucket_offsets(vc, g, "_b", "_c")
    n = counts.groupBy(*g).agg(F.sum("_bn").cast("long").alias("_n"))
    pos = (F.col("_n") - 1).cast("double") * F.lit(float(q))
    n = n.select(*g, F.floor(pos).cast("long").alias("_r_lo"), F.ceil(pos).cast("long").alias("_r_hi"),
                 (pos - F.floor(pos)).alias("_frac"))
    inside = lambda r: (F.col(r) >= F.col("_offset")) & (F.col(r) < F.col("_offset") + F.col("_bn"))
    target = join_small(counts, n, on=g, bound=n_groups).where(inside("_r_lo") | inside("_r_hi"))
    sel = join_small(vc, target, on=[*g, "_b"], bound=None if n_groups is None else 2 * n_groups)
    upto = Window.partitionBy(*g, "_b").orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    sel = sel.withColumn("_end", F.col("_offset") + F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("_start")) & (F.col(r) < F.col("_end")), F.col(value_col)))
    res = sel.groupBy(*g).agg(at("_r_lo").alias("_v_lo"), at("_r_hi").alias("_v_hi"), F.first("_frac").alias("_frac"))
    return res.select(*g, (F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * F.col("_frac")).alias(value_col))


def ordered_prefix(df: DataFrame, group_cols, order_col: str, measures, ranges: int | None = None) -> DataFrame:
    """Inclusive running sums of ``measures`` and the next ``order_col`` value,
    per group in ``order_col`` order -- exact, without an unpartitioned window.

    ``df`` must hold one row per (group, order value), e.g. value counts.
    Adds ``cum_<m>`` for each measure and ``next_value`` (NULL on the last row).
    """
    g = list(group_cols)
    d = sorted_ranges(df, [*g, order_col], ranges=ranges)
    sums = d.groupBy(*g, "_b").agg(*[F.sum(m).alias(f"_bs_{m}") for m in measures], F.min(order_col).alias("_bmin"))
    by_range = Window.partitionBy(*g).orderBy("_b")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*g, "_b", *[F.coalesce(F.sum(f"_bs_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
                       F.lead("_bmin").over(by_range).alias("_next_bmin"))
    d = join_small(d, sums, on=[*g, "_b"])
    inside = Window.partitionBy(*g, "_b").orderBy(order_col)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    for m in measures:
        d = d.withColumn(f"cum_{m}", F.col(f"_off_{m}") + F.sum(m).over(upto))
    d = d.withColumn("next_value", F.coalesce(F.lead(order_col).over(inside), F.col("_next_bmin")))
    return d.drop("_b", "_next_bmin", *[f"_off_{m}" for m in measures])
