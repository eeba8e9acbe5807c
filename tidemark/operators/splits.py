"""Dataset splits: exact stratified train/test (F1), cumulative-by-year
training sets (W1, A13, P10, S3) and the next split (W2).

Cumulative splits are *views* (``year BETWEEN start AND end``) over one
table; rows are never copied per split.  Split summaries come from one
per-year aggregate plus a running sum over the (few) year rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import split_name, split_dir_name
from tidemark.operators.ordered import flag_first


def seeded_hash(seed: int, key_cols) -> F.Column:
    """md5 of ``seed|k1|k2|...`` -- a seeded, engine-independent row order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols]))


def class_quotas(df: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """Per-class train/test sizes of an exact stratified split.

    ``n_test = ceil(test_size * n)``; the train size of each class is the
    floor of its proportional share plus one for the classes with the
    largest remainders (ties: smaller class value first).  The test size
    of a class is the rest of the class.  All windows run over the
    one-row-per-class table.
    """
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    all_w = Window.partitionBy()
    c = c.withColumn("_n", F.sum("n_class").over(all_w))
    c = c.withColumn("_n_train", F.col("_n") - F.ceil(F.lit(float(test_size)) * F.col("_n").cast("double")).cast("long"))
    cont = (F.col("n_class") * F.col("_n_train")).cast("double") / F.col("_n").cast("double")
    c = c.withColumn("_fl", F.floor(cont).cast("long")).withColumn("_rem", cont - F.floor(cont))
    c = c.withColumn("_need", F.col("_n_train") - F.sum("_fl").over(all_w))
    c = c.withColumn("_rk", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(label))))
    c = c.withColumn("train_quota", (F.col("_fl") + (F.col("_rk") <= F.col("_need")).cast("long")).cast("long"))
    return c.select(label, "n_class", "train_quota",
                    (F.col("n_class") - F.col("train_quota")).cast("long").alias("test_quota"))


def stratified_split(df: DataFrame, label: str, key_cols, test_size: float = 0.2, seed: int = 42,
                     flag_col: str = "is_test") -> DataFrame:
    """exact-size stratified split, deterministic under repartitioning.

    Rows are ordered inside each class by ``md5(seed|key)``; the first
    ``test_quota`` rows of a class are the test rows.  The cut of each class is
    found by nested hash-prefix histograms (``flag_first``), so rows are flagged
    where they are.  ``key_cols`` must identify a row (rows that share a key
    are equal for this purpose)."""
    quotas = [(r[label], r["test_quota"]) for r in class_quotas(df, label, test_size).collect()     # one row per class
              if r[label] is not None]
    return flag_first(df, seeded_hash(seed, list(key_cols)), [label], quotas, flag_col)


def year_label_counts(df: DataFrame, year_col: str, label: str, positive=1) -> DataFrame:
    """A2/A3 per year: rows and positives, one row per year."""
    return df.groupBy(year_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label) == F.lit(positive)).alias("n_pos"))


def cumulative_split_summary(train: DataFrame, n_test, year_col: str, label: str,
                             start_year: int, end_year: int, positive=1) -> DataFrame:
    """W1 + A13: one summary row per cumulative split ``[first year, year_i]``.

    ``train`` is filtered to the closed year range (P10, pushed into the
    scan when the year is a partition or stats column).  The running
    totals are a window over the per-year rows, i.e. over as many rows as
    there are years.  ``n_test`` is a Column/number: the fixed test size.
    """
    return summary_of_year_counts(
        year_label_counts(train.where(F.col(year_col).between(start_year, end_year)), year_col, label, positive),
        n_test, year_col)


def summary_of_year_counts(yc: DataFrame, n_test, year_col: str) -> DataFrame:
    """``cumulative_split_summary`` from the rows and positives of each year (one row per year)."""
    w = Window.orderBy(year_col).rowsBetween(Window.unboundedPreceding, 0)
    s = (yc.withColumn("split_id", F.row_number().over(Window.orderBy(year_col)).cast("int"))
           .withColumn("start_year", F.min(year_col).over(Window.partitionBy()).cast("int"))
           .withColumn("end_year", F.col(year_col).cast("int"))
           .withColumn("train_samples", F.sum("n_rows").over(w).cast("long"))
           .withColumn("_pos", F.sum("n_pos").over(w)))
    n_test_col = n_test if isinstance(n_test, F.Column) else F.lit(n_test)
    return s.select(
        "split_id",
        split_name(F.col("start_year"), F.col("end_year")).alias("years"),
        split_dir_name(F.col("split_id"), F.col("start_year"), F.col("end_year")).alias("split_name"),
        "start_year", "end_year", "train_samples",
        n_test_col.cast("long").alias("test_samples"),
        F.round((F.col("train_samples") - F.col("_pos")) / F.col("train_samples"), 6).alias("share_negative"),
        F.round(F.col("_pos") / F.col("train_samples"), 6).alias("share_positive"))


def split_rows(df: DataFrame, catalog: DataFrame, split_id: int, year_col: str) -> DataFrame:
    """S3: the training rows of one split, as a year-range filter.

    The bounds are read from the catalog (one row) and applied as literal
    predicates, so Parquet row-group stats / partition pruning apply.
    """
    r = catalog.where(F.col("split_id") == split_id).select("start_year", "end_year").first()
    if r is None:
        raise ValueError(f"split {split_id} not found")
    return df.where(F.col(year_col).between(r["start_year"], r["end_year"]))


def next_split(catalog: DataFrame, years: DataFrame, year_col: str) -> DataFrame:
    """The split after the latest one in ``catalog``.

    ``years`` holds the available years (one row each).  Returns one row:
    ``status`` is ``created`` (with the new split's id and years), or
    ``complete`` when no later year exists, or ``missing_year`` when the
    catalog's last end year is not among the available years.
    """
    yrs = years.select(F.col(year_col).cast("int").alias("y")).distinct()
    last = catalog.agg(F.max("split_id").alias("last_id"), F.max("end_year").alias("last_end"))
    last_id, last_end = last.select("last_id").scalar(), last.select("last_end").scalar()
    r = yrs.agg(
        F.min("y").alias("first_year"),
        F.min(F.when(last_end.isNull() | (F.col("y") > last_end), F.col("y"))).alias("next_year"),
        F.max((F.col("y") == last_end).cast("int")).alias("known"))
    r = r.withColumn("last_id", last_id).withColumn("last_end", last_end)
    sid = (F.coalesce(F.col("last_id"), F.lit(0)) + 1).cast("int")
    status = (F.when(F.col("last_end").isNotNull() & (F.coalesce(F.col("known"), F.lit(0)) == 0), "missing_year")
              .when(F.col("next_year").isNull(), "complete").otherwise("created"))
    return r.select(
        status.alias("status"),
        F.when(status == "created", sid).alias("split_id"),
        F.when(status == "created", F.col("first_year")).cast("int").alias("start_year"),
        F.when(status == "created", F.col("next_year")).cast("int").alias("end_year"),
        F.when(status == "created", split_name(F.col("first_year"), F.col("next_year"))).alias("years"))


def positional_cut(df: DataFrame, key_cols, share: float = 0.8, seed: int = 42,
                   flag_col: str = "first_part") -> DataFrame:
    """The first ``floor(share * n)`` rows in a seeded order vs the rest.

    The row order is an explicit parameter (seeded hash of the key), and the
    cut is exact."""
    first = int(float(df.count()) * float(share))
    return flag_first(df, seeded_hash(seed, list(key_cols)), [], [(first,)], flag_col)
