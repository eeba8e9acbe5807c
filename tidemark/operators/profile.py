"""Profiling aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.clean import missing_shares


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """A1: NULL count per column in long form (one scan)."""
    return missing_shares(df, cols).select("column_name", "null_count")


def total_nulls(df: DataFrame, cols=None) -> DataFrame:
    """A1: NULL count summed over all columns."""
    return null_counts(df, cols).agg(F.sum("null_count").cast("long").alias("total_nulls"))


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """A2: rows per key value, sorted by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(key)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """A3/A4: count and share per class.  The share window runs over the
    aggregated per-class rows, not over data rows."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    return c.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def key_range(df: DataFrame, col: str) -> DataFrame:
    """A5: min and max of a column."""
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def dtype_histogram(df: DataFrame) -> dict:
    """Columns per type (schema only)."""
    out: dict[str, int] = {}
    for f in df.schema.fields:
        out[f.dataType.simpleString()] = out.get(f.dataType.simpleString(), 0) + 1
    return out


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """Groups of identical rows that occur more than once."""
    cols = list(cols or df.columns)
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_copies"))
            .where(F.col("n_copies") > 1))


def column_profile(df: DataFrame, numeric_cols, exact_distinct: bool = True) -> DataFrame:
    """Per numeric column count, nulls, distinct, min, max, mean, std (sample).

    One aggregate over the table, unpivoted into one row per column.
    ``exact_distinct=False`` uses HyperLogLog++ for very wide or very large tables.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(numeric_cols):
        x = F.col(c).cast("double")
        dist = F.countDistinct(x) if exact_distinct else F.approx_count_distinct(x)
        aggs += [F.count(x).alias(f"n{i}"), dist.alias(f"d{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.col(f"n{i}").cast("long").alias("n_values"),
                        (F.col("_rows") - F.col(f"n{i}")).cast("long").alias("n_nulls"),
                        F.col(f"d{i}").cast("long").alias("n_distinct"),
                        F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"),
                        F.col(f"m{i}").alias("mean_value"), F.col(f"s{i}").alias("std_value"))
               for i, c in enumerate(numeric_cols)]
    return row.select(F.explode(F.array(*structs)).alias("p")).select("p.*")


def column_sketches(df: DataFrame, numeric, categorical=(), by=(), kll_k: int = 400, hll_bits: int = 12) -> DataFrame:
    """A14, mergeable: one row per (``by``..., column) with counts, range, moments, a
    HyperLogLog sketch of the distinct values and, for numbers, a KLL sketch of the quantiles.

    One aggregate over the table, combined before the shuffle; a row is a few kilobytes
    whatever the number of rows behind it.  Keep the table, e.g. per year or per batch, and
    ``merge_sketches`` gives the profile of any union of them without reading rows again.
    NaN counts as a missing value of a numeric column.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    cells = []
    for i, c in enumerate([*numeric, *categorical]):
        num = i < len(numeric)
        x = F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) if num else F.col(c).cast("string")
        none = F.lit(None).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.hll_sketch_agg(x.cast("string"), F.lit(hll_bits)).alias(f"h{i}")]
        if num:
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"),
                     F.kll_sketch_agg_double(x, F.lit(kll_k)).alias(f"k{i}")]
        cells.append(F.struct(
            F.lit(c).alias("column_name"), F.col("_rows").alias("n_rows"), F.col(f"n{i}").alias("n_values"),
            *[(F.col(f"{a}{i}") if num else none).alias(name)
              for a, name in (("lo", "min_value"), ("hi", "max_value"), ("m", "mean_value"))],
            (F.col(f"v{i}") * F.col(f"n{i}") if num else none).alias("square_sum"), F.col(f"h{i}").alias("distinct_sketch"),
            (F.col(f"k{i}") if num else F.lit(None).cast("binary")).alias("quantile_sketch")))
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return wide.select(*by, F.inline(F.array(*cells)))


def merge_sketches(sketches: DataFrame, by=()) -> DataFrame:
    """The sketches of unions: one row per (``by``..., column).  Deviations are added about
    the common mean (no difference of large squares)."""
    keys = [*by, "column_name"]
    group = Window.partitionBy(*keys)
    n, mean = F.col("n_values"), F.col("mean_value")
    common = F.sum(n * mean).over(group) / F.sum(F.when(mean.isNotNull(), n)).over(group)
    return sketches.withColumn("_mean", common).groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum(n).alias("n_values"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), F.max("_mean").alias("mean_value"),
        F.sum(F.col("square_sum") + n * (mean - F.col("_mean")) * (mean - F.col("_mean"))).alias("square_sum"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double(F.when(n > 0, F.col("quantile_sketch"))).alias("quantile_sketch"))


def profile_of_sketches(sketches: DataFrame, probabilities=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A14 from sketches: counts, range, mean and sample deviation are exact, ``n_distinct`` and
    ``quantiles`` are estimates (about 1.6 % relative and 0.7 % of rank at the default sizes)."""
    n = F.col("n_values")
    quantiles = F.when((n > 0) & F.col("mean_value").isNotNull(),
                       F.array(*[F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(p))) for p in probabilities]))
    keys = [c for c in sketches.columns if c not in ("n_rows", "n_values", "min_value", "max_value", "mean_value", "square_sum",
                                                     "distinct_sketch", "quantile_sketch")]
    return sketches.select(
        *keys, n.cast("long").alias("n_values"), (F.col("n_rows") - n).cast("long").alias("n_nulls"),
        F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), "min_value", "max_value", "mean_value",
        F.when(n > 1, F.sqrt(F.col("square_sum") / (n - 1))).alias("std_value"), quantiles.alias("quantiles"))


def top_values(df: DataFrame, cols, k: int = 5, by=()) -> DataFrame:
    """The ``k`` most frequent values of every column, ties to the smaller value (exact; counts are
    combined before the shuffle and only ``k`` rows a task and column reach the ranking)."""
    keys = [*by, "column_name"]
    long = df.select(*by, *[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot(list(by), list(cols), "column_name", "value").where(F.col("value").isNotNull())
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n_rows"))
    order = Window.partitionBy(*keys).orderBy(F.col("n_rows").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
