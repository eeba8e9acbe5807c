"""Leakage-safe feature preparation: fit on train, apply to any frame.

F2 median imputation, F3 mode imputation, F4/F6 one-hot with the first
sorted category dropped, F5 standard scaling (population std), F8 the
fitted parameters as tables, J2 parameters attached as scalar subqueries.

Fitting runs two aggregate jobs, as scaling needs the imputed values:
(1) medians + modes + vocabulary, (2) mean/std.  Applying is one lazy
projection; fitted values travel as scalar-subquery literals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import bucketed_rank, exact_quantiles, sorted_ranges
from tidemark.session import cut_lineage

# sklearn treats a scale below ten machine epsilons as zero and divides by 1.
_ZERO_SCALE = 10 * 2.220446049250313e-16
# Up to this many categories in total the vocabulary is kept in the model and
# encoded as one int column per category; a wider one stays a table
# (``FeatureModel.wide_vocabulary``) and is encoded as sparse vectors.
MAX_DUMMIES = 10_000


def dummy_name(col: str, value: str) -> str:
    """``col_value`` with characters Parquet rejects in names replaced by ``_``."""
    return f"{col}_{re.sub(r'[^0-9A-Za-z]+', '_', str(value)).strip('_')}"


def unpivot_long(df: DataFrame, cols, value_type: str) -> DataFrame:
    """Wide -> (column_name, value) with a common value type."""
    casted = df.select(*[F.col(c).cast(value_type).alias(c) for c in cols])
    return casted.unpivot([], list(cols), "column_name", "value")


def fit_medians(train: DataFrame, cols, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """F2 fit: median per column in long form (column_name, median).

    ``exact=True`` gives the interpolated median of ``percentile`` without
    holding a column's values in one buffer (see ``ordered.exact_quantiles``);
    ``exact=False`` uses ``percentile_approx``.
    """
    long = unpivot_long(train, cols, "double")
    if exact:
        return exact_quantiles(long, ["column_name"], "value", 0.5, n_groups=len(list(cols))) \
            .withColumnRenamed("value", "median")
    return long.groupBy("column_name").agg(F.percentile_approx("value", 0.5, accuracy).alias("median"))


def fit_modes(train: DataFrame, cols) -> DataFrame:
    """F3 fit: most frequent non-null value per column; ties -> smallest value.

    Counts per (column, value) are combined map-side; the winner per
    column is a ``min_by`` over (-count, value).
    """
    long = unpivot_long(train, cols, "string").where(F.col("value").isNotNull())
    vc = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_c"))
    return vc.groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("_c")).alias("a"), F.col("value").alias("b"))).alias("mode"))


def fit_vocabulary(train: DataFrame, cols) -> DataFrame:
    """sorted distinct values per column (long form, with 0-based position).

    Any number of values: positions come from ranks inside sampled ranges of a
    column's values plus the sizes of the ranges before, so no column is
    ordered in one task, also where all values begin alike.
    """
    distinct = unpivot_long(train, cols, "string").where(F.col("value").isNotNull()).distinct()
    long = sorted_ranges(distinct, ["column_name", "value"])
    return bucketed_rank(long, ["column_name"], "_b", ["value"], "_r").select(
        "column_name", "value", (F.col("_r") - 1).cast("int").alias("position"))


@dataclass
class FeatureModel:
    """Fitted parameters: a few scalars per column, held on the driver and
    applied as literals (constant-folded by Catalyst), like a Spark ML model."""
    numeric: list
    categorical: list
    scale: list
    medians: dict                 # column -> median
    modes: dict                   # column -> most frequent value
    vocabulary: dict              # column -> sorted list of categories
    scaler: dict                  # column -> (mean, population std)
    drop_first: bool = True
    dummy_columns: list = field(default_factory=list)
    wide_vocabulary: DataFrame | None = None      # (column_name, value, position) above MAX_DUMMIES

    # ---- apply ------------------------------------------------------------
    def impute(self, df: DataFrame) -> DataFrame:
        """F2/F3 apply (P16): only NULL is filled -- a supplied 0 stays 0."""
        out = []
        for c in df.columns:
            if c in self.medians and self.medians[c] is not None:
                out.append(F.coalesce(F.col(c), F.lit(float(self.medians[c]))).alias(c))
            elif c in self.modes and self.modes[c] is not None:
                out.append(F.coalesce(F.col(c), F.lit(self.modes[c]).cast(df.schema[c].dataType)).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)

    def encode(self, df: DataFrame) -> DataFrame:
        """F4 apply + P8: int dummies from the fitted vocabulary; unseen -> all zeros.
        A wide vocabulary gives one sparse vector per column instead."""
        if self.wide_vocabulary is not None:
            return encode_sparse(df, self.wide_vocabulary, self.categorical, self.drop_first)
        keep = [F.col(c) for c in df.columns if c not in self.categorical]
        dummies = []
        for c in self.categorical:
            vocab = self.vocabulary.get(c, [])
            for v in (vocab[1:] if self.drop_first else vocab):
                dummies.append(F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
                               .alias(dummy_name(c, v)))
        return df.select(*keep, *dummies)

    def scale_frame(self, df: DataFrame) -> DataFrame:
        """F5 apply: ``(x - mean) / std`` with zero std -> divide by 1."""
        cols = []
        for c in df.columns:
            if c in self.scaler:
                mean, std = self.scaler[c]
                std = 1.0 if std is None or std < _ZERO_SCALE else float(std)
                cols.append(((F.col(c) - F.lit(float(mean))) / F.lit(std)).alias(c))
            else:
                cols.append(F.col(c))
        return df.select(*cols)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scale_frame(self.encode(self.impute(df)))

    # ---- fitted parameters as tables (F8 / S5) ----------------------------
    def params_frame(self, spark) -> DataFrame:
        """One row: ``train_medians map<string,double>``, ``train_modes map<string,string>``,
        ``vocabulary map<string,array<string>>`` -- the scorer's defaults file."""
        from pyspark.sql import types as T
        schema = T.StructType([
            T.StructField("train_medians", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("train_modes", T.MapType(T.StringType(), T.StringType())),
            T.StructField("vocabulary", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
            T.StructField("scaler", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])
        row = ({k: (None if v is None else float(v)) for k, v in self.medians.items()},
               {k: (None if v is None else str(v)) for k, v in self.modes.items()},
               {k: list(v) for k, v in self.vocabulary.items()},
               {k: [float(a) if a is not None else None for a in v] for k, v in self.scaler.items()})
        return spark.createDataFrame([row], schema)

    @classmethod
    def from_params(cls, row, numeric, categorical, drop_first: bool = True) -> "FeatureModel":
        """Rebuild a model from a ``params_frame`` row (read back with S5)."""
        vocab = {k: list(v) for k, v in (row["vocabulary"] or {}).items()}
        scaler = {k: tuple(v) for k, v in (row["scaler"] or {}).items()}
        m = cls(list(numeric), list(categorical), list(scaler), dict(row["train_medians"] or {}),
                dict(row["train_modes"] or {}), vocab, scaler, drop_first)
        m.dummy_columns = [dummy_name(c, v) for c in categorical for v in (vocab[c][1:] if drop_first else vocab[c])]
        return m


def fit(train: DataFrame, numeric, categorical, scale=None, drop_first: bool = True,
        exact_median: bool = True, max_dummies: int = MAX_DUMMIES) -> FeatureModel:
    """Fit F2-F6 on ``train``.

    Job 1: medians, modes and vocabulary (aggregates, one row per column or
    category).  Job 2: mean / population std of the imputed scale columns.
    Only these aggregates reach the driver; their size is the schema width
    plus the vocabulary, which is collected only up to ``max_dummies``
    categories.  Above, modes come from their own aggregate and the
    vocabulary is a written table.
    """
    numeric, categorical = list(numeric), list(categorical)
    scale = list(numeric if scale is None else scale)
    medians = ({r["column_name"]: r["median"] for r in fit_medians(train, numeric, exact_median).collect()}
               if numeric else {})
    # modes and vocabulary from one aggregate: counts per (column, value),
    # brought to the driver only when within the dense-layout bound
    modes: dict = {}
    vocab: dict = {c: [] for c in categorical}
    wide = None
    if categorical:
        vc = (unpivot_long(train, categorical, "string").where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
        rows = vc.limit(max_dummies + 1).collect()
        if len(rows) > max_dummies:
            wide = cut_lineage(fit_vocabulary(train, categorical), "vocabulary")
            modes = dict.fromkeys(categorical) | {r["column_name"]: r["mode"] for r in fit_modes(train, categorical).collect()}
            rows = []
        for r in sorted(rows, key=lambda r: (r["column_name"], r["value"])):
            vocab[r["column_name"]].append(r["value"])
        for c in categorical if wide is None else []:
            counts = [(-r["n"], r["value"]) for r in rows if r["column_name"] == c]
            modes[c] = min(counts)[1] if counts else None
    model = FeatureModel(numeric, categorical, scale, medians, modes, vocab, {}, drop_first, wide_vocabulary=wide)
    if scale:
        imputed = model.impute(train.select(*scale))
        aggs = []
        for c in scale:
            aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
        r = imputed.agg(*aggs).first()
        model.scaler = {c: (r[f"mean_{c}"], r[f"std_{c}"]) for c in scale}
    model.dummy_columns = [dummy_name(c, v) for c in categorical
                           for v in (vocab[c][1:] if drop_first else vocab[c])]
    return model


def _one_hot(position: Column, size: Column) -> Column:
    """Sparse 0/1 vector of ``size`` entries with a one at ``position``, none where that is null."""
    return F.when(position.isNull(), F.struct(size.alias("size"), F.array().cast("array<int>").alias("ones"))) \
        .otherwise(F.struct(size.alias("size"), F.array(position).alias("ones")))


def encode_sparse(df: DataFrame, vocabulary: DataFrame, cols, drop_first: bool = True) -> DataFrame:
    """F4 at any width: column ``c`` becomes ``c_vec``, a struct (size, ones).

    ``vocabulary`` is a table (column_name, value, position) as written by
    ``fit_vocabulary``; it is joined, never collected, so its size is not
    limited.  Like the dense layout it drops each column's first sorted
    category; NULL and unseen categories encode as no ones.
    """
    first = 1 if drop_first else 0
    sizes = {r["column_name"]: r["n"] for r in                 # one row per column
             vocabulary.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for c in cols:
        own = vocabulary.where(F.col("column_name") == c).select(
            F.col("value").alias("_value"), (F.col("position") - first).alias("_position"))
        at = F.when(F.col("_position") >= 0, F.col("_position").cast("int"))
        size = F.lit(max(0, sizes.get(c, 0) - first))
        out = (out.join(own, F.col(c).cast("string") == F.col("_value"), "left")
               .withColumn(f"{c}_vec", _one_hot(at, size)).drop(c, "_value", "_position"))
    return out
