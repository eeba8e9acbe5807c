"""Row/column cleaning and schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import season_of_date, yes_no_flag

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType,
                 T.ByteType, T.DecimalType)


def drop_null_rows(df: DataFrame, subset) -> DataFrame:
    """Drop rows with a NULL in any of ``subset``."""
    return df.na.drop("any", subset=list(subset))


def missing_shares(df: DataFrame, cols=None) -> DataFrame:
    """P3/A1 input: one aggregate -> long form (column_name, null_count, null_share)."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = row.unpivot(["_n"], cols, "column_name", "null_count")
    return long.select("column_name", F.col("null_count").cast("long").alias("null_count"),
                       (F.col("null_count") / F.col("_n")).alias("null_share"))


def columns_over_missing(df: DataFrame, threshold: float = 0.30, cols=None) -> list[str]:
    """Names of columns whose NULL share exceeds ``threshold``.

    One aggregate job; the result is one row per column, so bringing the
    column names to the driver is bounded by the schema width.
    """
    shares = missing_shares(df, cols)
    return [r["column_name"] for r in shares.where(F.col("null_share") > threshold).collect()]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.30, cols=None) -> DataFrame:
    """P2+P3: drop the columns above the missing-share limit."""
    return df.drop(*columns_over_missing(df, threshold, cols))


def add_calendar(df: DataFrame, date_col: str, year_col: str = "year",
                 season_col: str = "season", drop_date: bool = True) -> DataFrame:
    """Year and season from a date; the date itself is dropped (as the reference does)."""
    d = F.col(date_col).cast("date")
    out = df.withColumn(year_col, F.year(d).cast("int")).withColumn(season_col, season_of_date(d))
    return out.drop(date_col) if drop_date else out


def encode_yes_no(df: DataFrame, cols) -> DataFrame:
    """Yes/No text columns -> 1/0 ints (other values -> NULL)."""
    for c in cols:
        df = df.withColumn(c, yes_no_flag(F.col(c)))
    return df


def bools_to_int(df: DataFrame) -> DataFrame:
    """Cast every boolean column to int."""
    return df.select(*[F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType)
                       else F.col(f.name) for f in df.schema.fields])


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """64-bit numeric columns (int64/float64 in the reference's terms)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.LongType)) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    """Text, boolean and 32-bit integer columns count as categorical."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType, T.IntegerType)) and f.name not in exclude]


def align_to_schema(df: DataFrame, expected: list[str], fill=0) -> DataFrame:
    """Add missing expected columns as ``fill``, drop extras, reorder -- one projection."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in expected])


def schema_difference(left: DataFrame, right: DataFrame) -> dict:
    """Column-set comparison (schema only, no job)."""
    a, b = left.columns, right.columns
    return {"only_left": [c for c in a if c not in b], "only_right": [c for c in b if c not in a],
            "same_order": a == b}


def check_unscaled_key(df: DataFrame, col: str, min_max: float = 100.0) -> tuple:
    """P20: the key column exists and has not been scaled (max >= ``min_max``)."""
    if col not in df.columns:
        raise ValueError(f"column {col!r} not found")
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if r["hi"] is None or r["hi"] < min_max:
        raise ValueError(f"column {col!r} looks scaled: range {r['lo']}..{r['hi']}")
    return r["lo"], r["hi"]


def interim(df: DataFrame, label_col: str, date_col: str, require=(), drop=(),
            missing_limit: float | None = 0.30, yes_no=()) -> DataFrame:
    """Raw observations -> interim table (P1, P2/P3, P4-P7) as one lazy projection.

    ``missing_limit`` triggers one aggregate to decide which sparse columns
    to drop; pass ``None`` to skip it.
    """
    out = drop_null_rows(df, [label_col, *require])
    out = out.drop(*drop)
    if missing_limit is not None:
        out = drop_sparse_columns(out, missing_limit)
    out = add_calendar(out, date_col)
    return encode_yes_no(out, [label_col, *yes_no])


def join_labels(features: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """Features and labels that arrive as separate tables are aligned by an
    explicit row id, never by position."""
    return features.join(labels, on=row_id, how="inner")


def features_and_label(df: DataFrame, label: str) -> tuple[list, str]:
    """The feature columns (everything but the label) and the label."""
    return [c for c in df.columns if c != label], label
