"""Access to the Parquet tables a job reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read ``{root}/{name}.parquet``.

    Reads are lazy: Catalyst prunes columns and pushes filters into the
    Parquet scan, so callers should select/filter rather than pre-trim.
    """
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
