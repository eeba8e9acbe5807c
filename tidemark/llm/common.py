"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import cut_lineage, scratch_path

__all__ = ["WHITE", "WORD", "read_table", "cut_lineage", "scratch_path", "text_or_empty", "only", "unused", "apart"]

#: Fixed values of the query contracts: ASCII white space, and a word.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader (any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    """The text, with a null read as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under the operator's own names.

    Projecting first keeps the scan narrow and makes clashes with extra
    columns of the caller's table impossible: ``only(df, id="doc_id")``.
    """
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until the frame has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(rows: DataFrame, column: str, at: str = "at") -> DataFrame:
    """``rows`` with a 62-bit hash column made different for rows that share it.

    Of m rows with one hash, the first keeps it and the others get the hash of
    (hash, 1), ..., (hash, m - 1): the same hashes in any order of the rows, so
    long as rows with one hash are equal in all that matters.  ``rows`` must be
    a written table and ``at`` its monotonically_increasing_id().  Rows are
    counted by (hash, writing task), so a hash held by a third of all rows is
    numbered by many tasks.  Without repeats nothing is shuffled but one count.
    """
    if rows.groupBy(column).count().filter("count > 1").isEmpty():
        return rows
    task, n, before, first = (unused(rows, c) for c in ("task", "n", "before", "first"))
    tasks = rows.withColumn(task, F.shiftright(at, 33))
    counts = tasks.groupBy(column, task).agg(F.count("*").alias(n))
    upto = Window.partitionBy(column).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(column, task, F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(column, task).orderBy(at))
    number = F.col(before) + F.col(first) - 1
    return cut_lineage(
        tasks.withColumn(first, place).join(counts, [column, task])
        .withColumn(column, F.when(number == 0, F.col(column)).otherwise(
            F.shiftrightunsigned(F.xxhash64(F.col(column), number), 2)))
        .select(*rows.columns), "apart")
