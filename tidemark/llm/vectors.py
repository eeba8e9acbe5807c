"""Usable vectors of an embedding table, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, only


def usable_vectors(table: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id long, vec array<double>), written: the rows that take part.

    Left out: null ids; vectors that are null, empty or hold a null or
    non-finite component; zero vectors unless ``zero``; vectors whose length
    is not the table's most frequent one (the smaller of equals).  Rows that
    repeat an id count once, with the smallest of their vectors.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = (only(table, id=id_col, vec=vec_col)
            .select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
            .filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
            .filter((F.size("vec") > 0) & F.forall("vec", finite)))
    if not zero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    rows = cut_lineage(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows if size is None else rows.filter(F.size("vec") == size["n"])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def block(id_col: str, blocks: Column | int, salt: int) -> Column:
    """Block number of a row in 0..blocks-1, by a hash of its id."""
    blocks = blocks if isinstance(blocks, Column) else F.lit(blocks)
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), blocks.cast("long")).cast("int")


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, components added in order
    (so equal vectors always get equal scores)."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out
