"""Embedding whitening with MLlib's BlockMatrix.

1. Every remaining vector becomes whole numbers x = floor(scale * c) + shift;
   the rows are written with dense row numbers.
2. One grouped pass gives the exact sums per dimension.
3. The rows are centred by the mean (n * x - S, exact, over n, then put in
   an IndexedRowMatrix and dealt into blocks of a BlockMatrix B.
4. transpose(B) times B, with the middle dimension cut into many splits, is
   the scatter; its eigh is local (dimensions squared, never rows).
5. B times the whitening matrix (leading eigenvectors over the roots of their
   eigenvalues, a one-block BlockMatrix) projects the rows; row numbers
   join them back to the ids.

BlockMatrix deals the blocks of a tall matrix to about the square root of
its partitions and keeps one such group in memory, and it indexes rows with
32 bits.  So the rows go through in slabs of ``SLAB_ROWS`` row numbers: a
task holds a bounded piece of one slab whatever the table's size.  Scatter
matrices of slabs add up; the projections of all slabs are one union.  A row
number range reads only its own part of the written table.

To the driver go dimension sums, one scatter matrix a slab and one count per
task of the numbering pass; to the tasks goes the whitening matrix.

Defined results: left out are vectors that are null, empty, or hold null or
non-finite entries, and vectors whose length is not the table's most
frequent one (the smaller of equals).  Zero vectors, null ids and repeated
rows remain, row by row.  x of entries beyond ``EDGE`` is that of EDGE.
``deviation`` beyond 64 bits is the largest long.  A component without
variance (eigenvalue below 1e-12 of the largest) has whitened null and stays
out of the identity error; its share explained is that eigenvalue's (0 for
a table without any variance).  An empty table gives no rows.  Extra columns
are never read.  Of an eigenvector's two signs the one with a positive
largest entry is taken.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, only

#: Fixed values of the query contract.
SCALE, SHIFT = 1024, 100_000
#: Entries count as at most this (either sign), so that sums of x stay whole.
EDGE = float(1 << 40)
BLOCK_ROWS = 1024
SLAB_ROWS = 1 << 20
LONG_MAX = (1 << 63) - 1


def whole_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x array<long>, row long), written: remaining rows under dense numbers 0, 1, ..."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    clip = lambda c: F.greatest(F.least(c, F.lit(EDGE)), F.lit(-EDGE))
    rows = (only(table, vec_id=id_col, vec=vec_col)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"))
            .filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite)))
    size = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if size is not None:
        rows = rows.filter(F.size("vec") == size["dims"])
    written = cut_lineage(rows.select(
        "vec_id", F.transform("vec", lambda c: F.floor(F.lit(scale) * clip(c)).cast("long") + F.lit(shift)).alias("x"),
        F.monotonically_increasing_id().alias("at")), "whiten-vectors")
    # the writing task's number is in the id's upper bits; one count per task reaches the driver
    task, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, n = [], 0
    for r in written.groupBy(task.alias("task")).agg((F.max(place) + 1).alias("n")).orderBy("task").collect():
        starts.append((r["task"], n))
        n += r["n"]
    table = written.sparkSession.createDataFrame(starts, "task long, start long")
    return (written.join(F.broadcast(table), task == F.col("task"))
            .select("vec_id", "x", (F.col("start") + place).alias("row")))


def dimension_sums(rows: DataFrame) -> tuple[int, list, int, int]:
    """(rows, exact sum of x per dimension, smallest x, largest x)."""
    # sums of the upper and lower halves cannot overflow; put together they are exact
    x = rows.select(F.posexplode("x").alias("d", "x"))
    low = F.col("x").bitwiseAND(F.lit((1 << 20) - 1))
    got = x.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.shiftright("x", 20)).alias("upper"), F.sum(low).alias("lower"),
                             F.min("x").alias("least"), F.max("x").alias("most")).orderBy("d").collect()
    if not got:
        return 0, [], 0, 0
    return (got[0]["n"], [(r["upper"] << 20) + r["lower"] for r in got],
            min(r["least"] for r in got), max(r["most"] for r in got))


def centred(n: int, sums: list, least: int, most: int) -> Column:
    """array of n * x - S: long where that cannot overflow, else decimal; exact either way."""
    if n * max(abs(least), abs(most)) < 1 << 62:
        s = F.array(*[F.lit(v) for v in sums])
        return F.zip_with("x", s, lambda x, v: x * F.lit(n) - v)
    s = F.array(*[F.lit(str(v)).cast("decimal(38,0)") for v in sums])
    return F.zip_with("x", s, lambda x, v: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)")).cast("decimal(38,0)") - v)


def squared_deviation(diff: Column, n: int, dims: int, least: int, most: int) -> Column:
    """Sum of the squares of ``diff`` as long (the largest long if it is beyond)."""
    if dims * (n * (most - least)) ** 2 <= LONG_MAX:
        return F.aggregate(diff, F.lit(0).cast("long"), lambda a, d: a + d * d)
    # a difference beyond the root of 2^63 alone passes the limit; the others' squares fit a decimal
    root = 3_037_000_500
    square = lambda d: F.when(F.abs(d) >= F.lit(root), F.lit(LONG_MAX).cast("decimal(38,0)")).otherwise(
        d.cast("long").cast("decimal(19,0)") * d.cast("long").cast("decimal(19,0)"))
    total = F.aggregate(diff, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + square(d)).cast("decimal(38,0)"))
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def block_matrix(rows: DataFrame, vec: str, n: int, dims: int, block_rows: int) -> BlockMatrix:
    """Rows (row long, ``vec`` array<double>) as distributed blocks, kept while they are used; stays in the JVM."""
    vectors = rows.select(F.col("row"), array_to_vector(vec).alias("vector"))
    blocks = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dims).toBlockMatrix(block_rows, dims)
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def release(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left times right with the middle dimension's blocks dealt into ``splits`` groups."""
    both = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(both, left._java_matrix_wrapper.call("rowsPerBlock"), right._java_matrix_wrapper.call("colsPerBlock"))


def block_rows_frame(matrix: BlockMatrix) -> DataFrame:
    """(row long, vec array<double>) of a BlockMatrix, without Python workers."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("vec"))


@dataclass
class Whitening:
    """Eigenvalues (falling), unit eigenvectors as columns, and each one's share of the trace."""
    values: np.ndarray
    vectors: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, cov: np.ndarray, components: int) -> "Whitening":
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        big = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
        trace = float(np.trace(cov))
        return cls(values, vectors * np.where(big < 0, -1.0, 1.0),
                   values / trace if trace > 0 else np.zeros(len(values)))

    def live(self) -> np.ndarray:
        return self.values > 1e-12 * max(float(self.values[0]), 0.0)

    def matrix(self) -> np.ndarray:
        """dimensions x components; zero columns for components without variance."""
        root = np.sqrt(np.where(self.live(), self.values, 1.0))
        return np.where(self.live(), self.vectors / root, 0.0)


def slabs(rows: DataFrame, n: int, size: int) -> list:
    """(rows of the slab renumbered from 0, first row number, number of rows)."""
    cuts = range(0, n, size)
    if len(cuts) == 1:
        return [(rows, 0, n)]
    return [(rows.filter(F.col("row").between(a, min(n, a + size) - 1)).withColumn("row", F.col("row") - F.lit(a)),
             a, min(n, a + size) - a) for a in cuts]


def whiten(table: DataFrame, components: int = 8, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id",
           vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, slab_rows: int = SLAB_ROWS) -> tuple[DataFrame, Whitening | None]:
    """(one row per remaining vector: vec_id, n, deviation, whitened array<double>, identity_error; the model)."""
    spark = table.sparkSession
    rows = whole_vectors(table, id_col, vec_col, scale, shift)
    n, sums, least, most = dimension_sums(rows)
    if not n:
        return spark.createDataFrame([], "vec_id long, n long, deviation long, whitened array<double>, identity_error double"), None
    dims = len(sums)
    diff = centred(n, sums, least, most)
    at = cut_lineage(rows.select(
        "row", "vec_id", squared_deviation(diff, n, dims, least, most).alias("deviation"),
        F.transform(diff, lambda d: d.cast("double") / F.lit(float(n))).alias("c")), "whiten-centred")
    parts = [(block_matrix(s, "c", m, dims, block_rows), a, -(-m // block_rows))
             for s, a, m in slabs(at.select("row", "c"), n, slab_rows)]
    scatter = reduce(np.add, (product(b.transpose(), b, max(1, blocks // 8)).toLocalMatrix().toArray()
                              for b, _, blocks in parts))
    model = Whitening.of(scatter / n, min(components, dims))
    w = model.matrix()
    k = w.shape[1]
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, k, w.ravel(order="F")))], 1), dims, k)
    projected = reduce(DataFrame.unionByName, (
        block_rows_frame(product(b, right, 1)).select((F.col("row") + F.lit(a)).alias("row"), F.col("vec").alias("whitened"))
        for b, a, _ in parts))
    out = cut_lineage(at.select("row", "vec_id", "deviation").join(projected, "row"), "whiten-projected")
    for b, _, _ in parts:
        release(b)
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.lit(identity_error(out, model)).alias("identity_error")), model


def identity_error(out: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance (divisor n, centred) minus the identity."""
    live = [int(i) for i in np.flatnonzero(model.live())]
    if not live:
        return 0.0
    w = lambda i: F.col("whitened")[i]
    cov = out.agg(*[(F.covar_pop(w(i), w(j)) if i != j else F.var_pop(w(i))).alias(f"c{i}_{j}")
                    for i in live for j in live if i <= j]).first()
    return max(abs(cov[f"c{i}_{j}"] - (1.0 if i == j else 0.0)) for i in live for j in live if i <= j)


def component_rows(found: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    if model is None:
        return found.selectExpr("vec_id", "1 AS component", "n", "deviation", "CAST(null AS double) AS whitened",
                                "CAST(null AS double) AS explained", "identity_error")
    share = F.array(*[F.lit(float(s)) for s in model.shares])
    live = F.array(*[F.lit(bool(x)) for x in model.live()])
    return (found.select("vec_id", "n", "deviation", "identity_error", F.posexplode("whitened").alias("i", "w"))
            .select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation",
                    F.when(F.element_at(live, F.col("i") + 1), F.col("w")).alias("whitened"),
                    F.element_at(share, F.col("i") + 1).alias("explained"), "identity_error"))
