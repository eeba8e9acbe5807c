"""Exact top-k by an impact-ordered, score-at-a-time index.

Vectors of whole numbers are documents, their components the terms.  The
index of a block of rows holds, per component, the rows ordered by value:
read from the top for a positive query weight and from the bottom for a
negative one, a list comes in descending impact (weight times value).
A query's impacts are quantised into levels, the highest first; a level's
segment of a list is the stretch of postings whose impact lies in it.
Segments are processed level by level over all lists.  After a level:

* a row's accumulator is exact for the postings seen, and every posting not
  yet seen has an impact below the level's floor, so
  accumulator + floor * (postings not seen) bounds the row's score;
* the rows with the highest bounds are scored exactly; the k-th of these
  scores is a proven lower limit of the k-th best;
* rows whose bound is below that limit are out, for good.

Processing stops only when that proof leaves few rows ("possible
members", at most ``RESCORE`` of the block or RESCORE_LEAST), or all
segments are done; then all possible members are scored exactly from their
vectors.  So the result is the exact top k, ties included.

Blocks: rows and queries are dealt into blocks of bounded size by a hash of
their id; each pair of blocks is one task's work and returns k rows per
query.  Rows that take part: see ``usable_vectors`` (zero vectors do).  An
empty table gives no rows.  A score beyond 64 bits counts as the nearest
long, in the ranking too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ann_partitions import top_k
from tidemark.llm.vectors import block, matrix, usable_vectors

#: Impact levels above zero, and as many below; each is STEP times finer than the one before.
LEVELS = 3
STEP = 4
RESCORE = 1 / 16
RESCORE_LEAST = 64
#: Whole numbers are exact in double precision up to here.
EXACT = float(1 << 53)


class ImpactIndex:
    """Impact-ordered postings of one block: per component, rows by descending value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values                # (rows,), (rows, components), whole numbers
        by_term = np.ascontiguousarray(values.T)
        self.order = np.argsort(-by_term, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(by_term, self.order, axis=1)
        self.rising = -self.sorted                         # ascending, for searches

    def top(self, q_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, exact scores) of the k best rows other than the query's."""
        n = len(self.values)
        members = np.arange(n)
        terms = np.flatnonzero(q).tolist()
        acc, seen = np.zeros(n), np.zeros(n)
        done = dict.fromkeys(terms, 0)                     # postings processed of each list
        first = np.where(q > 0, self.sorted[:, 0], self.sorted[:, -1]) * q
        last = np.where(q > 0, self.sorted[:, -1], self.sorted[:, 0]) * q
        most = max(RESCORE_LEAST, int(n * RESCORE), 2 * k)
        for floor in self._levels(float(first.max()), float(last.min())):
            rows, adds = [], []
            for d in terms:
                w, old = q[d], done[d]
                upto = self._reach(self.rising[d], w, floor)
                if upto > old:
                    seg = slice(old, upto) if w > 0 else slice(n - upto, n - old)
                    rows.append(self.order[d, seg])
                    adds.append(self.sorted[d, seg] * w)
                    done[d] = upto
            if rows:
                at = np.concatenate(rows)
                acc += np.bincount(at, np.concatenate(adds), n)
                seen += np.bincount(at, minlength=n)
            bound = acc + floor * (len(terms) - seen)
            limit = self._limit(q_id, q, bound, k)
            members = np.flatnonzero(bound + 0.5 >= limit)   # scores are whole numbers
            if len(members) <= most:
                break
        score = self.values[members] @ q
        keep = self.ids[members] != q_id
        members, score = members[keep], score[keep]
        best = np.lexsort((self.ids[members], -score))[:k]
        return members[best], score[best]

    @staticmethod
    def _levels(high: float, low: float) -> list[float]:
        """Floors of the quantised impact levels, descending, down to ``low``."""
        up = [f for i in range(1, LEVELS + 1) if (f := high / STEP ** i) > max(low, 0)]
        down = [f for i in range(LEVELS, 0, -1) if (f := low / STEP ** i) < 0]
        return [*up, *([0.0] if low < 0 else []), *down, low]

    @staticmethod
    def _reach(rising: np.ndarray, w: float, floor: float) -> int:
        """Postings of a list whose impact is at least ``floor``."""
        if w > 0:
            return int(rising.searchsorted(-floor / w, "right"))
        return len(rising) - int(rising.searchsorted(-floor / w, "left"))

    def _limit(self, q_id: int, q: np.ndarray, bound: np.ndarray, k: int) -> float:
        """Exact score of the k-th best among the rows with the highest bounds."""
        m = min(len(bound), 2 * k + 1)
        rows = np.argpartition(-bound, m - 1)[:m]
        rows = rows[self.ids[rows] != q_id]
        if len(rows) < k:
            return -np.inf
        return float(np.partition(self.values[rows] @ q, -k)[-k])


def block_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> pa.Table:
    """The k best rows of one block for each query of another."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT:
        index = ImpactIndex(c_ids, c)
        found = ((i, *index.top(i, x, k)) for i, x in zip(q_ids.tolist(), q))
    else:                                                  # huge components: Python's whole numbers
        whole = [[int(x) for x in row] for row in c.tolist()]
        found = (big_top(i, [int(x) for x in row], c_ids, whole, k) for i, row in zip(q_ids.tolist(), q.tolist()))
    for i, rows, score in found:
        out["query_id"] += [i] * len(rows)
        out["vec_id"] += c_ids[rows].tolist()
        out["score"] += [int(x) for x in score]
    return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                     "score": pa.array(out["score"], pa.int64())})


def big_top(q_id: int, q: list, c_ids: np.ndarray, whole: list, k: int):
    clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    scored = sorted((-clamp(sum(a * b for a, b in zip(q, row))), i, n)
                    for n, (i, row) in enumerate(zip(c_ids.tolist(), whole)) if i != q_id)[:k]
    return q_id, np.array([n for *_, n in scored], np.int64), [-s for s, *_ in scored]


def impact_top_k(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256, row_block: int = 8192,
                 query_block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``every``."""
    rows = usable_vectors(table, id_col, vec_col, zero=True)
    queries = rows.filter(F.col("id") % every == 0)
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    a = queries.select(block("id", query_blocks, 1).alias("qb"),
                       F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), "id", "vec")
    b = rows.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
                    block("id", row_blocks, 2).alias("rb"), "id", "vec")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.int64())})
        whole = lambda t: np.floor(matrix(t.column("vec")) * scale)
        return block_top(left.column("id").to_numpy(), whole(left), right.column("id").to_numpy(), whole(right), k)

    found = a.groupBy("qb", "rb").cogroup(b.groupBy("qb", "rb")).applyInArrow(
        score, "query_id long, vec_id long, score long")
    return top_k(found, k)
