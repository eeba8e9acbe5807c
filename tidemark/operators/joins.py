"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only if it holds at most this many rows.  Fitted
# parameters, vocabularies, class quotas and bucket prefix tables are far
# below it; anything data-sized falls back to a shuffle join.
BROADCAST_MAX_ROWS = 200_000


def bounded_small(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool]:
    """Cache ``small`` and report whether it is within ``max_rows``.

    The count runs on an already-aggregated frame, so it is cheap; the
    cache keeps the join from recomputing the aggregate.
    """
    small = small.cache()
    n = small.limit(max_rows + 1).count()
    return small, n <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_MAX_ROWS, bound: int | None = None) -> DataFrame:
    """Join ``big`` with ``small``; broadcast ``small`` only when its row count is bounded.

    ``bound`` is a row bound known by construction (e.g. columns x buckets);
    when it is within ``max_rows`` no counting job is needed.  Otherwise the
    small side is counted (it is an aggregate, so this is cheap) and joined
    by shuffle if it turns out large.
    """
    if bound is not None and bound <= max_rows:
        return big.join(F.broadcast(small), on=on, how=how)
    small, ok = bounded_small(small, max_rows)
    return big.join(F.broadcast(small) if ok else small, on=on, how=how)


def param_struct(one_row: DataFrame) -> F.Column:
    """Fitted parameters as a scalar-subquery struct Column.

    ``one_row`` is a global aggregate (exactly one row).  The subquery
    runs once and its value is shipped to every task as a literal -- no
    join, no cross product.  Read fields with ``.getField(name)``.
    """
    return one_row.select(F.struct(*one_row.columns).alias("_p")).scalar()
