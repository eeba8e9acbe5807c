"""Approximate nearest neighbours by learned partitions.

Fit (on a sample of at most ``sample_rows`` rows, chosen by hash): build
the sample's nearest-neighbour graph, cut it into balanced parts by
recursive bisection (median split along the main direction, then swaps
that lower the number of cut edges and keep both sizes), and train a small
classifier -- one hidden layer -- that predicts, from a vector alone, how
its neighbours are spread over the parts.  There is a part for every
``rows_per_part`` rows, and four from 128 rows on.  Above ``fanout`` parts
there are two levels: every part of the first is cut by a graph and a
classifier of its own, fitted in its own task.  Two levels hold
``fanout`` squared parts (half a thousand million rows at the defaults);
beyond that, parts grow with the table.

Index: every row goes to its most probable part; the index is a written
table.  Search: a query goes to its most probable parts until they hold
``mass`` of the predicted probability, at least ``least_probes`` parts and
more than k rows, so a query never returns fewer than it could.  All rows
of these parts are compared with it exactly.  The mass is not set but
measured: the true neighbours of ``judge_rows`` rows kept from the fit are
found by comparing these rows with all others, and the mass is the
smallest that finds the share ``goal`` of them (``AnnIndex`` reports it,
with the recall and the share of rows visited).

A part may hold any share of the rows: parts are gathered into bins of
bounded size, a larger part is dealt over several bins by a hash, and a
bin's queries are dealt into blocks; every bin and block is one task's
work, scored as matrix products of a part and its queries and cut to the
k best per query; no pairs are emitted.  Scores are recomputed in double
precision, component by component, before ties are broken.

Only the sample, the judged rows with the parts of their neighbours, and
one row per part reach the driver; a model is a few small matrices.  Rows that
take part: see ``usable_vectors`` (zero vectors do not).  An empty table
gives no rows; a query's own row is no candidate.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut_lineage
from tidemark.llm.vectors import block, exact_products, matrix, usable_vectors


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo:lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo:lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(x: np.ndarray, edges: np.ndarray, n_left: int, passes: int = 12) -> np.ndarray:
    """Boolean side (True: left) of each row: n_left rows left, few edges cut."""
    centred = x - x.mean(axis=0)
    direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    left = np.zeros(len(x), bool)
    left[np.argsort(centred @ direction, kind="stable")[:n_left]] = True
    u, v = edges
    for _ in range(passes):
        gain = np.bincount(u, np.where(left[u] == left[v], -1.0, 1.0), len(x))
        a = np.flatnonzero(left)[np.argsort(-gain[left], kind="stable")]
        b = np.flatnonzero(~left)[np.argsort(-gain[~left], kind="stable")]
        n = min(len(a), len(b))
        better = np.flatnonzero(gain[a[:n]] + gain[b[:n]] > 0)
        if not len(better):
            break
        m = max(1, (int(better[-1]) + 1) // 2)             # half of them: swaps disturb each other
        left[a[:m]], left[b[:m]] = False, True
    return left


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row: ``parts`` parts of equal size (up to one), few cut edges."""
    label = np.zeros(len(x), np.int64)
    u = np.repeat(np.arange(len(x)), graph.shape[1])
    both = np.concatenate([[u, graph.ravel()], [graph.ravel(), u]], axis=1)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = first
            continue
        at = np.full(len(x), -1)
        at[rows] = np.arange(len(rows))
        inside = at[both]
        left = bisect(x[rows], inside[:, (inside >= 0).all(axis=0)], len(rows) * (n // 2) // n)
        todo += [(rows[left], first, n // 2), (rows[~left], first + n // 2, n - n // 2)]
    return label


class Router:
    """Small classifier: vector -> probability of each part."""

    def __init__(self, x: np.ndarray, spread: np.ndarray, hidden: int = 96, epochs: int = 40, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale = np.sqrt((x ** 2).mean()) or 1.0
        x = x / self.scale
        sizes = (x.shape[1], hidden, spread.shape[1])
        w = [rng.normal(0, 1 / np.sqrt(a), (a, b)) for a, b in zip(sizes[:-1], sizes[1:])] + [np.zeros(hidden), np.zeros(sizes[2])]
        m, v, step = [0 * p for p in w], [0 * p for p in w], 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.tanh(x[rows] @ w[0] + w[2])
                z = self._softmax(h @ w[1] + w[3])
                dz = (z - spread[rows]) / len(rows)
                dh = (dz @ w[1].T) * (1 - h ** 2)
                step += 1
                rate = 3e-3 * (1 - epoch / epochs)
                for i, g in enumerate((x[rows].T @ dh, h.T @ dz, dh.sum(0), dz.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        self.w = w
        self.parts = sizes[2]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.tanh(x / self.scale @ self.w[0] + self.w[2]) @ self.w[1] + self.w[3])


def fit_router(x: np.ndarray, parts: int, graph_k: int = 16) -> Router:
    """Cut the sample's neighbour graph and learn to predict its parts."""
    graph = neighbour_graph(x, graph_k)
    label = balanced_parts(x, graph, parts)
    spread = np.zeros((len(x), parts))
    spread[np.arange(len(x)), label] += 1
    np.add.at(spread, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
    return Router(x, spread / spread.sum(axis=1, keepdims=True))


def best_rows(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int,
              cells: int = 1 << 21) -> pa.Table:
    """The k best candidates of each query in one pair of blocks, exactly scored."""
    out = []
    reach = np.sqrt((c ** 2).sum(axis=1).max()) * np.sqrt((q ** 2).sum(axis=1))
    for lo in range(0, len(q), max(1, cells // len(c))):
        rows = slice(lo, lo + max(1, cells // len(c)))
        s = q[rows] @ c.T
        s[q_ids[rows, None] == c_ids[None, :]] = -np.inf
        top = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        near = (s >= (top - 1e-9 * reach[rows])[:, None]) & (s > -np.inf)
        i, j = np.nonzero(near)
        score = np.concatenate([exact_products(q[lo + i[a:a + 65536]], c[j[a:a + 65536]])
                                for a in range(0, len(i), 65536)] or [np.empty(0)])
        order = np.lexsort((c_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        out.append(pa.table({"query_id": pa.array(q_ids[lo + i[keep]], pa.int64()),
                             "vec_id": pa.array(c_ids[j[keep]], pa.int64()), "score": pa.array(score[keep])}))
    return pa.concat_tables(out)


FOUND = "query_id long, vec_id long, score double"


class Partitions:
    """Leaf parts and the probability of each for a vector.

    One router of ``top`` parts; where a table needs more parts than one
    router holds, each of its parts has a router of its own and a leaf's
    probability is the product of the two."""

    def __init__(self, top: Router | None, below: list[Router | None]):
        self.top, self.below = top, below
        self.sizes = [b.parts if b else 1 for b in below]
        self.count = sum(self.sizes)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        p = self.top(x) if self.top else np.ones((len(x), 1))
        return np.concatenate([p[:, [t]] * b(x) if b else p[:, [t]] for t, b in enumerate(self.below)], axis=1)

    def slices(self, n: int, cells: int = 1 << 22) -> Iterator[slice]:
        """Rows to route at a time: rows x parts stays bounded."""
        step = max(1, cells // self.count)
        return (slice(lo, lo + step) for lo in range(0, n, step))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Most probable leaf of each row."""
        return np.concatenate([self(x[s]).argmax(axis=1) for s in self.slices(len(x))] or [np.empty(0, np.int64)])


def probe_order(p: np.ndarray, held: np.ndarray, least_probes: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts by falling probability, probability before each): a part is
    visited if the latter is below the mass; -1 where it is always visited."""
    order = np.argsort(-p, axis=1, kind="stable")
    sorted_p = np.take_along_axis(p, order, 1)
    before = np.cumsum(sorted_p, axis=1) - sorted_p
    rows_before = np.cumsum(held[order], axis=1) - held[order]
    before[(np.arange(p.shape[1]) < least_probes) | (rows_before <= k)] = -1.0
    return order, before


def mass_for_recall(partitions: Partitions, held: np.ndarray, x: np.ndarray, parts: list[np.ndarray], goal: float,
                    least_probes: int, k: int) -> tuple[float, float, float]:
    """(mass, recall, share of rows visited): the smallest mass at which the
    rows ``x``, whose true neighbours lie in ``parts``, reach ``goal``."""
    needed, orders, befores = [], [], []
    for s in partitions.slices(len(x)):
        order, before = probe_order(partitions(x[s]), held, least_probes, k)
        at = np.empty_like(before)
        np.put_along_axis(at, order, before, 1)
        needed += [at[i, p] for i, p in enumerate(parts[s])]
        orders.append(held[order])
        befores.append(before)
    needed = np.sort(np.concatenate(needed)) if needed else np.empty(0)
    if not len(needed):
        return 1.0, 1.0, 1.0
    mass = float(np.nextafter(needed[int(np.ceil(goal * len(needed))) - 1], 2.0))
    visited = sum((h * (b < mass)).sum() for h, b in zip(orders, befores)) / (len(x) * held.sum())
    return mass, float((needed < mass).mean()), float(visited)


@dataclass
class AnnIndex:
    """``rows`` (id, vec, part) written; what was measured on the rows kept from the fit."""
    rows: DataFrame
    partitions: Partitions
    held: np.ndarray
    mass: float
    recall: float
    visited: float


def assigned(rows: DataFrame, partitions: Partitions) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = partitions.leaf(matrix(pa.chunked_array([b.column("vec")])))
                yield b.append_column("part", pa.array(part, pa.int32()))

    return rows.select("id", "vec").mapInArrow(assign, "id long, vec array<double>, part int")


def part_sizes(rows: DataFrame, parts: int) -> np.ndarray:
    held = np.zeros(parts, np.int64)
    for r in rows.groupBy("part").count().collect():       # one row a part
        held[r["part"]] = r["count"]
    return held


def routers_below(rows: DataFrame, held: np.ndarray, rows_per_part: int, fanout: int, sample_rows: int) -> list[Router | None]:
    """A router for every part, fitted in that part's task on at most about ``sample_rows`` of its rows."""
    plan = F.broadcast(rows.sparkSession.createDataFrame(   # one row a part of the first level
        [(p, int(min(fanout, max(1, -(-int(h) // rows_per_part)))), min(1.0, sample_rows / max(1, int(h))))
         for p, h in enumerate(held)], "part int, below int, share double"))
    sample = rows.join(plan, "part").filter(
        (F.col("below") > 1) & (F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)))

    def fit(t: pa.Table) -> pa.Table:
        router = fit_router(matrix(t.column("vec")), t.column("below")[0].as_py())
        return pa.table({"part": t.column("part")[:1], "router": pa.array([pickle.dumps(router)], pa.binary())})

    got = sample.groupBy("part").applyInArrow(fit, "part int, router binary").collect()   # one row a part
    found = {r["part"]: pickle.loads(bytes(r["router"])) for r in got}
    return [found.get(p) for p in range(len(held))]


def fit_index(rows: DataFrame, k: int = 20, sample_rows: int = 8192, judge_rows: int = 256, rows_per_part: int = 2048,
              fanout: int = 512, goal: float = 0.95, least_probes: int = 2) -> AnnIndex:
    """Fit the partitions, index every row of (id, vec) and choose the mass."""
    n = rows.count()
    parts = max(1, min(4, n // 32), -(-n // rows_per_part))
    judged = min(judge_rows, n // 5)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(n, sample_rows + judged)).select("id", "vec").toArrow()
    judge, sample = some.slice(len(some) - judged), some.slice(0, len(some) - judged)
    first = parts if parts <= fanout else min(fanout, int(np.ceil(np.sqrt(parts))))
    top = fit_router(matrix(sample.column("vec")), first) if first > 1 else None
    partitions = Partitions(top, [None] * first)
    index = cut_lineage(assigned(rows, partitions), "ann-index")
    held = part_sizes(index, partitions.count)
    if parts > first:
        partitions = Partitions(top, routers_below(index, held, rows_per_part, fanout, sample_rows))
        index = cut_lineage(assigned(index, partitions), "ann-leaves")
        held = part_sizes(index, partitions.count)
    mass, recall, visited = 1.0, 1.0, 1.0
    if partitions.count > 1:
        ids, x = judge.column("id").to_numpy(), matrix(judge.column("vec"))
        near = dict(true_parts(index, ids, x, k))
        mass, recall, visited = mass_for_recall(partitions, held, x, [near.get(int(i), np.empty(0, np.int64)) for i in ids],
                                                goal, least_probes, k)
    return AnnIndex(index, partitions, held, mass, recall, visited)


def true_parts(index: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of the true k nearest of a bounded set of rows: each task keeps its k best."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            c_ids, part = b.column("id").to_numpy(), b.column("part").to_numpy()
            best = best_rows(ids, x, c_ids, matrix(pa.chunked_array([b.column("vec")])), k)
            order = np.argsort(c_ids)
            at = order[np.searchsorted(c_ids, best.column("vec_id").to_numpy(), sorter=order)]
            best = best.append_column("part", pa.array(part[at], pa.int32()))
            kept = k_best(best if kept is None else pa.concat_tables([kept, best]), k)
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    got = (index.mapInArrow(scan, FOUND + ", part int").withColumn("rank", F.row_number().over(order))
           .filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list("part").alias("parts")).collect())
    return ((r["query_id"], np.array(r["parts"])) for r in got)


def k_best(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query of (query_id, vec_id, score, ...)."""
    q, v, s = (found.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
    order = np.lexsort((v, -s, q))
    first = np.searchsorted(q[order], q[order])
    return found.take(pa.array(order[np.arange(len(q)) - first < k]))


def bins_of(held: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, number of bins) of each part: neighbouring parts share a
    bin of at most ``block_rows`` rows; a larger part has bins of its own."""
    first, count = np.zeros(len(held), np.int64), np.ones(len(held), np.int64)
    at, filled = 0, 0
    for p, h in enumerate(held.tolist()):
        if filled and filled + h > block_rows:
            at, filled = at + 1, 0
        first[p] = at
        if h > block_rows:
            count[p] = -(-h // block_rows)
            at += int(count[p])
        else:
            filled += h
    return first, count


def nearest_by_partitions(table: DataFrame, every: int = 20, k: int = 20, sample_rows: int = 8192, judge_rows: int = 256,
                          rows_per_part: int = 2048, fanout: int = 512, goal: float = 0.95, least_probes: int = 2,
                          block_rows: int = 32_768, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose
    id is divisible by ``every``, among all other rows."""
    spark = table.sparkSession
    rows = usable_vectors(table, id_col, vec_col, zero=False)
    ann = fit_index(rows, k, sample_rows, judge_rows, rows_per_part, fanout, goal, least_probes)
    partitions, held, mass = ann.partitions, ann.held, ann.mass
    first_bin, n_bins = bins_of(held, block_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a query goes once to a bin, with the parts it visits there
        for b in batches:
            x = matrix(pa.chunked_array([b.column("vec")])) if b.num_rows else np.empty((0, 1))
            for s in partitions.slices(len(x)):
                order, before = probe_order(partitions(x[s]), held, least_probes, k)
                i, j = np.nonzero(before < mass)
                part = order[i, j]
                times = n_bins[part]
                i, part = np.repeat(i, times), np.repeat(part, times)
                step = np.arange(len(part)) - np.repeat(np.cumsum(times) - times, times)
                bin_ = first_bin[part] + step
                by = np.lexsort((part, bin_, i))
                i, part, bin_ = i[by], part[by], bin_[by]
                new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (bin_[1:] != bin_[:-1])]) if len(i) else np.empty(0, int)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(i)], pa.int32()), pa.array(part, pa.int32()))
                out = b.take(pa.array(s.start + i[new], pa.int64()))
                yield out.append_column("bin", pa.array(bin_[new], pa.int32())).append_column("parts", lists)

    asked = cut_lineage(rows.filter(F.col("id") % every == 0).select("id", "vec").mapInArrow(
        route, "id long, vec array<double>, bin int, parts array<int>"), "ann-queries")
    load = {r["bin"]: r["count"] for r in asked.groupBy("bin").count().collect()}    # one row a bin
    blocks = F.broadcast(spark.createDataFrame(             # one row a bin
        [(b, int(-(-c // block_rows))) for b, c in load.items()], "bin int, query_blocks int"))
    bins = F.broadcast(spark.createDataFrame(               # one row a part
        [(p, int(first_bin[p]), int(n_bins[p])) for p in range(len(held))], "part int, first_bin int, n_bins int"))
    a = asked.join(blocks, "bin").select("bin", block("id", F.col("query_blocks"), 1).alias("qb"), "id", "vec", "parts")
    b = (ann.rows.join(bins, "part")
         .select((F.col("first_bin") + block("id", F.col("n_bins"), 2)).alias("bin"), "part", "id", "vec").join(blocks, "bin")
         .select("bin", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "part", "id", "vec"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                           "score": pa.array([], pa.float64())})]
        if len(left) and len(right):
            q_ids, q, c_ids, c = (f(t.column(n)) for t in (left, right) for f, n in ((pa.ChunkedArray.to_numpy, "id"), (matrix, "vec")))
            wanted = left.column("parts").combine_chunks()
            asks = np.repeat(np.arange(len(left)), wanted.value_lengths().to_numpy())
            asked_part, part = wanted.flatten().to_numpy(), right.column("part").to_numpy()
            for p in np.unique(part):
                i, j = asks[asked_part == p], np.flatnonzero(part == p)
                if len(i):
                    found.append(best_rows(q_ids[i], q[i], c_ids[j], c[j], k))
        return k_best(pa.concat_tables(found), k)

    return top_k(a.groupBy("bin", "qb").cogroup(b.groupBy("bin", "qb")).applyInArrow(score, FOUND), k)


def top_k(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: highest score, then smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
