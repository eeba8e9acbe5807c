"""Hard negatives by segment summaries.

Every vector of whole numbers is cut into segments; a segment is summed up by
its mean m and its deviation d (root of the sum of squared differences from
the mean).  For two vectors and segments of length L

    sum over segments (L m m')  -  sum (d d')   <=  inner product
    inner product  <=  sum over segments (L m m')  +  sum (d d')

The summaries of the finest segments are stored with the rows; those of
segments twice as long follow from them without the vectors.  A block of
rows is searched from the coarsest segments to the finest: at each level

* some rows that look best by their means are scored exactly; the k-th of
  them is a proven limit (per anchor, or per anchor and positive),
* rows whose upper bound is below the limit, or whose lower bound is above
  the highest score allowed, are out; only the others are refined,

and what is left after the finest level is scored exactly.  So results are
exact, ties included.

Two passes over the same stored index: the first finds each anchor's
positives (same label), the second, for every positive, the best rows of
other labels inside its score window.  A block is one task's work: its
rows are held, all anchors stream past in batches.  Anchors meet every
block (a stated query set against all rows); a block returns k rows at most
per anchor or pair.

Defined results: rows with a null id, a null label, a vector that is null,
empty, holds a null or non-finite component, or whose length is not the
most frequent one (the smaller of equals), take no part; zero vectors do.
Rows that repeat an id count once, with their smallest (vector, label).  An
anchor without positives, or a pair whose window is empty (a negative
positive score), gives no rows.  An empty table gives no rows; extra columns
are never read.  A score beyond 64 bits counts as the nearest long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut_lineage, only
from tidemark.llm.vectors import block, matrix

#: Segment counts, coarse to fine (as far as the dimensions allow).
LEVELS = (8, 16, 32)
ROW_BLOCK = 8192
#: Anchors that are compared with a block at once.
CHUNK = 32
#: Whole numbers are exact in double precision up to here.
EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1

INDEX = "id long, label long, vec array<double>, summary array<double>"


# ---- segment summaries -------------------------------------------------

def edges(dims: int, segments: int) -> np.ndarray:
    """Segment starts of ``dims`` components (nested between powers of two), and the end."""
    return np.arange(segments + 1) * dims // segments


def levels(dims: int) -> list[int]:
    return [s for s in LEVELS if s < dims] or [1]


def summaries(values: np.ndarray, segments: int) -> np.ndarray:
    """Rows of [mean * root of length, deviation] per segment, shape (rows, 2 * segments)."""
    cut = edges(values.shape[1], segments)
    size = np.diff(cut)
    mean = np.add.reduceat(values, cut[:-1], axis=1) / size
    off = values - np.repeat(mean, size, axis=1)
    return np.hstack([mean * np.sqrt(size), np.sqrt(np.add.reduceat(off * off, cut[:-1], axis=1))])


def coarser(fine: np.ndarray, dims: int, segments: int) -> np.ndarray:
    """Summaries of ``segments`` segments from those of twice as many."""
    mean, dev = np.hsplit(fine, 2)
    size = np.diff(edges(dims, 2 * segments))
    root, both = np.sqrt(size), size[::2] + size[1::2]
    total = mean * root
    wide = (total[:, ::2] + total[:, 1::2]) / both
    plain = mean / root
    apart = size * (plain - np.repeat(wide, 2, axis=1)) ** 2 + dev * dev
    return np.hstack([wide * np.sqrt(both), np.sqrt(apart[:, ::2] + apart[:, 1::2])])


def norms(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((values * values).sum(axis=1))


class Index:
    """One block's rows with their summaries at all levels."""

    def __init__(self, ids, labels, values, finest):
        self.ids, self.labels, self.values = ids, labels, values
        dims, counts = values.shape[1], levels(values.shape[1])
        self.levels = [finest]
        for s in reversed(counts[:-1]):
            self.levels.insert(0, coarser(self.levels[0], dims, s))
        self.norm = norms(values)
        self.peak = float(np.abs(values).max(initial=0.0))

    def take(self, rows: np.ndarray) -> "Index":
        part = object.__new__(Index)
        part.ids, part.labels, part.values, part.norm = self.ids[rows], self.labels[rows], self.values[rows], self.norm[rows]
        part.levels, part.peak = [s[rows] for s in self.levels], self.peak
        return part

    def scores(self, rows: np.ndarray, q: np.ndarray):
        """Exact inner products as int64."""
        if self.peak * float(np.abs(q).max(initial=0.0)) * len(q) < EXACT:
            return (self.values[rows] @ q).astype(np.int64)
        whole = [int(x) for x in q]
        got = (sum(a * int(b) for a, b in zip(whole, r)) for r in self.values[rows].tolist())
        return np.array([max(LONG_MIN, min(LONG_MAX, s)) for s in got], np.int64)


def bounds(anchors: np.ndarray, rows: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, product of means, upper) for every anchor and row; rounding is inside the bounds."""
    half = anchors.shape[1] // 2
    with np.errstate(over="ignore", invalid="ignore"):
        middle = anchors[:, :half] @ rows[:, :half].T
        spread = anchors[:, half:] @ rows[:, half:].T + slack
        low, high = middle - spread, middle + spread
    if not np.isfinite(spread).all():                      # components near the largest double: nothing is known
        low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
        middle[~np.isfinite(middle)] = 0.0
    return low, middle, high


def kth(scores: np.ndarray, k: int) -> float:
    """The k-th best score as a limit (none where rows beyond 64 bits could tie with it)."""
    if len(scores) < k:
        return -np.inf
    score = int(np.partition(scores, -k)[-k])
    return float(score) if score > LONG_MIN else -np.inf


class Search:
    """What one chunk of anchors still looks for in a block.

    ``windows[a]`` lists (low, high): anchor a wants, for each window, its k
    best rows with low <= score <= high."""

    def __init__(self, index: Index, ids, values, finest, allowed: np.ndarray, windows: list, k: int):
        self.index, self.q, self.k, self.windows = index, values, k, windows
        self.alive = allowed & (index.ids[None, :] != ids[:, None])
        dims = values.shape[1]
        self.q_levels = [finest]
        for s in reversed(levels(dims)[:-1]):
            self.q_levels.insert(0, coarser(self.q_levels[0], dims, s))
        self.norm = norms(values)
        self.limits = [[float(low) if low > LONG_MIN else -np.inf for low, _ in w] for w in windows]

    def refine(self) -> None:
        for q_level, level in zip(self.q_levels, self.index.levels):
            rows = np.flatnonzero(self.alive.any(axis=0))
            if not len(rows):
                return
            slack = 1e-9 * self.norm[:, None] * self.index.norm[None, rows] + 0.5
            low, middle, high = bounds(q_level, level[rows], slack)
            for a in range(len(self.q)):
                here = np.flatnonzero(self.alive[a, rows])
                self.alive[a, rows[here]] = self._possible(a, rows[here], low[a, here], middle[a, here], high[a, here])

    def _possible(self, a: int, rows, low, middle, high) -> np.ndarray:
        """Which of the rows may be among the results of one of anchor a's windows."""
        out = np.zeros(len(rows), bool)
        for w, (_, top) in enumerate(self.windows[a]):
            self._raise(a, w, rows, middle)
            out |= (high >= self.limits[a][w]) & (low <= (top if top < LONG_MAX else np.inf))
        return out

    def _raise(self, a: int, w: int, rows, middle) -> None:
        """Score a few likely rows; the k-th one inside the window is a proven limit."""
        top, tries = self.windows[a][w][1], 2 * self.k
        inside = np.flatnonzero(middle <= top) if top < LONG_MAX else np.arange(len(rows))
        if len(inside) > tries:
            inside = inside[np.argpartition(middle[inside], -tries)[-tries:]]
        score = self.index.scores(rows[inside], self.q[a])
        score = score[(score <= top) & (score >= self.windows[a][w][0])]
        self.limits[a][w] = max(self.limits[a][w], kth(score, self.k))

    def results(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, row numbers, scores), best first."""
        for a in range(len(self.q)):
            rows = np.flatnonzero(self.alive[a])
            score = self.index.scores(rows, self.q[a])
            for w, (low, top) in enumerate(self.windows[a]):
                fit = np.flatnonzero((score >= low) & (score <= top))
                best = fit[np.lexsort((self.index.ids[rows[fit]], ~score[fit]))][:self.k]
                yield a, w, rows[best], score[best]


# ---- blocks of rows, streams of anchors --------------------------------

def segment_index(table: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, shift_every: int,
                  classes: int) -> DataFrame:
    """The stored index (id, label, vec, summary): rows that take part, each id once."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    largest = F.lit(float(np.finfo(np.float64).max))
    whole = lambda x: F.least(F.greatest(x * F.lit(float(scale)), -largest), largest)
    label = F.col("label").cast("long")
    rows = (only(table, id=id_col, vec=vec_col, label=label_col)
            .select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"),
                    F.when(F.col("id") % shift_every == 0, (label + 1) % classes).otherwise(label).alias("label"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
            .filter((F.size("vec") > 0) & F.forall("vec", finite)))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is not None:
        rows = rows.filter(F.size("vec") == size["n"])
    once = rows.groupBy("id").agg(F.min(F.struct("vec", "label")).alias("r"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.floor(matrix(pa.chunked_array([batch.column(2)])))
                with np.errstate(over="ignore", invalid="ignore"):
                    fine = summaries(x, levels(x.shape[1])[-1])
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(1),
                                                  "vec": lists(x), "summary": lists(fine)})

    return cut_lineage(once.select("id", "r.label", F.transform("r.vec", whole).alias("vec")).mapInArrow(add, INDEX),
                       "segment-index")


def lists(x: np.ndarray) -> pa.ListArray:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def against_blocks(index: DataFrame, anchors: DataFrame, blocks: int, search: Callable, extra: str, schema: str) -> DataFrame:
    """``search(block Index, anchors' RecordBatch)`` yields record batches of ``schema``.

    anchors: the index's columns and ``extra`` (array<long> columns).  Rows of a block come first, then its
    anchors, a batch at a time; only the block's rows are held."""
    names = [c.split()[0] for c in extra.split(",")]
    rows = index.select(block("id", blocks, 3).alias("block"), F.lit(0).alias("kind"), "id", "label", "vec", "summary",
                        *[F.lit(None).cast("array<long>").alias(c) for c in names])
    asks = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                          "id", "label", "vec", "summary", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, now = None, [], None
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part, here, kind = batch.slice(a, b - a), int(key[a]) // 2, int(key[a]) % 2
                if here != at:
                    at, held, now = here, [], None
                if kind == 0:
                    held.append(part)
                elif held or now is not None:
                    if now is None:
                        t = pa.Table.from_batches(held)
                        held = []
                        now = Index(t.column("id").to_numpy(), t.column("label").to_numpy(),
                                    matrix(t.column("vec")), matrix(t.column("summary")))
                    yield from search(now, part)

    return (rows.unionByName(asks).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
            .mapInArrow(run, schema))


def _anchors(part: pa.RecordBatch):
    """(ids, labels, values, summaries) of a batch of anchors."""
    t = pa.Table.from_batches([part])
    return t.column("id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("vec")), matrix(t.column("summary"))


def _batch(names: str, found: list) -> Iterator[pa.RecordBatch]:
    """One record batch of long columns from pieces (arrays of equal length per piece)."""
    if found:
        yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(x), pa.int64()) for c, x in zip(names.split(), zip(*found))})


def find_positives(index: DataFrame, anchors: DataFrame, blocks: int, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, place: the k best other rows of the anchor's label."""

    def search(rows: Index, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels, values, finest = _anchors(part)
        out = []
        for label in np.unique(labels):
            same = rows.take(np.flatnonzero(rows.labels == label))
            mine = np.flatnonzero(labels == label)
            for at in range(0, len(mine), CHUNK):
                pick = mine[at:at + CHUNK]
                s = Search(same, ids[pick], values[pick], finest[pick], np.ones((len(pick), len(same.ids)), bool),
                           [[(LONG_MIN, LONG_MAX)]] * len(pick), k)
                s.refine()
                out += [(np.full(len(found), ids[pick[a]]), same.ids[found], score) for a, _, found, score in s.results()]
        yield from _batch("anchor_id positive_id positive_score", out)

    found = against_blocks(index, anchors.withColumn("none", F.array().cast("array<long>")), blocks, search, "none array<long>",
                           "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def find_negatives(index: DataFrame, asks: DataFrame, blocks: int, k: int) -> DataFrame:
    """anchor_id, positive_id, negative_id, negative_score, rank.

    asks: the anchors with array columns positive, low, high (a window per positive)."""

    def search(rows: Index, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels, values, finest = _anchors(part)
        positive, low, high = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("positive", "low", "high"))
        out = []
        for at in range(0, len(ids), CHUNK):
            pick = slice(at, at + CHUNK)
            s = Search(rows, ids[pick], values[pick], finest[pick], rows.labels[None, :] != labels[pick][:, None],
                       [list(zip(a, b)) for a, b in zip(low[pick], high[pick])], k)
            s.refine()
            out += [(np.full(len(found), ids[at + a]), np.full(len(found), positive[at + a][w]), rows.ids[found], score)
                    for a, w, found, score in s.results()]
        yield from _batch("anchor_id positive_id negative_id negative_score", out)

    found = against_blocks(index, asks, blocks, search, "positive array<long>, low array<long>, high array<long>",
                           "anchor_id long, positive_id long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def window_edge(score: str, percent: int, up: bool) -> Column:
    """The smallest whole number >= (or largest <=) ``percent`` hundredths of a long column, as long."""
    exact = F.col(score).cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")
    edge = (F.ceil(exact) if up else F.floor(exact)).cast("decimal(38,0)")
    return F.least(F.greatest(edge, F.lit(LONG_MIN).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def hard_negatives(table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
                   scale: int = 256, shift_every: int = 7, classes: int = 10, row_block: int = ROW_BLOCK,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; negatives score between ``least`` and ``most``
    hundredths of the positive's score."""
    index = segment_index(table, id_col, vec_col, label_col, scale, shift_every, classes)
    blocks = max(1, -(-index.count() // row_block))
    anchors = index.filter(F.col("id") % every == 0)
    pairs = cut_lineage(find_positives(index, anchors, blocks, positives), "positives")
    windows = (pairs.select("anchor_id", "positive_id", window_edge("positive_score", least, True).alias("low"),
                            window_edge("positive_score", most, False).alias("high"))
               .filter("low <= high").groupBy("anchor_id")
               .agg(F.collect_list(F.struct("positive_id", "low", "high")).alias("w")))     # at most ``positives``
    asks = (anchors.join(windows, F.col("id") == F.col("anchor_id"))
            .select("id", "label", "vec", "summary", F.col("w.positive_id").alias("positive"), F.col("w.low").alias("low"),
                    F.col("w.high").alias("high")))
    found = find_negatives(index, asks, blocks, negatives)
    return (found.join(pairs.select("anchor_id", "positive_id", "positive_score"), ["anchor_id", "positive_id"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
