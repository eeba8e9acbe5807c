"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on at most about ``fit_rows`` labelled rows (chosen by hash; the only
bounded part): every word counts as itself and as its character 4- and
5-grams, hashed into ``2^HASH`` features.  Per feature and class the number
of documents that have it is counted by Spark.  A feature's weight is its
log-odds between the classes under an informative Dirichlet prior
(pseudo-documents in proportion to the feature's overall share), lowered
by ``z`` of its standard errors and never below 0; a word's weight is the
largest of its features'.

Scan: words without weight cost ``DRIFT``.  One linear pass finds all
maximal-scoring segments of a text (every segment whose score no
extension or part of it beats); the pass steps over weighted words only.

Calibration: the best segment of a clean text of n words follows an
extreme-value law, E = K n exp(-lambda score); lambda and K are fitted on
clean labelled rows.  A segment with E < ALPHA is significant.  The text's
probability is a logistic curve over its best calibrated score, the best
raw score and the sum over its significant segments.  The prior's strength
and z are those with the least log loss.  All of this uses weights from the
half of the fit rows (halves by text hash) that the judged row is not in,
so no row is judged by counts it is part of.  A text's score is the mean
of what the two halves' weights say, for which that calibration holds.
Its passages are the segments that are significant under either half's
weights; those that overlap are one passage, with the best score of them.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0;
label, lang, source and doc_id are never inputs of a score.

Defined results: null text counts as empty; empty texts get the score of
no evidence; a null doc_id counts as held out; a doc_id with several labels
counts as toxic if one says so; labels other than 0 and 1 are ignored; if
the labels lack a class every text gets the smoothed share of toxic ones;
an empty table gives no rows.  Words longer than 64 characters are read in
pieces of 64.  Shuffles: only counts (a bounded table); texts are not
moved, apart from the written fit rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, only, text_or_empty

HASH = 18
SIZE = 1 << HASH
DRIFT = 0.3
ALPHA = 0.01
#: (pseudo-documents per fit row, standard errors) to choose from.
SETTINGS = ((0.001, 1.6), (0.02, 3.0), (0.02, 4.0), (0.125, 3.0), (0.125, 4.0), (0.125, 5.0))
WORDS = re.compile(r"\w{1,64}")


#: Odd 64-bit multipliers of the feature hash.
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
POWERS = np.cumprod(np.full(200, STEP, np.uint64))       # lower case may double a word's characters


def words_of(text: str) -> list[str]:
    """The words of a text, each in lower case: word i is the i-th match in ``text``."""
    if text.isascii():
        return WORDS.findall(text.lower())
    return [w.lower() for w in WORDS.findall(text)]


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of many words: (first position of each word, features by
    position, whether each is one).  A position of ``^word$`` has three: the
    4-gram and the 5-gram that start there and, at the first, the whole word."""
    text = "".join([f"^{w}$" for w in words])
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    at = np.arange(len(text)) - np.repeat(start, size)       # position in its word
    left = np.repeat(size, size) - at                        # characters from here on
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) * MIX
    code ^= code >> np.uint64(29)
    ahead = np.concatenate([code, np.zeros(4, np.uint64)])
    four = code.copy()
    for k in (1, 2, 3):
        four = four * STEP + ahead[k:k + len(code)]
    five = four * STEP + ahead[4:4 + len(code)]
    whole = np.zeros_like(code)
    whole[start] = np.add.reduceat(code * POWERS[at], start) + MIX
    h = np.stack([four, five * MIX, whole])
    h = ((h ^ (h >> np.uint64(31))) * STEP) >> np.uint64(64 - HASH)
    return start, h.astype(np.int64), np.stack([left >= 4, left >= 5, at == 0])


def features(words: list[str]) -> list[np.ndarray]:
    """Hashed features of each word: itself and its 4- and 5-grams."""
    if not words:
        return []
    start, h, real = hashed(words)
    owner = np.zeros(h.shape[1], np.int64)
    owner[start[1:]] = 1
    owner = np.broadcast_to(np.cumsum(owner), h.shape)[real]
    order = np.argsort(owner, kind="stable")
    return np.split(h[real][order], np.cumsum(np.bincount(owner))[:-1])


def weights(clean: np.ndarray, toxic: np.ndarray, n_clean: float, n_toxic: float, prior: float, z: float) -> np.ndarray:
    """Lower confidence bound of each feature's log-odds, at least 0."""
    n = n_clean + n_toxic
    pseudo = prior * n
    share = (clean + toxic + 0.01) / (n + 0.02)
    a, b = toxic + pseudo * share, clean + pseudo * share
    not_a, not_b = np.maximum(n_toxic + pseudo - a, 1e-9), np.maximum(n_clean + pseudo - b, 1e-9)
    odds = np.log(a / not_a) - np.log(b / not_b)
    return np.maximum(0, odds - z * np.sqrt(1 / a + 1 / not_a + 1 / b + 1 / not_b)).astype(np.float32)


class WordWeights(dict):
    """word -> row of ``values``: the word's weight under each of ``tables``."""

    def __init__(self, tables: np.ndarray, max_words: int = 200_000):
        super().__init__()
        self.tables, self.max_words = tables, max_words
        self.values = np.zeros((max_words, len(tables)), np.float32)

    def add(self, words: list[str]) -> None:
        """Weights of new words, all at once."""
        row = len(self)
        while row + len(words) > len(self.values):        # one text with very many words
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        start, h, real = hashed(words)
        for k, table in enumerate(self.tables):
            self.values[row:row + len(words), k] = np.maximum.reduceat(np.where(real, table[h], 0).max(axis=0), start)
        self.update(zip(words, range(row, row + len(words))))

    def scan(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, their weights: one column per table)."""
        if len(self) >= self.max_words:
            self.clear()
        words = words_of(text)
        fresh = [w for w in set(words) if w not in self]
        for lo in range(0, len(fresh), 50_000):
            self.add(fresh[lo:lo + 50_000])
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return len(words), self.values[rows]


def segments(at: list[int], score: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a text whose word
    at[i] scores score[i] > 0 and all other words -drift.

    Linear: each candidate remembers the nearest earlier one that starts
    lower, and a candidate is merged away at most once."""
    out: list[tuple] = []                                 # (first, last, sum before, sum after, link)
    total, end = 0.0, -1
    for i, s in zip(at, score):
        total -= drift * (i - end - 1)
        end = i
        first, before, after = i, total, total + s
        total = after
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= after:
                break
            first, before = out[j][0], out[j][2]
            del out[j:]
            j -= 1
        out.append((first, i, before, after, j))
    return [(a, b, r - l) for a, b, l, r, _ in out]


def united(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Segments in order; those that share a word are one, with the best score."""
    out: list[tuple[int, int, float]] = []
    for a, z, s in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]), max(s, out[-1][2]))
        else:
            out.append((a, z, s))
    return out


@dataclass
class Model:
    tables: np.ndarray                                    # feature weights of either half's counts
    rate: float = 1.0                                     # lambda
    log_k: float = 0.0
    coef: tuple = (0.0, 0.0, 0.0, 0.0)                    # intercept and slopes; see evidence()

    def evidence(self, n_words: int, found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
        """(best calibrated score, best raw score, sum over significant segments),
        on logarithmic scales: scores have long tails."""
        base = self.log_k + np.log(max(n_words, 1))
        best = max([s for *_, s in found], default=0.0)
        excess = [x for x in (self.rate * s - base for *_, s in found) if x > -np.log(ALPHA)]
        return float(np.arcsinh(self.rate * best - base)), float(np.log1p(best)), float(np.log1p(sum(excess)))

    def probability(self, evidence) -> np.ndarray:
        """Mean over the halves; evidence: (texts, halves, 3)."""
        x = np.asarray(evidence, float).reshape(-1, len(self.tables), 3)
        return (1 / (1 + np.exp(-np.clip(self.coef[0] + x @ np.asarray(self.coef[1:]), -30, 30)))).mean(axis=1)

    def judge(self, text: str, cache: WordWeights):
        """(evidence per half, number of words, the significant segments of either half)."""
        n, values = cache.scan(text)
        found = [found_in(values[:, k]) for k in range(values.shape[1])]
        evidence = [self.evidence(n, f) for f in found]
        base = self.log_k + np.log(max(n, 1))
        return evidence, n, united([x for f in found for x in f if self.rate * x[2] - base > -np.log(ALPHA)])


def extreme_value(best: np.ndarray, n_words: np.ndarray) -> tuple[float, float]:
    """(lambda, log K) of E = K n exp(-lambda best), by quartiles (a few wrongly
    labelled texts with high scores must not widen the law)."""
    some = best > 0
    if some.sum() < 30:
        return 1.0, 0.0
    s, ln = best[some], np.log(np.maximum(n_words[some], 1))
    at = {p: -np.log(-np.log(p)) for p in (0.25, 0.75)}  # standard quantiles of the law
    rate = 1.0
    for _ in range(30):
        low, high = np.quantile(s - ln / rate, (0.25, 0.75))
        rate = 0.5 * rate + 0.5 * float(np.clip((at[0.75] - at[0.25]) / max(high - low, 1e-6), 0.05, 20))
    return rate, rate * float(np.quantile(s - ln / rate, 0.25)) - at[0.25]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """(intercept and slopes, mean log loss) by Newton steps on scaled columns."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.zeros(a.shape[1])
    damp = ridge * np.diag([0, *[1] * x.shape[1]]) + 1e-9 * np.eye(a.shape[1])

    def cost(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * w @ damp @ w)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + damp, a.T @ (y - p) - damp @ w)
        size, now = 1.0, cost(w)
        while size > 1e-6 and cost(w + size * step) > now:
            size /= 2
        w += size * step
        if np.abs(size * step).max() < 1e-7:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-12, 1 - 1e-12)
    slopes = w[1:] / sd
    return np.concatenate([[w[0] - slopes @ mean], slopes]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, y, half) of at most about ``fit_rows`` labelled rows that are not held out, written."""
    marks = (only(labels, id=id_col, y=label_col).filter(F.col("y").isin(0, 1) & ~held_out("id"))
             .groupBy(F.col("id").cast("long").alias("lid")).agg(F.max(F.col("y").cast("int")).alias("y")))
    share = min(1.0, fit_rows / max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64(F.lit(1), "lid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = only(docs, id=id_col, t=text_col).select(F.col("id").cast("long").alias("id"), text_or_empty("t").alias("text"))
    # marks has about fit_rows rows by construction
    return cut_lineage(texts.join(F.broadcast(marks), F.col("id") == F.col("lid")).select(
        "text", "y", (F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(2))).cast("int").alias("half")), "toxic-fit")


def count_features(sample: DataFrame, tasks: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(documents per half, class and feature; documents per half and class)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, known = np.zeros((4, SIZE + 1), np.int32), {}
        for b in batches:
            for text, y, half in zip(*(c.to_pylist() for c in b.columns)):
                words = set(words_of(text))
                if len(known) >= 100_000:
                    known.clear()
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, features(fresh)))
                row = have[2 * half + y]
                if words:
                    row[np.unique(np.concatenate([known[w] for w in words]))] += 1
                row[SIZE] += 1
        for k in range(4):
            f = np.flatnonzero(have[k])
            if len(f):
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(f), k), pa.int32()),
                                                  "f": pa.array(f, pa.int32()), "n": pa.array(have[k][f], pa.int64())})

    # at most 4 * (2^HASH + 1) rows come back, whatever the input
    got = (sample.select("text", "y", "half").coalesce(tasks).mapInArrow(count, "k int, f int, n long")
           .groupBy("k", "f").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros((4, SIZE + 1))
    out[got.column("k").to_numpy(), got.column("f").to_numpy()] = got.column("n").to_numpy()
    return out[:, :SIZE].reshape(2, 2, SIZE), out[:, SIZE].reshape(2, 2)


def found_in(values: np.ndarray) -> list[tuple[int, int, float]]:
    at = np.flatnonzero(values > 0)
    return segments(at.tolist(), values[at].tolist())


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 40_000, judge_rows: int = 12_000, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Model | float:
    """The model, or a constant probability if the labels lack a class."""
    sample = fit_sample(docs, labels, fit_rows, id_col, text_col, label_col)
    counts, n = count_features(sample)
    if (n.sum(axis=0) < 2).any():
        return float((n[:, 1].sum() + 0.5) / (n.sum() + 1))
    share = min(1.0, judge_rows / n.sum())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row of half h is judged by the counts of half 1 - h
        caches = [WordWeights(np.stack([weights(*counts[1 - h], *n[1 - h], *s) for s in SETTINGS])) for h in (0, 1)]
        for b in batches:
            for text, y, half in zip(*(c.to_pylist() for c in b.columns)):
                length, values = caches[half].scan(text)
                found = [[s for *_, s in found_in(values[:, k])] for k in range(len(SETTINGS))]
                yield pa.RecordBatch.from_pydict({"y": pa.array([y], pa.int32()), "n": pa.array([length], pa.int64()),
                                                  "s": pa.array([found], pa.list_(pa.list_(pa.float64())))})

    # the segments' scores stay in a table; a maximum and three figures a row and setting come to the driver
    judged = cut_lineage(sample.filter(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
                         .select("text", "y", "half").mapInArrow(judge, "y int, n long, s array<array<double>>"), "toxic-judged")
    best = judged.select("y", "n", F.transform("s", lambda x: F.coalesce(F.array_max(x), F.lit(0.0))).alias("top")).toArrow()
    y, length = best.column("y").to_numpy(), best.column("n").to_numpy().astype(float)
    top = np.array(best.column("top").to_pylist(), float).reshape(-1, len(SETTINGS))
    models = [Model(np.stack([weights(*counts[h], *n[h], *s) for h in (0, 1)]), *extreme_value(top[y == 0, k], length[y == 0]))
              for k, s in enumerate(SETTINGS)]
    laws = [Model(np.empty((2, 0)), m.rate, m.log_k) for m in models]     # the weights are not needed again

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [[v for law, found in zip(laws, row) for v in law.evidence(m, [(0, 0, s) for s in found])]
                 for m, row in zip(b.column("n").to_pylist(), b.column("s").to_pylist())]
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "x": pa.array(x, pa.list_(pa.float64()))})

    seen = judged.mapInArrow(evidence, "y int, x array<double>").toArrow()
    y = seen.column("y").to_numpy().astype(float)
    x = np.array(seen.column("x").to_pylist(), float).reshape(-1, len(SETTINGS), 3)
    fits = [logistic(x[:, k], y) for k in range(len(SETTINGS))]
    chosen = int(np.argmin([loss for _, loss in fits]))
    models[chosen].coef = tuple(fits[chosen][0])
    return models[chosen]


def score_texts(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the significant segments (character offsets, score, E) of every row."""
    schema = "doc_id long, score double, segments array<struct<start:int,end:int,score:double,e_value:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = None if isinstance(model, float) else WordWeights(model.tables)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for b in batches:
            score, passages = [], []
            for text in b.column(1).to_pylist():
                marks: list[dict] = []
                if cache is None:
                    score.append(model)
                else:
                    evidence, n, strong = model.judge(text, cache)
                    score.append(evidence)
                    if strong:
                        base = model.log_k + np.log(max(n, 1))
                        spans = [m.span() for m in WORDS.finditer(text)]
                        marks = [{"start": spans[a][0], "end": spans[z][1], "score": s,
                                  "e_value": float(np.exp(base - model.rate * s))} for a, z, s in strong]
                passages.append(marks)
            out = score if cache is None else model.probability(score)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(out, pa.float64()),
                                              "segments": pa.array(passages, kind)})

    return (only(docs, id=id_col, text=text_col)
            .select(F.col("id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 40_000, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, segments for every row of ``docs``."""
    model = fit(docs, labels, fit_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    return score_texts(docs, model, id_col, text_col).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "segments")


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = 40_000, id_col: str = "doc_id",
               text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; rows are judged where they are read."""
    model = fit(docs, labels, fit_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = None if isinstance(model, float) else WordWeights(model.tables)
        for b in batches:
            if cache is None:
                score = np.full(b.num_rows, model)
            else:
                score = model.probability([model.judge(t or "", cache)[0] for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)
