"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a budget of words.  Whole multiples of the source are
repeats of all its documents; the rest of the budget is filled by the
documents whose hash lies below a threshold.  Hashes are uniform and
fixed by the row's content, so reruns agree and a larger budget takes a
superset ("nested" thresholds).

The threshold is found without sorting: sum the words by source and hash
bucket (one partial aggregation), run a cumulative sum over a source's
``2^BITS`` buckets, and refine only the bucket in which the budget ends,
``BITS`` more hash bits at a time, until it holds a single hash.  The
document there does not fit any more; the words still missing are filled
the same way from the documents after it that are no longer than the gap.
Each such pass shrinks the gap; it ends when the gap is below
``TOLERANCE`` of the target or nothing fits, and a last document is taken
if that comes nearer to the target.

To the driver go one row per source and search step, never per document;
the histogram itself stays in Spark (at most 2^BITS rows a source).

Defined results: null text has size 0; null source is a source of its
own, ordered last; null or repeated doc_ids are kept row by row; rows equal
in doc_id, source and text are told apart by an occurrence number in the
hash, so any number of them can be taken; a source without words has target 0; an empty table gives no rows; extra
columns are never read (``apply_mix`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import WORD, apart, cut_lineage, only, text_or_empty

BITS = 12
HASH_BITS = 62
TOLERANCE = 1e-4
#: A source table of up to this many rows is sent to every task; a larger one is shuffled.
BROADCAST_SOURCES = 50_000


def row_hash(id_col: str, source_col: str, text_col: str) -> Column:
    """Uniform hash of a row's content in [0, 2^HASH_BITS)."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)), 64 - HASH_BITS)


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The narrow table all later steps read: doc_id, source, size in words, hash."""
    return only(docs, doc_id=id_col, source=source_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        row_hash("doc_id", "source", "text").alias("h"), F.monotonically_increasing_id().alias("at"))


def share_out(sizes: dict, weights, cap: float) -> dict:
    """Targets by weight (repeating over the sources in code-point order, null
    last) that share out all words; none above ``cap`` times its source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), list(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


@dataclass
class Search:
    """One source's fill so far.  A pass looks at rows with hash >= ``after``
    and size <= ``longest``; its boundary lies in [lo, lo + 2^bits)."""
    gap: float                                       # words still missing
    target: float
    longest: int = 1 << 62
    after: int = 0
    lo: int = 0
    bits: int = HASH_BITS
    below: int = 0                                   # words of this pass below lo
    rules: list = field(default_factory=list)        # (longest, low, high): rows taken

    def open(self) -> bool:
        return self.longest > 0 and self.after < 1 << HASH_BITS and self.gap > TOLERANCE * self.target

    def end_pass(self, high: int) -> None:
        """Take the pass's rows below ``high``; the next pass starts after it."""
        self.rules.append((self.longest, self.after, high))
        self.gap -= self.below
        self.longest, self.after = int(self.gap), high + 1
        self.lo, self.bits, self.below = 0, HASH_BITS, 0


RULES = "rules array<struct<longest:long,low:long,high:long>>"


def taken_by_rules() -> Column:
    """Whether one of the row's source's rules takes the row (columns rules, size, h)."""
    return F.exists("rules", lambda r: (F.col("size") <= r["longest"]) & (F.col("h") >= r["low"]) & (F.col("h") < r["high"]))


def with_sources(rows: DataFrame, values: list, schema: str) -> DataFrame:
    """``rows`` joined with one row of values per source (column s, null-safe)."""
    table = rows.sparkSession.createDataFrame(values, f"s string, {schema}")
    if len(values) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    return rows.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def narrow(rows: DataFrame, searches: dict) -> None:
    """One histogram over all open searches; each one's boundary gets BITS sharper."""
    bucket = F.expr("(h - lo) div step")
    hist = (with_sources(rows, [(k, s.lo, s.lo + (1 << s.bits), 1 << max(0, s.bits - BITS), s.after, s.longest,
                                 s.gap - s.below) for k, s in searches.items()],
                         "lo long, hi long, step long, after long, longest long, room double")
            .filter("h >= lo and h < hi and h >= after and size <= longest")
            .groupBy("source", bucket.alias("bucket"), "lo", "step", "room")
            .agg(F.sum("size").alias("n"), F.min("h").alias("first"), F.max("h").alias("last")))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    found = {r["source"]: r for r in hist.withColumn("upto", F.sum("n").over(run)).groupBy("source").agg(
        F.min(F.when(F.col("upto") > F.col("room"), F.struct("bucket", "first", "last"))).alias("edge"),
        F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))).alias("fits")).collect()}
    for k, s in searches.items():
        got = found.get(k)
        s.below += (got["fits"] or 0) if got else 0
        edge = got["edge"] if got else None
        if edge is None:                             # everything that was left fits
            s.end_pass(1 << HASH_BITS)
        elif edge["first"] == edge["last"]:
            s.end_pass(edge["first"])
        else:
            s.bits = max(0, s.bits - BITS)
            s.lo += edge["bucket"] << s.bits


def take_nearest(rows: DataFrame, searches: dict) -> None:
    """One more document for a source whose target that brings nearer."""
    short = [(k, s.gap, s.rules) for k, s in searches.items() if s.gap > TOLERANCE * s.target]
    if short:
        best = (with_sources(rows, short, f"gap double, {RULES}").filter(~taken_by_rules() & (F.col("size") > 0))
                .groupBy("source", "gap").agg(F.min(F.struct("size", "h")).alias("d"))
                .filter(F.col("d.size") < 2 * F.col("gap")).collect())
        for r in best:
            searches[r["source"]].rules.append((r["d"]["size"], r["d"]["h"], r["d"]["h"] + 1))


def mix_plan(rows: DataFrame, weights, max_repeats: int) -> list:
    """Per source: (source, source_size, target, whole repeats, rules)."""
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = share_out(sizes, weights, max_repeats)
    whole = {k: min(max_repeats, int(targets[k] // n)) if n else 1 for k, n in sizes.items()}
    searches = {k: Search(targets[k] - whole[k] * n if whole[k] < max_repeats else 0.0, targets[k])
                for k, n in sizes.items()}
    while live := {k: s for k, s in searches.items() if s.open()}:
        narrow(rows, live)
    take_nearest(rows, searches)
    return [(k, n, targets[k], whole[k], searches[k].rules) for k, n in sizes.items()]


def with_copies(rows: DataFrame, plan: list) -> DataFrame:
    """``rows`` (source, size, h, ...) with source_size, target and copies:
    how many times the mix takes the row (0..max_repeats)."""
    return (with_sources(rows, plan, f"source_size long, target double, whole int, {RULES}")
            .withColumn("copies", F.col("whole") + taken_by_rules().cast("int")).drop("whole", "rules"))


def source_mix(docs: DataFrame, weights=(5, 2, 1), max_repeats: int = 3, id_col: str = "doc_id",
               source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) for every row."""
    rows = apart(cut_lineage(sized(docs, id_col, source_col, text_col), "mix-sizes"), "h")
    return with_copies(rows, mix_plan(rows, weights, max_repeats)).withColumn(
        "taken", F.col("size") * F.col("copies")).drop("h", "at")


def apply_mix(docs: DataFrame, weights=(5, 2, 1), max_repeats: int = 3, id_col: str = "doc_id",
              source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as the mix takes it.

    A row's copies follow from its own source, size and hash, so the texts
    are not shuffled; the plan (one row a source) goes to them.  Only where rows
    repeat are the texts written once with the hashes that tell them apart (of
    rows that differ in other columns alone, any may be the ones taken)."""
    narrow_rows = cut_lineage(sized(docs, id_col, source_col, text_col), "mix-sizes")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    keyed = keyed.select("row", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
                         row_hash("doc_id", "source", "text").alias("h"))
    rows = apart(narrow_rows, "h")
    if rows is not narrow_rows:
        keyed = rows = apart(cut_lineage(keyed.withColumn("at", F.monotonically_increasing_id()), "mix-rows"), "h")
    taken = with_copies(keyed, mix_plan(rows, weights, max_repeats)).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
