"""Request telemetry over an event table ``(ts, endpoint, method, status_code, duration)``.

A15 average latency, A16 request totals, A17 cumulative latency
histogram, A18 quantile from a histogram (linear interpolation inside the
bucket), W4 instant counter rate, W5 range rate / quantile over sliding
windows, W6 alert held for a duration (gaps and islands, over steps or over the
intervals of a gauge), P21 endpoint
allow-list.  Everything aggregates first; windows then run over the
per-(series, bucket) or per-(series, step) rows, whose number depends on
the time span and bucket count, not on the number of requests.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import anchored_any

# Latency histogram upper bounds (seconds) of the request
# metric; +Inf is implicit.
LATENCY_BUCKETS = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)
INF = float("inf")


def allow_endpoints(df: DataFrame, endpoints, col: str = "endpoint") -> DataFrame:
    """Keep only the listed endpoints (an anchored alternation)."""
    return df.where(anchored_any(F.col(col), endpoints))


def request_totals(log: DataFrame, by=("endpoint", "method", "status_code")) -> DataFrame:
    """Request count per label set."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n_requests"))


def average_latency(log: DataFrame, duration: str = "duration") -> DataFrame:
    """sum/count per (endpoint, method) series, then averaged over the series of an endpoint."""
    per = log.groupBy("endpoint", "method").agg((F.sum(duration) / F.count(F.lit(1))).alias("_avg"))
    return per.groupBy("endpoint").agg(F.avg("_avg").alias("avg_latency"))


def latency_histogram(log: DataFrame, bounds=LATENCY_BUCKETS, by=("endpoint",),
                      duration: str = "duration") -> DataFrame:
    """Cumulative bucket counts ``(by..., le, cum_count)``; ``le = +Inf`` is the total."""
    les = [*bounds, INF]
    row = log.groupBy(*by).agg(*[F.count_if(F.col(duration) <= F.lit(le)).alias(f"_b{i}")
                                 for i, le in enumerate(les)])
    cells = [F.struct(F.lit(le).cast("double").alias("le"), F.col(f"_b{i}").cast("long").alias("cum_count"))
             for i, le in enumerate(les)]
    return row.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")


def histogram_quantile(hist: DataFrame, q: float, by=("endpoint",), le: str = "le",
                       cum: str = "cum_count") -> DataFrame:
    """Quantile from cumulative buckets, as the alert rule computes it.

    rank = q * total; the first bucket whose cumulative count reaches the
    rank is interpolated linearly between its lower and upper bound (the
    lower bound of the first bucket is 0).  If that bucket is +Inf the
    upper bound of the last finite bucket is returned; no observations ->
    NULL.  Windows run over the bucket rows of each series.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(le)
    h = (hist.withColumn("_prev_le", F.lag(le).over(w))
             .withColumn("_prev_cum", F.coalesce(F.lag(cum).over(w), F.lit(0)))
             .withColumn("_total", F.max(cum).over(Window.partitionBy(*by))))
    h = h.withColumn("_rank", F.lit(float(q)) * F.col("_total"))
    hit = (F.col(cum) >= F.col("_rank")) & (F.col("_total") > 0)
    # one aggregate per series: the first bucket reaching the rank (min_by skips NULL keys)
    first = h.groupBy(*by).agg(F.min_by(F.struct(le, cum, "_prev_le", "_prev_cum", "_rank"),
                                        F.when(hit, F.col(le))).alias("b"))
    lo = F.coalesce(F.col("b._prev_le"), F.lit(0.0))
    hi = F.col(f"b.{le}")
    n = F.col(f"b.{cum}") - F.col("b._prev_cum")
    val = F.when(F.isnan(hi) | (hi == F.lit(INF)), F.col("b._prev_le")) \
        .when(n == 0, hi).otherwise(lo + (hi - lo) * (F.col("b._rank") - F.col("b._prev_cum")) / n)
    return first.select(*by, val.alias("quantile"))


def bucket_counts(bounds, duration: str = "duration") -> list:
    """Cumulative bucket counts as aggregate expressions (``le`` ascending, +Inf last)."""
    return [F.count_if(F.col(duration) <= F.lit(b)) for b in [*bounds, INF]]


def quantile_from_counts(cum: Column, bounds, q: float) -> Column:
    """A18 on an array of cumulative counts aligned with ``bounds`` + [+Inf]."""
    les = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    total = F.element_at(cum, -1)
    rank = F.lit(float(q)) * total
    idx = F.array_position(F.transform(cum, lambda c: c >= rank), True)   # 1-based, first hit
    hi = F.element_at(les, idx.cast("int"))
    prev_le = F.when(idx > 1, F.element_at(les, (idx - 1).cast("int")))
    prev_c = F.when(idx > 1, F.element_at(cum, (idx - 1).cast("int"))).otherwise(F.lit(0))
    n = F.element_at(cum, idx.cast("int")) - prev_c
    lo = F.coalesce(prev_le, F.lit(0.0))
    val = F.when(hi == F.lit(float("inf")), prev_le).when(n == 0, hi) \
        .otherwise(lo + (hi - lo) * (rank - prev_c) / n)
    return F.when(total > 0, val)


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def interval_seconds(text: str) -> int:
    """Seconds of an interval such as ``"5 minutes"`` (seconds to days)."""
    n, unit = text.split()
    return int(n) * _UNIT_SECONDS[unit.lower().rstrip("s")]


def windowed_latency(log: DataFrame, q: float = 0.95, window: str = "5 minutes", slide: str = "1 minute",
                     bounds=LATENCY_BUCKETS, window_seconds: int | None = None, ts: str = "ts",
                     duration: str = "duration") -> DataFrame:
    """W5 + A17 + A18: per (sliding window, endpoint) request rate and histogram quantile.

    The log is aggregated once, into panes (the longest interval that divides both
    window and slide): one row of cumulative bucket counts per (pane, endpoint), combined
    before the shuffle.  Every pane row then goes to the windows that cover it and the
    counts are added, so what is multiplied by window / slide is pane rows, not requests.
    Rate and quantile are read off the same counts.  Rows without a time are in no window,
    rows without a duration count for the rate alone.
    """
    length, step = interval_seconds(window), interval_seconds(slide)
    if step > length:
        raise ValueError(f"slide {slide} is longer than window {window}")
    pane = math.gcd(length, step)
    counts = [c.alias(f"_c{i}") for i, c in enumerate(bucket_counts(bounds, duration))]
    panes = log.groupBy(F.window(ts, f"{pane} seconds").alias("_pane"), "endpoint").agg(F.count(F.lit(1)).alias("_n"), *counts)
    back = F.explode(F.array(*[F.lit(k * pane) for k in range(length // pane)]))
    starts = panes.withColumn("_back", back).withColumn(
        "window_start", F.col("_pane.start") - F.make_dt_interval(secs=F.col("_back").cast("decimal(18,6)")))
    if step != pane:                                      # windows start at multiples of the slide only
        starts = starts.where(F.window("window_start", f"{step} seconds")["start"] == F.col("window_start"))
    sums = [F.sum(f"_c{i}") for i in range(len(counts))]
    per = starts.groupBy("window_start", "endpoint").agg(F.sum("_n").alias("_n"), F.array(*sums).alias("_cum"))
    return per.select(
        "window_start", (F.col("window_start") + F.make_dt_interval(secs=F.lit(length).cast("decimal(18,6)"))).alias("window_end"),
        "endpoint", (F.col("_n") / F.lit(float(window_seconds or length))).alias("rate"),
        quantile_from_counts(F.col("_cum"), bounds, q).alias("p_quantile"))


def _epoch_seconds(c):
    return (F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def counter_samples(log: DataFrame, step_seconds: int = 60, ts: str = "ts", by=("endpoint",)) -> DataFrame:
    """Cumulative request counter per series sampled at the end of each step
    (only steps with traffic produce a sample)."""
    t = _epoch_seconds(F.col(ts))
    per = log.groupBy(*by, (F.floor(t / step_seconds) * step_seconds + step_seconds).alias("sample_ts")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("sample_ts").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("counter", F.sum("_n").over(w)).drop("_n")


def instant_rate(samples: DataFrame, by=("endpoint",), value: str = "counter", t: str = "sample_ts") -> DataFrame:
    """Per-second rate from the last two samples of each series (reset-aware)."""
    w = Window.partitionBy(*by).orderBy(t)
    s = samples.withColumn("_pv", F.lag(value).over(w)).withColumn("_pt", F.lag(t).over(w))
    delta = F.when(F.col(value) < F.col("_pv"), F.col(value)).otherwise(F.col(value) - F.col("_pv"))
    s = s.withColumn("irate", delta / (F.col(t) - F.col("_pt")))
    last = s.where(F.col("_pv").isNotNull()).groupBy(*by).agg(F.max_by(F.struct(t, "irate"), F.col(t)).alias("x"))
    return last.select(*by, F.col(f"x.{t}").alias("last_sample_ts"), F.col("x.irate").alias("irate"))


def alert_islands(cond: DataFrame, step_seconds: int, hold_seconds: int, by=("endpoint",),
                  t: str = "step_ts", flag: str = "firing_cond") -> DataFrame:
    """Runs of consecutive evaluation steps with the condition true.

    Each run gets its start/end; the alert fires once the condition has
    held for ``hold_seconds`` (``end - start >= hold``), i.e. the first
    firing step is ``start + hold``.  Missing steps count as false.
    """
    by = list(by)
    on = cond.where(F.col(flag))
    idx = (F.col(t) / F.lit(step_seconds)).cast("long")
    w = Window.partitionBy(*by).orderBy(t)
    on = on.withColumn("_island", idx - F.row_number().over(w))
    isl = on.groupBy(*by, "_island").agg(F.min(t).alias("start_ts"), F.max(t).alias("end_ts"),
                                         F.count(F.lit(1)).alias("n_steps"))
    return isl.select(*by, "start_ts", "end_ts", "n_steps",
                      (F.col("end_ts") - F.col("start_ts")).alias("held_seconds"),
                      (F.col("end_ts") - F.col("start_ts") >= hold_seconds).alias("fired"),
                      F.when(F.col("end_ts") - F.col("start_ts") >= hold_seconds,
                             F.col("start_ts") + hold_seconds).alias("first_firing_ts"))


def gauge_alerts(gauge: DataFrame, firing, step_seconds: int, hold_seconds: int, until: int,
                 by=("model_name",), start: str = "start_ts", end: str = "end_ts", value: str = "value") -> DataFrame:
    """W6 over a gauge given as intervals ``[start, end)`` in epoch seconds (``end`` NULL: still open).

    The condition ``firing(value)`` is evaluated at every multiple of ``step_seconds`` up to
    ``until``; a step with no gauge is false.  The steps inside an interval are counted, not
    listed, so the work depends on the number of changes of the gauge only.  Each run of true
    steps gets its start, end, lowest value and the first step at which it has held for
    ``hold_seconds`` (NULL if it never has).
    """
    step = F.lit(step_seconds)
    last = F.coalesce(F.least(F.col(end), F.lit(until + 1)), F.lit(until + 1))
    on = gauge.withColumns({"_lo": F.ceil(F.col(start) / step), "_hi": F.ceil(last / step) - 1}) \
        .where(firing(F.col(value)) & (F.col("_lo") <= F.col("_hi")))
    w = Window.partitionBy(*by).orderBy("_lo")
    broken = F.coalesce((F.lag("_hi").over(w) + 1 != F.col("_lo")).cast("int"), F.lit(0))
    runs = on.withColumn("_new", broken).withColumn("_run", F.sum("_new").over(w)).groupBy(*by, "_run").agg(
        (F.min("_lo") * step).alias("start_ts"), (F.max("_hi") * step).alias("end_ts"),
        F.sum(F.col("_hi") - F.col("_lo") + 1).alias("n_steps"), F.min(value).alias("lowest_value"))
    held = F.col("end_ts") - F.col("start_ts")
    first = F.col("start_ts") + -(-hold_seconds // step_seconds) * step_seconds
    return runs.select(*by, "start_ts", "end_ts", "n_steps", "lowest_value", held.alias("held_seconds"),
                       (held >= hold_seconds).alias("fired"), F.when(held >= hold_seconds, first).alias("first_firing_ts"))


def latency_alerts(log: DataFrame, threshold: float, hold_seconds: int, q: float = 0.95,
                   window: str = "5 minutes", slide: str = "1 minute", step_seconds: int = 60,
                   bounds=LATENCY_BUCKETS, window_seconds: int | None = None) -> DataFrame:
    """W5 + A18 + W6: p-quantile over a sliding window above ``threshold`` for ``hold_seconds``."""
    wl = windowed_latency(log, q, window, slide, bounds, window_seconds)
    cond = wl.select("endpoint", _epoch_seconds(F.col("window_end")).alias("step_ts"),
                     (F.col("p_quantile") > threshold).alias("firing_cond"))
    return alert_islands(cond, step_seconds, hold_seconds)
