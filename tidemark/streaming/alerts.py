"""Alert held for a duration, as a stateful stream.

A step older than the last one seen for its endpoint cannot be merged any
more; it is emitted as a row with ``n_steps = 0`` (``late_steps`` reads
them), also when no run is open, so the order in which files arrive never
starts a run in the past.  A repeated step is ignored.

Input: per (endpoint, evaluation step) the alert condition (e.g. the T2
output).  State per endpoint is the open run of consecutive true steps;
each micro-batch emits the runs it closed and the current open run
(output mode *update*); the ``foreachBatch`` writer stores them by
batch id and readers keep the latest row per (endpoint, start_ts).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT_SCHEMA = "endpoint string, start_ts long, end_ts long, n_steps long"
STATE_SCHEMA = "start_ts long, last_ts long, n long"


def _islands(step: int):
    def fn(key, pdfs, state):
        start = last = n = None
        if state.exists:
            start, last, n = state.get
        rows = pd.concat(list(pdfs)).sort_values("step_ts")
        out = []
        for t, c in zip(rows["step_ts"].tolist(), rows["firing_cond"].tolist()):
            if last is not None and t <= last:
                if t < last and c:
                    out.append((key[0], t, t, 0))         # late: reported, not merged
                continue
            if c:
                if start is not None and t == last + step:
                    last, n = t, n + 1
                else:
                    if start is not None:
                        out.append((key[0], start, last, n))
                    start, last, n = t, t, 1
            else:
                if start is not None:
                    out.append((key[0], start, last, n))
                start, last, n = None, t, None
        if start is not None:
            out.append((key[0], start, last, n))
        state.update((start, last, n))
        yield pd.DataFrame(out, columns=["endpoint", "start_ts", "end_ts", "n_steps"])
    return fn


def alert_runs_stream(cond: DataFrame, step_seconds: int) -> DataFrame:
    """cond: (endpoint, step_ts long, firing_cond boolean) streaming frame."""
    return cond.groupBy("endpoint").applyInPandasWithState(
        _islands(step_seconds), OUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def latest_runs(df: DataFrame, hold_seconds: int) -> DataFrame:
    """Reader side: the last update of each run, plus the firing decision."""
    df = df.where(F.col("n_steps") > 0)
    last = df.groupBy("endpoint", "start_ts").agg(F.max_by(F.struct("end_ts", "n_steps"), F.col("n_steps")).alias("x"))
    held = F.col("x.end_ts") - F.col("start_ts")
    return last.select("endpoint", "start_ts", F.col("x.end_ts").alias("end_ts"), F.col("x.n_steps").alias("n_steps"),
                       held.alias("held_seconds"), (held >= hold_seconds).alias("fired"),
                       F.when(held >= hold_seconds, F.col("start_ts") + hold_seconds).alias("first_firing_ts"))


def late_steps(df: DataFrame) -> DataFrame:
    """Reader side: firing steps that arrived after a later step of their endpoint."""
    return df.where(F.col("n_steps") == 0).select("endpoint", F.col("start_ts").alias("step_ts"))
