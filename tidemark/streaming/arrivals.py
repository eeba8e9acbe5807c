"""Incremental arrival -> next cumulative split -> drift -> retrain decision.

New training rows land in a folder; each micro-batch appends them to the
cumulative table and reduces them to additive counts: rows and positives
per year, and rows per (year, column, value).  Every newly complete year
then gets its split (W2, A13), its drift against the reference split
(D2-D8) and its retrain decision (D9) from counts alone:

* a split's counts are the running sum ``upto`` kept with an earlier
  decision, plus the counts of the batches since (late rows of older years
  included), so a batch reads its own rows and distinct values, never the
  cumulative table or the counts of every batch before;
* the reference split's counts are its own running sum plus its late rows.

All outputs, the catalog rows included, are written into ``batch_id=N``
(running sums: ``end_year=Y``) folders with overwrite.  A split is finished
once its decision is written, not once it is in the catalog: a batch
replayed after a failure between the two rewrites its catalog rows and
running sums and decides.  Only running sums named by a written decision
are read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import splits as sp
from tidemark.sources import io as sio


class SplitDecisionWriter:
    """``foreachBatch`` callable; ``base`` holds cum/, years/, counts/, upto/, catalog/ and decisions/.

    A year is complete once a later year has arrived (event-time
    completeness); ``flush()`` at end of input completes the last year.
    Rows without a year go to the cumulative table only.
    """

    def __init__(self, base: str, year_col: str, label: str, numeric, categorical, n_test: int,
                 reference_split: int = 1, opts: dr.DriftOptions = dr.DriftOptions()):
        self.base, self.year_col, self.label = base, year_col, label
        self.numeric, self.categorical, self.n_test = list(numeric), list(categorical), n_test
        self.reference_split, self.opts = reference_split, opts
        self.cum_path, self.cat_path, self.dec_path = f"{base}/cum", f"{base}/catalog", f"{base}/decisions"
        self.years_path, self.counts_path, self.upto_path = f"{base}/years", f"{base}/counts", f"{base}/upto"
        self.kinds = {k: (c, t) for k, c, t in (("num", self.numeric, "double"), ("cat", self.categorical, "string")) if c}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, part = batch.sparkSession, f"batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(f"{self.cum_path}/{part}")
        rows = spark.read.parquet(f"{self.cum_path}/{part}").where(F.col(self.year_col).isNotNull())
        sp.year_label_counts(rows, self.year_col, self.label).write.mode("overwrite").parquet(f"{self.years_path}/{part}")
        for kind, (cols, value_type) in self.kinds.items():
            dr.yearly_values(rows, self.year_col, cols, value_type) \
                .write.mode("overwrite").parquet(f"{self.counts_path}/{kind}/{part}")
        self._advance(spark, str(batch_id), final=False)

    def flush(self, spark) -> None:
        self._advance(spark, "final", final=True)

    def _decided(self, spark) -> dict:
        """End year -> last batch in its running sum (None: no sum kept), of every written decision."""
        try:
            rows = spark.read.parquet(self.dec_path).select("end_year", "upto_batch").collect()   # one row per split
        except AnalysisException as e:
            if not sio.missing_path(e):
                raise
            return {}
        return {r["end_year"]: r["upto_batch"] for r in rows}

    def _since(self, spark, kind: str, seen: list, upto: int, start: int | None, marker: int | None) -> DataFrame:
        """Counts up to year ``upto``: the running sum of year ``start`` and what came after batch ``marker``.

        Counts in the sum, and late ones of its years, stand under year ``start``.  Only the batches
        that hold such counts are read (``seen``: one row per batch and year)."""
        y = F.col("year")
        fresh = lambda r: r["y"] <= upto and (start is None or r["y"] > start or r["b"] > marker)
        batches = sorted({r["b"] for r in seen if fresh(r)})
        table = spark.read.parquet(f"{self.counts_path}/{kind}")
        if start is None:
            return table.where(F.col("batch_id").isin(batches) & (y <= upto)).drop("batch_id")
        later = table.where(F.col("batch_id").isin(batches) & (y <= upto) & ((y > start) | (F.col("batch_id") > marker)))
        summed = spark.read.parquet(f"{self.upto_path}/{kind}/end_year={start}")
        return later.drop("batch_id").withColumn("year", F.greatest(y, F.lit(start))) \
            .unionByName(summed.withColumn("year", F.lit(start)))

    def _advance(self, spark, tag: str, final: bool) -> None:
        """Create every newly complete split and decide on it: catalog rows from
        the per-year counts (W2/A13) and one drift pass for all new splits together."""
        try:
            years_table = spark.read.parquet(self.years_path)
        except AnalysisException as e:
            if not sio.missing_path(e):
                raise
            return                                         # nothing arrived yet
        seen = years_table.select(F.col(self.year_col).alias("y"), F.col("batch_id").alias("b")).collect()  # a row per batch and year
        years = sorted({r["y"] for r in seen})
        complete = years if final else years[:-1]
        have = self._decided(spark)
        new = [y for y in complete if y not in have]
        if not new:
            return
        upto, marker = max(new), max(r["b"] for r in seen)
        per_year = years_table.groupBy(self.year_col).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_pos"))
        summ = sp.summary_of_year_counts(per_year.where(F.col(self.year_col) <= upto), self.n_test, self.year_col) \
            .where(F.col("end_year").isin(*new))
        sio.append_catalog(summ, self.cat_path, tag)
        cat = sio.read_catalog(spark, self.cat_path)
        bounds = cat.select("split_id", "start_year", "end_year").collect()        # one row per split
        ref = [r for r in bounds if r["split_id"] == self.reference_split]
        if not ref:
            raise ValueError(f"reference split {self.reference_split} not in catalog")
        ref_end = ref[0]["end_year"]
        kept = {y: b for y, b in have.items() if b is not None}
        start = max((y for y in kept if y < min(new)), default=None)
        sides = {}
        for kind in self.kinds:
            counts = self._since(spark, kind, seen, upto, start, kept.get(start))
            if ref_end in kept:
                reference = self._since(spark, kind, seen, ref_end, ref_end, kept[ref_end])
            else:
                reference = self._since(spark, kind, seen, ref_end, None, None)
            for y in {upto} | ({ref_end} & set(new)):
                counts.where(F.col("year") <= y).groupBy("column_name", "value").agg(F.sum("n").alias("n")) \
                    .write.mode("overwrite").parquet(f"{self.upto_path}/{kind}/end_year={y}")
            sides[kind] = counts, reference.drop("year")
        per = dr.drift_from_year_counts(
            [r for r in bounds if r["end_year"] in new], {c: k for k, (cols, _) in self.kinds.items() for c in cols},
            sides.get("num"), sides.get("cat"), self.opts, size_rule=True)
        dec = dr.split_decisions(per, self.reference_split, self.opts)
        out = dec.join(cat.select("split_id", "years", "end_year"), "split_id") \
            .withColumn("reference_split", F.lit(self.reference_split)) \
            .withColumn("upto_batch", F.when(F.col("end_year").isin(*({upto} | ({ref_end} & set(new)))), F.lit(marker)))
        out.select("split_id", "years", "end_year", "reference_split", "number_of_drifted_columns",
                   "share_of_drifted_columns", "severity", "retrain", "decision_reason", "upto_batch") \
            .write.mode("overwrite").parquet(f"{self.dec_path}/batch_id={tag}")
