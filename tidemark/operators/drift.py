"""Distribution drift between a reference and a current frame.

Both frames are unpivoted to ``(side, column_name, value)`` and reduced to
counts per (column, value) -- one shuffle whose size is the number of
distinct values, not rows.  Every statistic is computed from those counts:

* numeric: Wasserstein-1 / max(std_pop(ref), 0.001)  (drift if >= 0.1)
           two-sample Kolmogorov-Smirnov (drift if p < 0.05)
* categorical: Jensen-Shannon distance, natural log (drift if >= 0.1)
           chi-square goodness of fit vs. scaled reference counts,
           two-proportion z-test for binary columns (drift if p < 0.05)

The default test per column follows the size rule: reference above
``small_sample_limit`` rows -> Wasserstein / Jensen-Shannon, else KS /
chi-square (z for two values); numeric columns with at most
``few_values`` distinct values are tested as categorical.  All of these
are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import chi2_sf, ks_pvalue, norm_two_sided
from tidemark.operators.joins import join_small
from tidemark.operators.ordered import ordered_prefix
from tidemark.session import cut_lineage


# Distinct values per ordered-prefix window partition at most (on average).


@dataclass(frozen=True)
class DriftOptions:
    num_threshold: float = 0.1          # Wasserstein (normalised)
    cat_threshold: float = 0.1          # Jensen-Shannon distance
    p_threshold: float = 0.05           # KS / chi-square / z
    small_sample_limit: int = 1000      # reference rows at or below -> p-value tests
    exact_ks_rows: int = 10_000         # the small-sample KS p-value is exact up to so many rows of the larger side
    few_values: int = 5                 # numeric with <= this many distinct values -> categorical
    zero_fill: float = 0.0001           # empty category share in Jensen-Shannon
    std_floor: float = 0.001            # Wasserstein normaliser floor
    drift_share: float = 0.02           # retrain / alert threshold on the share of drifted columns


def _long(ref: DataFrame, cur: DataFrame, cols, value_type: str) -> DataFrame:
    def side(df, s):
        casted = df.select(*[F.col(c).cast(value_type).alias(c) for c in cols])
        return casted.unpivot([], list(cols), "column_name", "value").withColumn("_side", F.lit(s))
    return side(ref, 0).unionByName(side(cur, 1)).where(F.col("value").isNotNull())


def value_counts_by_side(ref: DataFrame, cur: DataFrame, cols, value_type: str) -> DataFrame:
    """(column_name, value, n_ref, n_cur): the one shuffle all tests share."""
    return _long(ref, cur, cols, value_type).groupBy("column_name", "value").agg(
        F.count_if(F.col("_side") == 0).alias("n_ref"), F.count_if(F.col("_side") == 1).alias("n_cur"))


def _totals(vc: DataFrame) -> DataFrame:
    return vc.groupBy("column_name").agg(
        F.sum("n_ref").alias("tot_ref"), F.sum("n_cur").alias("tot_cur"),
        F.count(F.lit(1)).alias("n_unique"))


def numeric_tests(vc: DataFrame, opts: DriftOptions = DriftOptions(), n_cols: int | None = None) -> DataFrame:
    """Wasserstein (normalised) and KS per numeric column from value counts (column_name, value, n_ref, n_cur)."""
    return numeric_tests_by_side(vc, ["n_cur"], opts, n_cols).drop("side")


def numeric_tests_by_side(vc: DataFrame, sides: list, opts: DriftOptions = DriftOptions(), n_cols: int | None = None) -> DataFrame:
    """Wasserstein and KS of each current side against the reference: one row per column and ``side`` (its place).

    ``vc``: one row per (column_name, value) with ``n_ref`` and a count column for each of ``sides``; the values
    are ordered once for all sides.  A value that neither the reference nor a side holds changes nothing there.
    ``n_cols`` (number of tested columns) bounds the per-column tables, so
    they are broadcast without a counting job.  The KS p-value is exact where
    it decides (few reference rows) and the other side is not too long.
    """
    # one pass over the value counts: totals and reference mean per column
    stats = vc.groupBy("column_name").agg(
        F.sum("n_ref").alias("tot_ref"), (F.sum(F.col("value") * F.col("n_ref")) / F.sum("n_ref")).alias("_mean"),
        *[F.sum(c).alias(f"_tot_{i}") for i, c in enumerate(sides)],
        *[F.count_if(F.col("n_ref") + F.col(c) > 0).alias(f"_unique_{i}") for i, c in enumerate(sides)])
    d = join_small(ordered_prefix(vc, ["column_name"], "value", ["n_ref", *sides]), stats, on=["column_name"], bound=n_cols)
    fr = F.col("cum_n_ref") / F.col("tot_ref")
    gap = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    found = []
    for i, c in enumerate(sides):
        apart = F.abs(fr - F.when(F.col(f"_unique_{i}") > 0, F.col(f"cum_{c}") / F.col(f"_tot_{i}")))
        upto = F.col("cum_n_ref") + F.col(f"cum_{c}")
        outside = (upto == 0) | (upto == F.col("tot_ref") + F.col(f"_tot_{i}"))      # before the first or from the last value on
        found += [F.sum(F.when(outside, F.lit(0.0)).otherwise(apart * gap)).alias(f"_w_{i}"), F.max(apart).alias(f"_ks_{i}"),
                  F.first(f"_tot_{i}").alias(f"_n_{i}"), F.first(f"_unique_{i}").alias(f"_u_{i}")]
    agg = d.groupBy("column_name").agg(
        F.sqrt(F.sum(F.col("n_ref") * (F.col("value") - F.col("_mean")) ** 2) / F.sum("n_ref")).alias("ref_std"),
        F.first("tot_ref").alias("n_ref"), *found)
    each = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"_n_{i}").alias("n_cur"), F.col(f"_u_{i}").alias("n_unique"),
                              F.col(f"_ks_{i}").alias("ks_statistic"), F.col(f"_w_{i}").alias("wasserstein"))
                     for i in range(len(sides))])
    agg = agg.select("column_name", "n_ref", "ref_std", F.inline(each)).where(F.col("n_unique") > 0)
    return agg.select(
        "column_name", "side", "n_ref", "n_cur", "n_unique", "ks_statistic",
        (F.col("wasserstein") / F.greatest(F.col("ref_std"), F.lit(opts.std_floor))).alias("wasserstein_norm"),
        ks_pvalue(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur"),
                  (F.col("n_ref") <= opts.small_sample_limit) & (F.col("n_cur") <= opts.exact_ks_rows)).alias("ks_pvalue"))


def categorical_tests(vc: DataFrame, opts: DriftOptions = DriftOptions(), with_pvalues: bool = True,
                      n_cols: int | None = None, p_limit: int | None = None) -> DataFrame:
    """Jensen-Shannon distance, chi-square statistic (and z for binary) per column.

    ``p_limit``: p-values only for columns with at most so many reference
    rows, null for the others.
    """
    tot = _totals(vc)
    d = join_small(vc, tot, on=["column_name"], bound=n_cols)
    p = F.when(F.col("n_ref") == 0, F.lit(opts.zero_fill)).otherwise(F.col("n_ref") / F.col("tot_ref"))
    q = F.when(F.col("n_cur") == 0, F.lit(opts.zero_fill)).otherwise(F.col("n_cur") / F.col("tot_cur"))
    d = d.withColumn("_p", p).withColumn("_q", q)
    norm = d.groupBy("column_name").agg(F.sum("_p").alias("_sp"), F.sum("_q").alias("_sq"),
                                        F.min("value").alias("_vmin"))
    d = join_small(d, norm, on=["column_name"], bound=n_cols)
    pn, qn = F.col("_p") / F.col("_sp"), F.col("_q") / F.col("_sq")
    m = (pn + qn) / 2
    expected = F.col("n_ref") * F.col("tot_cur") / F.col("tot_ref")
    chi = F.when(expected == 0, F.when(F.col("n_cur") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))) \
        .otherwise((F.col("n_cur") - expected) ** 2 / expected)
    # z-test: share of the smallest category value on each side
    d = d.withColumn("_first", F.col("value") == F.col("_vmin"))
    agg = d.groupBy("column_name").agg(
        F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(pn * F.log(pn / m)) + 0.5 * F.sum(qn * F.log(qn / m))))
        .alias("jensen_shannon"),
        F.sum(chi).alias("chi_square"),
        F.first("tot_ref").alias("n_ref"), F.first("tot_cur").alias("n_cur"),
        F.first("n_unique").alias("n_unique"),
        F.max(F.when(F.col("_first"), F.col("n_ref"))).alias("_x1"),
        F.max(F.when(F.col("_first"), F.col("n_cur"))).alias("_x2"))
    out = agg.select("column_name", "n_ref", "n_cur", "n_unique", "jensen_shannon", "chi_square",
                     (F.col("n_unique") - 1).cast("int").alias("chi_dof"), "_x1", "_x2")
    if with_pvalues:
        asked = F.lit(True) if p_limit is None else F.col("n_ref") <= p_limit
        p1, p2 = F.try_divide("_x1", "n_ref"), F.try_divide("_x2", "n_cur")   # null when a side has no rows
        pp = F.try_divide(F.col("_x1") + F.col("_x2"), F.col("n_ref") + F.col("n_cur"))
        se = F.sqrt(pp * (1 - pp) * (F.try_divide(F.lit(1), F.col("n_ref")) + F.try_divide(F.lit(1), F.col("n_cur"))))
        z = F.when(asked, F.when(se == 0, F.lit(0.0)).otherwise((p1 - p2) / se))
        chi = F.when(asked, F.col("chi_square"))
        out = out.withColumn("chi_pvalue", chi2_sf(chi, F.col("chi_dof").cast("double"))) \
                 .withColumn("z_pvalue", norm_two_sided(z))
    return out.drop("_x1", "_x2")


def _choose(per_column: DataFrame, opts: DriftOptions, size_rule: bool) -> DataFrame:
    """``stattest``, ``drift_score`` and ``drift_detected`` of each column, by the
    size rule or, without it, by the large-sample tests whatever the size."""
    small = (F.col("n_ref") <= opts.small_sample_limit) & F.lit(size_rule)
    as_cat = (F.col("kind") == "cat") | (F.col("n_unique") <= opts.few_values)
    binary = F.col("n_unique") <= 2
    test = (F.when(~as_cat & small, "ks").when(~as_cat, "wasserstein")
            .when(small & binary, "z").when(small, "chisquare").otherwise("jensenshannon"))
    score = (F.when(test == "ks", F.col("ks_pvalue")).when(test == "wasserstein", F.col("wasserstein_norm"))
             .when(test == "z", F.col("z_pvalue")).when(test == "chisquare", F.col("chi_pvalue"))
             .otherwise(F.col("jensen_shannon")))
    out = per_column.withColumn("stattest", test).withColumn("drift_score", score)
    drifted = (F.when(F.col("stattest").isin("ks", "z", "chisquare"), F.col("drift_score") < opts.p_threshold)
               .when(F.col("stattest") == "wasserstein", F.col("drift_score") >= opts.num_threshold)
               .otherwise(F.col("drift_score") >= opts.cat_threshold))
    return out.withColumn("drift_detected", drifted)


def column_drift(ref: DataFrame, cur: DataFrame, numeric, categorical,
                 opts: DriftOptions = DriftOptions(), with_pvalues: bool = True,
                 size_rule: bool | None = None) -> DataFrame:
    """One row per column with the selected test, its score and the drift flag.

    Numeric columns with few distinct values are re-tested as categorical,
    so both numeric and categorical statistics are computed for numeric
    columns (from the same counts) and the rule picks one.  ``with_pvalues``
    shows the categorical p-values of all columns; without it they are
    computed just where the rule asks for them.  ``size_rule`` (by default
    as ``with_pvalues``) lets the reference side's size choose the test.
    """
    size_rule = with_pvalues if size_rule is None else size_rule
    numeric, categorical = list(numeric), list(categorical)
    p_limit = None if with_pvalues else opts.small_sample_limit if size_rule else -1
    parts = []
    if numeric:
        # written: every test and the ranges of the ordered values read them
        nvc = cut_lineage(value_counts_by_side(ref, cur, numeric, "double"), "value-counts")
        nt = numeric_tests(nvc, opts, len(numeric))
        few = _totals(nvc).where(F.col("n_unique") <= opts.few_values).select("column_name")
        nvc_few = nvc.join(few, on="column_name", how="left_semi")
        ncat = categorical_tests(nvc_few.withColumn("value", F.col("value").cast("string")), opts, True,
                                 len(numeric), p_limit) \
            .select("column_name", "jensen_shannon", "chi_square", "chi_dof", "chi_pvalue", "z_pvalue")
        parts.append(nt.join(ncat, on="column_name", how="left").withColumn("kind", F.lit("num")))
    if categorical:
        cvc = value_counts_by_side(ref, cur, categorical, "string")
        ct = categorical_tests(cvc, opts, True, len(categorical), p_limit).withColumn("kind", F.lit("cat"))
        for c in ("ks_statistic", "wasserstein_norm", "ks_pvalue"):
            ct = ct.withColumn(c, F.lit(None).cast("double"))
        parts.append(ct)
    allc = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    out = _choose(allc, opts, size_rule)
    return out if with_pvalues else out.drop("chi_pvalue", "z_pvalue")


def dataset_summary(per_column: DataFrame) -> DataFrame:
    """Number / share of drifted columns; dataset drift = share > 0 (the reference's override)."""
    return per_column.agg(
        F.count(F.lit(1)).alias("number_of_columns"),
        F.count_if(F.col("drift_detected")).alias("number_of_drifted_columns"),
        (F.count_if(F.col("drift_detected")) / F.count(F.lit(1))).alias("share_of_drifted_columns")
    ).withColumn("dataset_drift", F.col("share_of_drifted_columns") > 0)


def alert_level(share: F.Column, drift: F.Column, threshold: float = 0.02) -> F.Column:
    """OK / INFO / WARNING / CRITICAL (critical at twice the threshold)."""
    return (F.when(~drift, "OK").when(share >= 2 * threshold, "CRITICAL")
            .when(share >= threshold, "WARNING").otherwise("INFO"))


def alert_text(n_drifted: F.Column, share: F.Column, drift: F.Column, threshold: float = 0.02) -> tuple:
    """The alert's message and recommendation (fixed texts, percentages to one digit, ties to even)."""
    percent = F.format_string("%.1f", F.bround(share * 100, 1))
    low, high = f"{threshold * 100:.0f}", f"{threshold * 200:.0f}"
    message = F.when(~drift, "No data drift detected").otherwise(
        F.format_string("Data drift detected in %d columns (%s%%)", n_drifted, percent))
    advice = (F.when(~drift, "Continue monitoring")
              .when(share >= 2 * threshold, f"SEVERE DRIFT DETECTED (>{high}%) - Training triggered, immediate investigation recommended.")
              .when(share >= threshold, f"DRIFT DETECTED (≥{low}%) - Training triggered, monitoring recommended.")
              .otherwise(f"MINOR DRIFT (<{low}%) - Below training threshold, continue monitoring."))
    return message, advice


def check_against_production(df: DataFrame, catalog: DataFrame, state: DataFrame, runs: DataFrame, current_split: int,
                             year_col: str, numeric, categorical, run_ts, opts: DriftOptions = DriftOptions(),
                             with_pvalues: bool = True, size_rule: bool | None = None) -> DataFrame:
    """D1 -> S3 -> D11 -> D8: the drift of ``current_split`` against the split that the registry's
    production model was trained on (split 1 without one), with the alert's texts and ``run_ts``."""
    reference = reference_split_id(state, runs)
    report = check_drift_for_split(df, catalog, reference, current_split, year_col, numeric, categorical, opts,
                                   with_pvalues, size_rule)
    message, advice = alert_text(F.col("number_of_drifted_columns"), F.col("share_of_drifted_columns"),
                                 F.col("dataset_drift"), opts.drift_share)
    return report.withColumns({"message": message, "recommendation": advice, "run_ts": F.lit(run_ts)})


def retrain_decision(share: F.Column, threshold: float, first_split: F.Column | None = None,
                     check_enabled: bool = True, check_failed: F.Column | None = None) -> tuple:
    """(train?, reason).  First split or disabled check -> train; failed
    check -> train (recorded); share below the threshold -> skip; else train."""
    first = first_split if first_split is not None else F.lit(False)
    failed = check_failed if check_failed is not None else F.lit(False)
    enabled = F.lit(bool(check_enabled))
    train = F.when(first | ~enabled, True).when(failed, True).when(share < threshold, False).otherwise(True)
    reason = (F.when(first, "first_split").when(~enabled, "check_disabled").when(failed, "drift_check_failed")
              .when(share < threshold, "drift_below_threshold").otherwise("drift_above_threshold"))
    return train, reason


def drift_report(ref: DataFrame, cur: DataFrame, numeric, categorical,
                 opts: DriftOptions = DriftOptions(), with_pvalues: bool = True,
                 size_rule: bool | None = None) -> DataFrame:
    """D2 + D7 + D8 + D9 as one row."""
    s = dataset_summary(column_drift(ref, cur, numeric, categorical, opts, with_pvalues, size_rule))
    train, reason = retrain_decision(F.col("share_of_drifted_columns"), opts.drift_share)
    return s.select("*", alert_level(F.col("share_of_drifted_columns"), F.col("dataset_drift"),
                                     opts.drift_share).alias("severity"),
                    train.alias("retrain"), reason.alias("decision_reason"))


def reference_split_id(state: DataFrame, runs: DataFrame, default: int = 1) -> int:
    """Split id of the current production model (highest Production
    version, Q5); ``default`` when the registry has no production model."""
    from tidemark.operators.registry import production_model
    r = production_model(state, runs).select(F.col("params")["split_id"].cast("int").alias("s")).first()
    return default if r is None or r["s"] is None else int(r["s"])


def check_drift_for_split(df: DataFrame, catalog: DataFrame, reference_split: int, current_split: int,
                          year_col: str, numeric, categorical, opts: DriftOptions = DriftOptions(),
                          with_pvalues: bool = True, size_rule: bool | None = None) -> DataFrame:
    """Drift report of split ``current_split`` against ``reference_split``
    (both read as year-range views of ``df`` through the catalog)."""
    from tidemark.operators.splits import split_rows
    ref = split_rows(df, catalog, reference_split, year_col)
    cur = split_rows(df, catalog, current_split, year_col)
    return drift_report(ref, cur, numeric, categorical, opts, with_pvalues, size_rule) \
        .withColumn("reference_split", F.lit(reference_split)).withColumn("current_split", F.lit(current_split))


def write_drift_result(per_column: DataFrame, summary: DataFrame, path: str, run_ts) -> None:
    """The drift result as tables (per column + summary), appended by run timestamp."""
    per_column.withColumn("run_ts", F.lit(run_ts)).write.mode("append").parquet(f"{path}/columns")
    summary.withColumn("run_ts", F.lit(run_ts)).write.mode("append").parquet(f"{path}/summary")


def yearly_values(df: DataFrame, year_col: str, cols, value_type: str) -> DataFrame:
    """(year, column_name, value, n): additive counts, so those of two batches of rows are summed."""
    long = df.select(F.col(year_col).alias("year"), *[F.col(c).cast(value_type).alias(c) for c in cols]) \
        .unpivot(["year"], list(cols), "column_name", "value").where(F.col("value").isNotNull())
    return long.groupBy("year", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def drift_by_split(df: DataFrame, catalog: DataFrame, year_col: str, numeric, categorical,
                   reference_split: int = 1, opts: DriftOptions = DriftOptions(),
                   splits=None, size_rule: bool = False) -> DataFrame:
    """D11 for every split of the catalog in one pass (no per-split jobs).

    Values are counted once per (year, column, value) and the tests run on
    these counts (``drift_from_year_counts``); data rows are never copied
    per split.  Returns one row per (split_id, column_name).

    ``splits`` (optional split ids) limits the work to those splits.
    ``size_rule``: as in ``column_drift``.
    """
    cat_rows = catalog.select("split_id", "start_year", "end_year").collect()   # one row per split
    ref = [r for r in cat_rows if r["split_id"] == reference_split]
    if not ref:
        raise ValueError(f"reference split {reference_split} not in catalog")
    if splits is not None:
        wanted = set(splits)
        cat_rows = [r for r in cat_rows if r["split_id"] in wanted]
        if not cat_rows:
            raise ValueError(f"none of the splits {sorted(wanted)} is in the catalog")
    years = (ref[0]["start_year"], ref[0]["end_year"])

    def counts(cols, value_type):
        return yearly_values(df, year_col, cols, value_type), years

    return drift_from_year_counts(cat_rows, {c: "num" for c in numeric} | {c: "cat" for c in categorical},
                                  counts(numeric, "double") if numeric else None,
                                  counts(categorical, "string") if categorical else None, opts, size_rule)


def drift_from_year_counts(splits, kinds: dict, numeric: tuple | None, categorical: tuple | None,
                           opts: DriftOptions = DriftOptions(), size_rule: bool = False) -> DataFrame:
    """Tests of every split of ``splits`` (split_id, start_year, end_year) from value counts alone.

    ``numeric`` and ``categorical``: (counts (year, column_name, value, n),
    reference counts (column_name, value, n)); rows of either may repeat a
    key.  In place of reference counts (first year, last year) takes the counts
    of those years.  A count row is credited to the splits whose year range
    contains it, for the current side, and every reference row to the reference
    side of each split.  A numeric value is one row with a count per split, so
    values are shuffled and ordered once, not once a split; categories and
    columns of few values are tested with ``split|column`` as the group key.
    ``kinds``: column name -> "num" or "cat".
    """
    bounds = F.array(*[F.struct(F.lit(r["split_id"]).alias("s"), F.lit(r["start_year"]).alias("a"),
                                F.lit(r["end_year"]).alias("b")) for r in splits])
    every_split = F.array(*[F.lit(r["split_id"]) for r in splits])
    n_num, n_cat = (sum(k == kind for k in kinds.values()) for kind in ("num", "cat"))
    p_limit = opts.small_sample_limit if size_rule else -1
    sides = [f"n_cur_{i}" for i in range(len(splits))]
    key_of = lambda split: F.concat_ws("|", split.cast("string"), F.col("column_name"))
    zero = F.lit(0).cast("long")

    def by_value(by_year, reference):
        n = F.col("n").cast("long")
        within = lambda a, b: F.when(F.col("year").between(a, b), n).otherwise(zero)
        own = within(*reference) if isinstance(reference, tuple) else zero
        rows = by_year.select("column_name", "value", own.alias("n_ref"),
                              *[within(r["start_year"], r["end_year"]).alias(c) for r, c in zip(splits, sides)])
        if not isinstance(reference, tuple):
            rows = rows.unionByName(reference.select("column_name", "value", n.alias("n_ref"), *[zero.alias(c) for c in sides]))
        return rows.groupBy("column_name", "value").agg(*[F.sum(c).alias(c) for c in ["n_ref", *sides]]) \
            .where(F.greatest("n_ref", *sides) > 0)

    def by_side(by_year, reference):
        if isinstance(reference, tuple):
            by_year = cut_lineage(by_year, "yearly-values")
            reference = by_year.where(F.col("year").between(*reference)).drop("year")
        member = F.filter(bounds, lambda s: (F.col("year") >= s["a"]) & (F.col("year") <= s["b"]))
        cur = by_year.select(F.explode(F.transform(member, lambda s: s["s"])).alias("_split"), "column_name", "value",
                             F.lit(0).cast("long").alias("n_ref"), F.col("n").cast("long").alias("n_cur"))
        refs = reference.select(F.explode(every_split).alias("_split"), "column_name", "value",
                                F.col("n").cast("long").alias("n_ref"), F.lit(0).cast("long").alias("n_cur"))
        return cur.unionByName(refs).groupBy(
            key_of(F.col("_split")).alias("column_name"), "value") \
            .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))

    parts = []
    if numeric:
        nvc = cut_lineage(by_value(*numeric), "split-values")
        split_of = F.element_at(every_split, F.col("side") + 1)
        nt = numeric_tests_by_side(nvc, sides, opts, n_num).withColumn("column_name", key_of(split_of)).drop("side")
        # columns of few values: a row per split that holds the value
        unique = [F.count_if(F.col("n_ref") + F.col(c) > 0) for c in sides]
        few = nvc.groupBy("column_name").agg(F.array(*[(n > 0) & (n <= opts.few_values) for n in unique]).alias("_few"))
        few = few.where(F.exists("_few", lambda x: x))
        each = F.array(*[F.when(F.col("_few")[i] & (F.col("n_ref") + F.col(c) > 0),
                                F.struct(F.lit(r["split_id"]).alias("_split"), F.col(c).alias("n_cur")))
                         for i, (r, c) in enumerate(zip(splits, sides))])
        nvc_few = join_small(nvc, few, on=["column_name"], bound=n_num).select(
            "column_name", F.col("value").cast("string").alias("value"), "n_ref", F.inline(F.array_compact(each)))
        nvc_few = nvc_few.withColumn("column_name", key_of(F.col("_split"))).drop("_split")
        ncat = categorical_tests(nvc_few, opts, True, len(splits) * n_num, p_limit) \
            .select("column_name", "jensen_shannon", "chi_pvalue", "z_pvalue")
        parts.append(nt.join(ncat, "column_name", "left").withColumn("kind", F.lit("num")))
    if categorical:
        ct = categorical_tests(by_side(*categorical), opts, True, len(splits) * n_cat, p_limit)
        parts.append(ct.select("column_name", "n_ref", "n_unique", "jensen_shannon", "chi_pvalue", "z_pvalue",
                               F.lit("cat").alias("kind"), F.lit(None).cast("double").alias("wasserstein_norm"),
                               F.lit(None).cast("double").alias("ks_pvalue")))
    allc = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    key = F.split(F.col("column_name"), r"\|", 2)
    return _choose(allc, opts, size_rule).select(key[0].cast("int").alias("split_id"), key[1].alias("column_name"),
                                                 "stattest", "drift_score", "drift_detected")


def split_decisions(per_split_column: DataFrame, reference_split: int = 1,
                    opts: DriftOptions = DriftOptions()) -> DataFrame:
    """D7-D9 per split from ``drift_by_split`` output."""
    s = per_split_column.groupBy("split_id").agg(
        F.count_if(F.col("drift_detected")).alias("number_of_drifted_columns"),
        (F.count_if(F.col("drift_detected")) / F.count(F.lit(1))).alias("share_of_drifted_columns"))
    share = F.col("share_of_drifted_columns")
    train, reason = retrain_decision(share, opts.drift_share, F.col("split_id") == reference_split)
    return s.select("*", alert_level(share, share > 0, opts.drift_share).alias("severity"),
                    train.alias("retrain"), reason.alias("decision_reason"))
