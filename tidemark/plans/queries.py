"""Registered queries: one callable ``(spark, root) -> DataFrame`` per operator group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import confidence_band
from tidemark.operators import splits as sp
from tidemark.plans import fixtures as fx
from tidemark.plans import preprocess as pp


def q_cumulative_split_summary(spark: SparkSession, root: str) -> DataFrame:
    """P5, P9, P10, P19, W1, A3, A13 over the F1 train rows."""
    split = pp.split_obs(spark, root)
    train = split.where(~F.col("is_test"))
    return sp.cumulative_split_summary(train, pp.test_count(split), "year", fx.OBS_LABEL,
                                       fx.YEAR_START, fx.YEAR_END)


QUERIES = {
    "cumulative_split_summary": q_cumulative_split_summary,
}


# ------------------------------------------------------------ clean / profile
from tidemark.operators import clean as cl  # noqa: E402
from tidemark.operators import profile as pf  # noqa: E402


def q_interim_obs(spark, root):
    """The interim observation table."""
    return pp.interim_obs(spark, root)


def q_split_class_quotas(spark, root):
    """F1 allocation: per-class sizes of the exact stratified split."""
    return sp.class_quotas(pp.interim_obs(spark, root), fx.OBS_LABEL, fx.TEST_SIZE)


def q_stratified_test_rows(spark, root):
    """F1 membership: the keys of every test row."""
    return pp.split_obs(spark, root).where(F.col("is_test")).select(*fx.OBS_KEY, fx.OBS_LABEL)


def q_rows_per_year(spark, root):
    """A2 + P9: training rows per (rounded) year, sorted."""
    from tidemark.functions.columns import round_key
    train = pp.split_obs(spark, root).where(~F.col("is_test"))
    return pf.counts_by(train.withColumn("year", round_key(F.col("year"))), "year")


def q_class_distribution(spark, root):
    """A3: class counts and shares of the training rows."""
    train = pp.split_obs(spark, root).where(~F.col("is_test"))
    return pf.class_distribution(train, fx.OBS_LABEL).withColumn("share", F.round("share", 6))


def q_year_range(spark, root):
    """A5 + P20: min/max of the year key."""
    return pf.key_range(pp.interim_obs(spark, root), "year")


def q_distinct_years(spark, root):
    """Sorted distinct years inside the closed range (P10)."""
    df = pp.interim_obs(spark, root).where(F.col("year").between(fx.YEAR_START, fx.YEAR_END))
    return pf.distinct_sorted(df, "year")


def q_null_profile(spark, root):
    """A1: NULL count per column of the observation view."""
    return pf.null_counts(fx.obs(spark, root))


def q_missing_share_columns(spark, root):
    """NULL share per column and the drop decision at the 0.30 limit."""
    s = cl.missing_shares(fx.obs(spark, root))
    return s.select("column_name", F.round("null_share", 6).alias("null_share"),
                    (F.col("null_share") > 0.30).alias("drop_column"))


def q_column_profile(spark, root):
    """Numeric column profile of the observation view."""
    p = pf.column_profile(fx.obs(spark, root), fx.OBS_NUMERIC)
    return p.select("column_name", "n_values", "n_nulls", "n_distinct", "min_value", "max_value",
                    F.round("mean_value", 6).alias("mean_value"), F.round("std_value", 6).alias("std_value"))


def q_duplicate_documents(spark, root):
    """Groups of byte-identical document texts (exact copies)."""
    from tidemark.sources.tables import read_table
    docs = read_table(spark, root, "documents").select(F.md5("text").alias("text_md5"))
    return pf.duplicate_rows(docs, ["text_md5"])


def _catalog(spark, root, split=None):
    split = pp.split_obs(spark, root) if split is None else split
    train = split.where(~F.col("is_test"))
    return sp.cumulative_split_summary(train, pp.test_count(split), "year", fx.OBS_LABEL,
                                       fx.YEAR_START, fx.YEAR_END)


def q_split_members(spark, root):
    """S3: the training rows of split 3 (years first..first+2) as a range view."""
    split = pp.split_obs(spark, root)
    train = split.where(~F.col("is_test"))
    cat = _catalog(spark, root, split)
    return sp.split_rows(train, cat, 3, "year").select(*fx.OBS_KEY, "year", fx.OBS_LABEL)


def q_next_split(spark, root):
    """With splits 1-3 already in the catalog, the split to create next."""
    split = pp.split_obs(spark, root)
    cat = _catalog(spark, root, split).where(F.col("split_id") <= 3)
    years = split.where(F.col("year").between(fx.YEAR_START, fx.YEAR_END))
    return sp.next_split(cat, years, "year")


QUERIES.update({
    "interim_obs": q_interim_obs,
    "split_class_quotas": q_split_class_quotas,
    "stratified_test_rows": q_stratified_test_rows,
    "rows_per_year": q_rows_per_year,
    "class_distribution": q_class_distribution,
    "year_range": q_year_range,
    "distinct_years": q_distinct_years,
    "null_profile": q_null_profile,
    "missing_share_columns": q_missing_share_columns,
    "column_profile": q_column_profile,
    "duplicate_documents": q_duplicate_documents,
    "split_members": q_split_members,
    "next_split": q_next_split,
})


# ------------------------------------------------------------------ features
from tidemark.operators import features as ft  # noqa: E402

FEATURE_CATEGORICAL = [*fx.WIDE_CATEGORICAL, "season"]


def _fitted(spark, root):
    split = pp.split_obs_wide(spark, root)
    train = split.where(~F.col("is_test"))
    return split, train, ft.fit(train, fx.OBS_NUMERIC, FEATURE_CATEGORICAL)


def q_train_medians(spark, root):
    """F2 fit: exact median of each numeric column over the training rows."""
    train = pp.split_obs(spark, root).where(~F.col("is_test"))
    m = ft.fit_medians(train, fx.OBS_NUMERIC)
    return m.select("column_name", F.round("median", 6).alias("median"))


def q_train_modes(spark, root):
    """F3 fit: most frequent category per column, ties to the smallest."""
    train = pp.split_obs_wide(spark, root).where(~F.col("is_test"))
    return ft.fit_modes(train, FEATURE_CATEGORICAL)


def q_onehot_vocabulary(spark, root):
    """sorted vocabulary per category column and the dummy each value maps to."""
    train = pp.split_obs_wide(spark, root).where(~F.col("is_test"))
    v = ft.fit_vocabulary(train, FEATURE_CATEGORICAL)
    name = F.concat(F.col("column_name"), F.lit("_"),
                    F.regexp_replace(F.regexp_replace(F.col("value"), "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    return v.select("column_name", "value", "position",
                    F.when(F.col("position") > 0, name).alias("dummy_column"))


def q_scaler_params(spark, root):
    """F5 fit: mean and population std of the imputed training columns."""
    split = pp.split_obs_wide(spark, root)
    train = split.where(~F.col("is_test"))
    med = {r["column_name"]: r["median"] for r in ft.fit_medians(train, fx.OBS_NUMERIC).collect()}
    imputed = train.select(*[F.coalesce(F.col(c), F.lit(float(med[c]))).alias(c) for c in fx.OBS_NUMERIC])
    long = imputed.unpivot([], fx.OBS_NUMERIC, "column_name", "value")
    return long.groupBy("column_name").agg(F.round(F.avg("value"), 6).alias("mean"),
                                           F.round(F.stddev_pop("value"), 6).alias("std"))


def q_encoded_features(spark, root):
    """F2-F5 apply + P8 + P11 + J2: the model-ready matrix for train and test rows."""
    split, _, model = _fitted(spark, root)
    out = model.transform(split)
    return out.select(*[F.round(c, 6).alias(c) if c in fx.OBS_NUMERIC else F.col(c) for c in out.columns])


QUERIES.update({
    "train_medians": q_train_medians,
    "train_modes": q_train_modes,
    "onehot_vocabulary": q_onehot_vocabulary,
    "scaler_params": q_scaler_params,
    "encoded_features": q_encoded_features,
})


# ---------------------------------------------------------------- evaluation
from tidemark.operators import evaluate as ev  # noqa: E402


def _scored_pred(spark, root):
    return ev.threshold_predictions(fx.scored(spark, root), "score", 0.5)


def q_confusion_matrix(spark, root):
    """2x2 confusion grid of the rule-based scorer."""
    return ev.confusion_matrix(_scored_pred(spark, root), "label", "prediction")


def q_binary_metrics(spark, root):
    """A9 + A10: accuracy, precision, recall, F1 and exact ROC-AUC."""
    m = ev.binary_metrics(_scored_pred(spark, root), "label", "prediction", "score")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in
                                              ("accuracy", "precision", "recall", "f1_score", "roc_auc")])


def q_classification_report(spark, root):
    """Per-class report with accuracy, macro and weighted rows."""
    r = ev.classification_report(_scored_pred(spark, root), "label", "prediction", (0, 1), ("No", "Yes"))
    return r.select("row_name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")], "support")


def q_metrics_by_year(spark, root):
    """A9 + A10 per order year -- one pass evaluates every group."""
    df = _scored_pred(spark, root).withColumn("year", F.year("o_orderdate").cast("int"))
    m = ev.binary_metrics(df, "label", "prediction", "score", group_cols=["year"])
    return m.select("year", "tp", "fp", "fn", "tn",
                    *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1_score", "roc_auc")])


QUERIES.update({
    "confusion_matrix": q_confusion_matrix,
    "binary_metrics": q_binary_metrics,
    "classification_report": q_classification_report,
    "metrics_by_year": q_metrics_by_year,
})


# --------------------------------------------------------------------- drift
from tidemark.operators import drift as dr  # noqa: E402


def _encoded(spark, root):
    split, _, model = _fitted(spark, root)
    return model.transform(split), model


def _drift_cols(model):
    return [*fx.OBS_NUMERIC, "year", *model.dummy_columns]


def _ref_cur(df, ref_end=fx.YEAR_START, cur_end=fx.YEAR_END):
    """Reference = split 1 training rows, current = the last cumulative split (Q11)."""
    train = df.where(~F.col("is_test"))
    return (train.where(F.col("year").between(fx.YEAR_START, ref_end)),
            train.where(F.col("year").between(fx.YEAR_START, cur_end)))


def q_drift_numeric_tests(spark, root):
    """D3 + D5: normalised Wasserstein and KS (statistic, asymptotic p) per numeric column."""
    ref, cur = _ref_cur(pp.split_obs(spark, root))
    vc = dr.value_counts_by_side(ref, cur, fx.OBS_NUMERIC, "double")
    t = dr.numeric_tests(vc)
    return t.select("column_name", "n_ref", "n_cur", "n_unique",
                    F.round("wasserstein_norm", 6).alias("wasserstein_norm"),
                    F.round("ks_statistic", 9).alias("ks_statistic"), F.round("ks_pvalue", 6).alias("ks_pvalue"))


def q_drift_categorical_tests(spark, root):
    """D4 + D6 statistics: Jensen-Shannon distance and chi-square per category column."""
    ref, cur = _ref_cur(pp.split_obs_wide(spark, root))
    vc = dr.value_counts_by_side(ref, cur, FEATURE_CATEGORICAL, "string")
    t = dr.categorical_tests(vc, with_pvalues=False)
    return t.select("column_name", "n_ref", "n_cur", "n_unique", "chi_dof",
                    F.round("jensen_shannon", 9).alias("jensen_shannon"), F.round("chi_square", 6).alias("chi_square"))


def q_drift_pvalues(spark, root):
    """D5 + D6 p-values (KS series, chi-square and z tails) per column."""
    ref, cur = _ref_cur(pp.split_obs_wide(spark, root))
    per = dr.column_drift(ref, cur, fx.OBS_NUMERIC, FEATURE_CATEGORICAL, with_pvalues=True)
    return per.select("column_name", "kind", "ks_pvalue", "chi_pvalue", "z_pvalue")


def q_drift_columns(spark, root):
    """The default test per feature column of the encoded matrix, split 1 vs split 6."""
    enc, model = _encoded(spark, root)
    ref, cur = _ref_cur(enc)
    per = dr.column_drift(ref, cur, _drift_cols(model), [], with_pvalues=False, size_rule=True)
    return per.select("column_name", "stattest", F.round("drift_score", 6).alias("drift_score"), "drift_detected")


def q_drift_report(spark, root):
    """D2 + D7 + D8 + D9 + D11: dataset drift summary, alert level and retrain decision."""
    enc, model = _encoded(spark, root)
    ref, cur = _ref_cur(enc)
    rep = dr.drift_report(ref, cur, _drift_cols(model), [], with_pvalues=False, size_rule=True)
    return rep.select(F.lit(1).alias("reference_split"), F.lit(fx.YEAR_END - fx.YEAR_START + 1).alias("current_split"),
                      "number_of_columns", "number_of_drifted_columns",
                      F.round("share_of_drifted_columns", 9).alias("share_of_drifted_columns"),
                      "dataset_drift", "severity", "retrain", "decision_reason")


def q_drift_baseline(spark, root):
    """D10 + W7: the reference split against itself, first 80% vs last 20% (seeded order)."""
    enc, model = _encoded(spark, root)
    ref, _ = _ref_cur(enc)
    cut = sp.positional_cut(ref, fx.OBS_KEY, 0.8, fx.SEED)
    a, b = cut.where(F.col("first_part")), cut.where(~F.col("first_part"))
    per = dr.column_drift(a, b, _drift_cols(model), [], with_pvalues=False, size_rule=True)
    return per.select("column_name", "stattest", F.round("drift_score", 6).alias("drift_score"), "drift_detected")


QUERIES.update({
    "drift_numeric_tests": q_drift_numeric_tests,
    "drift_categorical_tests": q_drift_categorical_tests,
    "drift_pvalues": q_drift_pvalues,
    "drift_columns": q_drift_columns,
    "drift_report": q_drift_report,
    "drift_baseline": q_drift_baseline,
})


PROFILE_COLUMNS = ["column_name", "n_values", "n_nulls", "min_value", "max_value"]


def q_split_profiles(spark, root):
    """A14 merged: sketches kept per year, merged to the profile of every cumulative split without reading rows again."""
    split = pp.split_obs_wide(spark, root)
    train = split.where(~F.col("is_test") & F.col("year").between(fx.YEAR_START, fx.YEAR_END))
    yearly = cut_lineage(pf.column_sketches(train, fx.OBS_NUMERIC, FEATURE_CATEGORICAL, by=["year"]), "yearly-sketches")
    cat = _catalog(spark, root, split).select("split_id", "start_year", "end_year")
    member = yearly.join(F.broadcast(cat), F.col("year").between(F.col("start_year"), F.col("end_year")))   # a row a year
    p = pf.profile_of_sketches(pf.merge_sketches(member, by=["split_id"]))
    return p.select("split_id", *PROFILE_COLUMNS, F.round("mean_value", 6).alias("mean_value"), F.round("std_value", 6).alias("std_value"))


def q_baseline_quality(spark, root):
    """D10, quality half + W7: both parts of the reference split profiled, with the most frequent value of each column."""
    split = pp.split_obs_wide(spark, root)
    ref = split.where(~F.col("is_test") & (F.col("year") == fx.YEAR_START))
    cut = cut_lineage(sp.positional_cut(ref, fx.OBS_KEY, 0.8, fx.SEED), "baseline-parts")
    p = pf.profile_of_sketches(pf.column_sketches(cut, fx.OBS_NUMERIC, FEATURE_CATEGORICAL, by=["first_part"]))
    top = pf.top_values(cut, FEATURE_CATEGORICAL, 1, by=["first_part"]).select(
        "first_part", "column_name", F.col("value").alias("top_value"), F.col("n_rows").alias("n_top"))
    return p.join(top, ["first_part", "column_name"], "left").select(
        "first_part", *PROFILE_COLUMNS, F.round("mean_value", 6).alias("mean_value"), F.round("std_value", 6).alias("std_value"),
        "top_value", "n_top")


QUERIES.update({
    "split_profiles": q_split_profiles,
    "baseline_quality": q_baseline_quality,
})


# ------------------------------------------------------------------ registry
from tidemark.operators import registry as rg  # noqa: E402

MODEL_NAME = "obs_model"


def _runs(spark, root):
    df = _scored_pred(spark, root).withColumn("year", F.year("o_orderdate").cast("int"))
    m = ev.binary_metrics(df, "label", "prediction", "score", group_cols=["year"])
    # the split that ends in the run's year; a year without one logs none
    m = m.withColumn("split_id", F.when(F.col("year").between(fx.YEAR_START, fx.YEAR_END), F.col("year") - fx.YEAR_START + 1))
    return rg.runs_from_metrics(m, "year", MODEL_NAME, param_cols=("year",))


def _registry(spark, root):
    runs = _runs(spark, root)
    dec = rg.champion_challenger(runs)
    events = rg.promotion_events(dec, {"years": F.col("year"),
                                       "f1_score": F.format_string("%.4f", F.col("metrics")["f1_score"])})
    return runs, dec, events


def q_registry_promotions(spark, root):
    """R1 + M4 + R3: champion/challenger over yearly runs and the resulting stages."""
    runs, dec, events = _registry(spark, root)
    state = rg.current_state(events)
    return dec.join(state.select("model_name", "version", F.col("stage").alias("final_stage")),
                    ["model_name", "version"]).select(
        "version", "run_id", F.round(F.col("metrics")["f1_score"], 9).alias("f1_score"),
        F.round("production_metric_before", 9).alias("production_f1_before"),
        "is_better", F.round("improvement_pct", 6).alias("improvement_pct"), "final_stage")


def q_production_model(spark, root):
    """R2 + W3 + J4 + A19 + R5: the production version, its metrics and the F1 alert."""
    runs, _, events = _registry(spark, root)
    p = rg.production_model(rg.current_state(events), runs)
    f1 = F.col("metrics")["f1_score"]
    return p.select("version", "run_id", F.col("params")["split_id"].cast("int").alias("split_id"),
                    *[F.round(F.col("metrics")[k], 9).alias(k) for k in
                      ("f1_score", "accuracy", "precision", "recall", "roc_auc")],
                    (f1 < 0.6).alias("f1_alert"))


def q_registry_archive_all(spark, root):
    """Archive every version; existing tags kept, absent ones added."""
    runs, _, events = _registry(spark, root)
    state = rg.current_state(events)
    as_of = F.date_format(fx.scored(spark, root).agg(F.max("o_orderdate")).scalar(), "yyyy-MM-dd'T'HH:mm:ss")
    arch = rg.archive_all(state, as_of)
    final = rg.current_state(events.unionByName(arch))
    return final.select("version", "stage", F.col("tags")["archived"].alias("tag_archived"),
                        F.col("tags")["archived_at"].alias("tag_archived_at"),
                        F.col("tags")["is_production"].alias("tag_is_production"),
                        F.col("tags")["f1_score"].alias("tag_f1_score"))


def q_production_drift_check(spark, root):
    """D1 -> D11 -> D8: the newest split against the split of the registry's production model, with the alert's texts."""
    runs, _, events = _registry(spark, root)
    enc, model = _encoded(spark, root)
    train = enc.where(~F.col("is_test") & F.col("year").between(fx.YEAR_START, fx.YEAR_END))
    as_of = fx.scored(spark, root).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    rep = dr.check_against_production(train, _catalog(spark, root), rg.current_state(events), runs, fx.YEAR_END - fx.YEAR_START + 1,
                                      "year", _drift_cols(model), [], as_of, with_pvalues=False, size_rule=True)
    return rep.select("reference_split", "current_split", "number_of_drifted_columns",
                      F.round("share_of_drifted_columns", 9).alias("share_of_drifted_columns"),
                      "severity", "message", "recommendation", "run_ts")


QUERIES.update({
    "production_drift_check": q_production_drift_check,
    "registry_promotions": q_registry_promotions,
    "production_model": q_production_model,
    "registry_archive_all": q_registry_archive_all,
})


# ----------------------------------------------------------------- telemetry
from tidemark.operators import telemetry as tm  # noqa: E402

# The request log's durations span 0.01..490 instead of seconds, so the
# fixed bucket bounds and the 2-second threshold are scaled by 50.
LATENCY_SCALE = 50.0
SCALED_BUCKETS = tuple(b * LATENCY_SCALE for b in tm.LATENCY_BUCKETS)
LATENCY_THRESHOLD = 2.0 * LATENCY_SCALE
ALERT_HOLD_SECONDS = 120
ALLOWED_ENDPOINTS = ("click", "view", "purchase", "signup")


def _log(spark, root):
    return fx.request_log(spark, root)


def q_request_totals(spark, root):
    """Requests per endpoint, method and status."""
    return tm.request_totals(_log(spark, root))


def q_average_latency(spark, root):
    """Average latency per endpoint (sum/count per series, averaged)."""
    return tm.average_latency(_log(spark, root)).select("endpoint", F.round("avg_latency", 9).alias("avg_latency"))


def q_latency_histogram(spark, root):
    """Cumulative latency buckets per endpoint."""
    return tm.latency_histogram(_log(spark, root), SCALED_BUCKETS)


def q_latency_p95(spark, root):
    """A18 + P21: p95 from the histogram per allowed endpoint."""
    log = tm.allow_endpoints(_log(spark, root), ALLOWED_ENDPOINTS)
    h = tm.latency_histogram(log, SCALED_BUCKETS)
    return tm.histogram_quantile(h, 0.95).select("endpoint", F.round("quantile", 9).alias("quantile"))


def q_windowed_latency(spark, root):
    """W5 + A17 + A18: 5-minute windows sliding by 1 minute: rate and p95 per endpoint."""
    log = tm.allow_endpoints(_log(spark, root), ALLOWED_ENDPOINTS)
    w = tm.windowed_latency(log, 0.95, "5 minutes", "1 minute", SCALED_BUCKETS, 300)
    return w.select("window_start", "window_end", "endpoint", F.round("rate", 9).alias("rate"),
                    F.round("p_quantile", 9).alias("p_quantile"))


def q_instant_rate(spark, root):
    """Per-second request rate from the last two counter samples per endpoint."""
    s = tm.counter_samples(_log(spark, root), 60)
    return tm.instant_rate(s).select("endpoint", "last_sample_ts", F.round("irate", 9).alias("irate"))


def q_latency_alerts(spark, root):
    """W5 + A18 + W6: p95 above the threshold held for 2 minutes -> alert runs per endpoint."""
    log = tm.allow_endpoints(_log(spark, root), ALLOWED_ENDPOINTS)
    return tm.latency_alerts(log, LATENCY_THRESHOLD, ALERT_HOLD_SECONDS, bounds=SCALED_BUCKETS)


QUERIES.update({
    "request_totals": q_request_totals,
    "average_latency": q_average_latency,
    "latency_histogram": q_latency_histogram,
    "latency_p95": q_latency_p95,
    "windowed_latency": q_windowed_latency,
    "instant_rate": q_instant_rate,
    "latency_alerts": q_latency_alerts,
})


# ------------------------------------------------------------ sources/sinks
from pyspark.errors import AnalysisException  # noqa: E402
from tidemark.sources import io as sio  # noqa: E402
from tidemark.session import scratch_path  # noqa: E402


def q_csv_roundtrip(spark, root):
    """S7 + S1: the interim table written as CSV (NULL as NA) and read back with its schema."""
    df = pp.interim_obs(spark, root)
    path = scratch_path(spark, "interim-csv")
    sio.write_csv(df, path)
    return sio.read_csv(spark, path, df.schema)


def q_params_json_roundtrip(spark, root):
    """F8 + S5: fitted medians and modes written as a JSON parameter file and read back."""
    train = pp.split_obs_wide(spark, root).where(~F.col("is_test"))
    model = ft.fit(train, fx.OBS_NUMERIC, FEATURE_CATEGORICAL, scale=[])
    path = scratch_path(spark, "params-json")
    sio.write_json(model.params_frame(spark), path, files=1)
    schema = model.params_frame(spark).schema
    back = sio.read_json(spark, path, schema)
    med = back.select(F.explode("train_medians").alias("column_name", "median")) \
        .select("column_name", F.round("median", 6).alias("median"), F.lit(None).cast("string").alias("mode"))
    mod = back.select(F.explode("train_modes").alias("column_name", "mode")) \
        .select("column_name", F.lit(None).cast("double").alias("median"), "mode")
    return med.unionByName(mod)


def q_split_catalog_append(spark, root):
    """S6 + W2: catalog with splits 1-3, then the next split appended, read back."""
    split = pp.split_obs(spark, root)
    cat = _catalog(spark, root, split)
    path = scratch_path(spark, "split-catalog")
    sio.append_catalog(cat.where(F.col("split_id") <= 3), path)
    have = sio.read_catalog(spark, path)
    nxt = sp.next_split(have, split.where(F.col("year").between(fx.YEAR_START, fx.YEAR_END)), "year").first()
    if nxt["status"] == "created":
        sio.append_catalog(cat.where(F.col("split_id") == nxt["split_id"]), path)
    return sio.read_catalog(spark, path)


def q_split_catalog_header(spark, root):
    """The catalog's header, written as a JSON table and read back."""
    split = pp.split_obs(spark, root)
    train = split.where(~F.col("is_test") & F.col("year").between(fx.YEAR_START, fx.YEAR_END))
    features = [c for c in split.columns if c not in ("is_test", "year", fx.OBS_LABEL, *fx.OBS_KEY)]
    header = sio.catalog_header(train, split.where(F.col("is_test")), "year", len(features), fx.SEED)
    path = scratch_path(spark, "split-header")
    sio.write_json(header, path, files=1)
    back = sio.read_json(spark, path, header.schema)
    return back.withColumn("years_available", F.array_join(F.col("years_available").cast("array<string>"), ","))


def q_split_snapshot_fingerprint(spark, root):
    """S12 + S3: immutable snapshot of split 3's training rows and its content fingerprint."""
    split = pp.split_obs(spark, root)
    rows = sp.split_rows(split.where(~F.col("is_test")), _catalog(spark, root, split), 3, "year")
    fp = sio.write_snapshot(rows.select(*fx.OBS_KEY, "year", fx.OBS_LABEL),
                            scratch_path(spark, "split-03"), [*fx.OBS_KEY, "year", fx.OBS_LABEL], method="md5")
    return fp.select(F.lit(3).alias("split_id"), "n_rows", "fingerprint")


QUERIES.update({
    "csv_roundtrip": q_csv_roundtrip,
    "params_json_roundtrip": q_params_json_roundtrip,
    "split_catalog_append": q_split_catalog_append,
    "split_catalog_header": q_split_catalog_header,
    "split_snapshot_fingerprint": q_split_snapshot_fingerprint,
})


# ------------------------------------------------------- validation / scoring
from tidemark.operators import model as ml  # noqa: E402
from tidemark.operators import validation as vl  # noqa: E402
from tidemark.session import cut_lineage  # noqa: E402
from tidemark.sources.artefacts import ModelStore  # noqa: E402
from tidemark.sources.tables import read_table  # noqa: E402


def _requests_json(spark, root):
    """Scoring requests as JSON text, one per order (fields mapped from order,
    customer and nation columns; NULL fields are omitted from the JSON)."""
    o = read_table(spark, root, "orders")
    c = read_table(spark, root, "customer")
    n = read_table(spark, root, "nation")
    r = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    wind = (F.when(F.col("o_orderpriority") == "1-URGENT", "N").when(F.col("o_orderpriority") == "2-HIGH", "NE")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "E").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
            .otherwise("LOW"))
    body = F.struct(
        F.col("n_name").alias("location"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        (F.col("o_totalprice") / 10000).alias("min_temp"), (F.col("c_acctbal") / 100).alias("max_temp"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(2).alias("rain_today"),
        (F.col("c_acctbal") / 1000).alias("rainfall"), wind.alias("wind_gust_dir"),
        (F.col("o_totalprice") / 5000).alias("humidity_9am"), (F.col("c_acctbal") / 50).alias("wind_gust_speed"))
    return r.select(F.col("o_orderkey").alias("request_id"), F.to_json(body).alias("value"))


def _location_vocab(spark, root):
    """Known locations: nations outside region 0."""
    return read_table(spark, root, "nation").where(F.col("n_regionkey") != 0).select(F.col("n_name").alias("value"))


def q_request_validation(spark, root):
    """S9 + P14 + P15 + J3: decode JSON requests, apply every rule, check the location vocabulary."""
    req = vl.parse_requests(_requests_json(spark, root), keep=["request_id"])
    v = vl.validate(req, _location_vocab(spark, root))
    return v.select("request_id", "is_valid", F.array_join("errors", ";").alias("errors"))


def _obs_requests(split):
    """Observation rows as JSON requests (test rows), parsed back with the same schema."""
    cols = [c for c in split.columns if c not in ("is_test", fx.OBS_LABEL)]
    schema = split.select(*cols).schema
    js = split.where(F.col("is_test")).select(*fx.OBS_KEY, F.to_json(F.struct(*cols)).alias("value"))
    parsed = js.select(F.from_json("value", schema).alias("r")).select("r.*")
    return parsed


def q_request_features(spark, root):
    """M3 feature part (S9 + P16 + F4 + P11 + F5): JSON requests -> model-ready rows."""
    split, _, model = _fitted(spark, root)
    feats = model.transform(_obs_requests(split))
    expected = [*fx.OBS_KEY, "year", *fx.OBS_NUMERIC, *model.dummy_columns]
    out = cl.align_to_schema(feats, expected)
    return out.select(*[F.round(c, 6).alias(c) if c in fx.OBS_NUMERIC else F.col(c) for c in out.columns])


def _feature_cols(model):
    return [*fx.OBS_NUMERIC, "year", *model.dummy_columns]


def _stored_gbt(spark, split, model):
    """The boosted trees of the training rows: fitted by the first query that needs them, then loaded."""
    train = split.where(~F.col("is_test"))
    return ml.fit_stored(ModelStore(spark), train, lambda: cut_lineage(model.transform(train), "train"),
                         _feature_cols(model), fx.OBS_LABEL)


def q_gbt_test_metrics(spark, root):
    """M1 + M2 + S8 + A9 + A10: boosted trees of the training rows, scored on the test rows."""
    split, _, model = _fitted(spark, root)
    fitted = _stored_gbt(spark, split, model)
    # written: the metrics pass over the scores several times
    scored_test = cut_lineage(ml.score(fitted, model.transform(split.where(F.col("is_test"))), keep=[fx.OBS_LABEL]), "scored")
    m = ev.binary_metrics(scored_test, fx.OBS_LABEL, "prediction", "probability")
    return m.select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1_score", "roc_auc")


def q_model_grid_search(spark, root):
    """M6 + R1: logistic regressions and decision trees over a parameter grid, cross-validated on
    stratified folds of the training rows; the candidates' runs as logged in the registry table."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    split, _, model = _fitted(spark, root)
    train = model.transform(split.where(~F.col("is_test")))
    found = ml.grid_search(train, _feature_cols(model), fx.OBS_LABEL, fx.OBS_KEY, {
        LogisticRegression(labelCol=fx.OBS_LABEL, maxIter=20): {"regParam": [0.0, 0.1]},
        DecisionTreeClassifier(labelCol=fx.OBS_LABEL, seed=fx.SEED): {"maxDepth": [3, 6]}}, seed=fx.SEED)
    registry = rg.RegistryTable(spark, scratch_path(spark, "search-registry"))
    registry.log(found.runs(spark, "search"), "place")
    return registry.state()[1].select(
        "model_name", "version", "run_id", F.col("params")["family"].alias("family"),
        F.col("params")["parameters"].alias("parameters"), F.round(F.col("metrics")["areaUnderROC"], 4).alias("roc_auc"))


def _obs_request_json(spark, root, split):
    """The test rows as JSON requests with their date, ``(value)``: year and season are derived when scoring."""
    held_out = split.where(F.col("is_test")).select(*fx.OBS_KEY).distinct()
    rows = fx.obs_wide(spark, root).join(held_out, fx.OBS_KEY, "left_semi")
    fields = [c for c in OBS_REQUEST.fields.names if c != OBS_REQUEST.date]
    date = F.date_format(fx.OBS_DATE, "yyyy-MM-dd").alias(OBS_REQUEST.date)
    return rows.select(F.to_json(F.struct(*fields, date)).alias("value"))


#: An observation as a scoring request.
OBS_REQUEST = vl.Contract(
    T.StructType([*[T.StructField(c, T.LongType()) for c in fx.OBS_KEY], *[T.StructField(c, T.DoubleType()) for c in fx.OBS_NUMERIC],
                  *[T.StructField(c, T.StringType()) for c in [*fx.WIDE_CATEGORICAL, fx.OBS_DATE]]]),
    required=("l_quantity", "l_extendedprice", "c_mktsegment", fx.OBS_DATE), date=fx.OBS_DATE, vocabulary="c_mktsegment",
    rules=(("l_quantity", "l_quantity <= 0"), ("l_extendedprice", "l_extendedprice < 0"),
           ("discount", "NOT discount BETWEEN 0 AND 1"), ("tax", "NOT tax BETWEEN 0 AND 1")),
    blank_is_absent=("l_linestatus", "o_orderpriority"))
OBS_LABELS = ("Not returned", "Returned")


def _score_obs(valid, model, fitted):
    return vl.score_requests(valid, model, _feature_cols(model), lambda x, keep: ml.score(fitted, x, keep=keep),
                             OBS_LABELS, OBS_REQUEST, fx.OBS_KEY)


def q_simple_scoring(spark, root):
    """M3: JSON requests -> validate -> derive -> fill -> encode -> align -> scale -> score -> label."""
    split, _, model = _fitted(spark, root)
    fitted = _stored_gbt(spark, split, model)
    checked = vl.checked_requests(_obs_request_json(spark, root, split), vl.known_values(spark, model, "c_mktsegment"), OBS_REQUEST)
    valid, rejected = vl.split_valid(checked)
    return _score_obs(valid, model, fitted).unionByName(rejected.select(*fx.OBS_KEY, "errors"), allowMissingColumns=True)


def _station_model(spark, root):
    return ft.fit(fx.station_training(spark, root), fx.STATION_NUMERIC, fx.STATION_CATEGORICAL)


def _score_stations(valid, model):
    """M3's second half with a fixed linear score, so that SQL can follow it to the last digit."""
    features = [*fx.STATION_NUMERIC, "rain_today", "year", *model.dummy_columns]

    def score(x, keep):
        z = F.col("humidity_3pm") - F.col("max_temp") + F.lit(0.5) * F.col("rain_today")
        p = 1 / (1 + F.exp(-z))
        ones = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in model.dummy_columns]))
        return x.select(*keep, *[F.round(c, 6).alias(c) for c in fx.STATION_NUMERIC], F.array_join(ones, ";").alias("categories"),
                        (p > 0.5).cast("int").alias("prediction"), F.round(p, 6).alias("probability"),
                        confidence_band(p).alias("confidence"))

    out = vl.score_requests(valid, model, features, score, ("No Rain Tomorrow", "Rain Tomorrow"),
                            keep=["request_id", "is_valid", "errors"])
    return out.select("*", "inputs_used.year", "inputs_used.season").drop("inputs_used")


def _station_columns(out):
    return out.withColumn("errors", F.array_join("errors", ";"))


def q_request_scoring(spark, root):
    """M3 + P4-P6 + P14-P17 on all 18 fields: scored requests and rejects (malformed, incomplete, invalid) in one frame."""
    model = _station_model(spark, root)
    checked = vl.checked_requests(fx.station_requests(spark, root), vl.known_values(spark, model, "location"), keep=["request_id"])
    valid, rejected = vl.split_valid(checked)
    rejected = rejected.select("request_id", "is_valid", "errors")
    return _station_columns(_score_stations(valid, model).unionByName(rejected, allowMissingColumns=True))


QUERIES.update({
    "request_validation": q_request_validation,
    "request_features": q_request_features,
    "gbt_test_metrics": q_gbt_test_metrics,
    "model_grid_search": q_model_grid_search,
    "simple_scoring": q_simple_scoring,
    "request_scoring": q_request_scoring,
})


# ----------------------------------------------------------------- streaming
from tidemark.streaming import common as stc  # noqa: E402
from tidemark.streaming import latency as stl  # noqa: E402
from tidemark.streaming import scoring as sts  # noqa: E402

STREAM_DELAY = "10 minutes"


def q_stream_windowed_latency(spark, root):
    """The windowed p95/rate job as a stream (watermark 10 min, append mode, file sink)."""
    log = tm.allow_endpoints(_log(spark, root), ALLOWED_ENDPOINTS)
    landing = stc.land_files(log, "events")
    src = stc.to_event_time(spark.readStream.schema(log.schema).parquet(landing))
    agg = stl.windowed_latency_stream(src, 0.95, "5 minutes", "1 minute", STREAM_DELAY, SCALED_BUCKETS, 300)
    paths = stc.run_available_now(
        lambda out, ck: agg.writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", ck), "latency", spark)
    res = spark.read.parquet(paths["sink"])
    return res.select("window_start", "window_end", "endpoint", F.round("rate", 9).alias("rate"),
                      F.round("p_quantile", 9).alias("p_quantile"))


QUERIES.update({
    "stream_windowed_latency": q_stream_windowed_latency,
})


def q_stream_request_validation(spark, root):
    """T4 + S9 + P14 + P15: JSON requests arriving as files, validated per micro-batch,
    valid rows and rejects written to two sinks."""
    landing = stc.land_files(_requests_json(spark, root), "requests")
    src = spark.readStream.schema("request_id long, value string").parquet(landing)
    vocab = _location_vocab(spark, root)
    checked = sts.validated_batches(src, vocab).select("request_id", "errors", "is_valid")
    base = scratch_path(spark, "requests-out")
    paths = stc.run_available_now(
        lambda out, ck: checked.writeStream.foreachBatch(sts.write_two_sinks(f"{base}/valid", f"{base}/rejected"))
        .option("checkpointLocation", ck), "requests", spark)
    parts = []
    for side in ("valid", "rejected"):
        try:
            parts.append(spark.read.parquet(f"{base}/{side}"))
        except AnalysisException as e:                    # a side with no rows writes no folder
            if not sio.missing_path(e):
                raise
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("request_id", "is_valid", F.array_join("errors", ";").alias("errors"))


def q_stream_split_decisions(spark, root):
    """Yearly arrivals -> next cumulative split -> drift vs split 1 -> retrain decision."""
    from tidemark.streaming.arrivals import SplitDecisionWriter
    split = pp.split_obs(spark, root)
    n_test = split.where(F.col("is_test")).count()
    train = split.where(~F.col("is_test") & F.col("year").between(fx.YEAR_START, fx.YEAR_END)) \
        .drop("is_test")
    landing = scratch_path(spark, "landing-train")
    for y in range(fx.YEAR_START, fx.YEAR_END + 1):      # arrivals in year order
        train.where(F.col("year") == y).write.mode("append").parquet(landing)
    # about one year per micro-batch (results do not depend on it: a year is
    # complete only once a later year has arrived, or at end of input)
    src = spark.readStream.schema(train.schema).option("maxFilesPerTrigger", 8).parquet(landing)
    base = scratch_path(spark, "arrivals")
    fn = SplitDecisionWriter(base, "year", fx.OBS_LABEL, fx.OBS_NUMERIC, ["l_linestatus", "season"], n_test)
    stc.run_available_now(lambda out, ck: src.writeStream.foreachBatch(fn).option("checkpointLocation", ck),
                          "arrivals", spark)
    fn.flush(spark)                                       # end of input completes the last year
    cat = sio.read_catalog(spark, f"{base}/catalog")
    dec = spark.read.parquet(f"{base}/decisions").drop("batch_id")
    return cat.join(dec.drop("years", "end_year"), "split_id").select(
        "split_id", "years", "start_year", "end_year", "train_samples", "test_samples",
        "share_positive", "number_of_drifted_columns",
        F.round("share_of_drifted_columns", 9).alias("share_of_drifted_columns"),
        "severity", "retrain", "decision_reason")


QUERIES.update({
    "stream_request_validation": q_stream_request_validation,
    "stream_split_decisions": q_stream_split_decisions,
})


# ------------------------------------------------------------------ sampling
from tidemark.operators import sampling as sm  # noqa: E402

KNN_K = 5


def q_knn_neighbors(spark, root):
    """J6 / F7 step: exact 5 nearest same-label neighbours of every embedding."""
    emb = read_table(spark, root, "embeddings")
    nn = sm.exact_knn(emb, "vec_id", "embedding", "label", KNN_K, block_size=64)
    return nn.select(F.col("id").alias("vec_id"), "rank", "neighbor_id", F.round("distance", 6).alias("distance"))


def q_oversampled_class_counts(spark, root):
    """F7 + A4 + U3: class counts before and after interpolation oversampling."""
    emb = read_table(spark, root, "embeddings")
    out = sm.oversample(emb, "vec_id", "embedding", "label", KNN_K, block_size=64)
    return out.groupBy("label").agg(F.count_if(~F.col("synthetic")).alias("n_before"),
                                    F.count(F.lit(1)).alias("n_after"))


def q_seeded_sample(spark, root):
    """An exact-size seeded sample (5,000 rows) of the last cumulative split."""
    train = pp.split_obs(spark, root).where(~F.col("is_test") & F.col("year").between(fx.YEAR_START, fx.YEAR_END))
    return sm.seeded_sample(train, 5000, fx.OBS_KEY, fx.SEED).select(*fx.OBS_KEY, "year", fx.OBS_LABEL)


def q_input_example(spark, root):
    """W9 + R6: the 5-row input example stored with a model (first rows in key order)."""
    train = pp.split_obs(spark, root).where(~F.col("is_test"))
    return sm.head(train, 5, fx.OBS_KEY).select(*fx.OBS_KEY, "year", fx.OBS_LABEL)


QUERIES.update({
    "knn_neighbors": q_knn_neighbors,
    "oversampled_class_counts": q_oversampled_class_counts,
    "seeded_sample": q_seeded_sample,
    "input_example": q_input_example,
})


def q_stream_latency_alerts(spark, root):
    """T2 -> T3: windowed p95 stream, then a stateful alert-duration stream over its output."""
    from tidemark.streaming import alerts as sta
    log = tm.allow_endpoints(_log(spark, root), ALLOWED_ENDPOINTS)
    landing = stc.land_files(log, "events-alerts")
    src = stc.to_event_time(spark.readStream.schema(log.schema).parquet(landing))
    agg = stl.windowed_latency_stream(src, 0.95, "5 minutes", "1 minute", STREAM_DELAY, SCALED_BUCKETS, 300)
    p = stc.run_available_now(
        lambda out, ck: agg.writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", ck), "latency-a", spark)
    win = spark.readStream.schema(spark.read.parquet(p["sink"]).schema).parquet(p["sink"])
    cond = win.select("endpoint", (F.unix_micros(F.col("window_end").cast("timestamp")) / 1_000_000).cast("long")
                      .alias("step_ts"), (F.col("p_quantile") > LATENCY_THRESHOLD).alias("firing_cond"))
    runs = sta.alert_runs_stream(cond, 60)
    base = scratch_path(spark, "alert-runs")

    def _write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
    stc.run_available_now(lambda out, ck: runs.writeStream.outputMode("update").foreachBatch(_write)
                          .option("checkpointLocation", ck), "alerts", spark)
    return sta.latest_runs(spark.read.parquet(base).drop("batch_id"), ALERT_HOLD_SECONDS)


def _yearly_registry(spark, root, name="registry", newest=None):
    """The yearly runs (or the ``newest`` ones) registered one after the other, each against the champion it meets."""
    table = rg.RegistryTable(spark, scratch_path(spark, name))
    runs = cut_lineage(_runs(spark, root).withColumn("texts", F.create_map().cast("map<string,string>")), "runs")
    years = [r["year"] for r in runs.select("year").distinct().orderBy("year").collect()]
    for y in years[-newest:] if newest else years:                                       # one row and one commit a year
        table.register(runs.where(F.col("year") == y).drop("year", "version", "run_id"), tag_cols={"years": F.lit(y)})
    return table


def q_registry_lifecycle(spark, root):
    """R1 + M4 + R3 on the registry table: champion, challenger and archive branches, commit by commit."""
    _, runs, events = _yearly_registry(spark, root).state()
    state = rg.current_state(events)
    return runs.join(state.select("model_name", "version", "stage", "tags"), ["model_name", "version"]).select(
        "version", "run_id", F.round(F.col("metrics")["f1_score"], 9).alias("f1_score"),
        F.round(F.col("metrics")["production_metric_before"], 9).alias("production_f1_before"),
        (F.col("params")["is_better"] == "true").alias("is_better"),
        F.round(F.col("metrics")["improvement_pct"], 6).alias("improvement_pct"), F.col("stage").alias("final_stage"),
        F.col("tags")["is_production"].alias("tag_is_production"))


def q_train_and_promote(spark, root):
    """M5: split 3 -> oversample -> fit -> score test -> metrics -> compare with the registry's champion -> promote."""
    from tidemark.plans.training import train_and_promote
    split, _, model = _fitted(spark, root)
    cat = _catalog(spark, root, split)
    raw = sp.split_rows(split.where(~F.col("is_test")), cat, 3, "year")
    entry = cat.where(F.col("split_id") == 3).first()
    table = _yearly_registry(spark, root, "registry-training", newest=1)
    logged = {"split_id": 3, "split_name": entry["split_name"], "start_year": entry["start_year"], "end_year": entry["end_year"]}
    res = train_and_promote(model.transform(raw), model.transform(split.where(F.col("is_test"))), _feature_cols(model),
                            fx.OBS_LABEL, logged, MODEL_NAME, table, fx.OBS_KEY, identity=raw)
    last, runs, events = table.state()
    new = runs.join(rg.current_state(events), ["model_name", "version"]).where(
        F.col("version") == F.lit(res["commit"]))
    return new.select(
        "version", "run_id", F.col("params")["split_id"].alias("split_id"), F.col("params")["split_name"].alias("split_name"),
        F.col("params")["train_samples"].alias("train_samples"), F.col("params")["is_better"].alias("is_better"),
        F.col("metrics")["f1_score"].alias("f1_score"), F.col("metrics")["roc_auc"].alias("roc_auc"), "stage")


QUERIES["registry_lifecycle"] = q_registry_lifecycle
QUERIES.update({
    "stream_latency_alerts": q_stream_latency_alerts,
    "train_and_promote": q_train_and_promote,
})


def q_drift_all_splits(spark, root):
    """D11 for every cumulative split against split 1 in one pass."""
    split = pp.split_obs(spark, root)
    cat = _catalog(spark, root, split)
    train = split.where(~F.col("is_test") & F.col("year").between(fx.YEAR_START, fx.YEAR_END))
    per = dr.drift_by_split(train, cat, "year", fx.OBS_NUMERIC, ["l_linestatus", "season"], 1,
                             size_rule=True)
    dec = dr.split_decisions(per, 1)
    return dec.select("split_id", "number_of_drifted_columns",
                      F.round("share_of_drifted_columns", 9).alias("share_of_drifted_columns"),
                      "severity", "retrain", "decision_reason")


QUERIES["drift_all_splits"] = q_drift_all_splits

QUALITY_TRIAL_DAYS = 10                     # a weak month's version is rolled back after so many days
QUALITY_HOLD_DAYS = 14
DAY = 86_400


def _monthly_registry(spark, root):
    """One version a month, promoted whatever its F1; a version below the average F1 is replaced by the
    one before after a trial.  Returns (runs, stage events with times, the average)."""
    month = F.trunc("o_orderdate", "month")
    m = ev.binary_metrics(_scored_pred(spark, root).withColumn("month", month), "label", "prediction", "score", group_cols=["month"])
    runs = cut_lineage(rg.runs_from_metrics(m, "month", MODEL_NAME, param_cols=("month",)), "monthly-runs")
    f1 = F.col("metrics")["f1_score"]
    average = runs.agg(F.round(F.avg(f1), 4)).first()[0]
    v, at = F.col("version"), F.unix_date("month") * F.lit(DAY).cast("long")
    weak = (f1 < F.lit(average if average is not None else 0.0)) & (v > 1)
    trial = at + QUALITY_TRIAL_DAYS * DAY
    steps = [(v - 2, "Archived", at, v > 2), (v - 1, "Archived", at, v > 1), (v, "Production", at, F.lit(True)),
             (v, "Archived", trial, weak), (v - 1, "Production", trial, weak)]
    made = F.array_compact(F.array(*[F.when(when, F.struct(ver.cast("int").alias("version"), (v.cast("long") * 10 + i).alias("seq"),
                                                           F.lit(stage).alias("stage"), t.alias("event_ts")))
                                     for i, (ver, stage, t, when) in enumerate(steps)]))
    return runs, runs.select("model_name", F.inline(made)), average


def q_model_quality_alerts(spark, root):
    """R5 + W6: the production model's F1 below the threshold, evaluated daily, held for two weeks."""
    runs, events, average = _monthly_registry(spark, root)
    last = runs.agg(F.max(F.unix_date("month"))).first()[0] or 0
    runs_of_alert = tm.gauge_alerts(rg.production_gauge(events, runs), lambda value: value < F.lit(average).cast("double"), DAY,
                                    QUALITY_HOLD_DAYS * DAY, last * DAY)
    return runs_of_alert.drop("model_name").withColumn("lowest_value", F.round("lowest_value", 9))


QUERIES["model_quality_alerts"] = q_model_quality_alerts


def _stream_two_sinks(spark, requests, name, vocab, contract, keep, score):
    """T4: requests arriving as files -> M3 per micro-batch -> scored rows and rejects in two sinks, read back as one frame."""
    landing = stc.land_files(requests, name)
    src = spark.readStream.schema(requests.schema).parquet(landing)
    checked = vl.checked_requests(src, vocab, contract, keep=keep)
    base = scratch_path(spark, f"{name}-out")
    rejects = ["is_valid", "errors", *(keep or fx.OBS_KEY)]
    writer = sts.write_two_sinks(f"{base}/valid", f"{base}/rejected", score, rejects)
    stc.run_available_now(
        lambda out, ck: checked.writeStream.foreachBatch(writer).option("checkpointLocation", ck), name, spark)
    return sts.read_two_sinks(spark, f"{base}/valid", f"{base}/rejected")


def q_stream_request_scoring(spark, root):
    """T4 + M3: ``request_scoring`` as a stream; the scored rows and the rejects of both sinks."""
    model = _station_model(spark, root)
    out = _stream_two_sinks(spark, fx.station_requests(spark, root), "station-requests",
                            vl.known_values(spark, model, "location"), vl.STATION, ["request_id"],
                            lambda good: _score_stations(good, model))
    return _station_columns(out)


def q_stream_scoring(spark, root):
    """T4 + M3: ``simple_scoring`` as a stream, the boosted trees applied per micro-batch; both sides."""
    split, _, model = _fitted(spark, root)
    fitted = _stored_gbt(spark, split, model)
    out = _stream_two_sinks(spark, _obs_request_json(spark, root, split), "obs-requests",
                            vl.known_values(spark, model, "c_mktsegment"), OBS_REQUEST, [],
                            lambda good: _score_obs(good, model, fitted))
    return out.drop("is_valid") if "errors" in out.columns else out


QUERIES["stream_scoring"] = q_stream_scoring
QUERIES["stream_request_scoring"] = q_stream_request_scoring


def q_joined_training_rows(spark, root):
    """J1 + P8 + P12: features and labels kept as separate tables, joined by row id; booleans as 0/1."""
    train = pp.split_obs(spark, root).where(~F.col("is_test")).withColumn("row_id", F.concat_ws("-", *fx.OBS_KEY))
    table = cl.bools_to_int(train.select("row_id", *fx.OBS_NUMERIC, (F.col("season") == "Summer").alias("is_summer"),
                                         (F.col("l_linestatus") == "O").alias("is_open"), fx.OBS_LABEL))
    features, label = cl.features_and_label(table, fx.OBS_LABEL)
    x, y = cut_lineage(table.select(*features), "training-x"), cut_lineage(table.select("row_id", label), "training-y")
    return cl.join_labels(x, y, "row_id")


def q_drift_result_sink(spark, root):
    """The per-column drift result and its summary appended to their tables and read back."""
    enc, model = _encoded(spark, root)
    ref, cur = _ref_cur(enc)
    per = cut_lineage(dr.column_drift(ref, cur, _drift_cols(model), [], with_pvalues=False, size_rule=True), "drift-columns")
    path = scratch_path(spark, "drift-result")
    dr.write_drift_result(per, dr.dataset_summary(per), path, f"{fx.YEAR_END}-12-31T00:00:00")
    total = spark.read.parquet(f"{path}/summary").select("run_ts", "number_of_columns", "number_of_drifted_columns")
    return spark.read.parquet(f"{path}/columns").join(F.broadcast(total), "run_ts").select(
        "run_ts", "column_name", "stattest", F.round("drift_score", 6).alias("drift_score"), "drift_detected",
        "number_of_columns", "number_of_drifted_columns")


QUERIES.update({
    "joined_training_rows": q_joined_training_rows,
    "drift_result_sink": q_drift_result_sink,
})
