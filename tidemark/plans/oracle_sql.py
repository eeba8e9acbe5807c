"""DuckDB SQL for each registered query, built from the shared fixture CTEs."""

from __future__ import annotations

from tidemark.plans import fixtures as fx
from tidemark.plans.fixtures import SQL_LOG, SQL_OBS, SQL_OBS_WIDE, SQL_SCORED

# The interim projection (P4-P7) in SQL.
_INTERIM_COLS = """l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         discount, tax, l_linestatus{extra},
         CAST(CASE target WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS INTEGER) AS target,
         CAST(year(obs_date) AS INTEGER) AS year,
         CASE WHEN month(obs_date) IN (12, 1, 2) THEN 'Summer'
              WHEN month(obs_date) IN (3, 4, 5) THEN 'Autumn'
              WHEN month(obs_date) IN (6, 7, 8) THEN 'Winter'
              ELSE 'Spring' END AS season"""


def _interim(src: str, extra: str = "") -> str:
    return f"""interim AS (
  SELECT {_INTERIM_COLS.format(extra=extra)}
  FROM {src} WHERE target IS NOT NULL)"""


_SPLIT = """cls AS (SELECT target, count(*) AS n_class FROM interim GROUP BY target),
q0 AS (SELECT target, n_class, sum(n_class) OVER () AS n,
              sum(n_class) OVER () - CAST(ceil(CAST(0.2 AS DOUBLE) * CAST(sum(n_class) OVER () AS DOUBLE)) AS BIGINT) AS n_train
       FROM cls),
q1 AS (SELECT *, CAST(n_class * n_train AS DOUBLE) / CAST(n AS DOUBLE) AS cont FROM q0),
q2 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM q1),
q3 AS (SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, target) AS rk FROM q2),
quota AS (SELECT target, n_class - CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS test_quota FROM q3),
split AS (
  SELECT i.*, row_number() OVER (
           PARTITION BY i.target
           ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
                    l_orderkey, l_linenumber, l_partkey, l_suppkey) <= q.test_quota AS is_test
  FROM interim i JOIN quota q ON i.target = q.target)"""


def with_split(wide: bool = False) -> str:
    if wide:
        return "WITH " + SQL_OBS_WIDE + ",\n" + _interim("obs_wide", ", o_orderpriority, c_mktsegment") + ",\n" + _SPLIT
    return "WITH " + SQL_OBS + ",\n" + _interim("obs") + ",\n" + _SPLIT


SPLIT_SUMMARY = with_split() + """,
yc AS (SELECT year, count(*) AS n_rows, count(*) FILTER (WHERE target = 1) AS n_pos
       FROM split WHERE NOT is_test AND year BETWEEN 1995 AND 2000 GROUP BY year),
s AS (SELECT year,
             CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS split_id,
             CAST(min(year) OVER () AS INTEGER) AS start_year,
             CAST(year AS INTEGER) AS end_year,
             CAST(sum(n_rows) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS train_samples,
             CAST(sum(n_pos) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS pos
      FROM yc),
n AS (SELECT CASE WHEN start_year = end_year THEN CAST(end_year AS VARCHAR)
                  ELSE CAST(start_year AS VARCHAR) || '-' || CAST(end_year AS VARCHAR) END AS years, *
      FROM s)
SELECT split_id, years, printf('split_%02d_%s', split_id, years) AS split_name,
       start_year, end_year, train_samples,
       (SELECT count(*) FROM split WHERE is_test) AS test_samples,
       round((train_samples - pos) / train_samples, 6) AS share_negative,
       round(pos / train_samples, 6) AS share_positive
FROM n"""

ORACLES: dict[str, str] = {
    "cumulative_split_summary": SPLIT_SUMMARY,
}

_OBS_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "discount", "tax", "l_returnflag", "l_linestatus", "l_shipdate", "obs_date", "target"]


def _null_profile() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM obs"
        for c in _OBS_COLS)
    return "WITH " + SQL_OBS + "\n" + parts


def _missing_share() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS s FROM obs"
        for c in _OBS_COLS)
    return ("WITH " + SQL_OBS + ",\nm AS (" + parts + ")\n"
            "SELECT column_name, round(s, 6) AS null_share, s > 0.30 AS drop_column FROM m")


def _column_profile() -> str:
    cols = ["l_quantity", "l_extendedprice", "discount", "tax"]
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n_values, count(*) - count({c}) AS n_nulls,
                  count(DISTINCT {c}) AS n_distinct, min({c}) AS min_value, max({c}) AS max_value,
                  round(avg({c}), 6) AS mean_value, round(stddev_samp({c}), 6) AS std_value FROM obs"""
        for c in cols)
    return "WITH " + SQL_OBS + "\n" + parts


_CATALOG_CTE = """,
yc AS (SELECT year, count(*) AS n_rows FROM split WHERE NOT is_test AND year BETWEEN 1995 AND 2000 GROUP BY year),
cat AS (SELECT CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS split_id,
               CAST(min(year) OVER () AS INTEGER) AS start_year, CAST(year AS INTEGER) AS end_year FROM yc)"""

ORACLES.update({
    "interim_obs": "WITH " + SQL_OBS + ",\n" + _interim("obs") + "\nSELECT * FROM interim",
    "split_class_quotas": with_split().split(",\nsplit AS (")[0] + """
SELECT q3.target, q3.n_class, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS train_quota,
       quota.test_quota FROM q3 JOIN quota ON q3.target = quota.target""",
    "stratified_test_rows": with_split() + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target FROM split WHERE is_test""",
    "rows_per_year": with_split() + """
SELECT CAST(round_even(year, 0) AS INTEGER) AS year, count(*) AS n_rows FROM split WHERE NOT is_test GROUP BY 1""",
    "class_distribution": with_split() + """
SELECT target, count(*) AS n_rows, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share
FROM split WHERE NOT is_test GROUP BY target""",
    "year_range": "WITH " + SQL_OBS + ",\n" + _interim("obs") + """
SELECT min(year) AS min_value, max(year) AS max_value FROM interim""",
    "distinct_years": "WITH " + SQL_OBS + ",\n" + _interim("obs") + """
SELECT DISTINCT year FROM interim WHERE year BETWEEN 1995 AND 2000""",
    "null_profile": _null_profile(),
    "missing_share_columns": _missing_share(),
    "column_profile": _column_profile(),
    "duplicate_documents": """
SELECT md5(text) AS text_md5, count(*) AS n_copies FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "split_members": with_split() + _CATALOG_CTE + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, split.year, target
FROM split, cat WHERE NOT is_test AND cat.split_id = 3 AND split.year BETWEEN cat.start_year AND cat.end_year""",
    "next_split": with_split() + _CATALOG_CTE + """,
have AS (SELECT max(split_id) AS last_id, max(end_year) AS last_end FROM cat WHERE split_id <= 3),
yrs AS (SELECT DISTINCT year AS y FROM interim WHERE year BETWEEN 1995 AND 2000),
r AS (SELECT min(y) AS first_year, min(y) FILTER (WHERE y > (SELECT last_end FROM have)) AS next_year FROM yrs)
SELECT CASE WHEN next_year IS NULL THEN 'complete' ELSE 'created' END AS status,
       CAST((SELECT last_id FROM have) + 1 AS INTEGER) AS split_id,
       CAST(first_year AS INTEGER) AS start_year, CAST(next_year AS INTEGER) AS end_year,
       CAST(first_year AS VARCHAR) || '-' || CAST(next_year AS VARCHAR) AS years
FROM r""",
})

_NUM = ["l_quantity", "l_extendedprice", "discount", "tax"]
_CAT = ["l_linestatus", "o_orderpriority", "c_mktsegment", "season"]
# The category domains of the driver tables, sorted; the first is dropped.
_DOMAINS = {
    "l_linestatus": ["F", "O"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "season": ["Autumn", "Spring", "Summer", "Winter"],
}


def _dummy(c, v):
    import re
    return f"{c}_" + re.sub(r"[^0-9A-Za-z]+", "_", v).strip("_")


def _medians_sql():
    return ", ".join(f"median({c}) AS {c}" for c in _NUM)


def _modes_sql(src):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS c FROM {src} "
        f"WHERE {c} IS NOT NULL GROUP BY 2" for c in _CAT)
    return parts


_FEAT = with_split(wide=True) + f""",
tr AS (SELECT * FROM split WHERE NOT is_test),
med AS (SELECT {_medians_sql()} FROM tr),
imp AS (SELECT s.* REPLACE ({", ".join(f"coalesce(s.{c}, med.{c}) AS {c}" for c in _NUM)}) FROM split s, med),
sc AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _NUM)} FROM imp WHERE NOT is_test)"""

ORACLES.update({
    "train_medians": with_split() + ",\ntr AS (SELECT * FROM split WHERE NOT is_test)\n" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(median({c}), 6) AS median FROM tr" for c in _NUM),
    "train_modes": with_split(wide=True) + ",\ntr AS (SELECT * FROM split WHERE NOT is_test),\n"
        "vc AS (" + _modes_sql("tr") + ")\n"
        "SELECT column_name, value AS mode FROM (SELECT *, row_number() OVER "
        "(PARTITION BY column_name ORDER BY c DESC, value) AS rn FROM vc) WHERE rn = 1",
    "onehot_vocabulary": with_split(wide=True) + ",\ntr AS (SELECT * FROM split WHERE NOT is_test),\n"
        "vc AS (" + _modes_sql("tr") + ")\n"
        "SELECT column_name, value, CAST(row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INTEGER) AS position,\n"
        "  CASE WHEN row_number() OVER (PARTITION BY column_name ORDER BY value) > 1 THEN column_name || '_' ||\n"
        "    regexp_replace(regexp_replace(value, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g') END AS dummy_column\n"
        "FROM vc",
    "scaler_params": _FEAT + "\n" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS std FROM sc" for c in _NUM),
    "encoded_features": _FEAT + "\nSELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, target, year, is_test, " +
        ", ".join(f"round((imp.{c} - m_{c}) / CASE WHEN s_{c} < {10 * 2.220446049250313e-16!r} THEN 1.0 ELSE s_{c} END, 6) AS {c}"
                  for c in _NUM) + ", " +
        ", ".join(f"CAST(coalesce(imp.{c} = '{v}', false) AS INTEGER) AS \"{_dummy(c, v)}\""
                  for c in _CAT for v in _DOMAINS[c][1:]) +
        "\nFROM imp, sc",
})

_PRED = "WITH " + SQL_SCORED + ",\np AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction, " \
        "CAST(year(o_orderdate) AS INTEGER) AS year FROM scored)"


def _metrics_sql(group: str = "") -> str:
    gsel = f"{group}, " if group else ""
    gby = f"GROUP BY {group}" if group else ""
    part = f"PARTITION BY {group} " if group else ""
    on = f"USING ({group})" if group else "ON TRUE"
    return _PRED + f""",
c AS (SELECT {gsel}count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
             count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM p {gby}),
g AS (SELECT {gsel}score, sum(label) AS pos, sum(1 - label) AS neg FROM p {gby}{', ' if group else 'GROUP BY '}score),
cum AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
auc AS (SELECT {gsel}sum(CAST(pos AS DOUBLE) * (CAST(below AS DOUBLE) + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc
        FROM cum {gby})
SELECT {gsel}tp, fp, fn, tn,
       round(CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) END, 9) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 9) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 9) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 9) AS f1_score,
       round(roc_auc, 9) AS roc_auc
FROM c JOIN auc {on}"""


ORACLES.update({
    "confusion_matrix": _PRED + """
SELECT a.v AS actual, b.v AS predicted, count(p.label) AS n_rows
FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) b(v)
LEFT JOIN p ON p.label = a.v AND p.prediction = b.v GROUP BY 1, 2""",
    "binary_metrics": _metrics_sql(),
    "metrics_by_year": _metrics_sql("year"),
    "classification_report": _PRED + """,
k AS (SELECT v AS cls, CASE v WHEN 0 THEN 'No' ELSE 'Yes' END AS row_name FROM (VALUES (0), (1)) t(v)),
pc AS (SELECT row_name,
              count(*) FILTER (WHERE label = cls AND prediction = cls) AS tp,
              count(*) FILTER (WHERE prediction = cls) AS pp,
              count(*) FILTER (WHERE label = cls) AS sup
       FROM k, p GROUP BY row_name),
m AS (SELECT row_name,
             CASE WHEN pp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pp END AS precision,
             CASE WHEN sup = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / sup END AS recall,
             CASE WHEN pp + sup = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (pp + sup) END AS f1_score,
             sup AS support FROM pc),
tot AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS correct FROM p)
SELECT row_name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(correct AS DOUBLE) / n, 9), n FROM tot
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1_score), 9), (SELECT n FROM tot) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / (SELECT n FROM tot), 9),
                 round(sum(recall * support) / (SELECT n FROM tot), 9),
                 round(sum(f1_score * support) / (SELECT n FROM tot), 9), (SELECT n FROM tot) FROM m""",
})


# ---------------------------------------------------------------- drift SQL
def _enc_cte() -> str:
    cols = ", ".join(f"(imp.{c} - m_{c}) / CASE WHEN s_{c} < {10 * 2.220446049250313e-16!r} THEN 1.0 ELSE s_{c} END AS {c}"
                     for c in _NUM)
    dums = ", ".join(f"CAST(coalesce(imp.{c} = '{v}', false) AS INTEGER) AS \"{_dummy(c, v)}\""
                     for c in _CAT for v in _DOMAINS[c][1:])
    return _FEAT + f""",
enc AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, target, year, is_test, {cols}, {dums} FROM imp, sc)"""


_ENC_COLS = [*_NUM, "year"] + [_dummy(c, v) for c in _CAT for v in _DOMAINS[c][1:]]


def _long_cte(ref: str, cur: str, cols, vtype: str = "DOUBLE") -> str:
    sel = ", ".join(f'CAST("{c}" AS {vtype}) AS "{c}"' for c in cols)
    on = ", ".join(f'"{c}"' for c in cols)
    return f"""long AS (
  SELECT 0 AS side, column_name, value FROM (UNPIVOT (SELECT {sel} FROM {ref}) ON {on} INTO NAME column_name VALUE value)
  UNION ALL
  SELECT 1 AS side, column_name, value FROM (UNPIVOT (SELECT {sel} FROM {cur}) ON {on} INTO NAME column_name VALUE value)),
vc AS (SELECT column_name, value, count(*) FILTER (WHERE side = 0) AS n_ref, count(*) FILTER (WHERE side = 1) AS n_cur
       FROM long WHERE value IS NOT NULL GROUP BY ALL),
tot AS (SELECT column_name, sum(n_ref) AS tot_ref, sum(n_cur) AS tot_cur, count(*) AS n_unique FROM vc GROUP BY 1)"""


_NUM_STATS = """,
cum AS (SELECT vc.*, tot_ref, tot_cur, n_unique,
               CAST(sum(n_ref) OVER w AS DOUBLE) / tot_ref AS fr, CAST(sum(n_cur) OVER w AS DOUBLE) / tot_cur AS fc,
               lead(value) OVER (PARTITION BY column_name ORDER BY value) AS nxt
        FROM vc JOIN tot USING (column_name)
        WINDOW w AS (PARTITION BY column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
mu AS (SELECT column_name, sum(value * n_ref) / sum(n_ref) AS mu FROM vc GROUP BY 1),
num AS (SELECT column_name, CAST(any_value(tot_ref) AS BIGINT) AS n_ref, CAST(any_value(tot_cur) AS BIGINT) AS n_cur,
               CAST(any_value(n_unique) AS BIGINT) AS n_unique,
               sum(abs(fr - fc) * coalesce(nxt - value, 0))
                 / greatest(sqrt(sum(n_ref * (value - mu) * (value - mu)) / sum(n_ref)), 0.001) AS wasserstein_norm,
               max(abs(fr - fc)) AS ks_statistic
        FROM cum JOIN mu USING (column_name) GROUP BY 1),
numz AS (SELECT *, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) * ks_statistic AS z FROM num),
nump AS (SELECT *, CASE WHEN z < 0.18 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101),
                lambda k: 2.0 * pow(-1.0, k - 1) * exp(-2.0 * k * k * z * z))), 0.0), 1.0) END AS ks_pvalue FROM numz)"""

_CAT_STATS = """,
pq AS (SELECT vc.*, tot_ref, tot_cur, n_unique,
              CASE WHEN n_ref = 0 THEN 0.0001 ELSE CAST(n_ref AS DOUBLE) / tot_ref END AS p,
              CASE WHEN n_cur = 0 THEN 0.0001 ELSE CAST(n_cur AS DOUBLE) / tot_cur END AS q,
              CAST(n_ref * tot_cur AS DOUBLE) / tot_ref AS e
       FROM vc JOIN tot USING (column_name)),
pn AS (SELECT *, p / sum(p) OVER (PARTITION BY column_name) AS pn, q / sum(q) OVER (PARTITION BY column_name) AS qn FROM pq),
cat AS (SELECT column_name, CAST(any_value(tot_ref) AS BIGINT) AS n_ref, CAST(any_value(tot_cur) AS BIGINT) AS n_cur,
               CAST(any_value(n_unique) AS BIGINT) AS n_unique, CAST(any_value(n_unique) - 1 AS INTEGER) AS chi_dof,
               sqrt(greatest(0.0, 0.5 * sum(pn * ln(pn / ((pn + qn) / 2))) + 0.5 * sum(qn * ln(qn / ((pn + qn) / 2))))) AS jensen_shannon,
               sum(CASE WHEN e = 0 THEN CASE WHEN n_cur = 0 THEN 0.0 ELSE CAST('inf' AS DOUBLE) END
                        ELSE (n_cur - e) * (n_cur - e) / e END) AS chi_square
        FROM pn GROUP BY 1)"""

_SELECT_TEST = """,
sel AS (SELECT num.column_name,
               CASE WHEN num.n_unique <= 5 THEN 'jensenshannon' ELSE 'wasserstein' END AS stattest,
               CASE WHEN num.n_unique <= 5 THEN cat.jensen_shannon ELSE num.wasserstein_norm END AS score
        FROM num LEFT JOIN cat USING (column_name))"""

_REFCUR = """,
ref AS (SELECT * FROM {src} WHERE NOT is_test AND year BETWEEN 1995 AND 1995),
cur AS (SELECT * FROM {src} WHERE NOT is_test AND year BETWEEN 1995 AND 2000)"""

_DRIFT_COLUMNS = (_enc_cte() + _REFCUR.format(src="enc") + ",\n" + _long_cte("ref", "cur", _ENC_COLS)
                  + _NUM_STATS + _CAT_STATS + _SELECT_TEST)

_BASELINE = (_enc_cte() + _REFCUR.format(src="enc") + """,
cutr AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
                                      l_orderkey, l_linenumber, l_partkey, l_suppkey)
                   <= floor(CAST(count(*) OVER () AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS first_part FROM ref),
a AS (SELECT * FROM cutr WHERE first_part),
b AS (SELECT * FROM cutr WHERE NOT first_part),\n""" + _long_cte("a", "b", _ENC_COLS)
             + _NUM_STATS + _CAT_STATS + _SELECT_TEST)

ORACLES.update({
    "drift_numeric_tests": with_split() + _REFCUR.format(src="split") + ",\n" + _long_cte("ref", "cur", _NUM)
        + _NUM_STATS + """
SELECT column_name, n_ref, n_cur, n_unique, round(wasserstein_norm, 6) AS wasserstein_norm,
       round(ks_statistic, 9) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue FROM nump""",
    "drift_categorical_tests": with_split(wide=True) + _REFCUR.format(src="split") + ",\n"
        + _long_cte("ref", "cur", _CAT, "VARCHAR") + _CAT_STATS + """
SELECT column_name, n_ref, n_cur, n_unique, chi_dof, round(jensen_shannon, 9) AS jensen_shannon,
       round(chi_square, 6) AS chi_square FROM cat""",
    "drift_columns": _DRIFT_COLUMNS + """
SELECT column_name, stattest, round(score, 6) AS drift_score, score >= 0.1 AS drift_detected FROM sel""",
    "drift_baseline": _BASELINE + """
SELECT column_name, stattest, round(score, 6) AS drift_score, score >= 0.1 AS drift_detected FROM sel""",
    "drift_report": _DRIFT_COLUMNS + """,
s AS (SELECT count(*) AS number_of_columns, count(*) FILTER (WHERE score >= 0.1) AS number_of_drifted_columns,
             CAST(count(*) FILTER (WHERE score >= 0.1) AS DOUBLE) / count(*) AS share FROM sel)
SELECT 1 AS reference_split, 6 AS current_split, number_of_columns, number_of_drifted_columns,
       round(share, 9) AS share_of_drifted_columns, share > 0 AS dataset_drift,
       CASE WHEN NOT share > 0 THEN 'OK' WHEN share >= 0.04 THEN 'CRITICAL' WHEN share >= 0.02 THEN 'WARNING' ELSE 'INFO' END AS severity,
       NOT share < 0.02 AS retrain,
       CASE WHEN share < 0.02 THEN 'drift_below_threshold' ELSE 'drift_above_threshold' END AS decision_reason
FROM s""",
})


# ------------------------------------------------------------- registry SQL
_REG = _PRED + """,
c AS (SELECT year, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
             count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM p GROUP BY year),
g AS (SELECT year, score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY year, score),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY year ORDER BY score
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
auc AS (SELECT year, sum(CAST(pos AS DOUBLE) * (CAST(below AS DOUBLE) + 0.5 * neg))
                     / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc_raw FROM cum GROUP BY year),
runs AS (SELECT c.year, auc_raw,
                CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1_raw,
                round(CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) END, 9) AS accuracy,
                round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 9) AS precision,
                round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 9) AS recall,
                CAST(row_number() OVER (ORDER BY c.year) AS INTEGER) AS version
         FROM c JOIN auc ON c.year = auc.year)"""
_REG += """,
dec AS (SELECT *, max(f1_raw) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM runs),
dec2 AS (SELECT *, prev IS NULL OR f1_raw > prev AS is_better,
                CASE WHEN prev IS NULL THEN NULL WHEN prev > 0 THEN (f1_raw - prev) / prev * 100 ELSE 100.0 END AS imp FROM dec),
last_prod AS (SELECT max(version) AS v FROM dec2 WHERE is_better),
st AS (SELECT dec2.*, CASE WHEN version = (SELECT v FROM last_prod) THEN 'Production'
                           WHEN is_better THEN 'Archived' ELSE 'None' END AS final_stage FROM dec2)"""

ORACLES.update({
    "registry_promotions": _REG + """
SELECT version, printf('run_obs_model_%02d', version) AS run_id, round(f1_raw, 9) AS f1_score,
       round(prev, 9) AS production_f1_before, is_better, round(imp, 6) AS improvement_pct, final_stage FROM st""",
    "registry_lifecycle": _REG + """
SELECT version, printf('run_obs_model_%02d', version) AS run_id, round(f1_raw, 9) AS f1_score,
       round(prev, 9) AS production_f1_before, is_better, round(imp, 6) AS improvement_pct, final_stage,
       CASE WHEN final_stage = 'Production' THEN 'True' ELSE 'False' END AS tag_is_production FROM st""",
    "production_model": _REG + """
SELECT version, printf('run_obs_model_%02d', version) AS run_id, CASE WHEN year BETWEEN 1995 AND 2000 THEN year - 1994 END AS split_id,
       round(f1_raw, 9) AS f1_score, accuracy, precision,
       recall, round(auc_raw, 9) AS roc_auc, f1_raw < 0.6 AS f1_alert FROM st WHERE final_stage = 'Production'""",
    "registry_archive_all": _REG + """
SELECT version, 'Archived' AS stage, 'true' AS tag_archived,
       strftime((SELECT max(o_orderdate) FROM orders), '%Y-%m-%dT%H:%M:%S') AS tag_archived_at,
       CASE WHEN final_stage = 'Production' THEN 'True' ELSE 'False' END AS tag_is_production,
       printf('%.4f', f1_raw) AS tag_f1_score FROM st""",
})


# ------------------------------------------------------------ telemetry SQL
_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
_LES = "(VALUES " + ", ".join(f"(CAST({b} AS DOUBLE))" for b in _BOUNDS) + ", (CAST('inf' AS DOUBLE))) b(le)"
_ALLOWED = "('click', 'view', 'purchase', 'signup')"


def _quantile_sql(src: str, keys: str) -> str:
    """A18 over cumulative buckets in ``src`` (columns keys..., le, cum_count)."""
    return f"""h AS (SELECT *, lag(le) OVER w AS prev_le, coalesce(lag(cum_count) OVER w, 0) AS prev_cum,
              max(cum_count) OVER (PARTITION BY {keys}) AS total,
              CAST(0.95 AS DOUBLE) * max(cum_count) OVER (PARTITION BY {keys}) AS rnk
       FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY le)),
hit AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY le) AS rn FROM h WHERE cum_count >= rnk AND total > 0),
qv AS (SELECT {keys}, CASE WHEN isinf(le) THEN prev_le WHEN cum_count - prev_cum = 0 THEN le
                   ELSE coalesce(prev_le, 0.0) + (le - coalesce(prev_le, 0.0)) * (rnk - prev_cum) / (cum_count - prev_cum) END AS quantile
       FROM hit WHERE rn = 1)"""


_WINDOWED = "WITH " + SQL_LOG + f""",
al AS (SELECT * FROM log WHERE endpoint IN {_ALLOWED}),
ex AS (SELECT al.*, time_bucket(INTERVAL 1 minute, ts) - to_minutes(k) AS window_start FROM al, range(0, 5) t(k)),
hist AS (SELECT window_start, endpoint, le, count(*) FILTER (WHERE duration <= le) AS cum_count FROM ex, {_LES} GROUP BY ALL),
rate AS (SELECT window_start, endpoint, count(*) / 300.0 AS rate FROM ex GROUP BY ALL),
""" + _quantile_sql("hist", "window_start, endpoint") + """,
wl AS (SELECT rate.window_start, rate.window_start + INTERVAL 5 minute AS window_end, rate.endpoint, rate.rate, qv.quantile
       FROM rate JOIN qv USING (window_start, endpoint))"""

ORACLES.update({
    "request_totals": "WITH " + SQL_LOG + "\nSELECT endpoint, method, status_code, count(*) AS n_requests FROM log GROUP BY ALL",
    "average_latency": "WITH " + SQL_LOG + """
SELECT endpoint, round(avg(a), 9) AS avg_latency
FROM (SELECT endpoint, method, sum(duration) / count(*) AS a FROM log GROUP BY ALL) GROUP BY endpoint""",
    "latency_histogram": "WITH " + SQL_LOG + f"""
SELECT endpoint, le, count(*) FILTER (WHERE duration <= le) AS cum_count FROM log, {_LES} GROUP BY ALL""",
    "latency_p95": "WITH " + SQL_LOG + f""",
al AS (SELECT * FROM log WHERE endpoint IN {_ALLOWED}),
hist AS (SELECT endpoint, le, count(*) FILTER (WHERE duration <= le) AS cum_count FROM al, {_LES} GROUP BY ALL),
""" + _quantile_sql("hist", "endpoint") + """
SELECT endpoint, round(quantile, 9) AS quantile FROM qv""",
    "windowed_latency": _WINDOWED + """
SELECT window_start, window_end, endpoint, round(rate, 9) AS rate, round(quantile, 9) AS p_quantile FROM wl""",
    "instant_rate": "WITH " + SQL_LOG + """,
per AS (SELECT endpoint, CAST(floor((epoch_us(ts) // 1000000) / 60) * 60 + 60 AS BIGINT) AS sample_ts, count(*) AS n
        FROM log GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY endpoint ORDER BY sample_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS counter FROM per),
l AS (SELECT *, lag(counter) OVER w AS pv, lag(sample_ts) OVER w AS pt FROM c WINDOW w AS (PARTITION BY endpoint ORDER BY sample_ts)),
r AS (SELECT endpoint, sample_ts, CAST(CASE WHEN counter < pv THEN counter ELSE counter - pv END AS DOUBLE) / (sample_ts - pt) AS irate
      FROM l WHERE pv IS NOT NULL)
SELECT endpoint, max(sample_ts) AS last_sample_ts, round(arg_max(irate, sample_ts), 9) AS irate FROM r GROUP BY endpoint""",
    "latency_alerts": _WINDOWED + """,
cond AS (SELECT endpoint, epoch_us(window_end) // 1000000 AS step_ts FROM wl WHERE quantile > 100.0),
isl AS (SELECT *, step_ts // 60 - row_number() OVER (PARTITION BY endpoint ORDER BY step_ts) AS island FROM cond),
g AS (SELECT endpoint, min(step_ts) AS start_ts, max(step_ts) AS end_ts, count(*) AS n_steps FROM isl GROUP BY endpoint, island)
SELECT endpoint, start_ts, end_ts, n_steps, end_ts - start_ts AS held_seconds, end_ts - start_ts >= 120 AS fired,
       CASE WHEN end_ts - start_ts >= 120 THEN start_ts + 120 END AS first_firing_ts FROM g""",
})


# -------------------------------------------------------------- sources SQL
ORACLES.update({
    "csv_roundtrip": ORACLES["interim_obs"],
    "params_json_roundtrip": with_split(wide=True) + ",\ntr AS (SELECT * FROM split WHERE NOT is_test),\n"
        "vc AS (" + _modes_sql("tr") + ")\n" + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, round(median({c}), 6) AS median, CAST(NULL AS VARCHAR) AS mode FROM tr"
            for c in _NUM) + """
UNION ALL SELECT column_name, CAST(NULL AS DOUBLE) AS median, value AS mode FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY c DESC, value) AS rn FROM vc) WHERE rn = 1""",
    "split_catalog_append": "SELECT * FROM (" + SPLIT_SUMMARY + ") WHERE split_id <= 4",
    "split_snapshot_fingerprint": with_split() + _CATALOG_CTE + """,
r AS (SELECT split.* FROM split, cat WHERE NOT is_test AND cat.split_id = 3 AND split.year BETWEEN cat.start_year AND cat.end_year)
SELECT 3 AS split_id, count(*) AS n_rows,
       CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', coalesce(length(CAST(l_orderkey AS VARCHAR)) || ':' || CAST(l_orderkey AS VARCHAR), 'N'),
             coalesce(length(CAST(l_linenumber AS VARCHAR)) || ':' || CAST(l_linenumber AS VARCHAR), 'N'),
             coalesce(length(CAST(l_partkey AS VARCHAR)) || ':' || CAST(l_partkey AS VARCHAR), 'N'),
             coalesce(length(CAST(l_suppkey AS VARCHAR)) || ':' || CAST(l_suppkey AS VARCHAR), 'N'),
             coalesce(length(CAST(year AS VARCHAR)) || ':' || CAST(year AS VARCHAR), 'N'),
             coalesce(length(CAST(target AS VARCHAR)) || ':' || CAST(target AS VARCHAR), 'N'))), 1, 15)) AS BIGINT)) AS DECIMAL(38, 0)) AS fingerprint
FROM r""",
})


# ----------------------------------------------------------- validation SQL
_DIRS = "('N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW')"
ORACLES.update({
    "request_validation": f"""WITH r AS (
  SELECT o_orderkey AS request_id, n_name AS location, o_totalprice / 10000 AS min_temp, c_acctbal / 100 AS max_temp,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS rain_today, c_acctbal / 1000 AS rainfall,
         NULLIF(CASE o_orderpriority WHEN '1-URGENT' THEN 'N' WHEN '2-HIGH' THEN 'NE' WHEN '3-MEDIUM' THEN 'E'
                WHEN '4-NOT SPECIFIED' THEN '' ELSE 'LOW' END, '') AS wind_gust_dir,
         o_totalprice / 5000 AS humidity_9am, c_acctbal / 50 AS wind_gust_speed
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT request_id, concat_ws(';',
         CASE WHEN rain_today NOT IN (0, 1) THEN 'rain_today' END,
         CASE WHEN rainfall < 0 THEN 'rainfall' END,
         CASE WHEN min_temp >= max_temp THEN 'temp_order' END,
         CASE WHEN wind_gust_dir IS NOT NULL AND wind_gust_dir NOT IN {_DIRS} THEN 'wind_gust_dir' END,
         CASE WHEN NOT humidity_9am BETWEEN 0 AND 100 THEN 'humidity_9am' END,
         CASE WHEN wind_gust_speed < 0 THEN 'wind_gust_speed' END,
         CASE WHEN location NOT IN (SELECT n_name FROM nation WHERE n_regionkey <> 0) THEN 'unknown_location' END) AS errors
      FROM r)
SELECT request_id, errors = '' AS is_valid, errors FROM e""",
    "request_features": _enc_cte() + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, year, """ + ", ".join(
        f"round({c}, 6) AS {c}" for c in _NUM) + ", " + ", ".join(f'"{c}"' for c in _ENC_COLS[5:]) + """
FROM enc WHERE is_test""",
})


# ------------------------------------------------------------ streaming SQL
ORACLES.update({
    "stream_windowed_latency": _WINDOWED + """
SELECT window_start, window_end, endpoint, round(rate, 9) AS rate, round(quantile, 9) AS p_quantile FROM wl
WHERE window_end <= (SELECT max(ts) FROM al) - INTERVAL 10 minute""",
})

ORACLES.update({
    "stream_request_validation": ORACLES["request_validation"],
})


# ------------------------------------------------------------- sampling SQL
ORACLES.update({
    "knn_neighbors": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS d
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rk FROM p)
SELECT vec_id, CAST(rk AS INTEGER) AS rank, neighbor_id, round(d, 6) AS distance FROM r WHERE rk <= 5""",
    "oversampled_class_counts": """SELECT label, count(*) AS n_before, max(count(*)) OVER () AS n_after
FROM embeddings GROUP BY label""",
    "seeded_sample": with_split() + """,
t AS (SELECT * FROM split WHERE NOT is_test AND year BETWEEN 1995 AND 2000),
r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
                                   l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, year, target FROM r WHERE rn <= 5000""",
    "input_example": with_split() + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, year, target FROM split WHERE NOT is_test
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5""",
})

ORACLES.update({
    "stream_latency_alerts": _WINDOWED + """,
wlc AS (SELECT * FROM wl WHERE window_end <= (SELECT max(ts) FROM al) - INTERVAL 10 minute),
cond AS (SELECT endpoint, epoch_us(window_end) // 1000000 AS step_ts FROM wlc WHERE quantile > 100.0),
isl AS (SELECT *, step_ts // 60 - row_number() OVER (PARTITION BY endpoint ORDER BY step_ts) AS island FROM cond),
g AS (SELECT endpoint, min(step_ts) AS start_ts, max(step_ts) AS end_ts, count(*) AS n_steps FROM isl GROUP BY endpoint, island)
SELECT endpoint, start_ts, end_ts, n_steps, end_ts - start_ts AS held_seconds, end_ts - start_ts >= 120 AS fired,
       CASE WHEN end_ts - start_ts >= 120 THEN start_ts + 120 END AS first_firing_ts FROM g""",
})


def _t1_sql() -> str:
    num, cat = _NUM, ["l_linestatus", "season"]
    nsel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in num)
    csel = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cat)
    return with_split() + f""",
tr AS (SELECT * FROM split WHERE NOT is_test AND year BETWEEN 1995 AND 2000),
yc AS (SELECT year, count(*) AS n_rows, count(*) FILTER (WHERE target = 1) AS n_pos FROM tr GROUP BY year),
cat AS (SELECT CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS split_id,
               CAST(min(year) OVER () AS INTEGER) AS start_year, CAST(year AS INTEGER) AS end_year,
               CAST(sum(n_rows) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS train_samples,
               CAST(sum(n_pos) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS pos
        FROM yc),
cur AS (SELECT c.split_id, t.* FROM cat c JOIN tr t ON t.year BETWEEN c.start_year AND c.end_year),
ref AS (SELECT c.split_id, t.* FROM cat c, tr t WHERE t.year BETWEEN 1995 AND 1995),
nl AS (SELECT split_id, 0 AS side, column_name, value FROM (UNPIVOT (SELECT split_id, {nsel} FROM ref) ON {", ".join(num)} INTO NAME column_name VALUE value)
       UNION ALL
       SELECT split_id, 1 AS side, column_name, value FROM (UNPIVOT (SELECT split_id, {nsel} FROM cur) ON {", ".join(num)} INTO NAME column_name VALUE value)),
cl AS (SELECT split_id, 0 AS side, column_name, value FROM (UNPIVOT (SELECT split_id, {csel} FROM ref) ON {", ".join(cat)} INTO NAME column_name VALUE value)
       UNION ALL
       SELECT split_id, 1 AS side, column_name, value FROM (UNPIVOT (SELECT split_id, {csel} FROM cur) ON {", ".join(cat)} INTO NAME column_name VALUE value)),
nvc AS (SELECT split_id, column_name, value, count(*) FILTER (WHERE side = 0) AS n_ref, count(*) FILTER (WHERE side = 1) AS n_cur
        FROM nl WHERE value IS NOT NULL GROUP BY ALL),
ntot AS (SELECT split_id, column_name, sum(n_ref) AS tot_ref, sum(n_cur) AS tot_cur, count(*) AS n_unique,
                sum(value * n_ref) / sum(n_ref) AS mu FROM nvc GROUP BY ALL),
ncum AS (SELECT nvc.*, tot_ref, tot_cur, n_unique, mu,
                CAST(sum(n_ref) OVER w AS DOUBLE) / tot_ref AS fr, CAST(sum(n_cur) OVER w AS DOUBLE) / tot_cur AS fc,
                lead(value) OVER (PARTITION BY split_id, column_name ORDER BY value) AS nxt
         FROM nvc JOIN ntot USING (split_id, column_name)
         WINDOW w AS (PARTITION BY split_id, column_name ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
nsc AS (SELECT split_id, column_name, any_value(n_unique) AS n_unique,
               sum(abs(fr - fc) * coalesce(nxt - value, 0))
                 / greatest(sqrt(sum(n_ref * (value - mu) * (value - mu)) / sum(n_ref)), 0.001) AS score
        FROM ncum GROUP BY ALL),
cvc AS (SELECT split_id, column_name, value, count(*) FILTER (WHERE side = 0) AS n_ref, count(*) FILTER (WHERE side = 1) AS n_cur
        FROM cl WHERE value IS NOT NULL GROUP BY ALL),
ctot AS (SELECT split_id, column_name, sum(n_ref) AS tot_ref, sum(n_cur) AS tot_cur FROM cvc GROUP BY ALL),
cpq AS (SELECT cvc.split_id, cvc.column_name,
               CASE WHEN n_ref = 0 THEN 0.0001 ELSE CAST(n_ref AS DOUBLE) / tot_ref END AS p,
               CASE WHEN n_cur = 0 THEN 0.0001 ELSE CAST(n_cur AS DOUBLE) / tot_cur END AS q
        FROM cvc JOIN ctot USING (split_id, column_name)),
cpn AS (SELECT *, p / sum(p) OVER (PARTITION BY split_id, column_name) AS pn,
                  q / sum(q) OVER (PARTITION BY split_id, column_name) AS qn FROM cpq),
csc AS (SELECT split_id, column_name,
               sqrt(greatest(0.0, 0.5 * sum(pn * ln(pn / ((pn + qn) / 2))) + 0.5 * sum(qn * ln(qn / ((pn + qn) / 2))))) AS score
        FROM cpn GROUP BY ALL),
allsc AS (SELECT split_id, score FROM nsc WHERE n_unique > 5 UNION ALL SELECT split_id, score FROM csc),
d AS (SELECT split_id, count(*) FILTER (WHERE score >= 0.1) AS n_drift,
             CAST(count(*) FILTER (WHERE score >= 0.1) AS DOUBLE) / count(*) AS share FROM allsc GROUP BY split_id)
SELECT cat.split_id,
       CASE WHEN start_year = end_year THEN CAST(end_year AS VARCHAR)
            ELSE CAST(start_year AS VARCHAR) || '-' || CAST(end_year AS VARCHAR) END AS years,
       start_year, end_year, train_samples, (SELECT count(*) FROM split WHERE is_test) AS test_samples,
       round(pos / train_samples, 6) AS share_positive, n_drift AS number_of_drifted_columns,
       round(share, 9) AS share_of_drifted_columns,
       CASE WHEN NOT share > 0 THEN 'OK' WHEN share >= 0.04 THEN 'CRITICAL' WHEN share >= 0.02 THEN 'WARNING' ELSE 'INFO' END AS severity,
       CASE WHEN cat.split_id = 1 THEN true ELSE NOT share < 0.02 END AS retrain,
       CASE WHEN cat.split_id = 1 THEN 'first_split' WHEN share < 0.02 THEN 'drift_below_threshold'
            ELSE 'drift_above_threshold' END AS decision_reason
FROM cat JOIN d USING (split_id)"""


ORACLES["stream_split_decisions"] = _t1_sql()

ORACLES["drift_all_splits"] = ("SELECT split_id, number_of_drifted_columns, share_of_drifted_columns, severity, "
                               "retrain, decision_reason FROM (" + _t1_sql() + ")")


# ------------------------------------------------------ request scoring SQL
def _station_scoring_sql() -> str:
    num, cat = fx.STATION_NUMERIC, fx.STATION_CATEGORICAL
    mode = lambda c: (f"(SELECT {c} FROM station_train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")
    imp = ", ".join([f"coalesce({c}, (SELECT median({c}) FROM station_train)) AS {c}" for c in num]
                    + [f"coalesce({c}, {mode(c)}) AS {c}" for c in cat])
    sc = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in num)
    z = ", ".join(f"(i.{c} - m_{c}) / CASE WHEN s_{c} < {10 * 2.220446049250313e-16!r} THEN 1.0 ELSE s_{c} END AS {c}" for c in num)
    names = ", ".join(f"CASE WHEN i.{c} <> (SELECT min({c}) FROM station_train) AND i.{c} IN (SELECT {c} FROM station_train)"
                      f" THEN '{c}_' || i.{c} END" for c in cat)
    scored = ", ".join(f"CASE WHEN is_valid THEN round({c}, 6) END AS {c}" for c in num)
    return f"""WITH {fx.SQL_STATIONS},
train_imp AS (SELECT {imp} FROM station_train),
sc AS (SELECT {sc} FROM train_imp),
e AS (SELECT *, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED'
       THEN 'malformed;missing_required;unknown_location' ELSE concat_ws(';',
         CASE WHEN location IS NULL THEN 'missing_required' END,
         CASE WHEN rain_today NOT IN (0, 1) THEN 'rain_today' END,
         CASE WHEN rainfall < 0 THEN 'rainfall' END,
         CASE WHEN min_temp >= max_temp THEN 'temp_order' END,
         CASE WHEN wind_gust_dir NOT IN {_DIRS} THEN 'wind_gust_dir' END,
         CASE WHEN wind_dir_9am NOT IN {_DIRS} THEN 'wind_dir_9am' END,
         CASE WHEN wind_dir_3pm NOT IN {_DIRS} THEN 'wind_dir_3pm' END,
         CASE WHEN NOT humidity_9am BETWEEN 0 AND 100 THEN 'humidity_9am' END,
         CASE WHEN NOT humidity_3pm BETWEEN 0 AND 100 THEN 'humidity_3pm' END,
         CASE WHEN wind_gust_speed < 0 THEN 'wind_gust_speed' END,
         CASE WHEN wind_speed_9am < 0 THEN 'wind_speed_9am' END,
         CASE WHEN wind_speed_3pm < 0 THEN 'wind_speed_3pm' END,
         CASE WHEN location IS NULL OR location NOT IN (SELECT location FROM station_train) THEN 'unknown_location' END,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'date' END) END AS errors
      FROM requests),
i AS (SELECT request_id, errors, errors = '' AS is_valid, year, rain_today, {imp} FROM e),
zd AS (SELECT i.request_id, i.errors, i.is_valid, i.year, i.season, {z}, rain_today, concat_ws(';', {names}) AS categories FROM i, sc),
p AS (SELECT *, 1 / (1 + exp(-(humidity_3pm - max_temp + CAST(0.5 AS DOUBLE) * rain_today))) AS prob FROM zd)
SELECT request_id, is_valid, errors, {scored}, CASE WHEN is_valid THEN categories END AS categories,
       CASE WHEN is_valid THEN CAST(prob > 0.5 AS INTEGER) END AS prediction, CASE WHEN is_valid THEN round(prob, 6) END AS probability,
       CASE WHEN is_valid THEN CASE WHEN abs(prob - 0.5) > 0.3 THEN 'High' WHEN abs(prob - 0.5) > 0.15 THEN 'Medium' ELSE 'Low' END END AS confidence,
       CASE WHEN is_valid THEN CASE WHEN prob > 0.5 THEN 'Rain Tomorrow' ELSE 'No Rain Tomorrow' END END AS label,
       CASE WHEN is_valid THEN CAST(year AS INTEGER) END AS year, CASE WHEN is_valid THEN season END AS season
FROM p"""


ORACLES["request_scoring"] = ORACLES["stream_request_scoring"] = _station_scoring_sql()

ORACLES["model_quality_alerts"] = _PRED + """,
mc AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
              count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
       FROM p GROUP BY 1),
mf AS (SELECT month, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1,
              row_number() OVER (ORDER BY month) AS v FROM mc),
mt AS (SELECT *, (SELECT round(avg(f1), 4) FROM mf) AS thr, lag(f1) OVER (ORDER BY v) AS before,
              coalesce(lead(month) OVER (ORDER BY v), month + 1) AS until FROM mf),
days AS (SELECT CAST(d AS DATE) AS day, thr,
                CASE WHEN f1 < thr AND v > 1 AND CAST(d AS DATE) >= month + 10 THEN before ELSE f1 END AS value
         FROM (SELECT *, unnest(generate_series(CAST(month AS TIMESTAMP), CAST(until - 1 AS TIMESTAMP), INTERVAL 1 day)) AS d FROM mt)),
low AS (SELECT *, (day - DATE '1970-01-01') AS k, (day - DATE '1970-01-01') - row_number() OVER (ORDER BY day) AS run FROM days WHERE value < thr),
rr AS (SELECT CAST(min(k) * 86400 AS BIGINT) AS start_ts, CAST(max(k) * 86400 AS BIGINT) AS end_ts, count(*) AS n_steps, min(value) AS low FROM low GROUP BY run)
SELECT start_ts, end_ts, n_steps, round(low, 9) AS lowest_value, end_ts - start_ts AS held_seconds, end_ts - start_ts >= 14 * 86400 AS fired,
       CASE WHEN end_ts - start_ts >= 14 * 86400 THEN start_ts + 14 * 86400 END AS first_firing_ts FROM rr"""


# ------------------------------------------------------------- profile SQL
def _profile_sql(src: str, key: str, top: bool = False) -> str:
    """One row per (key, column): counts, range and moments; for texts optionally the most frequent value."""
    rows = []
    for c in [*_NUM, *_CAT]:
        num = c in _NUM
        stats = (f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 6) AS mean_value, "
                 f"round(stddev_samp({c}), 6) AS std_value" if num else
                 "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean_value, "
                 "CAST(NULL AS DOUBLE) AS std_value")
        best = ("" if not top else ", CAST(NULL AS VARCHAR) AS top_value, CAST(NULL AS BIGINT) AS n_top" if num else
                f", (SELECT {c} FROM {src} t WHERE t.{key} = g.{key} AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top_value"
                f", (SELECT count(*) FROM {src} t WHERE t.{key} = g.{key} AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS n_top")
        rows.append(f"SELECT {key}, '{c}' AS column_name, count({c}) AS n_values, count(*) - count({c}) AS n_nulls, {stats}{best} FROM {src} g GROUP BY {key}")
    return "\nUNION ALL ".join(rows)


ORACLES["split_profiles"] = with_split(wide=True) + _CATALOG_CTE + """,
m AS (SELECT cat.split_id, split.* FROM split, cat WHERE NOT is_test AND split.year BETWEEN cat.start_year AND cat.end_year)
""" + _profile_sql("m", "split_id")
ORACLES["baseline_quality"] = with_split(wide=True) + """,
ref AS (SELECT * FROM split WHERE NOT is_test AND year = 1995),
cutr AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
                                      l_orderkey, l_linenumber, l_partkey, l_suppkey)
                   <= floor(CAST(count(*) OVER () AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS first_part FROM ref)
""" + _profile_sql("cutr", "first_part", top=True)

_PRODUCTION_YEAR = ("(SELECT coalesce(max(year) FILTER (WHERE year BETWEEN 1995 AND 2000), 1995) FROM ("
                    + _REG + "\nSELECT year FROM st WHERE final_stage = 'Production'))")
ORACLES["production_drift_check"] = _DRIFT_COLUMNS.replace("year BETWEEN 1995 AND 1995", "year BETWEEN 1995 AND " + _PRODUCTION_YEAR, 1) + """,
s AS (SELECT count(*) FILTER (WHERE score >= 0.1) AS n, CAST(count(*) FILTER (WHERE score >= 0.1) AS DOUBLE) / count(*) AS share FROM sel)
SELECT CAST(""" + _PRODUCTION_YEAR + """ - 1994 AS INTEGER) AS reference_split, 6 AS current_split, n AS number_of_drifted_columns,
       round(share, 9) AS share_of_drifted_columns,
       CASE WHEN NOT share > 0 THEN 'OK' WHEN share >= 0.04 THEN 'CRITICAL' WHEN share >= 0.02 THEN 'WARNING' ELSE 'INFO' END AS severity,
       CASE WHEN NOT share > 0 THEN 'No data drift detected'
            ELSE 'Data drift detected in ' || n || ' columns (' || printf('%.1f', share * 100) || '%)' END AS message,
       CASE WHEN NOT share > 0 THEN 'Continue monitoring'
            WHEN share >= 0.04 THEN 'SEVERE DRIFT DETECTED (>4%) - Training triggered, immediate investigation recommended.'
            WHEN share >= 0.02 THEN 'DRIFT DETECTED (≥2%) - Training triggered, monitoring recommended.'
            ELSE 'MINOR DRIFT (<2%) - Below training threshold, continue monitoring.' END AS recommendation,
       (SELECT strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') FROM orders) AS run_ts
FROM s"""

ORACLES["split_catalog_header"] = with_split() + """,
t AS (SELECT * FROM split WHERE NOT is_test AND year BETWEEN 1995 AND 2000)
SELECT count(*) AS total_train_samples, (SELECT count(*) FROM split WHERE is_test) AS test_samples, 42 AS random_state,
       'cumulative_by_year' AS split_method, (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT CAST(year AS VARCHAR) AS y FROM t)) AS years_available,
       6 AS n_features FROM t"""

ORACLES["joined_training_rows"] = with_split() + """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, l_quantity, l_extendedprice, discount, tax,
       CAST(season = 'Summer' AS INTEGER) AS is_summer, CAST(l_linestatus = 'O' AS INTEGER) AS is_open, target FROM split WHERE NOT is_test"""
ORACLES["drift_result_sink"] = _DRIFT_COLUMNS + """
SELECT '2000-12-31T00:00:00' AS run_ts, column_name, stattest, round(score, 6) AS drift_score, score >= 0.1 AS drift_detected,
       count(*) OVER () AS number_of_columns, count(*) FILTER (WHERE score >= 0.1) OVER () AS number_of_drifted_columns FROM sel"""
