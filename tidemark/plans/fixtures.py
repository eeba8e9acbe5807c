"""Views shared by the registered queries and their SQL oracles.

Each view is given twice, as a DataFrame builder and as SQL text, with
the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import season_of_date
from tidemark.sources.tables import read_table

# Column roles of the observation view.
OBS_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
OBS_NUMERIC = ["l_quantity", "l_extendedprice", "discount", "tax"]
OBS_CATEGORICAL = ["l_linestatus"]
WIDE_CATEGORICAL = ["l_linestatus", "o_orderpriority", "c_mktsegment"]
OBS_LABEL = "target"
OBS_DATE = "obs_date"
SEED = 42
TEST_SIZE = 0.2
# Complete years of the driver data (the last ship year is partial).
YEAR_START, YEAR_END = 1995, 2000


def obs(spark: SparkSession, root: str) -> DataFrame:
    li = read_table(spark, root, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice",
        F.expr("nullif(l_discount, 0)").alias("discount"),
        F.expr("nullif(l_tax, 0)").alias("tax"),
        "l_returnflag", "l_linestatus", "l_shipdate",
        F.col("l_shipdate").cast("date").alias("obs_date"),
        F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No").alias("target"),
    )


def obs_wide(spark: SparkSession, root: str) -> DataFrame:
    """Observations with their order's priority and its customer's segment.

    Orders meet their customers first, so the observation rows are shuffled once at most."""
    o = read_table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = read_table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    named = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_mktsegment")
    return obs(spark, root).join(named, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def scored(spark: SparkSession, root: str) -> DataFrame:
    """Orders with a rule-based score in [0, 1] and a binary label.

    ``max(o_totalprice) over ()`` is a scalar subquery (one aggregate,
    evaluated once), not an unpartitioned window.
    """
    o = read_table(spark, root, "orders")
    mx = o.agg(F.max("o_totalprice").alias("_max_price")).scalar()
    return (o.withColumn("_max_price", mx)
            .select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority",
                    "o_totalprice",
                    (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                    (F.col("o_totalprice") / F.col("_max_price")).alias("score")))


def request_log(spark: SparkSession, root: str) -> DataFrame:
    ev = read_table(spark, root, "events")
    return ev.select(
        "event_id", "ts", "user_id",
        F.col("event_type").alias("endpoint"),
        F.lit("POST").alias("method"),
        F.col("value").alias("duration"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
    )


# Station readings in the scoring request's fields, derived from the columns of an
# order, its customer and nation.  The values are such that every rule is broken by
# some rows and every optional field is absent in some.
STATION_FIELDS = {
    "location": "CASE WHEN o_orderstatus = 'P' AND c_mktsegment = 'MACHINERY' THEN NULL ELSE n_name END",
    "min_temp": "o_totalprice / 20000",
    "max_temp": "o_totalprice / 20000 + c_acctbal / 500",
    "rain_today": "CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 2 ELSE 1 END",
    "wind_gust_speed": "CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN NULL ELSE c_acctbal / 100 END",
    "wind_gust_dir": "CASE o_orderpriority WHEN '1-URGENT' THEN 'N' WHEN '2-HIGH' THEN 'NE' WHEN '3-MEDIUM' THEN 'E' "
                     "WHEN '4-NOT SPECIFIED' THEN '' ELSE CASE WHEN o_orderstatus = 'P' THEN 'LOW' ELSE 'SSW' END END",
    "wind_speed_9am": "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE (o_totalprice - 5000) / 10000 END",
    "wind_dir_9am": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'W' WHEN 'BUILDING' THEN 'WNW' WHEN 'FURNITURE' THEN NULL "
                    "ELSE CASE WHEN o_totalprice > 300000 THEN 'down' ELSE 'S' END END",
    "wind_speed_3pm": "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE (c_acctbal + 500) / 200 END",
    "wind_dir_3pm": "CASE WHEN o_orderstatus = 'O' THEN '' WHEN o_totalprice < 20000 THEN 'east' ELSE 'ESE' END",
    "humidity_9am": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / 4000 END",
    "humidity_3pm": "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_acctbal / 98 END",
    "pressure_9am": "CASE WHEN n_regionkey = 3 THEN NULL ELSE 1000 + o_totalprice / 20000 END",
    "pressure_3pm": "CASE WHEN n_regionkey = 2 THEN NULL ELSE 1005 + c_acctbal / 1000 END",
    "temp_9am": "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice / 25000 END",
    "temp_3pm": "CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_acctbal / 400 END",
    "rainfall": "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL ELSE (c_acctbal + 800) / 1000 END",
}
STATION_NUMERIC = ["min_temp", "max_temp", "rainfall", "wind_gust_speed", "wind_speed_9am", "wind_speed_3pm",
                   "humidity_9am", "humidity_3pm", "pressure_9am", "pressure_3pm", "temp_9am", "temp_3pm"]
STATION_CATEGORICAL = ["location", "wind_gust_dir", "wind_dir_9am", "wind_dir_3pm", "season"]
STATION_TRAIN_BEFORE = "1998-01-01"          # readings before train, later ones are requests
STATION_TRAIN_REGION = "n_regionkey <> 0"    # stations of region 0 are unknown to the model


def stations(spark: SparkSession, root: str) -> DataFrame:
    o = read_table(spark, root, "orders")
    c = read_table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("date").alias("day"),
                       "o_orderstatus", "o_orderpriority", "n_regionkey",
                       *[F.expr(e).alias(f) for f, e in STATION_FIELDS.items()])


def station_training(spark: SparkSession, root: str) -> DataFrame:
    """Typed training readings with year and season; blank directions are NULL."""
    d = stations(spark, root).where(f"day < DATE '{STATION_TRAIN_BEFORE}' AND {STATION_TRAIN_REGION} AND location IS NOT NULL")
    d = d.withColumn("year", F.year("day")).withColumn("season", season_of_date(F.col("day")))
    return d.select("year", "rain_today", *STATION_NUMERIC,
                    *[F.nullif(F.col(c), F.lit("")).alias(c) for c in STATION_CATEGORICAL])


def station_requests(spark: SparkSession, root: str) -> DataFrame:
    """Later readings as JSON text ``(request_id, value)``; some have a date in another format, some are cut off."""
    d = stations(spark, root).where(f"day >= DATE '{STATION_TRAIN_BEFORE}'")
    partial = F.col("o_orderstatus") == "P"
    text = F.date_format("day", "yyyy-MM-dd")
    date = F.when(partial & (F.col("o_orderpriority") == "2-HIGH"), F.date_format("day", "dd/MM/yyyy")).otherwise(text)
    body = F.to_json(F.struct(date.alias("date"), *STATION_FIELDS))
    return d.select("request_id", F.when(partial & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), F.left(body, F.lit(40)))
                    .otherwise(body).alias("value"))


# ---------------------------------------------------------------- SQL side
SQL_OBS = """obs AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         NULLIF(l_discount, 0) AS discount, NULLIF(l_tax, 0) AS tax,
         l_returnflag, l_linestatus, l_shipdate,
         CAST(l_shipdate AS DATE) AS obs_date,
         CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS target
  FROM lineitem)"""

SQL_OBS_WIDE = SQL_OBS + """,
obs_wide AS (
  SELECT obs.*, o.o_orderpriority, c.c_mktsegment
  FROM obs JOIN orders o ON obs.l_orderkey = o.o_orderkey
           JOIN customer c ON o.o_custkey = c.c_custkey)"""

SQL_SCORED = """scored AS (
  SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice,
         CAST(o_orderstatus = 'F' AS INTEGER) AS label,
         o_totalprice / max(o_totalprice) OVER () AS score
  FROM orders)"""

SQL_LOG = """log AS (
  SELECT event_id, ts, user_id, event_type AS endpoint, 'POST' AS method,
         value AS duration,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code
  FROM events)"""

_SQL_SEASON = ("CASE WHEN month(day) IN (12, 1, 2) THEN 'Summer' WHEN month(day) IN (3, 4, 5) THEN 'Autumn' "
               "WHEN month(day) IN (6, 7, 8) THEN 'Winter' ELSE 'Spring' END")

SQL_STATIONS = f"""stations AS (
  SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS day, o_orderstatus, o_orderpriority, n_regionkey,
         year(o_orderdate) AS year, {_SQL_SEASON.replace("day", "o_orderdate")} AS season,
         """ + ",\n         ".join(f"NULLIF({e}, '') AS {f}" if "_dir" in f else f"{e} AS {f}"
                                    for f, e in STATION_FIELDS.items()) + f"""
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
station_train AS (SELECT * FROM stations WHERE day < DATE '{STATION_TRAIN_BEFORE}' AND {STATION_TRAIN_REGION} AND location IS NOT NULL),
requests AS (SELECT * FROM stations WHERE day >= DATE '{STATION_TRAIN_BEFORE}')"""
