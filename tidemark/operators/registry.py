"""Model registry as append-only tables.

* ``runs``    -- run_id, model_name, version, params map<string,string>,
                 metrics map<string,double>
* ``events``  -- model_name, version, seq, stage (NULL = tags only),
                 tags map<string,string>

A version's current stage is its latest stage event (``max_by`` on seq);
its tags are the ``map_concat`` fold of its tag events in seq order
(needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``).  Nothing is updated in
place, so concurrent writers only append.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.sources.io import missing_path

RUN_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("texts", T.MapType(T.StringType(), T.StringType())),
])
EVENT_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("stage", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])


def _empty_tags():
    return F.create_map().cast("map<string,string>")


def runs_from_metrics(metrics: DataFrame, order_col: str, model_name: str,
                      metric_cols=("f1_score", "accuracy", "precision", "recall", "roc_auc"),
                      param_cols=(), split_col: str = "split_id") -> DataFrame:
    """One run per metrics row; versions numbered in ``order_col`` order.

    The split a run was trained on is logged from ``split_col``, if ``metrics`` has it
    (it is not the version: a split can be trained on again)."""
    w = Window.partitionBy("model_name").orderBy(order_col)
    m = metrics.withColumn("model_name", F.lit(model_name))
    m = m.withColumn("version", F.row_number().over(w).cast("int"))
    metric_map = F.create_map(*[x for c in metric_cols for x in (F.lit(c), F.col(c).cast("double"))])
    logged = [*([split_col] if split_col in metrics.columns else []), *param_cols]
    params = [x for c in logged for x in (F.lit("split_id" if c == split_col else c), F.col(c).cast("string"))]
    return m.select("model_name", "version",
                    F.format_string("run_%s_%02d", F.lit(model_name), F.col("version")).alias("run_id"),
                    (F.create_map(*params) if params else _empty_tags()).alias("params"), metric_map.alias("metrics"), order_col)


def champion_challenger(runs: DataFrame, metric: str = "f1_score") -> DataFrame:
    """M4 over a sequence of versions.

    A new version beats production iff its metric is strictly greater; the
    first version always wins.  Because promotion needs a strict gain,
    production's metric before version v is the running maximum over the
    earlier versions, and the production version is the earliest one that
    reached it.  Windows run over the version rows of each model.
    """
    val = F.col("metrics").getItem(metric)
    w = (Window.partitionBy("model_name").orderBy("version")
         .rowsBetween(Window.unboundedPreceding, -1))
    r = runs.withColumn("_m", val)
    r = r.withColumn("production_metric_before", F.max("_m").over(w))
    r = r.withColumn("production_version_before",
                     F.max_by("version", F.struct(F.col("_m"), -F.col("version"))).over(w))
    prev = F.col("production_metric_before")
    r = r.withColumn("is_better", prev.isNull() | (F.col("_m") > prev))
    return r.withColumn("improvement_pct", improvement(prev, F.col("_m"))).drop("_m")


def improvement(before: F.Column, after: F.Column) -> F.Column:
    """M4: gain over production in percent (100 if production's metric is not positive, NULL without one)."""
    return F.when(before.isNull(), F.lit(None).cast("double")) \
        .when(before > 0, (after - before) / before * 100).otherwise(F.lit(100.0))


def promotion_events(decisions: DataFrame, tag_cols: dict | None = None, first_seq: int | None = None) -> DataFrame:
    """Register (stage None, tags), then -- if better -- archive the old
    production version and promote the new one.  Three seq slots per version,
    from ``first_seq`` for a single new version of an existing registry."""
    base = F.col("version").cast("long") * 3 if first_seq is None else F.lit(int(first_seq)).cast("long")
    tags = [F.lit("is_production"), F.lit("False")]
    for k, c in (tag_cols or {}).items():
        tags = [F.lit(k), c.cast("string")] + tags
    reg = F.struct(F.col("model_name"), F.col("version"), base.alias("seq"),
                   F.lit("None").alias("stage"), F.create_map(*tags).alias("tags"))
    arch = F.struct(F.col("model_name"), F.col("production_version_before").alias("version"),
                    (base + 1).alias("seq"), F.lit("Archived").alias("stage"),
                    F.create_map(F.lit("is_production"), F.lit("False")).alias("tags"))
    prom = F.struct(F.col("model_name"), F.col("version"), (base + 2).alias("seq"),
                    F.lit("Production").alias("stage"),
                    F.create_map(F.lit("is_production"), F.lit("True")).alias("tags"))
    arr = F.when(F.col("is_better") & F.col("production_version_before").isNotNull(), F.array(reg, arch, prom)) \
        .when(F.col("is_better"), F.array(reg, prom)).otherwise(F.array(reg))
    return decisions.select(F.explode(arr).alias("e")).select("e.*")


def current_state(events: DataFrame) -> DataFrame:
    """W3 per version: latest stage and folded tags."""
    staged = F.when(F.col("stage").isNotNull(), F.struct("seq", "stage"))
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("seq", "tags")),
                     lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)),
        _empty_tags(),
        lambda acc, x: F.map_concat(acc, F.coalesce(x["tags"], _empty_tags())))
    return events.groupBy("model_name", "version").agg(
        F.coalesce(F.max(staged)["stage"], F.lit("None")).alias("stage"),
        folded.alias("tags"), F.max("seq").alias("last_seq"))


def production_model(state: DataFrame, runs: DataFrame) -> DataFrame:
    """R2 + W3 + J4: the highest Production version per model, with its run's metrics.

    Version is compared as an int.  An empty result means "no production
    model yet"; read failures raise instead of being treated as empty (Q13).
    """
    prod = state.where(F.col("stage") == "Production").groupBy("model_name").agg(
        F.max("version").alias("version"))
    return prod.join(runs, on=["model_name", "version"])


def _held_nodes(lo, hi):
    """The aligned power-of-two blocks ``(level, node)`` that make up ``[lo, hi)``, two a level at most."""
    def at(level):
        size = F.pow(F.lit(2.0), level)
        a, b = F.ceil(lo / size).cast("long"), F.floor(hi / size).cast("long")
        return F.array(F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("node"))),
                       F.when((a < b) & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).alias("node"))))
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(hi + 1)).cast("int")), at)))


def production_gauge(events: DataFrame, runs: DataFrame, metric: str = "f1_score", t: str = "event_ts") -> DataFrame:
    """R5 input: a metric of the production model over time, as intervals
    ``(model_name, version, start_ts, end_ts, value)``; ``end_ts`` is NULL for the open one.

    ``events`` are stage events with a time ``t`` that does not fall as ``seq`` grows.  A version is in
    production from such an event to its next stage event; of several, the highest version counts
    (R2).  The highest version of every moment comes from equi-joins on power-of-two
    blocks of the change points (each interval is a few blocks, each point lies in one block a
    level), so versions that overlap for long make no pairs.  Moments without a production version have no row.
    """
    staged = events.where(F.col("stage").isNotNull())
    after = Window.partitionBy("model_name", "version").orderBy("seq")
    held = staged.select("model_name", "version", "stage", F.col(t).alias("start_ts"), F.lead(t).over(after).alias("end_ts")) \
        .where((F.col("stage") == "Production") & (F.col("end_ts").isNull() | (F.col("end_ts") > F.col("start_ts")))).drop("stage")
    in_order = Window.partitionBy("model_name").orderBy("at")
    points = staged.select("model_name", F.col(t).alias("at")).distinct().withColumns({
        "n": F.row_number().over(in_order), "next_at": F.lead("at").over(in_order),
        "size": F.count(F.lit(1)).over(Window.partitionBy("model_name"))})
    first = points.select("model_name", F.col("at").alias("start_ts"), F.col("n").alias("lo"), "size")
    end = points.select("model_name", F.col("at").alias("end_ts"), F.col("n").alias("hi"))
    spans = held.join(first, ["model_name", "start_ts"]).join(end, ["model_name", "end_ts"], "left") \
        .withColumn("hi", F.coalesce("hi", F.col("size") + 1))
    best = spans.select("model_name", "version", F.inline(_held_nodes(F.col("lo"), F.col("hi")))) \
        .groupBy("model_name", "level", "node").agg(F.max("version").alias("version"))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("size") + 2)).cast("int"))
    covers = points.select("model_name", "at", "next_at", "n", F.explode(levels).alias("level")) \
        .withColumn("node", F.floor(F.col("n") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    top = covers.join(best, ["model_name", "level", "node"]).groupBy("model_name", "at", "next_at") \
        .agg(F.max("version").alias("version"))
    return top.join(runs.select("model_name", "version", F.col("metrics")[metric].alias("value")), ["model_name", "version"]).select(
        "model_name", "version", F.col("at").alias("start_ts"), F.col("next_at").alias("end_ts"), "value")


def archive_all(state: DataFrame, as_of: F.Column, start_seq: F.Column | None = None) -> DataFrame:
    """Archive every version and tag it, numbered after the registry's last event
    (or after ``start_seq``), so archiving can be repeated.

    Versions not yet archived get stage Archived with ``archived`` and
    ``archived_at`` overwriting; versions already archived only get the
    tags they lack -- the event carries the *union* with existing tags
    winning, i.e. ``map_concat(new, old)``.
    """
    new = F.create_map(F.lit("archived"), F.lit("true"), F.lit("archived_at"), as_of.cast("string"))
    if start_seq is None:
        start_seq = F.coalesce(state.agg(F.max("last_seq")).scalar(), F.lit(0))
    already = F.col("stage") == "Archived"
    tags = F.when(already, F.map_concat(new, F.col("tags"))).otherwise(new)
    return state.select("model_name", "version",
                        (start_seq + F.col("version")).cast("long").alias("seq"),
                        F.lit("Archived").alias("stage"), tags.alias("tags"))


def input_signature(df: DataFrame, n: int = 5, order_cols=None) -> dict:
    """The model's input schema (JSON) and an ``n``-row example (JSON lines).

    Only ``n`` rows reach the driver (a top-n in an explicit order)."""
    ex = df.orderBy(*(order_cols or df.columns[:1])).limit(n)
    rows = [r[0] for r in ex.select(F.to_json(F.struct(*df.columns))).collect()]
    return {"schema_json": df.schema.json(), "input_example": rows}


def check_signature(df: DataFrame, schema_json: str) -> list:
    """R6 at scoring time: expected columns missing from ``df`` (P11 fills them)."""
    expected = [f.name for f in T.StructType.fromJson(__import__("json").loads(schema_json)).fields]
    return [c for c in expected if c not in df.columns]


class RegistryTable:
    """The registry's two tables on a shared file system, appended commit by commit.

    ``commits/commit=<n>`` holds the runs and events of one change.  A change
    is made from the state up to commit n, written aside and published as
    commit n + 1 by one rename that fails if that commit exists.  A writer that
    loses reads the new state and makes its change again, so of two promoters
    that compared with the same champion only one is published as such.
    (The rename is atomic on HDFS-like stores; an object store needs one with
    conditional writes.)
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        with_commit = T.StructType([*schema.fields, T.StructField("commit", T.IntegerType())])
        try:
            return (self.spark.read.schema(with_commit).option("basePath", f"{self.root}/commits")
                    .parquet(f"{self.root}/commits/commit=*/{name}"))
        except AnalysisException as e:
            if not missing_path(e):
                raise
            return self.spark.createDataFrame([], with_commit)

    def state(self) -> tuple[int, DataFrame, DataFrame]:
        """(last commit, runs, events) as of that commit."""
        # commits are listed first (one may hold no events, or no runs): what is read later holds them whole
        last, events = self._last(), self._table("events", EVENT_SCHEMA)
        upto = lambda t: t.where(F.col("commit") <= last).drop("commit")
        return last, upto(self._table("runs", RUN_SCHEMA)), upto(events)

    def _last(self) -> int:
        """Number of the last published commit."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = store.globStatus(path(f"{self.root}/commits/commit=*")) or []
        return max((int(f.getPath().getName().split("=")[1]) for f in found), default=0)

    def _publish(self, commit: int, runs: DataFrame, events: DataFrame) -> bool:
        """Write aside, then rename; False if the commit exists already."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        for name, frame, schema in (("runs", runs, RUN_SCHEMA), ("events", events, EVENT_SCHEMA)):
            frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]) \
                .coalesce(1).write.parquet(f"{aside}/{name}")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        path = jvm.org.apache.hadoop.fs.Path
        store = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        store.mkdirs(path(f"{self.root}/commits"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(path(aside), path(f"{self.root}/commits/commit={commit}"), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def change(self, make: Callable[[int, DataFrame, DataFrame], tuple[DataFrame, DataFrame]], attempts: int = 20) -> int:
        """Publish ``make(next seq, runs, events)`` (new runs, new events); returns the commit number."""
        for _ in range(attempts):
            last, runs, events = self.state()
            seq = (events.agg(F.max("seq")).first()[0] or 0) + 1
            if self._publish(last + 1, *make(seq, runs, events)):
                return last + 1
        raise RuntimeError(f"registry {self.root}: lost {attempts} races in a row")

    def register(self, run: DataFrame, metric: str = "f1_score", tag_cols: dict | None = None) -> int:
        """R1 + M4 + R3 for one run (one row: model_name, params, metrics, texts).

        The version is the model's largest plus one; the run is promoted, and the
        production version archived, iff ``metrics[metric]`` is strictly greater than
        production's (or there is none).  The comparison is logged with the run."""
        def make(seq, runs, events):
            name = run.first()["model_name"]
            mine = runs.where(F.col("model_name") == name)
            version = (mine.agg(F.max("version")).first()[0] or 0) + 1
            champion = production_model(current_state(events), mine).select(
                "version", F.col("metrics")[metric].alias("value")).first()
            new = (run.withColumn("version", F.lit(version))
                   .withColumn("run_id", F.format_string("run_%s_%02d", "model_name", "version")))
            before = champion["value"] if champion else None
            value = F.col("metrics")[metric]
            compared = (new.withColumn("production_metric_before", F.lit(before).cast("double"))
                        .withColumn("production_version_before", F.lit(champion["version"] if champion else None).cast("int"))
                        .withColumn("is_better", F.lit(champion is None) | (value > F.lit(before)))
                        .withColumn("improvement_pct", improvement(F.lit(before).cast("double"), value)))
            logged = F.create_map(F.lit("is_better"), F.col("is_better").cast("string"),
                                  F.lit("production_version_before"), F.col("production_version_before").cast("string"))
            out = compared.withColumn("params", F.map_concat(F.col("params"), logged)).withColumn(
                "metrics", F.map_concat("metrics", F.map_filter(
                    F.create_map(F.lit("improvement_pct"), F.col("improvement_pct"),
                                 F.lit("production_metric_before"), F.col("production_metric_before")),
                    lambda _, v: v.isNotNull())))
            return out, promotion_events(compared, tag_cols, seq)

        return self.change(make)

    def log(self, runs: DataFrame, order_col: str) -> int:
        """R1 for several runs of one model (model_name, params, metrics, texts), such as a search's
        candidates: versions in ``order_col`` order after the model's largest; nothing is promoted."""
        def make(seq, old, events):
            name = runs.first()["model_name"]
            last = old.where(F.col("model_name") == name).agg(F.max("version")).first()[0] or 0
            place = F.row_number().over(Window.partitionBy("model_name").orderBy(order_col))
            new = (runs.withColumn("version", (place + last).cast("int"))
                   .withColumn("run_id", F.format_string("run_%s_%02d", "model_name", "version")))
            return new, events.limit(0)

        return self.change(make)

    def archive_all(self, as_of: F.Column) -> int:
        """R4 on the table."""
        return self.change(lambda seq, runs, events: (
            runs.limit(0), archive_all(current_state(events), as_of, F.lit(seq - 1))))
