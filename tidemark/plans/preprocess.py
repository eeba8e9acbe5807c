"""Raw observations -> interim table -> exact stratified split.

The same composition the reference runs as a script, as one lazy plan;
the only actions are the small fit aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clean import interim
from tidemark.operators.splits import stratified_split
from tidemark.plans import fixtures as fx
from tidemark.session import cut_lineage


def interim_obs(spark: SparkSession, root: str) -> DataFrame:
    """obs -> P1 (label present), P2 (drop the label's source column and the
    raw timestamp), P3 (sparse columns), P4-P6 (year, season), P7 (label 0/1)."""
    return interim(fx.obs(spark, root), label_col=fx.OBS_LABEL, date_col=fx.OBS_DATE,
                   drop=("l_returnflag", "l_shipdate"), missing_limit=0.30)


def split_obs(spark: SparkSession, root: str) -> DataFrame:
    """Interim rows with the F1 ``is_test`` flag."""
    return cut_lineage(stratified_split(interim_obs(spark, root), fx.OBS_LABEL, fx.OBS_KEY,
                                        test_size=fx.TEST_SIZE, seed=fx.SEED))


def split_obs_wide(spark: SparkSession, root: str) -> DataFrame:
    """obs_wide through the same steps (adds two categorical columns).

    The joined rows are written once; missing shares, class sizes, the cut and the flagged rows read them there."""
    drop = ("l_returnflag", "l_shipdate")
    joined = cut_lineage(fx.obs_wide(spark, root).drop(*drop), "obs-wide")
    df = interim(joined, label_col=fx.OBS_LABEL, date_col=fx.OBS_DATE, missing_limit=0.30)
    return cut_lineage(stratified_split(df, fx.OBS_LABEL, fx.OBS_KEY, test_size=fx.TEST_SIZE, seed=fx.SEED))


def test_count(split: DataFrame) -> F.Column:
    """Size of the fixed test set as a scalar subquery."""
    return split.agg(F.count_if(F.col("is_test")).alias("n")).scalar()
