import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.stats import chi2_sf_np


def test_season_all_months(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = {r["m"]: r["s"] for r in df.select("m", C.season_of_month(F.col("m")).alias("s")).collect()}
    assert [got[m] for m in (12, 1, 2)] == ["Summer"] * 3
    assert [got[m] for m in (3, 4, 5)] == ["Autumn"] * 3
    assert [got[m] for m in (6, 7, 8)] == ["Winter"] * 3
    assert [got[m] for m in (9, 10, 11)] == ["Spring"] * 3


def test_yes_no_and_round_key(spark):
    df = spark.createDataFrame([("Yes", 2.5), ("No", 3.5), ("maybe", -2.5), (None, 2.4)], "f string, y double")
    r = df.select(C.yes_no_flag(F.col("f")).alias("f"), C.round_key(F.col("y")).alias("y")).collect()
    assert [x["f"] for x in r] == [1, 0, None, None]
    assert [x["y"] for x in r] == [2, 4, -2, 2]          # half to even


def test_confidence_and_split_names(spark):
    df = spark.createDataFrame([(0.9, 2008, 2008), (0.3, 2008, 2010), (0.55, 2008, 2016)], "p double, a int, b int")
    r = df.select(C.confidence_band(F.col("p")).alias("c"),
                  C.split_dir_name(F.lit(3), F.col("a"), F.col("b")).alias("n")).collect()
    assert [x["c"] for x in r] == ["High", "Medium", "Low"]
    assert [x["n"] for x in r] == ["split_03_2008", "split_03_2008-2010", "split_03_2008-2016"]
    parsed = df.select(C.split_end_year(F.lit("split_09_2008-2016")).alias("e")).first()["e"]
    assert parsed == 2016


def test_parse_date_bad_input(spark):
    df = spark.createDataFrame([("2025-01-15",), ("15/01/2025",), (None,)], "d string")
    r = [x["d"] for x in df.select(C.parse_date(F.col("d")).alias("d")).collect()]
    assert str(r[0]) == "2025-01-15" and r[1] is None and r[2] is None


@pytest.mark.parametrize("dof", [1e3, 1e6, 1e7])
def test_chi_square_tail_at_many_degrees_of_freedom(dof):
    """The median lies 2/3 below the mean, so the tail at stat = dof is 1/2 - (2/3) phi(0) / sd."""
    sd = math.sqrt(2 * dof)
    got = chi2_sf_np(np.array([dof, dof + 3 * sd, dof - 3 * sd]), np.array([dof] * 3))
    assert got[0] == pytest.approx(0.5 - 2 / 3 / math.sqrt(2 * math.pi) / sd, abs=1e-5)
    assert got[1] == pytest.approx(0.00135, abs=6e-4) and got[2] == pytest.approx(0.99865, abs=6e-4)
