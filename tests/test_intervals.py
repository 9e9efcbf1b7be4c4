"""Values joined to bands of a table, against a loop over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from vendorlake.operators import intervals
from vendorlake.sources import dims


def plain(values, bands, left):
    out = []
    for owner, i, v in values:
        met = [] if v is None or v != v else [b for o, b, lo, hi in bands if o is not None and o == owner and (lo is None or v >= lo) and (hi is None or v < hi) and (lo is None or hi is None or lo < hi)]
        out += [(owner, i, b) for b in met] or ([(owner, i, None)] if left else [])
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(6)
    number = lambda: float(r.choice([r.uniform(-1e3, 1e3), r.randrange(-5, 6), r.lognormvariate(0, 9), 7.0]))
    values = [(r.choice("ab"), i, 7.0 if i % 3 == 0 else number()) for i in range(600)] + [("a", 600, None), ("a", 601, float("nan")), (None, 602, 1.0), ("z", 603, 1.0), ("a", 604, float("inf"))]
    bands = [(r.choice("ab"), f"x{k}", *sorted((number(), number()))) for k in range(40)]
    bands += [("a", "all", None, None), ("b", "below", None, 0.0), ("a", "above", 7.0, None), ("a", "empty", 3.0, 3.0), ("b", "turned", 9.0, -9.0), ("a", "point", 7.0, 7.5), (None, "nobody", None, None)]
    return values, bands


@pytest.mark.parametrize(("how", "buckets", "share"), [("inner", 64, 1024), ("left", 5, 3), ("left", 1, 1)])
def test_band_join(spark, tables, how, buckets, share):
    values, bands = tables
    v = spark.createDataFrame(values, "owner string, id long, v double")
    b = spark.createDataFrame(bands, "owner string, label string, lo double, hi double")
    got = intervals.band_join(v, b, "v", "lo", "hi", ["owner"], how, buckets, share)
    assert got.columns == ["owner", "id", "v", "label", "lo", "hi"]
    assert sorted(((r["owner"], r["id"], r["label"]) for r in got.collect()), key=str) == plain(values, bands, how == "left")


def test_edited_bands_need_no_new_code(spark):
    options = dims.dim_option(spark).where("attribute = 'size' and ord > 0").select("label", "lo", "hi")
    edited = options.where("label <> '11–50'").unionByName(spark.createDataFrame([("11–20", 11.0, 21.0)], "label string, lo double, hi double"))
    values = spark.createDataFrame([(n,) for n in (0, 1, 10, 11, 20, 21, 50, 51, 1000, 1001)], "n long")
    got = {r["n"]: r["label"] for r in intervals.band_join(values, edited, "n", "lo", "hi", how="left").collect()}
    assert got == {0: None, 1: "1–10", 10: "1–10", 11: "11–20", 20: "11–20", 21: None, 50: None, 51: "51–200", 1000: "501–1,000", 1001: "1,000+"}


def test_plan_is_an_equi_join(spark, tables):
    values, bands = tables
    v, b = spark.createDataFrame(values, "owner string, id long, v double"), spark.createDataFrame(bands, "owner string, label string, lo double, hi double")
    plan = intervals.band_join(v, b, "v", "lo", "hi", ["owner"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_values_and_no_bands(spark):
    v, b = spark.createDataFrame([], "v double"), spark.createDataFrame([], "label string, lo double, hi double")
    one = spark.createDataFrame([(1.0,)], "v double")
    assert intervals.band_join(v, b, "v", "lo", "hi").count() == 0 and intervals.band_join(one, b, "v", "lo", "hi", how="left").count() == 1


def test_the_join_has_tasks_by_its_values(spark):
    """What goes in is small and what comes out is not, so that the number of tasks isn't left to the bytes read."""
    values = spark.range(40_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 1000).cast("double").alias("v"))
    bands = spark.createDataFrame([(k, float(lo), float(lo + 10)) for k in range(3) for lo in range(0, 1000, 100)], "k long, lo double, hi double")
    df = intervals.band_join(values, bands, "v", "lo", "hi", ["k"])
    assert df.count() == 40_000 // 10
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
