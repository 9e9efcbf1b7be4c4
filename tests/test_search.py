"""Filters, ranks, bands, facets and matches."""

import pytest
from pyspark.sql import functions as F
from test_shortlist import ANY, BRIEF, COMPANY, company

from vendorlake.functions.scalars import score_band
from vendorlake.operators import search
from vendorlake.sources import dims


@pytest.mark.parametrize(
    ("q", "hit"), [("", True), ("ACME", True), ("fleet", True), ("liquid", True), ("gps", False), ("a%r", False), ("acme ", True), ("tracker ", False), ("e", True)]
)
def test_text_filter(spark, q, hit):
    df = spark.createDataFrame([company(name="Acme Tracker", description="Fleet tools", verticals=["Bulk Liquids"], tags=["GPS"])], COMPANY)
    assert (search.text_filter(df, q).count() == 1) == hit


def test_text_filter_without_values(spark):
    df = spark.createDataFrame([company(name=None, description=None, verticals=[None])], COMPANY)
    assert search.text_filter(df, "x").count() == 0 and search.text_filter(df, "").count() == 1


def test_rank_and_band(spark):
    df = spark.createDataFrame([company(id=i + 1, score=float(s)) for i, s in enumerate((70, 90, 75, 90, 69.9))], COMPANY)
    rows = search.ranked(df).withColumn("band", score_band(F.col("score"))).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [2, 4, 3, 1, 5]
    assert [r["band"] for r in sorted(rows, key=lambda r: r["id"])] == ["C", "A", "C", "A", "D"]


@pytest.mark.parametrize(
    ("attribute", "value", "label"),
    [
        ("revenue", 999_999, "< $1M"), ("revenue", 1_000_000, "$1M–$5M"), ("revenue", 5_000_000, "$5M–$20M"), ("revenue", 200_000_000, "$200M+"),
        ("size", 10, "1–10"), ("size", 1000, "501–1,000"), ("size", 1001, "1,000+"), ("size", 0, None), ("founded", 1999, "Before 2000"),
        ("founded", 2000, "2000–2009"), ("founded", 2020, "2020–Present"), ("founded", None, None),
    ],
)
def test_bands(spark, attribute, value, label):
    assert spark.range(1).select(dims.band(attribute, F.lit(value).cast("long"))).first()[0] == label


def test_dimensions(spark):
    facets = dims.dim_facet(spark)
    assert facets.count() == 255 and facets.select("product", "grp").distinct().count() == 60 and facets.select("tag").distinct().count() == 154
    assert facets.select("grp").distinct().count() == 10 and facets.select("product", "tag").distinct().count() == 255
    assert dims.dim_vertical(spark).count() == 9 and dims.dim_option(spark).count() == 33


def match(spark, companies, **brief):
    base = dict(brief_id="b", product="P", tags=[], verticals=[], ownership=ANY[0], revenue=ANY[1], size=ANY[2], founded=ANY[3])
    c = spark.createDataFrame([company(**k) for k in companies], COMPANY).withColumns({"size": F.col("employees"), "founded": dims.band("founded", F.col("founded_year"))})
    rows = search.brief_match(c, spark.createDataFrame([tuple((base | brief).values())], BRIEF)).collect()
    return {r["id"]: r["tag_hits"] for r in rows}


def test_brief_match(spark):
    cs = [dict(id=1, verticals=["V"], tags=["a", "b"]), dict(id=2, verticals=[None], tags=["a", None]), dict(id=3, products=["Q"]), dict(id=4, ownership="VC-Backed", products=["P", "P"], founded_year=2016)]
    assert set(match(spark, cs)) == {1, 2, 4}  # nothing chosen: every company of the product, once
    assert set(match(spark, cs, verticals=["V", "W"])) == {1}
    assert match(spark, cs, tags=[("g", "a"), ("g", "z"), ("h", "b")]) == {1: 2}
    assert set(match(spark, cs, tags=[("g", "a"), ("g", "z")])) == {1, 2}
    assert set(match(spark, cs, ownership="VC-Backed")) == {4} and set(match(spark, cs, founded="2015–2019")) == {4}


def test_brief_match_plan_has_no_nested_loop(spark):
    c = spark.createDataFrame([company()], COMPANY).withColumns({"size": F.col("employees"), "founded": F.lit(None).cast("string")})
    b = spark.createDataFrame([("b", "P", [], [], *ANY)], BRIEF)
    plan = search.brief_match(c, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cards(spark):
    df = spark.createDataFrame([company(founded_year=2005, ownership="VC-Backed", employees="1–10")], COMPANY)
    assert search.detail_card(df).first()[2:] == ("2005", "—", "—", "1–10", "—")
    zero = df.withColumns({"hq": F.lit("0"), "employees": F.lit("0"), "founded_year": F.lit(0)})
    assert search.detail_card(zero).first()["founded"] == "—" and search.detail_card(zero).first()["hq"] == "0" and search.detail_card(zero).first()["employees"] == "0"
    assert search.saved_header(zero).first()["header"] == "Acme | VC-Backed | 0 | 0 emp"
    assert search.saved_header(df).first()["header"] == "Acme | VC-Backed | Est. 2005 | 1–10 emp"


def test_lookup(spark):
    known = spark.createDataFrame([("x", "X!")], "k string, shown string")
    rows = search.with_lookup(spark.createDataFrame([("x",), ("y",)], "c string"), known, "c", "k", "shown", "none").collect()
    assert {r["c"]: r["shown"] for r in rows} == {"x": "X!", "y": "none"}
