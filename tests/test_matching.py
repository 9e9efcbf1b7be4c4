"""The predicate index against the plain match, on skewed companies and briefs."""

import random

import pytest
from pyspark.sql import functions as F
from test_shortlist import ANY, BRIEF, COMPANY, company

from vendorlake.operators import matching, search
from vendorlake.operators.dealt import dealt

ATTRIBUTES = {"ownership": ["VC-Backed", "Acquired"], "revenue": ["< $1M", "$1M–$5M"], "size": ["1–10", "11–50"], "founded": ["2015–2019"]}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    tags, verticals = [f"t{i}" for i in range(12)], ["V", "W", "X"]
    some = lambda values, n: r.sample(values, r.randrange(min(n, len(values)) + 1))
    companies = [
        company(id=i, run_id=f"r{i % 3}", products=["P"] if i % 3 else r.sample(["P", "Q", "R"], r.randrange(3)), verticals=r.choice([some(verticals, 3), [None], ["V"]]), tags=[*some(tags, 4), *([None] if i % 9 == 0 else [])], ownership=r.choice([*ATTRIBUTES["ownership"], None]), founded_year=2016 if i % 2 else None)
        for i in range(300)
    ]
    briefs = [("b0", "P", [], [], *ANY), ("b1", "Z", [], [], *ANY), ("b2", None, [], ["V"], *ANY), ("b3", "P", [("g", "t1"), ("h", "nowhere")], [], *ANY)]
    for i in range(4, 60):
        chosen = [r.choice([ANY[k], r.choice(ATTRIBUTES[a])]) if r.random() < 0.3 else ANY[k] for k, a in enumerate(ATTRIBUTES)]
        briefs.append((f"b{i}", r.choice("PPPQR"), [(r.choice("gh"), t) for t in some(tags, 4)], some(verticals, 2), *chosen))
    c = spark.createDataFrame(companies, COMPANY)
    return c.withColumns({"size": F.when(F.col("id") % 2 == 0, "1–10"), "founded": F.when(F.col("founded_year") == 2016, "2015–2019")}), spark.createDataFrame(briefs, BRIEF)


def rows(df):
    return sorted((r["brief_id"], r["run_id"], r["id"], r["tag_hits"]) for r in df.select("brief_id", "run_id", "id", "tag_hits").collect())


@pytest.mark.parametrize("share", [1, 64])
def test_index_gives_the_match(spark, tables, share):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows(matching.brief_match_indexed(*tables, share=share))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == rows(search.brief_match(*tables)) and len(got) > 500 and len(set(got)) == len(got)


def test_briefs_are_filed_under_what_fewest_companies_meet(spark, tables):
    companies, briefs = tables
    counts = matching.looked_up(companies).groupBy(*matching.KEY).agg(F.count("*").alias("n"))
    n = {tuple(r[:3]): r[3] for r in counts.collect()}
    filed = {r["brief_id"]: r for r in matching.filed(briefs, counts).collect()}
    assert filed["b0"]["kind"] == "any" and filed["b3"]["asked"] == ["nowhere"]
    for b in filed.values():
        own = sum(n.get((b["product"], b["kind"], v), 0) for v in b["asked"])
        if b["verticals"]:
            assert own <= sum(n.get((b["product"], "vertical", v), 0) for v in b["verticals"])


def test_no_group_holds_more_than_twice_the_mean(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), "id")
    many, few = dealt(keys, keys.select("k").distinct(), ["k"], F.col("id"), share=500)
    sizes = [r["n"] for r in many.groupBy("k", "salt_").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * 20_000 / 500 and sum(sizes) == 20_000
    assert many.join(few, ["k", "salt_"]).count() == 20_000
