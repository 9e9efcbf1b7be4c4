"""The given tables in the shapes that the operators take: companies, briefs, replies, and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dims import FOUNDED, OPTIONS, OWNERSHIP, PRODUCTS, REVENUE, SIZE, VERTICALS, band, dim_facet

#: Values that occur in the given tables.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RECORDS_PER_REPLY = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], at: Column) -> Column:
    """values[at mod their number]."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def company_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company per customer, with numbers (n_employees, revenue_usd) beside their bands."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.year("o_orderdate").alias("year"))
    bought = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.min("year").alias("year"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), lines.l_partkey == F.col("p_partkey"))
    kinds = parts.join(orders.select("o_orderkey", "o_custkey"), parts.l_orderkey == F.col("o_orderkey")).groupBy("o_custkey", "p_type", "p_brand").agg(F.sum("l_quantity").alias("q"))
    # Dealt once by customer, a row for each type and brand; all that follows is the customer's.
    kinds = kinds.repartition("o_custkey")

    def most_bought(column: str, n: int, name: str) -> DataFrame:
        """Per customer the n values of the largest summed quantity; a customer has as many as the column has values at most."""
        each = kinds.groupBy("o_custkey", column).agg((-F.sum("q")).alias("q"))
        first = F.slice(F.array_sort(F.collect_list(F.struct("q", column))), 1, n)
        return each.groupBy("o_custkey").agg(F.array_sort(F.transform(first, lambda x: x[column])).alias(name))

    kinds = most_bought("p_type", 2, "verticals").join(most_bought("p_brand", 6, "tags"), "o_custkey")
    c = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # fixed size
    df = c.join(F.broadcast(nation), c.c_nationkey == nation.n_nationkey, "left").join(bought, c.c_custkey == bought.o_custkey, "left").drop("o_custkey")
    df = df.join(kinds, c.c_custkey == kinds.o_custkey, "left")
    none = F.array().cast("array<string>")
    key = F.col("c_custkey")
    employees, revenue = F.col("n") * 50, F.col("total") * 20
    founded = (F.col("year") + key % 30).cast("int")
    return df.select(
        F.concat(F.lit("run-"), (key % 15).cast("string")).alias("run_id"), key.cast("int").alias("id"), F.col("c_name").alias("name"),
        F.when(key % 7 != 0, F.concat(F.lit("https://v"), key, F.lit(".example"))).alias("website"), F.col("n_name").alias("country"), founded.alias("founded_year"),
        employees.alias("n_employees"), revenue.cast("decimal(20,2)").alias("revenue_usd"), band("size", employees).alias("employees"), band("revenue", revenue).alias("revenue"),
        F.col("c_mktsegment").alias("ownership"), F.concat_ws(", ", F.lit("Port"), F.col("n_name")).alias("hq"), F.coalesce("verticals", none).alias("verticals"),
        F.array(pick(PRODUCTS, key)).alias("products"), F.coalesce("tags", none).alias("tags"),
        F.concat(F.lit("Vendor in "), F.coalesce("n_name", F.lit("nowhere"))).alias("description"), (F.col("c_acctbal") / 100).alias("score"),
        band("size", employees).alias("size"), band("founded", founded).alias("founded"),
    )


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brief per supplier over the values that company_profile() has."""
    s = F.col("s_suppkey")
    brand = lambda a: F.concat(F.lit("Brand#"), (s * a % 25 + 1).cast("string"))
    tag = lambda g, t: F.struct(F.lit(g).alias("grp"), t.alias("tag"))
    no_tags, no_verticals = F.array().cast("array<struct<grp:string,tag:string>>"), F.array().cast("array<string>")
    chosen = lambda every, labels: F.when(s % every == 0, pick(labels[1:], s)).otherwise(labels[0])
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("b"), s).alias("brief_id"), pick(PRODUCTS, s).alias("product"),
        F.when(s % 3 == 0, F.array(tag("first", brand(1)), tag("first", brand(3)), tag("second", brand(7)))).when(s % 3 == 1, F.array(tag("first", brand(1)))).otherwise(no_tags).alias("tags"),
        F.when(s % 4 == 0, F.array(pick(TYPES, s), pick(TYPES, s + 1))).otherwise(no_verticals).alias("verticals"),
        F.when(s % 5 == 0, pick(SEGMENTS, s)).otherwise(OWNERSHIP[0]).alias("ownership"), chosen(7, REVENUE).alias("revenue"), chosen(6, SIZE).alias("size"), chosen(9, FOUNDED).alias("founded"),
    )


def record_json(c: Column, name: Column, segment: Column, balance: Column, product: Column) -> Column:
    """A record as a reply would hold it, with fields missing, single, empty or of another type by the key's modulus."""
    text = lambda v: F.concat(F.lit('"'), v.cast("string"), F.lit('"'))
    field = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    lit = F.lit
    return F.concat(lit("{"), F.concat_ws(
        ",",
        field("id", (c % 20).cast("string")), field("name", F.when(c % 13 == 0, lit('""')).otherwise(text(name))),
        F.when(c % 5 == 1, field("website", text(F.concat(lit("v"), c)))).when(c % 5 != 0, field("website", text(F.concat(lit("https://v"), c, lit(".example"))))),
        field("country", F.when(c % 3 == 0, lit('"US"')).when(c % 3 == 1, lit('"USA"')).otherwise(lit("null"))),
        F.when(c % 4 == 0, field("foundedYear", lit("0"))).when(c % 4 == 1, field("foundedYear", lit('""'))).when(c % 4 == 2, field("foundedYear", (c % 30 + 1990).cast("string"))),
        field("employees", F.when(c % 3 == 0, lit('"11–50"')).when(c % 3 == 1, lit('"many"')).otherwise(lit("null"))),
        field("ownership", F.when(c % 2 == 0, lit('"VC-Backed"')).otherwise(text(segment))),
        F.when(c % 5 == 0, field("verticals", lit('["Metals & Mining","Bulk Liquids"]'))).when(c % 5 == 1, field("verticals", lit('"Mining"')))
        .when(c % 5 == 2, field("verticals", lit('""'))).when(c % 5 == 4, field("verticals", lit('["x",null]'))),
        F.when(c % 3 == 0, field("products", F.concat(lit("["), text(product), lit("]")))).when(c % 3 == 1, field("products", lit('"ERP"'))),
        field("tags", F.when(c % 3 == 0, lit('["api"]')).when(c % 3 == 1, lit('"api"')).otherwise(lit("null"))),
        F.when(c % 4 == 0, field("score", F.floor(balance / 100).cast("string"))).when(c % 4 == 1, field("score", lit("91.5"))).when(c % 4 == 2, field("score", lit('"85"'))),
    ), lit("}"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply per RECORDS_PER_REPLY customers; by the run's number modulo 16: sound, trailing comma, prose bracket, cut short,
    no array, empty array, no JSON, a null record, a surplus bracket, text after the JSON, content that is a text, content that
    is an object, a null body, a null block, a comma and U+0085 before the bracket, a number among the blocks."""
    c = F.col("c_custkey")
    run = F.floor(c / RECORDS_PER_REPLY).cast("long")
    df = table(spark, sf_dir, "customer").select(run.alias("run"), pick(PRODUCTS, run).alias("product"), c, "c_name", "c_mktsegment", "c_acctbal")
    df = df.select("run", "product", "c_custkey", record_json(c, F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal"), F.col("product")).alias("r"))
    df = df.groupBy("run", "product").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "r"))), lambda x: x["r"]), ",").alias("rs"))
    m, rs, lit = F.col("run") % 16, F.col("rs"), F.lit
    whole = F.concat(lit("["), rs, lit("]"))
    text = (
        F.when(m == 0, F.concat(lit("Here: "), whole, lit(" done"))).when(m == 1, F.concat(lit("["), rs, lit(", ]"))).when(m == 2, F.concat(lit("see [1] then "), whole))
        .when(m == 3, F.substring(whole, lit(1), (F.length(whole) / 2).cast("int"))).when(m == 4, lit("no list here")).when(m == 5, lit("[]"))
        .when(m == 8, F.concat(whole, lit("]"))).when(m == 7, F.concat(lit("[null,"), rs, lit("]")))
        .when(m == 14, F.concat(lit("["), rs, lit(",\u0085]"))).otherwise(whole)
    )
    block = lambda kind, text, name: F.struct(lit(kind).alias("type"), text.cast("string").alias("text"), lit(name).cast("string").alias("name"))
    calls = F.array_repeat(block("tool_use", lit(None), "web_search"), (F.col("run") % 4).cast("int"))
    body = F.to_json(F.struct(F.concat(calls, F.array(block("text", text, None))).alias("content")))
    more = lambda element: F.replace(body, lit('"content":['), lit(f'"content":[{element},'))
    sent = (
        F.when(m == 6, "oops").when(m == 9, F.concat(body, lit(" x"))).when(m == 10, '{"content":"x"}').when(m == 11, '{"content":{}}').when(m == 12, "null")
        .when(m == 13, more("null")).when(m == 15, more("5")).otherwise(body)
    )
    return df.select(F.concat(lit("reply-"), F.col("run")).alias("run_id"), "product", F.timestamp_seconds(F.col("run") * 60).alias("received_at"), sent.alias("body"))


def _k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def selection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as clicks on a brief: click and view toggle, purchase sets an attribute, signup the product, error clears."""
    e = _k(table(spark, sf_dir, "events"))
    facets = dim_facet(spark)
    w = facets.groupBy("product_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_ord", "tag_ord", "grp", "tag"))), lambda x: F.struct(x["grp"].alias("grp"), x["tag"].alias("tag"))).alias("facets"))
    e = e.withColumn("product_ord", (F.col("user_id") % 15).cast("int")).join(F.broadcast(w), "product_ord")  # 15 rows
    kind, k = F.col("event_type"), F.col("k")
    facet = F.element_at("facets", (k % F.size("facets") + 1).cast("int"))
    attrs = list(OPTIONS)[:4]
    op = (
        F.when(kind == "click", "toggle_vertical").when(kind == "view", "toggle_tag").when(kind == "purchase", "set_attr").when(kind == "signup", "set_product")
        .when((kind == "error") & (k % 2 == 0), "clear_all").when(kind == "error", "clear_verticals")
    )
    grp = F.when(kind == "view", facet["grp"]).when(kind == "purchase", pick(attrs, k))
    label = F.coalesce(*(F.when(F.pmod(k, F.lit(4)) == i, pick(OPTIONS[a], F.col("event_id"))) for i, a in enumerate(attrs)))
    value = F.when(kind == "click", pick(VERTICALS, k)).when(kind == "view", facet["tag"]).when(kind == "purchase", label).when(kind == "signup", pick(PRODUCTS, k))
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("session_id"), op.alias("op"), grp.alias("grp"), value.alias("value")).where("op is not null")


def shortlist_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events as actions on shortlists: signup saves, error removes, click, view and purchase set role, comments and quality."""
    e = _k(table(spark, sf_dir, "events") if events is None else events)
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
    op = F.when(kind == "signup", "save").when(kind == "error", "unsave").otherwise("set")
    field = F.when(kind == "click", "role").when(kind == "view", "comments").when(kind == "purchase", "quality")
    value = F.when(kind == "click", F.concat(F.lit("role "), k)).when(kind == "view", F.concat(F.lit("note "), F.col("event_id"))).when(kind == "purchase", pick(OPTIONS["quality"], k))
    return e.select(
        "event_id", "ts", F.concat(F.lit("list-"), F.col("event_id") % 3).alias("list_id"), F.concat(F.lit("run-"), user % 15).alias("run_id"), user.cast("int").alias("id"),
        op.alias("op"), field.alias("field"), value.alias("value"),
    )
