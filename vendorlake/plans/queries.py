"""The library's queries over the given tables; oracles.py has each one's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import joined, score_band
from ..operators import audit, counters, ingest, intervals, search, shortlist, textindex, tiles
from ..operators.dealt import numbered
from ..sources import standins
from ..sources.dims import DESCRIPTION, OPTIONS, OTHER_COLOUR, OWNER_COLOUR, QUALITY_COLOUR, VERTICALS, dim_option
from ..sources.scratch import new_path
from ..sources.standins import table
from ..streaming import jobs, retained, selection
from .oracles import TEXT_QUERIES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def company_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = standins.company_profile(spark, sf_dir)
    return df.withColumns({c: F.array_join(c, "|") for c in ("verticals", "products", "tags")})


@query
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.col("text").alias("description"), F.array("lang", "source").alias("verticals"))
    return search.text_filters(docs, TEXT_QUERIES).select("query_id", "doc_id")


@query
def text_filters_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter a document, twelve characters of its text; the documents that each of them meets."""
    docs = table(spark, sf_dir, "documents")
    filters = docs.select(F.col("doc_id").alias("query_id"), F.substring("text", 21, 12).alias("q"))
    rows = docs.select("doc_id", F.col("source").alias("name"), F.col("text").alias("description"), F.array("lang", "source").alias("verticals"))
    return textindex.text_filters_indexed(rows, filters).select("query_id", "doc_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("run-"), key % 15).alias("run_id"), key.cast("int").alias("id"), (F.col("c_acctbal") / 100).alias("score"))


@query
def rank_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_scores(spark, sf_dir))


@query
def rank_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rank over all runs."""
    return numbered(_scores(spark, sf_dir), [F.desc("score"), F.asc("run_id"), F.asc("id")])


@query
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).groupBy(score_band(F.col("score")).alias("band")).agg(F.count("*").alias("n_companies"))


QUERIES["score_band"] = QUERIES.pop("score_bands")


def _facet(condition: Callable[[], Column], *needed: str) -> Query:
    """How many companies of a brief's product meet one of its conditions; companies are counted by what it needs of them, and meet each product and condition that briefs have once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = standins.company_profile(spark, sf_dir).withColumn("sold", F.explode("products"))
        c = c.groupBy("sold", *needed).agg(F.count("*").alias("n")).alias("c")
        briefs = standins.briefs(spark, sf_dir).select("brief_id", F.struct("product", *needed).alias("asked"))
        asked = briefs.select("asked").distinct().select("asked", "asked.*").alias("b")
        on = (F.col("c.sold") == F.col("b.product")) & condition()
        met = c.join(asked, on).groupBy("b.asked").agg(F.sum("c.n").alias("n_companies"))
        return briefs.join(met, "asked").groupBy("brief_id").agg(F.sum("n_companies").alias("n_companies"))

    return run


QUERIES |= {
    "facet_product": _facet(lambda: F.lit(True)),
    "facet_vertical": _facet(lambda: search.wants_vertical(F.col("b.verticals"), F.col("c.verticals")), "verticals"),
    "facet_tags": _facet(lambda: search.wants_tags(F.col("b.tags"), F.col("c.tags")), "tags"),
    **{f"facet_{a}": _facet(lambda a=a: search.facet("b", "c", a), a) for a in search.SENTINELS},
}


@query
def brief_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.ranked_match(standins.company_profile(spark, sf_dir), standins.briefs(spark, sf_dir), ["run_id", "id", "name", "score"])


@query
def brief_match_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.ranked_match(standins.company_profile(spark, sf_dir), standins.briefs(spark, sf_dir), ["run_id", "id", "name", "score"], indexed=True)


@query
def band_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's numbers with their labels, by a join to the option table."""
    numbers = {"revenue": "revenue_usd", "size": "n_employees", "founded": "founded_year"}
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(c).cast("double").alias("number")) for a, c in numbers.items()))).alias("x")
    values = standins.company_profile(spark, sf_dir).select("run_id", "id", each).select("run_id", "id", "x.*")
    options = dim_option(spark).where("lo is not null or hi is not null").select("attribute", "label", "lo", "hi")
    return intervals.band_join(values, options, "number", "lo", "hi", ["attribute"], "left").select("run_id", "id", "attribute", "number", "label")


@query
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of a supplier's nation whose balance lies in the supplier's band: bands by nation, with gaps, overlaps, open ends and empty ones."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").cast("double").alias("balance"))
    s, balance = F.col("s_suppkey"), F.col("s_acctbal").cast("double")
    lo = F.when(s % 10 != 0, balance)
    hi = F.when(s % 7 != 0, balance + F.when(s % 4 == 0, -1.0).otherwise(s % 5 * 100.0))
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nationkey"), lo.alias("lo"), hi.alias("hi"))
    return intervals.band_join(customers, bands, "balance", "lo", "hi", ["nationkey"]).select("s_suppkey", "c_custkey")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.selection(standins.selection_events(spark, sf_dir))


@query
def brief_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.active_filters(_sessions(spark, sf_dir))


@query
def brief_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.brief_text(standins.briefs(spark, sf_dir)).select("brief_id", "brief")


@query
def brief_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.brief_chips(standins.briefs(spark, sf_dir)).select("brief_id", F.array_join("chips", "|").alias("chips"))


@query
def option_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many briefs chose each option of each attribute."""
    options = [F.struct(F.lit(a).alias("attribute"), F.lit(i).alias("ord"), F.lit(x).alias("label"), (F.col(a) == x).alias("on")) for a in search.SENTINELS for i, x in enumerate(OPTIONS[a])]
    each = standins.briefs(spark, sf_dir).select(F.explode(F.array(*options)).alias("o"))
    return each.groupBy("o.attribute", "o.ord", "o.label").agg(F.count_if("o.on").alias("n_briefs"))


@query
def facet_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions have each facet selected."""
    used = _sessions(spark, sf_dir).select(F.explode("tags").alias("t"))
    return used.groupBy(F.concat_ws(":", "t.grp", "t.tag").alias("facet")).agg(F.count("*").alias("n_briefs"))


@query
def vertical_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = search.selected_flag(_sessions(spark, sf_dir), VERTICALS, "verticals")
    return flags.groupBy("option", "ord").agg(F.count_if("selected").alias("n_selected"), F.count("*").alias("n_briefs"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a reply's blocks: assistant turns as text, system turns as calls."""
    kind = F.when(F.col("role") == "assistant", "text").when(F.col("role") == "system", "tool_use").otherwise("other")
    block = F.struct(kind.alias("type"), "text", F.when(F.col("role") == "system", "web_search").alias("name"))
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("turns"))
    return df.select("conv_id", F.transform("turns", lambda t: t["b"]).alias("content"))


@query
def reply_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", ingest.block_text(F.col("content")).alias("reply"))


@query
def reply_call_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", ingest.call_count(F.col("content")).alias("n_calls"))


def _ingested(spark: SparkSession, sf_dir: str) -> ingest.Ingested:
    return ingest.ingest(standins.payloads(ingest.allow_repeated_keys(spark), sf_dir))


@query
def reply_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).companies.select("run_id", "id", "name", F.element_at("products", 1).alias("product"))


@query
def reply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ingested(spark, sf_dir)
    return counters.run_summary(found.outcomes, found.companies, found.companies.where("score >= 90")).drop("product")


@query
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.outcome_counts(_ingested(spark, sf_dir).outcomes)


@query
def reply_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).quarantine.select("run_id", "pos", "reason")


@query
def reply_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the normaliser replaces or casts, as the raw record still has it: its own id, and founded year and score as JSON."""
    raw = F.to_json("raw")
    return _ingested(spark, sf_dir).companies.select(
        "run_id", "id", F.get_json_object(raw, "$.id").cast("int").alias("raw_id"), F.get_json_object(raw, "$.score").alias("raw_score"), F.size(F.json_object_keys(raw)).alias("n_keys")
    )


@query
def raw_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys of the raw records, read back by path from the stored companies."""
    path = new_path(spark, "companies")
    _ingested(spark, sf_dir).companies.write.parquet(path)
    stored = ingest.with_raw_fields(spark.read.parquet(path), {"raw_id": ("$.id", "int"), "raw_score": ("$.score", "string")})
    return stored.select("run_id", "id", "raw_id", "raw_score")


@query
def owner_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's colour by its ownership, or the one for others."""
    colours = spark.createDataFrame(list(OWNER_COLOUR.items()), "label string, colour string")
    found = _ingested(spark, sf_dir).companies.select("run_id", "id", "ownership")
    return search.with_lookup(found, colours, "ownership", "label", "colour", OTHER_COLOUR)


@query
def product_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brief's product with what it is."""
    known = spark.createDataFrame(list(DESCRIPTION.items()), "name string, description string")
    return search.with_lookup(standins.briefs(spark, sf_dir).select("brief_id", "product"), known, "product", "name", "description", None)


@query
def quality_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shortlisted company's colour by its quality; none where the quality has none."""
    colours = spark.createDataFrame(list(QUALITY_COLOUR.items()), "label string, colour string")
    return search.with_lookup(_shortlist(spark, sf_dir).select("list_id", "run_id", "id", "quality"), colours, "quality", "label", "colour", None)


def _flat(companies: DataFrame) -> DataFrame:
    columns = ("run_id", "id", "name", "website", "country", "founded_year", "employees", "ownership", "score")
    return companies.select(*columns, *(joined(F.col(c), ",").alias(c) for c in ("verticals", "products", "tags")))


@query
def normalise_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_ingested(spark, sf_dir).companies)


@query
def props_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number read from a JSON text by key and type, counted by event type."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


def _joined_lists(briefs: DataFrame) -> DataFrame:
    return briefs.withColumns({"tags": F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["grp"], t["tag"])), "|"), "verticals": F.array_join("verticals", "|")})


@query
def selection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_lists(_sessions(spark, sf_dir))


def _shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.fold(standins.shortlist_events(spark, sf_dir))


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.saved_companies(standins.company_profile(spark, sf_dir), _shortlist(spark, sf_dir))


@query
def shortlist_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shortlist(spark, sf_dir)


@query
def shortlist_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).select("list_id", "run_id", "id", "name", "score", *(F.col(f"meta_{f}").alias(f) for f in ("role", "comments", "quality")))


@query
def shortlist_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.saved_flags(standins.company_profile(spark, sf_dir), _shortlist(spark, sf_dir)).select("run_id", "id", "is_saved")


@query
def shortlist_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.sheet(_saved(spark, sf_dir))


@query
def shortlist_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = _saved(spark, sf_dir)
    return search.saved_header(saved, ("list_id", "run_id", "id"))


@query
def shortlist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.shortlist_counts(_shortlist(spark, sf_dir), standins.company_profile(spark, sf_dir))


@query
def detail_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = standins.company_profile(spark, sf_dir)
    df = df.withColumns({"founded_year": F.when(F.col("id") % 3 != 0, F.col("founded_year")), "hq": F.when(F.col("id") % 4 != 0, F.col("hq")).when(F.col("id") % 8 == 0, "").otherwise("0")})
    return search.detail_card(df)


@query
def contract_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(ingest.exploded(ingest.parsed(standins.payloads(ingest.allow_repeated_keys(spark), sf_dir))))


@query
def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit taken while the companies are written, with the vocabularies of the option table."""
    payloads = standins.payloads(ingest.allow_repeated_keys(spark), sf_dir)
    options = dim_option(spark).where("ord > 0").select("attribute", "label")
    return audit.ingest_audited(payloads, lambda companies: companies.drop("raw").write.parquet(new_path(spark, "audited")), options)


@query
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet written as CSV and read again."""
    path = new_path(spark, "sheet")
    shortlist.write_sheet(shortlist.sheet(_saved(spark, sf_dir)), path)
    schema = ", ".join(f"`{c}` string" for c in shortlist.SHEET)
    df = spark.read.schema(schema).options(header=True, escape='"', emptyValue="", nullValue="\x00").csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in shortlist.SHEET))


#: Micro-batches in which a landed table is streamed, and the most rows of one of its files.
BATCHES, FILE_ROWS = 4, 1_000_000


def _landed(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """df landed as files in the shared folder, and streamed from there in BATCHES parts, each of as many files as keep all cores busy."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.repartition(BATCHES * spark.sparkContext.defaultParallelism).write.option("maxRecordsPerFile", FILE_ROWS).format(fmt).save(path)
    n_files = len(spark.read.schema(df.schema).format(fmt).load(path).inputFiles())
    return jobs.file_stream(spark, path, df.schema, max(1, -(-n_files // BATCHES)), fmt)


def _streamed(spark: SparkSession, sf_dir: str, sink: str, fmt: str = "parquet") -> DataFrame:
    """One of the tables that the payload stream writes."""
    source = _landed(standins.payloads(ingest.allow_repeated_keys(spark), sf_dir), "landed", fmt)
    out = new_path(spark, "ingested")
    jobs.start_ingest(source, out, new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(f"{out}/{sink}")


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _streamed(spark, sf_dir, "companies")
    return _flat(found).join(ingest.with_raw_fields(found, {"raw_id": ("$.id", "int")}).select("run_id", "id", "raw_id"), ["run_id", "id"])


@query
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "quarantine").select("run_id", "pos", "reason")


@query
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "outcomes").select("run_id", "outcome", "n_calls", "n_rejected")


@query
def stream_landed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of payloads that land as JSON lines."""
    return _streamed(spark, sf_dir, "outcomes", "json").select("run_id", "outcome", "n_calls", "n_found", "n_rejected")


@query
def stream_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standins.shortlist_events(spark, sf_dir, _landed(table(spark, sf_dir, "events"), "landed"))
    out = new_path(spark, "shortlist")
    jobs.start_shortlist(events, out, new_path(spark, "checkpoint")).awaitTermination()
    return jobs.latest(spark, out, list(shortlist.KEY))


@query
def stream_shortlist_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier events folded as a batch, the later ones as a stream that begins with that fold and forgets what is silent."""
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    late = micros >= (events.agg(F.avg(micros).cast("long")).first()[0] or 0)
    since = retained.parts(standins.shortlist_events(spark, sf_dir, events.where(~late)))
    out = new_path(spark, "shortlist")
    stream = standins.shortlist_events(spark, sf_dir, _landed(events.where(late), "landed"))
    retained.start_shortlist(stream, out, new_path(spark, "checkpoint"), 3600, since, {"once": True}).awaitTermination()
    return retained.shortlisted(spark, out)


@query
def stream_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, clicks = new_path(spark, "selection"), standins.selection_events(spark, sf_dir)
    selection.start_selection(_landed(clicks, "landed"), out, new_path(spark, "checkpoint")).awaitTermination()
    return _joined_lists(jobs.latest(spark, out, ["brief_id"]))


@query
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payload lands twice, in different files, and counts once."""
    payloads = standins.payloads(ingest.allow_repeated_keys(spark), sf_dir)
    source = _landed(payloads.unionByName(payloads), "landed")
    out = new_path(spark, "counters")
    jobs.start_counters(source, out, new_path(spark, "checkpoint")).awaitTermination()
    return jobs.latest(spark, out, ["outcome"])
