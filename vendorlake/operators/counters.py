"""The counts shown beside searches, briefs and shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import plural
from .search import SENTINELS


def active_filters(briefs: DataFrame) -> DataFrame:
    """brief_id, n_filters (tags, verticals and chosen attributes; product and text filter don't count), filters_text, n_verticals."""
    chosen = sum((F.when(F.col(c) != s, 1).otherwise(0) for c, s in SENTINELS.items()), F.lit(0))
    df = briefs.select("brief_id", (F.size("tags") + F.size("verticals") + chosen).alias("n_filters"), F.size("verticals").alias("n_verticals"))
    n = F.col("n_filters")
    return df.withColumn("filters_text", F.concat_ws(" ", n, plural(F.greatest(n, F.lit(1)), "filter", "filters"), F.lit("active")))


def run_summary(outcomes: DataFrame, companies: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Per run its outcome, call count, records found, shown after a filter, and whether a finished search shows nothing."""
    counts = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    df = outcomes.join(counts(companies if shown is None else shown, "n_shown"), "run_id", "left").withColumn("n_shown", F.coalesce("n_shown", F.lit(0)).cast("long"))
    return df.withColumn("shows_nothing", (F.col("outcome") != "request_failed") & (F.col("n_shown") == 0))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """outcome, n_runs, n_calls, n_found."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n_runs"), F.sum("n_calls").cast("long").alias("n_calls"), F.sum("n_found").alias("n_found"))


def shortlist_counts(shortlist: DataFrame, companies: DataFrame) -> DataFrame:
    """Per list: n_saved (all saved ids), saved_text, and n_in_view (those among the companies)."""
    known = companies.select("run_id", "id", F.lit(True).alias("known")).distinct()
    df = shortlist.join(known, ["run_id", "id"], "left")
    counts = df.groupBy("list_id").agg(F.count_if("saved").alias("n_saved"), F.count_if(F.col("saved") & F.col("known").isNotNull()).alias("n_in_view"))
    return counts.withColumn("saved_text", F.concat_ws(" ", "n_saved", plural(F.col("n_saved"), "company", "companies")))
