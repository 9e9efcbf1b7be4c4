"""Filtering, ranking, matching against briefs, and the projections shown for a company (F, O, P17-P21, J3-J6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import DASH, filled, joined, matches_text, text_filled
from ..sources.dims import FOUNDED, OWNERSHIP, REVENUE, SIZE

SENTINELS = {"ownership": OWNERSHIP[0], "revenue": REVENUE[0], "size": SIZE[0], "founded": FOUNDED[0]}


def text_filter(companies: DataFrame, q: str) -> DataFrame:
    """Companies in whose name, description or verticals q stands; an empty q keeps all."""
    return companies.where(matches_text(F.lit(q), F.col("name"), F.col("description"), F.col("verticals")))


def text_filters(companies: DataFrame, queries: dict[str, str]) -> DataFrame:
    """The matches of each of a few saved text filters (query_id -> q), with query_id. Rows are copied once a filter that they meet."""
    met = [F.when(matches_text(F.lit(q), F.col("name"), F.col("description"), F.col("verticals")), F.lit(i)) for i, q in queries.items()]
    return companies.withColumn("met_", F.array_compact(F.array(*met))).select(F.explode("met_").alias("query_id"), *companies.columns)


def ranked(companies: DataFrame, by: list[str] | None = None) -> DataFrame:
    """With rank within each run (or the columns of by): score falling, ties in record order."""
    w = W.partitionBy(*(by or ["run_id"])).orderBy(F.desc("score"), "run_id", "id")
    return companies.withColumn("rank", F.row_number().over(w))


def facet(brief: str, company: str, column: str) -> Column:
    """An attribute's condition: the sentinel asks for nothing, any other choice never meets a null."""
    wanted = F.col(f"{brief}.{column}")
    return (wanted == SENTINELS[column]) | F.coalesce(F.col(f"{company}.{column}") == wanted, F.lit(False))


def wants_vertical(selected: Column, verticals: Column) -> Column:
    """Any of the selected verticals; none selected asks for nothing."""
    return (F.size(selected) == 0) | F.coalesce(F.arrays_overlap(verticals, selected), F.lit(False))


def wants_tags(selected: Column, tags: Column) -> Column:
    """selected: array of (grp, tag). Within a group any tag will do; every group must be met."""
    groups = F.array_distinct(F.transform(selected, lambda s: s["grp"]))

    def met(group: Column) -> Column:
        own = F.transform(F.filter(selected, lambda s: s["grp"] == group), lambda s: s["tag"])
        return F.coalesce(F.arrays_overlap(tags, own), F.lit(False))

    return F.forall(groups, met)


def brief_match(companies: DataFrame, briefs: DataFrame, max_broadcast: int = 64 << 20) -> DataFrame:
    """Each brief's companies: product by equality on the exploded products, the other facets as residual conditions.

    Gives the companies' columns with brief_id and tag_hits (selected tags that the company has). Briefs are broadcast if
    they are at most max_broadcast bytes as JSON; else the join shuffles on the product. For very many, see
    matching.brief_match_indexed().
    """
    size = briefs.agg(F.sum(F.octet_length(F.to_json(F.struct(*briefs.columns))))).first()[0] or 0
    few = size <= max_broadcast
    b = (F.broadcast(briefs) if few else briefs).alias("b")
    c = companies.withColumn("sold", F.explode(F.array_distinct("products"))).alias("c")
    on = (F.col("c.sold") == F.col("b.product")) & wants_vertical(F.col("b.verticals"), F.col("c.verticals")) & wants_tags(F.col("b.tags"), F.col("c.tags"))
    for column in SENTINELS:
        on = on & facet("b", "c", column)
    hits = F.size(F.array_intersect("c.tags", F.transform("b.tags", lambda s: s["tag"])))
    return c.join(b, on).select("b.brief_id", *(f"c.{x}" for x in companies.columns), hits.alias("tag_hits"))


def detail_card(companies: DataFrame) -> DataFrame:
    """Founded, hq, country, employees and revenue for showing; what is missing shows as a dash."""
    return companies.select(
        "run_id", "id", filled(F.col("founded_year"), DASH).alias("founded"), *(text_filled(F.col(c), DASH).alias(c) for c in ("hq", "country", "employees", "revenue"))
    )


def saved_header(companies: DataFrame, key: tuple[str, ...] = ("run_id", "id")) -> DataFrame:
    """key and header, the line above a shortlisted company: what it has of ownership, hq, year, employees and revenue."""
    has = lambda c, text: F.when((filled if c == "founded_year" else text_filled)(F.col(c)) != "", text)
    parts = F.array_compact(F.array(
        F.col("name"), has("ownership", F.col("ownership")), has("hq", F.col("hq")), has("founded_year", F.concat(F.lit("Est. "), F.col("founded_year"))),
        has("employees", F.concat("employees", F.lit(" emp"))), has("revenue", F.col("revenue")),
    ))
    return companies.select(*key, F.array_join(parts, " | ").alias("header"))


def tag_names(brief_tags: Column) -> Column:
    """The tags of all groups in order, without their groups."""
    return F.transform(brief_tags, lambda s: s["tag"])


# What a brief says where nothing is chosen.
STOCK = {
    "verticals": "any industrial vertical", "tags": "no specific feature filters", "ownership": "any ownership",
    "revenue": "any revenue", "size": "any size", "founded": "any era",
}


def brief_text(briefs: DataFrame) -> DataFrame:
    """A brief as phrases, one column each and all in one line."""
    listed = lambda values, key: F.coalesce(F.nullif(joined(values), F.lit("")), F.lit(STOCK[key]))
    chosen = lambda c: F.when(F.col(c) == SENTINELS[c], STOCK[c]).otherwise(F.col(c))
    columns = {"verticals_text": listed(F.col("verticals"), "verticals"), "tags_text": listed(tag_names(F.col("tags")), "tags")}
    columns |= {f"{c}_text": chosen(c) for c in SENTINELS}
    df = briefs.select("brief_id", "product", *(x.alias(n) for n, x in columns.items()))
    return df.withColumn("brief", F.concat_ws("; ", "product", *columns))


def brief_chips(briefs: DataFrame) -> DataFrame:
    """The chips shown for a brief: product, verticals, tags, then chosen ownership, revenue and size. The era has none."""
    chosen = lambda c, suffix="": F.when(F.col(c) != SENTINELS[c], F.concat(F.col(c), F.lit(suffix)))
    chips = F.concat(F.array("product"), "verticals", tag_names(F.col("tags")), F.array_compact(F.array(chosen("ownership"), chosen("revenue"), chosen("size", " emp"))))
    return briefs.select("brief_id", chips.alias("chips"))


def with_lookup(df: DataFrame, dimension: DataFrame, column: str, key: str, value: str, default: str | None) -> DataFrame:
    """df with value looked up in a small dimension by column = key; default where the key is unknown."""
    found = df.join(F.broadcast(dimension.select(F.col(key).alias(column), value)), column, "left")
    return found if default is None else found.withColumn(value, F.coalesce(value, F.lit(default)))


def selected_flag(briefs: DataFrame, options: list[str], selection: str) -> DataFrame:
    """brief_id, ord, option, selected: every option of a vocabulary for every brief."""
    df = briefs.select("brief_id", F.col(selection).alias("chosen"), F.posexplode(F.array(*map(F.lit, options))).alias("ord", "option"))
    return df.select("brief_id", "ord", "option", F.coalesce(F.array_contains("chosen", F.col("option")), F.lit(False)).alias("selected"))
