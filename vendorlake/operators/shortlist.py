"""Event logs folded into selections and shortlists, and the shortlist's joins and sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DASH, filled, joined, text_filled
from .search import SENTINELS

META = ("website", "contact_name", "role", "email", "quality", "comments")
DEFAULTS = dict.fromkeys(META, "") | {"quality": DASH}
KEY = ("list_id", "run_id", "id")
# The sheet's columns, in order.
SHEET = (
    "Website", "Company", "Vertical", "Country", "Year Founded", "Employees", "Quality", "Est. Revenue", "Overview", "Ownership", "Contact Name", "Role", "Email", "Comments",
)


def _when(op: Column | str, name: str, at: Column) -> Column:
    return F.max(F.when(op == name, at))


def fold_aggregates() -> list[Column]:
    """Commutative aggregates of a shortlist event log: what fold() needs of each key, in any order of events."""
    at, op = F.struct("ts", "event_id"), F.col("op")
    out = [_when(op, "save", at).alias("saved_at"), _when(op, "unsave", at).alias("unsaved_at")]
    for f in META:
        is_set = (op == "set") & (F.col("field") == f)
        out += [F.max(F.when(is_set, at)).alias(f"{f}_at"), F.max_by(F.when(is_set, F.col("value")), F.when(is_set, at)).alias(f)]
    return out


def folded(groups: DataFrame) -> DataFrame:
    """From fold_aggregates() by key: saved if the last of save and unsave is a save; a field is what was set after the last save, else its default."""
    saved = F.col("saved_at").isNotNull() & (F.col("unsaved_at").isNull() | (F.col("saved_at") > F.col("unsaved_at")))
    fresh = lambda f: F.col(f"{f}_at").isNotNull() & (F.col("saved_at").isNull() | (F.col(f"{f}_at") > F.col("saved_at")))
    return groups.select(*KEY, saved.alias("saved"), *(F.when(fresh(f), F.coalesce(f, F.lit(DEFAULTS[f]))).otherwise(DEFAULTS[f]).alias(f) for f in META))


def fold(events: DataFrame) -> DataFrame:
    """shortlist events (event_id, ts, list_id, run_id, id, op, field, value) -> one row per key with saved and the six fields."""
    return folded(events.groupBy(*KEY).agg(*fold_aggregates()))


def selection(events: DataFrame) -> DataFrame:
    """Selection events (event_id, ts, session_id, op, grp, value) -> one brief per session.

    A toggled element is on after an odd number of toggles since its last reset, and stands where its last toggle put it;
    groups stand in the order of their first toggle since the reset. clear_verticals resets the verticals, clear_all all but
    the product, set_product also the tags; attributes and product keep what was set last.
    """
    at, op = F.struct("ts", "event_id"), F.col("op")
    last = events.groupBy("session_id").agg(
        F.max(F.when(op == "clear_all", at)).alias("all_at"), F.max(F.when(op.isin("clear_all", "clear_verticals"), at)).alias("verticals_at"),
        F.max(F.when(op.isin("clear_all", "set_product"), at)).alias("tags_at"), F.max_by(F.when(op == "set_product", F.col("value")), F.when(op == "set_product", at)).alias("product"),
        *(F.max_by(F.when((op == "set_attr") & (F.col("grp") == a), F.col("value")), F.when((op == "set_attr") & (F.col("grp") == a), at)).alias(a) for a in SENTINELS),
        *(F.max(F.when((op == "set_attr") & (F.col("grp") == a), at)).alias(f"{a}_at") for a in SENTINELS),
    )
    toggles = events.where(op.isin("toggle_tag", "toggle_vertical")).withColumn("at", at).join(last.select("session_id", "verticals_at", "tags_at"), "session_id")
    reset = F.when(op == "toggle_tag", F.col("tags_at")).otherwise(F.col("verticals_at"))
    live = toggles.where(reset.isNull() | (F.col("at") > reset))
    # At most as many elements a session as the vocabularies have.
    each = live.groupBy("session_id", "op", "grp", "value").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.min("at").alias("first"))
    on = F.col("n") % 2 == 1
    elements = F.array_sort(F.collect_list(F.when(on, F.struct("at", "grp", "value"))))
    by_op = each.groupBy("session_id", "op", "grp").agg(F.min("first").alias("first"), elements.alias("elements"))
    gathered = by_op.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("op") == "toggle_tag", F.struct("first", "elements")))).alias("tag_groups"),
        F.array_sort(F.collect_list(F.when(F.col("op") == "toggle_vertical", F.struct("first", "elements")))).alias("vertical_groups"),
    )
    flat = lambda c: F.flatten(F.transform(c, lambda g: g["elements"]))
    gathered = gathered.select(
        "session_id", F.transform(flat(F.col("tag_groups")), lambda e: F.struct(e["grp"].alias("grp"), e["value"].alias("tag"))).alias("tags"),
        F.transform(flat(F.col("vertical_groups")), lambda e: e["value"]).alias("verticals"),
    )
    df = last.join(gathered, "session_id", "left")
    kept = lambda a: F.when(F.col(a).isNotNull() & (F.col("all_at").isNull() | (F.col(f"{a}_at") > F.col("all_at"))), F.col(a)).otherwise(SENTINELS[a])
    return df.select(
        F.col("session_id").alias("brief_id"), "product", F.coalesce("tags", F.array().cast("array<struct<grp:string,tag:string>>")).alias("tags"),
        F.coalesce("verticals", F.array().cast("array<string>")).alias("verticals"), *(kept(a).alias(a) for a in SENTINELS),
    )


def saved_companies(companies: DataFrame, shortlist: DataFrame) -> DataFrame:
    """The companies of each list's saved ids, with their fields; unknown ids drop out, companies without fields get the defaults."""
    saved = shortlist.where("saved").select(*KEY, *(F.col(f).alias(f"meta_{f}") for f in META))
    return companies.join(saved, ["run_id", "id"])


def saved_flags(companies: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Every company with is_saved: whether any list holds it."""
    saved = shortlist.where("saved").select("run_id", "id").distinct().withColumn("is_saved", F.lit(True))
    return companies.join(saved, ["run_id", "id"], "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))


def sheet(saved: DataFrame) -> DataFrame:
    """saved_companies() as the sheet's 14 text columns, after list_id, run_id and id."""
    meta = lambda f: F.coalesce(f"meta_{f}", F.lit(DEFAULTS[f]))
    values = (
        F.coalesce(F.nullif(meta("website"), F.lit("")), text_filled(F.col("website"))), F.col("name"), joined(F.col("verticals")), filled(F.col("country")),
        filled(F.col("founded_year")), text_filled(F.col("employees")), F.when(meta("quality") == DASH, "").otherwise(meta("quality")), text_filled(F.col("revenue")),
        text_filled(F.col("description")), text_filled(F.col("ownership")), meta("contact_name"), meta("role"), meta("email"), meta("comments"),
    )
    return saved.select(*KEY, *(v.alias(n) for v, n in zip(values, SHEET, strict=True)))


def write_sheet(rows: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Writes the sheet's columns with a header, as CSV or Parquet; an empty shortlist writes nothing. Whether it wrote."""
    rows = rows.select(*(F.col(f"`{c}`") for c in SHEET))
    if rows.isEmpty():
        return False
    options = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": ""} if fmt == "csv" else {}
    rows.write.format(fmt).options(**options).mode("overwrite").save(path)
    return True
