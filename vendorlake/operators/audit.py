"""How far records keep the rules that their request states (C1-C11); nothing else enforces them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import let
from ..sources.dims import OWNERSHIP, REVENUE, SIZE, VERTICALS
from .ingest import _array, _kind, _text, exploded, normalised, parsed

LEAST_RECORDS = 20


#: The attributes whose values a record takes from a vocabulary, by the record's key.
OPTION_OF = {"employees": "size", "revenue": "revenue", "ownership": "ownership"}


def record_rules(record: Column, product: Column, known_options: dict[str, Column] | None = None) -> dict[str, Column]:
    """By rule, whether the record breaks it. known_options: by key of OPTION_OF, whether its value is in the vocabulary; the fixed ones where it isn't given."""
    text = lambda k: _text(record, k)
    missing = lambda k: text(k).isNull()
    is_known = lambda k, labels: text(k).isin(labels) if known_options is None else known_options[k]
    known = lambda k, labels: ~missing(k) & ~is_known(k, labels)
    array = lambda k: F.coalesce(_array(record, k), F.array().cast("array<string>"))
    score_kind, score = _kind(record, "score"), F.try_variant_get(record, "$.score", "double")
    return {
        "C1 name": missing("name") | (text("name") == ""),
        "C2 website": missing("website") | ~text("website").rlike("^https?://"),
        "C3 country": missing("country") | ~text("country").rlike("^[A-Za-z]{2}$"),
        "C4 founded": ~missing("foundedYear") & (_kind(record, "foundedYear") != "BIGINT"),
        "C5 employees": known("employees", SIZE[1:]),
        "C5 revenue": known("revenue", REVENUE[1:]),
        "C6 ownership": known("ownership", OWNERSHIP[1:]),
        "C7 verticals": F.size(F.array_except(array("verticals"), F.array(*map(F.lit, VERTICALS)))) > 0,
        "C8 products": F.coalesce(_array(record, "products") != F.array(product), F.lit(True)),
        "C9 score": F.coalesce((score_kind != "BIGINT") | ~score.between(1, 100), F.lit(True)),
    }


def audit(records: DataFrame) -> DataFrame:
    """exploded() records -> rule, n_checked, n_broken. C1-C9 count records, C10 raw ids that repeat within a run, C11 runs of under LEAST_RECORDS records."""
    objects = records.where(F.col("kind").startswith("OBJECT<"))
    rules = record_rules(F.col("record"), F.col("product"))
    flags = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("broken")) for n, c in rules.items())))
    each = objects.select(flags.alias("f")).groupBy("f.rule").agg(F.count("*").alias("n_checked"), F.count_if("f.broken").alias("n_broken"))
    ids = objects.groupBy("run_id", _text(F.col("record"), "id").alias("raw_id")).agg(F.count("*").alias("n")).where("raw_id is not null")
    ids = ids.agg(F.count("*").alias("n_checked"), F.count_if(F.col("n") > 1).alias("n_broken")).select(F.lit("C10 ids").alias("rule"), "n_checked", "n_broken")
    runs = records.groupBy("run_id").agg(F.count("*").alias("n"))
    runs = runs.agg(F.count("*").alias("n_checked"), F.count_if(F.col("n") < LEAST_RECORDS).alias("n_broken")).select(F.lit("C11 size").alias("rule"), "n_checked", "n_broken")
    return each.unionByName(ids).unionByName(runs)


def _repeats(records: Column) -> Column:
    """Of a reply's records n, how many distinct raw ids the objects have, and again, how many of those repeat."""
    ids = F.array_sort(F.array_compact(F.transform(F.filter(records, lambda r: F.schema_of_variant(r).startswith("OBJECT<")), lambda r: _text(r, "id"))))
    again = lambda v: F.filter(v["ids"], lambda x, i: (i > 0) & F.coalesce(F.get(v["ids"], i - 1) == x, F.lit(False)))
    return let(F.struct(ids.alias("ids")), lambda v: F.struct(F.size(F.array_distinct(v["ids"])).alias("n"), F.size(F.array_distinct(again(v))).alias("again")))


def ingest_audited(payloads: DataFrame, write: Callable[[DataFrame], None], options: DataFrame | None = None) -> DataFrame:
    """Hands the companies of the payloads to write, which must run one action over all of them, and gives the audit of their records: rule, n_checked, n_broken.

    The counts are metrics observed while the companies are written, so that the payloads are read and parsed once. A reply
    counts as a run of its own in C10 and C11. options: attribute, label; the vocabularies of C5 and C6, which may differ
    from the fixed ones.
    """
    replies, records = Observation("replies"), Observation("records")
    has = F.size("records") > 0
    df = parsed(payloads).withColumn("ids_", _repeats(F.coalesce("records", F.array().cast("array<variant>"))))
    df = df.observe(
        replies, F.sum("ids_.n").alias("C10 checked"), F.sum("ids_.again").alias("C10 broken"), F.count_if(has).alias("C11 checked"), F.count_if(has & (F.size("records") < LEAST_RECORDS)).alias("C11 broken")
    )
    each, known = exploded(df), None
    if options is not None:
        known = {}
        for key, attribute in OPTION_OF.items():
            labels = options.where(F.col("attribute") == attribute).select(F.col("label").alias(f"label_{key}"), F.lit(True).alias(f"known_{key}")).distinct()
            each = each.join(labels, _text(F.col("record"), key) == F.col(f"label_{key}"), "left")
            known[key] = F.coalesce(f"known_{key}", F.lit(False))
    is_object = F.coalesce(F.col("kind").startswith("OBJECT<"), F.lit(False))
    rules = record_rules(F.col("record"), F.col("product"), known)
    each = each.observe(records, F.count_if(is_object).alias("n"), *(F.count_if(is_object & F.coalesce(broken, F.lit(False))).alias(rule) for rule, broken in rules.items()))
    write(normalised(each))
    of_replies, of_records = replies.get, records.get
    rows = [(rule, of_records["n"], of_records[rule]) for rule in rules]
    rows += [(rule, of_replies[f"{rule.split()[0]} checked"] or 0, of_replies[f"{rule.split()[0]} broken"] or 0) for rule in ("C10 ids", "C11 size")]
    return payloads.sparkSession.createDataFrame(rows, "rule string, n_checked long, n_broken long")
