"""From raw replies to typed companies: text assembly, array extraction, repair, records, normalising.

A payload row is (run_id, product, received_at, body); body is the reply's JSON. Everything is column expressions over
VARIANT values, so the same code serves batch and streaming.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import let

COMPANY = (
    "run_id", "id", "name", "website", "country", "founded_year", "employees", "revenue", "ownership", "hq", "verticals", "products", "tags", "description", "score",
)
DEFAULT_SCORE = 75.0
OUTCOMES = ("request_failed", "no_array", "unparseable", "empty", "repaired", "parsed")


def allow_repeated_keys(spark: SparkSession) -> SparkSession:
    """In JSON objects the last of repeated keys counts; to be set in a session before payloads are read."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def block_text(content: Column) -> Column:
    """The texts of the text blocks, in order, a line feed between; null texts join as empty ones."""
    blocks = F.filter(F.coalesce(content, F.array().cast("array<struct<type:string,text:string,name:string>>")), lambda b: b["type"] == "text")
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n", "")


def call_count(content: Column, name: str = "web_search") -> Column:
    calls = F.filter(content, lambda b: (b["type"] == "tool_use") & (b["name"] == name))
    return F.greatest(F.size(calls), F.lit(0))


def array_text(text: Column) -> Column:
    """From the first [ to the last ]; null if there is no such span."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def strict_array(text: Column) -> Column:
    """text as a VARIANT if it is one JSON value and nothing more; else null.

    The parser stops after a value, so the text is parsed as the first of two elements of an array. The second is the
    text's own hash, which the text can't hold: it comes out as the second only if all before it is one value.
    """
    def one(t: Column) -> Column:
        wrapped = F.try_parse_json(F.concat(F.lit("["), t["text"], F.lit(',"'), t["own"], F.lit('"]')))
        return let(wrapped, lambda w: F.when(F.try_variant_get(w, "$[1]", "string") == t["own"], F.try_variant_get(w, "$[0]", "variant")))

    return let(F.struct(text.alias("text"), F.sha2(text, 256).alias("own")), one)


#: What counts as white space in the repair: the ASCII kinds, the Unicode spaces, line and paragraph separator, and the byte order mark; U+0085 does not.
SPACE = r"[\t\n\x0B\f\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def repaired_text(text: Column) -> Column:
    """Without the comma before a closing bracket, then before a closing brace."""
    return F.regexp_replace(F.regexp_replace(text, rf",{SPACE}*\]", "]"), rf",{SPACE}*\}}", "}")


def envelope(body: Column) -> Column:
    """A struct of content, the blocks of a reply's body, and sound, whether it can be read at all.

    A body is sound if it is one JSON value but not null, and its content is an array without a null, or absent, null, empty
    text, zero or false (then there are no blocks). Blocks that are no objects have neither type nor text.
    """
    field = lambda b, k: F.try_variant_get(b, f"$.{k}", "string").alias(k)

    def read(v: Column) -> Column:
        kind, text = v["kind"], F.try_variant_get(v["body"], "$.content", "string")
        nothing = kind.isNull() | (kind == "VOID") | ((kind == "STRING") & (text == "")) | ((kind == "BOOLEAN") & (text == "false")) | (is_number(kind) & (F.try_variant_get(v["body"], "$.content", "double") == 0))
        no_null = ~F.exists(v["blocks"], lambda b: F.coalesce(F.schema_of_variant(b), F.lit("VOID")) == "VOID")
        sound = F.coalesce(F.schema_of_variant(v["body"]) != "VOID", F.lit(False)) & F.when(v["blocks"].isNotNull(), no_null).otherwise(nothing)
        content = F.transform(v["blocks"], lambda b: F.struct(field(b, "type"), field(b, "text"), field(b, "name")))
        return let(sound, lambda s: F.struct(F.when(s, content).alias("content"), s.alias("sound")))

    def opened(v: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, "$.content", "variant"))
        return let(F.struct(v.alias("body"), F.try_variant_get(v, "$.content", "array<variant>").alias("blocks"), kind.alias("kind")), read)

    return let(strict_array(body), opened)


def parsed(payloads: DataFrame) -> DataFrame:
    """payloads with n_calls, records (array<variant>, null without any) and outcome."""
    def judged(e: Column, reply: Column, strict: Column, mended: Column) -> Column:
        records = F.try_variant_get(F.coalesce(strict, mended), "$", "array<variant>")

        def named(r: Column) -> Column:
            outcome = (
                F.when(~e["sound"], "request_failed").when(reply.isNull(), "no_array").when(r.isNull(), "unparseable")
                .when(F.size(r) == 0, "empty").when(strict.isNull(), "repaired").otherwise("parsed")
            )
            return F.struct(call_count(e["content"]).alias("n_calls"), r.alias("records"), outcome.alias("outcome"))

        return let(records, named)

    # Each step is bound once, so that a body is parsed once however many columns come of it.
    mended = lambda reply, strict: F.when(strict.isNull(), strict_array(repaired_text(reply)))
    read = let(envelope(F.col("body")), lambda e: let(array_text(block_text(e["content"])), lambda reply: let(
        strict_array(reply), lambda strict: let(mended(reply, strict), lambda m: judged(e, reply, strict, m))
    )))
    df = payloads.withColumn("read_", read)
    return df.select(*payloads.columns, "read_.n_calls", "read_.records", "read_.outcome")


def is_number(kind: Column) -> Column:
    """Of a VARIANT's kind, as schema_of_variant names it."""
    return kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")


def exploded(df: DataFrame) -> DataFrame:
    """run_id, product, pos (from 0), record (variant), kind (its type): one row per record."""
    # The outer form gives no filter on the array itself, which would be computed once more below.
    rows = df.select("run_id", "product", F.posexplode_outer("records").alias("pos", "record")).where("pos is not null")
    return rows.withColumn("kind", F.schema_of_variant("record"))


def _kind(record: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(record, f"$.{key}", "variant"))


def _array(record: Column, key: str) -> Column:
    """The key's array, its elements as text; null unless it is an array."""
    return F.when(_kind(record, key).startswith("ARRAY<"), F.try_variant_get(record, f"$.{key}", "array<string>"))


def _text(record: Column, key: str) -> Column:
    return F.try_variant_get(record, f"$.{key}", "string")


def verticals(record: Column) -> Column:
    """An array as it is; a single value as an array of it, unless it is null, empty, zero or false."""
    kind, text = _kind(record, "verticals"), _text(record, "verticals")
    empty = F.when(kind == "STRING", text == "").when(is_number(kind), F.try_variant_get(record, "$.verticals", "double") == 0).when(kind == "BOOLEAN", text == "false").otherwise(True)
    none = F.array().cast("array<string>")
    return F.coalesce(_array(record, "verticals"), F.when(F.coalesce(empty, F.lit(True)), none).otherwise(F.array(text)))


def score(record: Column) -> Column:
    """A JSON number as it is, not clamped; anything else counts as the default."""
    kind = _kind(record, "score")
    return F.coalesce(F.when(is_number(kind), F.try_variant_get(record, "$.score", "double")), F.lit(DEFAULT_SCORE))


def normalised(records: DataFrame) -> DataFrame:
    """Typed companies of the exploded records that are objects; ids are positions from 1, and raw keeps every key."""
    r = F.col("record")
    none = F.array().cast("array<string>")
    return records.where(F.col("kind").startswith("OBJECT<")).select(
        "run_id", (F.col("pos") + 1).alias("id"), _text(r, "name").alias("name"), _text(r, "website").alias("website"), _text(r, "country").alias("country"),
        F.nullif(F.try_variant_get(r, "$.foundedYear", "int"), F.lit(0)).alias("founded_year"),
        *(_text(r, k).alias(k) for k in ("employees", "revenue", "ownership", "hq")), verticals(r).alias("verticals"),
        F.coalesce(_array(r, "products"), F.array("product")).alias("products"), F.coalesce(_array(r, "tags"), none).alias("tags"),
        _text(r, "description").alias("description"), score(r).alias("score"), r.alias("raw"),
    )


def with_raw_fields(companies: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """companies with columns instead of raw: name -> (path, type) within the record as it came; null where it is missing or of another type.

    Over stored companies the scan reads those paths alone.
    """
    return companies.withColumns({name: F.try_variant_get("raw", path, kind) for name, (path, kind) in fields.items()}).drop("raw")


def quarantined(records: DataFrame) -> DataFrame:
    """The records that are no objects: run_id, pos, raw (text), reason."""
    bad = records.where(~F.coalesce(F.col("kind").startswith("OBJECT<"), F.lit(False)))
    return bad.select("run_id", "pos", F.col("record").cast("string").alias("raw"), F.concat(F.lit("not an object: "), F.coalesce("kind", F.lit("VOID"))).alias("reason"))


@dataclass
class Ingested:
    companies: DataFrame
    quarantine: DataFrame
    outcomes: DataFrame


def ingest(payloads: DataFrame) -> Ingested:
    """Companies, quarantine, and per run its outcome, n_calls, n_found (records that are companies) and n_rejected (records that are no objects)."""
    df = parsed(payloads)
    records = exploded(df)
    kinds = F.transform(F.coalesce("records", F.array().cast("array<variant>")), lambda r: F.schema_of_variant(r))
    rejected = F.size(F.filter(kinds, lambda k: ~F.coalesce(k.startswith("OBJECT<"), F.lit(False))))
    found = F.greatest(F.size(F.coalesce("records", F.array().cast("array<variant>"))) - F.col("n_rejected"), F.lit(0)).cast("long")
    outcomes = df.withColumn("n_rejected", rejected).select("run_id", "product", "outcome", "n_calls", found.alias("n_found"), "n_rejected")
    return Ingested(normalised(records), quarantined(records), outcomes)
