"""A training corpus from documents: language ID, near duplicates, benchmark decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. run()
writes each stage's result in the shared folder and rereads it as the next one's docs.

In every stage columns beyond those of documents are left behind, whatever their names; an empty table gives an empty one.
Rows are judged by their text, whatever their ids: near_duplicates and decontamination name a row by its id only where no
other row has it, else by id and text together. So a contaminated row goes and its namesake of another text stays, rows with
a null id are decided like any other, and of rows alike in id and text near_duplicates keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlake.llm import decontaminate, jaccard_join, langid, pii
from vendorlake.llm.bpe import encode_decode
from vendorlake.llm.queries import held_out, tokenizer
from vendorlake.llm.scratch import written
from vendorlake.llm.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose best language has a lower mean posterior are rejected, as are those without a letter.
LEAST_SCORE = 0.4
#: Keys of documents, up to so many rows, go to every executor; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _few(df: DataFrame) -> DataFrame:
    """A written table, for a join: broadcast if its number of rows allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with key (long), alike in rows of the same id and text alone, and whether any row is named by more than its id."""
    docs = docs.select(*COLUMNS)
    odd = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("odd_id"), F.lit(True).alias("odd")), "odd")
    if odd.isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long")), False
    # Negative, so that it is no id.
    own = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).bitwiseOR(F.lit(-(1 << 63)))
    named = docs.join(_few(odd), F.col("doc_id").eqNullSafe(F.col("odd_id")), "left")
    return named.withColumn("key", F.when(F.col("odd"), own).otherwise(F.col("doc_id").cast("long"))).select(*docs.columns, "key"), True


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """keyed rows whose key is not in keys."""
    return keyed.join(_few(written(keys.distinct(), "dropped")), "key", "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; texts that are null, have no letter or no likely language go."""
    ship(spark)
    found = langid.identify(docs, langid.fit(docs.where(~held_out())), keep=COLUMNS[1:])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by a similarity of 0.8 or more over five-word shingles, the document of the smallest id."""
    ship(spark)
    keyed, odd = _keyed(docs)
    groups = jaccard_join.similar_groups(keyed, id_col="key", width=5, part=80, whole=100)
    linked = groups.where("key <> component_id").select("key", "component_id")
    if not odd:
        return _without(keyed, linked.select("key")).select(*COLUMNS)
    # Keys aren't in the order of ids: of each group the row of the smallest id is looked for, a null one last.
    linked = written(linked.distinct(), "linked")
    members = linked.unionByName(linked.select(F.col("component_id").alias("key"), "component_id").distinct())
    ranked = keyed.select("key", "doc_id").distinct().join(members, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    kept = _without(keyed, members.join(ranked.select(F.col("m.key").alias("key")), "key", "left_anti").select("key"))
    # Rows alike in id and text: only those are shuffled with their texts.
    again = written(kept.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    again = _few(again)
    once = kept.join(again, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(again, "key", "left_anti").select(*COLUMNS).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    keyed, _ = _keyed(docs)
    found = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return _without(keyed, found.select("key")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and revealing terms taken out of its text; n_chars follows."""
    clean = pii.sanitise(docs, keep=("lang", "source"))
    return clean.select("doc_id", F.col("sanitised").alias("text"), "lang", "source", F.length("sanitised").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, and whether they decode to its text."""
    ship(spark)
    coded = encode_decode(docs, tokenizer("byte_bpe_50k.json"), keep=("text", "lang", "source"))
    return coded.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests/llm holds them against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
