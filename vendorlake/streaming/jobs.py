"""The streaming jobs: payload ingest (T1), the live shortlist (T2), live run counters.

Each start_* function gives a running query; what it writes holds the same rows as the batch operators give over the
same input. Late events need no watermark: the folds are order-insensitive, at the price of one small state row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import ingest, shortlist
from ..operators.counters import outcome_counts
from . import generations
from .generations import latest

__all__ = ["file_stream", "latest", "start_counters", "start_ingest", "start_shortlist"]


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def start_ingest(payloads: DataFrame, out_dir: str, checkpoint_dir: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes companies (raw as a VARIANT, whose common keys Parquet holds as columns of their own), quarantine and outcomes of each micro-batch under out_dir, in folders by batch that a replayed batch overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            found = ingest.ingest(batch)
            for name, df in (("companies", found.companies), ("quarantine", found.quarantine), ("outcomes", found.outcomes)):
                df.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()


def _kept_current(state: DataFrame, out_dir: str, checkpoint_dir: str, key: list[str], trigger: dict | None, every: int) -> StreamingQuery:
    """Writes what each micro-batch changes as a table of generations (see generations.py)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        generations.write_changes(batch, batch_id, out_dir, key, every)

    return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()


def start_shortlist(events: DataFrame, out_dir: str, checkpoint_dir: str, trigger: dict | None = None, every: int = generations.EVERY) -> StreamingQuery:
    """Keeps the shortlist fold as streaming state; read it with latest(spark, out_dir, shortlist.KEY)."""
    state = shortlist.folded(events.groupBy(*shortlist.KEY).agg(*shortlist.fold_aggregates()))
    return _kept_current(state, out_dir, checkpoint_dir, list(shortlist.KEY), trigger, every)


def start_counters(
    payloads: DataFrame, out_dir: str, checkpoint_dir: str, trigger: dict | None = None, every: int = generations.EVERY, repeats_within: str | None = None
) -> StreamingQuery:
    """Keeps runs, calls and records found by outcome; read them with latest(spark, out_dir, ["outcome"]).

    A run counts once, however often its payload lands: the first one counts. The state has a run's id for ever, or, if
    repeats_within is given (as "7 days"), as long as a repeat may come after it by received_at; what comes later than that
    after the latest payload seen isn't counted.
    """
    if repeats_within is None:
        once = payloads.dropDuplicates(["run_id"])
    else:
        once = payloads.withWatermark("received_at", repeats_within).dropDuplicatesWithinWatermark(["run_id"])
    return _kept_current(outcome_counts(ingest.ingest(once).outcomes), out_dir, checkpoint_dir, ["outcome"], trigger, every)
