"""The live shortlist with retention (T2): a company that is silent for long leaves the state and returns from the table.

The state of a company is its fold's parts: the last save, the last unsave and each field's last value, each with its time.
Parts merge by the later time, whatever their order and however often the same one comes. So the table holds parts too, and
its reader merges them: a company that has left the state and comes back writes only what is new, which meets what the table
has of it. The first start may take the parts that a batch fold gave, as the table's first rows and as the state.

Companies are kept BUCKETS apart by a hash of their key, and a bucket's parts are merged as a table, since a call of Python and
of the state for each company costs far more than its few rows. A micro-batch rewrites the state of the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import shortlist
from ..sources.shipping import ship
from . import generations
from .selection import PROVIDER, ROCKSDB

KEY = list(shortlist.KEY)
#: Groups that companies are kept in; a checkpoint is good for one number only.
BUCKETS = 1024
NAMES = ("save", "unsave", *shortlist.META)
#: A row that each company has, whatever its events.
SEEN = ""
ROW = [*KEY, "name", "us", "event_id", "value"]


def parts(events: DataFrame) -> DataFrame:
    """The fold of shortlist events by key before it is read: each part and its time."""
    return _whole(events).groupBy(*KEY).agg(*shortlist.fold_aggregates())


def _whole(events: DataFrame) -> DataFrame:
    return events.where(" and ".join(f"{c} is not null" for c in (*KEY, "ts", "event_id"))).withColumn("ts", F.col("ts").cast("timestamp"))


def merge_aggregates() -> list[Column]:
    """Parts of the same key as one, by the later time."""
    out = [F.max("saved_at").alias("saved_at"), F.max("unsaved_at").alias("unsaved_at")]
    for f in shortlist.META:
        out += [F.max(f"{f}_at").alias(f"{f}_at"), F.max_by(f, f"{f}_at").alias(f)]
    return out


def _bucketed(df: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of parts with their company's bucket, the key's columns as events have them."""
    keys = [F.col(c).cast(events.schema[c].dataType).alias(c) for c in KEY]
    return df.select(*keys, *ROW[len(KEY) :]).withColumn("bucket", F.pmod(F.hash(*KEY), F.lit(BUCKETS)))


def _long(df: DataFrame) -> DataFrame:
    """parts() with a row for each part."""
    row = lambda name, c, value: F.when(F.col(c).isNotNull(), F.struct(F.lit(name).alias("name"), F.unix_micros(F.col(c)["ts"]).alias("us"), F.col(c)["event_id"].alias("event_id"), value.alias("value")))
    none = F.lit(None).cast("string")
    seen = F.struct(F.lit(SEEN).alias("name"), F.lit(0).cast("long").alias("us"), F.lit(0).cast("long").alias("event_id"), none.alias("value"))
    rows = F.array(seen, row("save", "saved_at", none), row("unsave", "unsaved_at", none), *(row(f, f"{f}_at", F.col(f)) for f in shortlist.META))
    return df.select(*KEY, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(*KEY, "r.*")


def _as_parts(df: DataFrame) -> DataFrame:
    """What the state gives, as parts()."""
    at = lambda n: F.when(F.col(f"{n}_us").isNotNull(), F.struct(F.timestamp_micros(f"{n}_us").alias("ts"), F.col(f"{n}_event").alias("event_id")))
    fields = [c for f in shortlist.META for c in (at(f).alias(f"{f}_at"), F.col(f))]
    return df.select(*KEY, at("save").alias("saved_at"), at("unsave").alias("unsaved_at"), *fields)


def _last(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each company's part the row of the latest time; of rows of the same time the first."""
    return rows.sort_values(["us", "event_id"], ascending=False, kind="stable").drop_duplicates([*KEY, "name"])


def _wide(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a company: each part's time and each field's value, or null."""
    company = rows.groupby(KEY, sort=False).ngroup().to_numpy()
    out = rows[KEY].iloc[np.unique(company, return_index=True)[1]].reset_index(drop=True)
    for name in NAMES:
        some = (rows["name"] == name).to_numpy()
        at, absent = company[some], np.ones(len(out), bool)
        absent[at] = False
        for label, c in (("us", "us"), ("event", "event_id")):
            numbers = np.zeros(len(out), np.int64)
            numbers[at] = rows[c].to_numpy()[some]
            out[f"{name}_{label}"] = pd.arrays.IntegerArray(numbers, absent.copy())
        if name in shortlist.META:
            values = np.full(len(out), None, object)
            values[at] = rows["value"].to_numpy()[some]
            out[name] = values
    return out


class Parts(StatefulProcessor):
    """A bucket's companies: a row for each part, with the clock at the company's last event (touched)."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A bucket that is silent that long has no company left.
        self.state = handle.getValueState("parts", "rows binary", self.retention_ms)

    def _held(self, now: int) -> pd.DataFrame | None:
        held = self.state.get()
        if held is None:
            return None
        rows = pa.ipc.open_stream(held[0]).read_pandas()
        return rows[rows["touched"] + self.retention_ms > now]

    def _hold(self, rows: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        rows = initialState[ROW].assign(touched=now)
        # A large bucket comes in several frames.
        held = self._held(now)
        self._hold(rows if held is None else pd.concat([held, rows], ignore_index=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        new = None
        for frame in rows:
            seen = frame[KEY].drop_duplicates().assign(name=SEEN, us=0, event_id=0, value=None)
            more = pd.concat([frame.loc[frame["name"].isin(NAMES), ROW], seen], ignore_index=True)
            new = _last(more if new is None else pd.concat([new, more], ignore_index=True))
        held = self._held(now)
        old = new[:0] if held is None else held
        # The companies that have events now, with what is held of them.
        company = pd.concat([old[KEY], new[KEY]], ignore_index=True).groupby(KEY, sort=False).ngroup().to_numpy()
        again = np.isin(company[: len(old)], company[len(old) :])
        changed = _last(pd.concat([old.loc[again, ROW], new[ROW]], ignore_index=True)) if again.any() else new[ROW]
        live = changed.assign(touched=now)
        self._hold(live if held is None else pd.concat([held[~again], live], ignore_index=True))
        yield _wide(changed)

    def close(self) -> None:
        pass


def start_shortlist(
    events: DataFrame, out_dir: str, checkpoint_dir: str, retention: int, since: DataFrame | None = None, trigger: dict | None = None, every: int = generations.EVERY
) -> StreamingQuery:
    """Keeps the shortlist of events current; read it with shortlisted(). retention: seconds after which a silent company leaves the state.

    since: parts() of the events before the stream's; taken at the first start only. Events without a key, a time or an id are
    left out; a time without a zone is in the session's. A query with retention goes by the clock, so it is triggered over and over (every 10 seconds, if no trigger is
    given), or once.
    """
    spark = ship(events.sparkSession)
    schema = events.select(*KEY).schema
    for name in NAMES:
        schema = schema.add(f"{name}_us", "long").add(f"{name}_event", "long")
        schema = schema.add(name, "string") if name in shortlist.META else schema
    initial = None
    if since is not None:
        first = generations.write_first(since, out_dir)
        initial = _bucketed(_long(first), events).groupBy("bucket")
    known = F.when((F.col("op") == "set") & F.col("field").isin(*shortlist.META), F.col("field")).when(F.col("op").isin("save", "unsave"), F.col("op"))
    timed = _whole(events).select(*KEY, known.alias("name"), F.unix_micros("ts").alias("us"), "event_id", F.when(F.col("op") == "set", F.col("value")).alias("value"))
    changed = _bucketed(timed, events).groupBy("bucket").transformWithStateInPandas(Parts(retention * 1000), schema, "update", "processingTime", initial)

    def write(batch: DataFrame, batch_id: int) -> None:
        generations.write_changes(_as_parts(batch), batch_id, out_dir, KEY, every, merge_aggregates())

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps what it starts with
    try:
        stream = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_dir)
        return stream.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    finally:
        spark.conf.set(PROVIDER, before)


def shortlisted(spark: SparkSession, out_dir: str) -> DataFrame:
    """The shortlist as shortlist.fold() gives it."""
    return shortlist.folded(generations.latest(spark, out_dir, KEY, merge=merge_aggregates()))
