"""Streams: batch results in any order of arrival, repeats, restarts, and tables that stay small."""

import json
import random
from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from test_shortlist import SHORT, T0

from vendorlake.operators import counters, ingest, shortlist
from vendorlake.streaming import generations, jobs


def event_rows(n=240):
    r = random.Random(3)
    rows = []
    for i in range(n):
        op = r.choice(["save", "unsave", "set", "set"])
        field = r.choice(shortlist.META) if op == "set" else None
        rows.append((i, T0 + timedelta(seconds=i), f"l{r.randrange(2)}", "r", r.randrange(12), op, field, f"v{i}" if field else None))
    r.shuffle(rows)
    return rows


def land(spark, rows, schema, path, files):
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(str(path))
    return jobs.file_stream(spark, str(path), spark.createDataFrame([], schema).schema)


def plain(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def files_read(df):
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


def test_shortlist_stays_small_and_right(spark, tmp_path):
    rows = event_rows()
    events = land(spark, rows, SHORT, tmp_path / "in", 11)
    out = str(tmp_path / "out")
    jobs.start_shortlist(events, out, str(tmp_path / "checkpoint"), every=3).awaitTermination()
    got = jobs.latest(spark, out, list(shortlist.KEY))
    assert plain(got) == plain(shortlist.fold(spark.createDataFrame(rows, SHORT)))
    # 11 batches: a generation up to batch 8, then the changes of two.
    assert files_read(got) == {"upto=8", "batch=9", "batch=10"}
    assert sorted(p.name for p in (tmp_path / "out/changes").iterdir()) == [f"batch={n}" for n in (10, 6, 7, 8, 9)]
    assert sorted(p.name for p in (tmp_path / "out/generations").iterdir()) == ["upto=5", "upto=8"]


@pytest.mark.parametrize("broken", ["_publish", "_remove"])
def test_a_crash_between_the_steps(spark, tmp_path, monkeypatch, broken):
    """Stopped after the generation is written and before its manifest, or after that and before the old files go."""
    rows = event_rows()
    events = land(spark, rows, SHORT, tmp_path / "in", 8)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    whole = getattr(generations, broken)

    def crash(*a):
        raise RuntimeError("stopped here")

    monkeypatch.setattr(generations, broken, crash)
    with pytest.raises(StreamingQueryException):
        jobs.start_shortlist(events, out, checkpoint, every=2).awaitTermination()
    jobs.latest(spark, out, list(shortlist.KEY)).collect()  # readable meanwhile
    monkeypatch.setattr(generations, broken, whole)
    jobs.start_shortlist(events, out, checkpoint, every=2).awaitTermination()
    got = jobs.latest(spark, out, list(shortlist.KEY))
    assert plain(got) == plain(shortlist.fold(spark.createDataFrame(rows, SHORT))) and files_read(got) == {"upto=7"}


PAYLOAD = "run_id string, product string, received_at timestamp, body string"


def payload_rows():
    text = lambda n: json.dumps({"content": [{"type": "tool_use", "name": "web_search"}, {"type": "text", "text": json.dumps([{"name": f"c{k}"} for k in range(n)])}]})
    return [(f"run{i}", "P", T0 + timedelta(minutes=i), "oops" if i % 5 == 0 else text(i % 4)) for i in range(24)]


@pytest.mark.parametrize("repeats_within", [None, "1 day"])
def test_a_file_landed_twice_counts_once(spark, tmp_path, repeats_within):
    ingest.allow_repeated_keys(spark)
    rows = payload_rows()
    land(spark, rows, PAYLOAD, tmp_path / "in", 3)
    payloads = land(spark, rows[:15] + rows[3:9], PAYLOAD, tmp_path / "in", 2)
    out = str(tmp_path / "out")
    jobs.start_counters(payloads, out, str(tmp_path / "checkpoint"), repeats_within=repeats_within).awaitTermination()
    want = counters.outcome_counts(ingest.ingest(spark.createDataFrame(rows, PAYLOAD)).outcomes)
    got = plain(jobs.latest(spark, out, ["outcome"]))
    assert got == plain(want) and sum(r["n_found"] for r in want.collect()) == sum(i % 4 for i in range(24) if i % 5)


def test_a_restart_neither_loses_nor_repeats(spark, tmp_path):
    ingest.allow_repeated_keys(spark)
    rows = payload_rows()
    payloads = land(spark, rows[:10], PAYLOAD, tmp_path / "in", 2)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    jobs.start_counters(payloads, out, checkpoint).awaitTermination()
    land(spark, rows[5:], PAYLOAD, tmp_path / "in", 2)
    jobs.start_counters(payloads, out, checkpoint).awaitTermination()
    assert plain(jobs.latest(spark, out, ["outcome"])) == plain(counters.outcome_counts(ingest.ingest(spark.createDataFrame(rows, PAYLOAD)).outcomes))


def test_nothing_written_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        jobs.latest(spark, str(tmp_path), ["k"])
