"""The live selection against the batch fold, under events in any order, repeats and restarts."""

import random
import time
from datetime import timedelta

import pytest
from test_shortlist import SELECT, T0

from vendorlake.operators import shortlist
from vendorlake.streaming import jobs
from vendorlake.streaming.selection import start_selection


def rows(n=300):
    r = random.Random(11)
    out = []
    for i in range(n):
        op = r.choice(["toggle_tag"] * 4 + ["toggle_vertical"] * 4 + ["set_attr", "set_product", "clear_all", "clear_verticals"])
        grp = r.choice("gh") if op == "toggle_tag" else r.choice(["ownership", "size"]) if op == "set_attr" else None
        value = None if op.startswith("clear") else f"v{r.randrange(4)}"
        # Several events share a time; their ids tell them apart.
        out.append((i, T0 + timedelta(seconds=i // 3), f"s{r.randrange(6)}", op, grp, value))
    return out


def plain(df):
    return sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))


def land(spark, events, path, files):
    for k in range(files):
        spark.createDataFrame(events[k::files], SELECT).coalesce(1).write.mode("append").parquet(str(path))
    return jobs.file_stream(spark, str(path), spark.createDataFrame([], SELECT).schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_fold(spark, tmp_path, seed):
    events = rows()
    want = plain(shortlist.selection(spark.createDataFrame(events, SELECT)))
    random.Random(seed).shuffle(events)
    source = land(spark, events[:200], tmp_path / "in", 3)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    start_selection(source, out, checkpoint, every=2).awaitTermination()
    # The rest after a restart, with some of the events once more.
    land(spark, events[180:], tmp_path / "in", 2)
    start_selection(source, out, checkpoint, every=2).awaitTermination()
    assert plain(jobs.latest(spark, out, ["brief_id"])) == want


def test_a_silent_session_leaves_the_state(spark, tmp_path):
    one = [(1, T0, "s", "toggle_vertical", None, "V"), (2, T0, "s", "set_product", None, "P")]
    source = land(spark, one, tmp_path / "in", 1)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    start_selection(source, out, checkpoint, {"once": True}, retention=1).awaitTermination(120)
    assert jobs.latest(spark, out, ["brief_id"]).first()["verticals"] == ["V"]
    time.sleep(2)
    land(spark, [(3, T0, "s", "toggle_vertical", None, "W")], tmp_path / "in", 1)
    start_selection(source, out, checkpoint, {"once": True}, retention=1).awaitTermination(120)
    again = jobs.latest(spark, out, ["brief_id"]).first()
    assert again["verticals"] == ["W"] and again["product"] is None
