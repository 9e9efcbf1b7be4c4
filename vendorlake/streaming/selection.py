"""The live selection (Z1-Z6): each session's brief, kept current while its clicks arrive in any order.

A toggle counts from the last reset of its kind on, and a reset may arrive after toggles that are later than it, so a
session's state is its last resets, its last product and attributes, and the toggles since the resets, each by its place in
time. A reset drops what it outdates; a repeated event changes nothing. With retention a session that is silent that long
leaves the state, and its next event begins a new one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.search import SENTINELS
from ..sources.shipping import ship
from . import generations

BRIEF = "brief_id string, product string, tags array<struct<grp:string,tag:string>>, verticals array<string>, " + ", ".join(f"{a} string" for a in SENTINELS)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What each operation resets: all but the product, the verticals, the tags.
RESETS = {"clear_all": ("all", "verticals", "tags"), "clear_verticals": ("verticals",), "set_product": ("tags",)}


class Session:
    """One session's state; times are (microseconds, event id)."""

    def __init__(self, text: str | None = None):
        held = json.loads(text) if text else {}
        self.reset: dict[str, list] = held.get("reset", {})
        self.last: dict[str, list] = held.get("last", {})  # of the product and each attribute: time, value
        self.toggles: dict[str, list] = held.get("toggles", {"tags": [], "verticals": []})  # [time, grp, value]

    def text(self) -> str:
        return json.dumps({"reset": self.reset, "last": self.last, "toggles": self.toggles})

    def _since(self, kind: str, at: list) -> bool:
        return kind not in self.reset or at > self.reset[kind]

    def add(self, at: list, op: str, grp: str | None, value: str | None) -> None:
        for kind in RESETS.get(op, ()):
            if self._since(kind, at):
                self.reset[kind] = at
                if kind in self.toggles:
                    self.toggles[kind] = [t for t in self.toggles[kind] if t[0] > at]
        if op in ("set_product", "set_attr"):
            name = "product" if op == "set_product" else grp
            if name is not None and (name not in self.last or at > self.last[name][0]):
                self.last[name] = [at, value]
        elif op in ("toggle_tag", "toggle_vertical"):
            kind = "tags" if op == "toggle_tag" else "verticals"
            if self._since(kind, at) and [at, grp, value] not in self.toggles[kind]:
                self.toggles[kind].append([at, grp, value])

    def _on(self, kind: str) -> list[tuple]:
        """(grp, value) toggled an odd number of times: groups by their first toggle, values by their last."""
        first, each = {}, {}
        for at, grp, value in self.toggles[kind]:
            first[grp] = min(first.get(grp, at), at)
            n, last = each.get((grp, value), (0, at))
            each[grp, value] = (n + 1, max(last, at))
        return [k for _, _, k in sorted((first[k[0]], last, k) for k, (n, last) in each.items() if n % 2)]

    def brief(self, session_id: str) -> dict:
        chosen = {}
        for a, none in SENTINELS.items():
            at, value = self.last.get(a, (None, None))
            chosen[a] = value if at is not None and value is not None and self._since("all", at) else none
        tags, verticals = [{"grp": g, "tag": v} for g, v in self._on("tags")], [v for _, v in self._on("verticals")]
        return {"brief_id": session_id, "product": self.last.get("product", (None, None))[1], "tags": tags, "verticals": verticals, **chosen}


class Selections(StatefulProcessor):
    def __init__(self, retention_ms: int | None = None):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "text string", self.retention_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        session = Session(self.state.get()[0] if self.state.exists() else None)
        for part in rows:
            times = part["ts"].astype("datetime64[us]").astype("int64")
            text = lambda c, part=part: [None if pd.isna(x) else x for x in part[c]]
            for us, event_id, op, grp, value in zip(times, part["event_id"], text("op"), text("grp"), text("value"), strict=True):
                session.add([int(us), int(event_id)], op, grp, value)
        self.state.update((session.text(),))
        yield pd.DataFrame([session.brief(key[0])])

    def close(self) -> None:
        pass


def start_selection(events: DataFrame, out_dir: str, checkpoint_dir: str, trigger: dict | None = None, every: int = generations.EVERY, retention: int | None = None) -> StreamingQuery:
    """Selection events (event_id, ts, session_id, op, grp, value), none of them null but grp and value; read the briefs with
    latest(spark, out_dir, ["brief_id"]). retention: seconds after which a silent session leaves the state; None keeps all.

    A query with retention goes by the clock and so never has all there is: it is triggered over and over, or once.
    """
    spark = ship(events.sparkSession)
    events = events.where("session_id is not null and event_id is not null and ts is not null")
    ms = None if retention is None else retention * 1000
    briefs = events.groupBy("session_id").transformWithStateInPandas(Selections(ms), BRIEF, "update", "none" if ms is None else "processingTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        generations.write_changes(batch, batch_id, out_dir, ["brief_id"], every)

    trigger = trigger or ({"availableNow": True} if ms is None else {"processingTime": "10 seconds"})
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps what it starts with
    try:
        return briefs.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(**trigger).start()
    finally:
        spark.conf.set(PROVIDER, before)
