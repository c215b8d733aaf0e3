"""Continuous monitoring: rules are evaluated again on each update, and an alert is raised once and cleared once.

``watch`` is the stream form: keyed state with event-time timers. Updates wait in the state until the watermark has passed
them and are folded in the order of their time, so late ones within the watermark count where they belong and repeated ones
count once. ``history`` is the batch form over the same updates; both give the same rows.

A rule is a range in which a key's running total should be. An alert carries its cause: the update that broke the rule, or
brought the total back. A key without an update for ``gap`` is stale from then on, until its next update.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROWS = "key long, rule string, action string, at timestamp, cause string"
#: The store that keyed state with timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class Range:
    """A rule: the total stays between the two, both included."""

    name: str
    low: int
    high: int

    def broken(self, total: int) -> bool:
        return not self.low <= total <= self.high


class Monitor(StatefulProcessor):
    """State of a key: updates that wait, and what the folded ones came to. Updates that come or go together are one call of the store."""

    def __init__(self, rules: list[Range], gap: int) -> None:
        self.rules, self.gap = rules, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, value long")
        # the total, the last update's time and id, whether the key is stale, and a bit for each rule that is broken
        self.folded = handle.getValueState("folded", "total long, at long, id long, stale boolean, broken long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [row for part in rows for row in zip(part["at"].tolist(), part["id"].tolist(), part["value"].tolist(), strict=True)]
        if came:
            self.waiting.appendList(came)
            self._timer(min(at for at, _, _ in came))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted({(at, i): v for at, i, v in self.waiting.get()}.items())  # of repeated ones the last
        total, last, last_id, stale, broken = self.folded.get() or (0, None, None, False, 0)
        kept = [(*w, v) for w, v in waiting if w[0] > until]
        out: list[tuple] = []
        for (at, i), v in waiting[: len(waiting) - len(kept)]:
            if last is not None and (stale or at > last + self.gap):
                out += [] if stale else [("stale", "raised", last + self.gap, f"none since {last_id}")]
                out.append(("stale", "cleared", at, f"update {i}"))
                stale = False
            total, last, last_id = total + v, at, i
            for k, rule in enumerate(self.rules):
                if rule.broken(total) != bool(broken >> k & 1):
                    broken ^= 1 << k
                    out.append((rule.name, "raised" if broken >> k & 1 else "cleared", at, f"update {i}: {total}"))
        if last is not None and not stale and last + self.gap <= until:
            out.append(("stale", "raised", last + self.gap, f"none since {last_id}"))
            stale = True
        if last is not None:
            self.folded.update((total, last, last_id, stale, broken))
        if len(kept) < len(waiting):
            self.waiting.put(kept) if kept else self.waiting.clear()
        later = [at for at, _, _ in kept[:1]] + ([last + self.gap] if last is not None and not stale else [])
        if later:
            self._timer(min(later))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "rule": [x[0] for x in out], "action": [x[1] for x in out], "at": pd.to_datetime([x[2] for x in out], unit="us"), "cause": [x[3] for x in out]})

    def _timer(self, at: int) -> None:
        """Timers are in whole milliseconds; one fires when the watermark has passed it."""
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


def _micros(ts: str) -> Any:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def watch(updates: DataFrame, rules: list[Range], gap: str, key: str = "user_id", ts: str = "ts", ident: str = "event_id", value: str = "value") -> DataFrame:
    """key, rule, action, at and cause of each alert, of a stream with a watermark on ``ts``; the session needs ``STORE``."""
    width = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    own = updates.select(F.col(key).cast("long").alias("key"), _micros(ts).alias("at"), F.col(ident).cast("long").alias("id"), F.col(value).cast("long").alias("value"), F.col(ts))
    return own.groupBy("key").transformWithStateInPandas(Monitor(rules, width), ROWS, "Append", "EventTime")


def history(updates: DataFrame, rules: list[Range], gap: str, until: DataFrame, key: str = "user_id", ts: str = "ts", ident: str = "event_id", value: str = "value") -> DataFrame:
    """The same rows of a finished set of updates, up to the one time ``until`` gives (a row, a column)."""
    width = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    end = F.broadcast(until.toDF("_until").select(_micros("_until").alias("_until")))  # one row
    own = updates.select(F.col(key).cast("long").alias("key"), _micros(ts).alias("at"), F.col(ident).cast("long").alias("id"), F.col(value).cast("long").alias("value"))
    own = own.dropDuplicates(["key", "at", "id"]).crossJoin(end).filter("at <= _until")
    order = Window.partitionBy("key").orderBy("at", "id")
    folded = own.withColumns({"total": F.sum("value").over(order), "next": F.lead("at").over(order), "next_id": F.lead("id").over(order)})
    states = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), (~F.col("total").between(r.low, r.high)).alias("broken")) for r in rules])).alias("s")
    each = folded.select("key", "at", "id", "total", states).select("key", "at", "id", "total", "s.*")
    before = F.coalesce(F.lag("broken").over(Window.partitionBy("key", "rule").orderBy("at", "id")), F.lit(False))
    turned = each.withColumn("before", before).filter("broken <> before")
    turns = turned.select("key", "rule", F.when(F.col("broken"), "raised").otherwise("cleared").alias("action"), F.timestamp_micros("at").alias("at"), F.concat(F.lit("update "), F.col("id"), F.lit(": "), F.col("total")).alias("cause"))
    silent = folded.filter(F.coalesce(F.col("next") > F.col("at") + width, F.col("at") + width <= F.col("_until")))
    since = silent.select("key", F.lit("stale").alias("rule"), F.lit("raised").alias("action"), F.timestamp_micros(F.col("at") + width).alias("at"), F.concat(F.lit("none since "), F.col("id")).alias("cause"))
    again = silent.filter("next is not null").select("key", F.lit("stale").alias("rule"), F.lit("cleared").alias("action"), F.timestamp_micros("next").alias("at"), F.concat(F.lit("update "), F.col("next_id")).alias("cause"))
    return turns.unionByName(since).unionByName(again)
