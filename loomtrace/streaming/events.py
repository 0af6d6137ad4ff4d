"""Structured Streaming over event tables: windows with watermarks, sessions, deduplication, the page-state machine.

Each function takes and returns a streaming (or batch) DataFrame; ``drain`` runs one to the end of its available input."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import labels as lb
from ..sources.files import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, schema: str = EVENTS, files: int | None = None) -> DataFrame:
    """A stream of Parquet files; event time is a plain timestamp, which watermarks need."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value_sum"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value_sum")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def once_per_key(events: DataFrame, *key: str, late: str = "40 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


_ASIN = re.compile(r"[A-Za-z0-9]{8,16}")


def shop_event(page: str, searched: bool, tool: str | None, keywords: str | None, value: str | None, kinds: dict[str, str]) -> str:
    """The event of one step on a page: what ``labels.classify_shop`` folds over a whole trajectory, a step at a time."""
    if tool == "search_action" and keywords is not None:
        return "query_refinement" if searched else "query_formulation"
    if tool != "click_action" or value is None:
        return "other_click"
    v, asin = value.lower().strip(" "), bool(_ASIN.fullmatch(value.strip(" ")))
    fixed = {"buy now": "purchase_decision", "back to search": "search_backtracking"}
    if v in fixed:
        return fixed[v]
    kind = min((k.lower() for c, k in kinds.items() if c.lower() == v), default="")
    here = {
        "results": "result_navigation" if v in ("next >", "< prev") else "candidate_selection" if not kinds or kind == lb.PRODUCT_LINK else "",
        "item_detail": "detail_backtracking" if v == "< prev" else "",
        "item": "attribute_inspection" if v in lb.DETAILS else "option_selection" if (kind == lb.OPTION if kinds else not asin) else "",
        "unknown": "candidate_selection" if asin else "",
    }
    return here.get(page, "") or "other_click"


#: Steps of one element of the list in which they wait; groups of trajectories whose states lie together.
WAITING_STEPS, GROUPS = 1000, 16_384


class PageMachine(StatefulProcessor):
    """Steps of trajectories in the order of event time, whatever the order of their arrival; the key is a group of trajectories.

    Steps wait in a list until the watermark has passed them; one timer stands for the earliest of them. Then all that
    the watermark has passed go through their trajectory's machine in order. The state of a trajectory that has been still for ``idle_ms`` is dropped.
    Every call to the state is a message to the JVM, so steps and machines travel as JSON, a group's together: the number of messages doesn't
    grow with that of trajectories beyond ``GROUPS``."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.machines = handle.getValueState("machines", "states string")
        self.waiting = handle.getListState("waiting", "steps string")

    @staticmethod
    def _elements(steps: list[str]) -> list[tuple[str]]:
        return [("[" + ",".join(steps[at : at + WAITING_STEPS]) + "]",) for at in range(0, len(steps), WAITING_STEPS)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, steps = None, []
        for r in rows:
            steps.append(r["step"])
            first = r["at"] if first is None else min(first, r["at"])
            if len(steps) == WAITING_STEPS:
                self.waiting.appendValue(self._elements(steps)[0])
                steps = []
        if steps:
            self.waiting.appendValue(self._elements(steps)[0])
        if first is not None:
            due, set_before = -(-first // 1000), list(self.handle.listTimers())
            for at in set_before:
                if at > due:
                    self.handle.deleteTimer(at)
            if not any(at <= due for at in set_before):
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        passed = watermark * 1000
        steps = [(s["at"], s["event_id"], s) for (some,) in self.waiting.get() for s in json.loads(some)]
        steps.sort(key=lambda s: s[:2])
        due, rest = [s for s in steps if s[0] <= passed], [s for s in steps if s[0] > passed]
        before = self.machines.get()
        states = json.loads(before[0]) if before else {}
        for at, event_id, s in due:
            page, searched, n, _ = states.get(s["trajectory_id"], ("search", False, 0, 0))
            event = shop_event(page, searched, s["tool"], s["keywords"], s["value"], s["clickable_types"] or {})
            yield Row(trajectory_id=s["trajectory_id"], step_index=n, event_id=event_id, shop_event=event)
            states[s["trajectory_id"]] = lb.NEXT_PAGE.get(event, page), searched or event.startswith("query_"), n + 1, at
        more = {s["trajectory_id"] for _, _, s in rest}
        states = {t: s for t, s in states.items() if t in more or s[3] // 1000 + self.idle_ms > watermark}
        if states:
            self.machines.update((json.dumps(states),))
        elif before:
            self.machines.clear()
        if due and rest:
            self.waiting.put(self._elements([json.dumps(s) for _, _, s in rest]))
        elif due:
            self.waiting.clear()
        wake = [s[3] // 1000 + self.idle_ms for t, s in states.items() if t not in more] + [-(-s[0] // 1000) for s in rest[:1]]
        if wake:
            self.handle.registerTimer(min(wake))

    def close(self) -> None:
        pass


def page_states(steps: DataFrame, *, late: str = "40 days", idle_days: int = 90) -> DataFrame:
    """(trajectory_id, step_index, event_id, shop_event) of a stream of steps (trajectory_id, ts, event_id, tool, keywords, value, and clickable_types if
    there are any). Steps later than ``late`` behind the latest are dropped; those of one time are in the order of event_id."""
    if "clickable_types" not in steps.columns:
        steps = steps.withColumn("clickable_types", F.lit(None).cast("map<string,string>"))
    at = F.unix_micros("ts").alias("at")
    step = F.to_json(F.struct("trajectory_id", at, "event_id", "tool", "keywords", "value", "clickable_types"), {"ignoreNullFields": "false"})
    rows = steps.withWatermark("ts", late).select(F.pmod(F.xxhash64("trajectory_id"), F.lit(GROUPS)).alias("part"), "ts", at, step.alias("step"))
    return rows.groupBy("part").transformWithState(PageMachine(idle_days * 86_400_000), "trajectory_id string, step_index long, event_id long, shop_event string", "append", "eventTime")


#: The state store that timers and lists need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drain(out: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is available and return its rows, from files in the shared folder: those of the last batch in ``complete`` mode,
    else of all batches. A batch that is repeated overwrites its own files."""
    spark = out.sparkSession
    path, numbers = scratch(spark, "drained"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        numbers.append(number)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    if not numbers:
        return spark.createDataFrame([], out.schema)
    wanted = [max(numbers)] if mode == "complete" else sorted(set(numbers))
    return spark.read.schema(out.schema).parquet(*[f"{path}/batch={n}" for n in wanted])
