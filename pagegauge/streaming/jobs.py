"""Structured Streaming forms of jobs that also have a batch form.

Per-key state is small (a score and its sub-scores, a hash, a balance, a count). Scores and hashes of pages are kept by ``transformWithState``: rows that are later
than the watermark are dropped, and what a key holds is forgotten by an event-time timer once nothing came for ``keep``, so state follows the pages
that are still scanned. Rows of a key are taken in the order of time and number within a micro-batch (whose size the source bounds); earlier micro-batches come first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.constants import SUB_SCORES
from ..operators.alerts import AlertConfig, alert_list
from ..operators.logs import visits
from ..sources.stored import new_path

#: How much later than the newest row another may come, and how long a page that isn't seen again is kept in mind.
LATE, KEEP = "7 days", dt.timedelta(days=400)
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def visits_per_day(lines: DataFrame, as_of: Column, late: str = "1 day") -> DataFrame:
    """Visits per UTC day and bot of an arriving log; lines within the watermark still count, later ones are dropped."""
    seen = visits(lines, as_of).withWatermark("ts", late)
    return seen.groupBy(F.window("ts", "1 day"), "bot").agg(F.count("*").alias("visits")).select(F.to_date("window.start").alias("day"), "bot", "visits")


def _ordered(batches: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    rows = pd.concat(list(batches), ignore_index=True)
    return rows.sort_values(list(by), kind="stable")


def _stateful(rows: DataFrame, keys: list[str], fold, output: str, state: str) -> DataFrame:
    return rows.groupBy(*keys).applyInPandasWithState(fold, output, state, "append", GroupStateTimeout.NoTimeout)


class LastRow(StatefulProcessor):
    """Each row of a key beside what the row before it had in some columns; the last row is forgotten after ``keep``.

    ``made(row, before)`` gives the output rows; ``before`` is null for the first. State is one value and one timer a key.
    """

    def __init__(self, columns: tuple[str, ...], kinds: str, order: tuple[str, ...], made, keep: dt.timedelta):
        self.columns, self.kinds, self.order, self.made, self.keep = columns, kinds, order, made, int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", f"seen long, {self.kinds}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        before = None if held is None else tuple(held[1:])
        rows = list(rows)
        # a row finds a name by looking through all of them: places are looked up once
        order, columns, time = ([rows[0].__fields__.index(c) for c in names] for names in (self.order, self.columns, ("event_time",)))
        rows.sort(key=itemgetter(*order))
        for row in rows:
            yield from self.made(row, before)
            before = tuple(row[c] for c in columns)
        seen = int(max(row[time[0]] for row in rows).timestamp() * 1000)
        self.last.update((seen if held is None else max(seen, held[0]), *before))
        if held is None:
            self.handle.registerTimer(seen + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self.last.get()[0] + self.keep
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)  # seen again since
        else:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _beside_last(rows: DataFrame, keys: list[str], at: str, late: str, processor: LastRow, output: str) -> DataFrame:
    timed = rows.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(*keys).transformWithState(processor, StructType.fromDDL(output), "append", "EventTime")


def with_previous_scores(scans: DataFrame, columns: tuple[str, ...] = ("score", *SUB_SCORES), late: str = LATE, keep: dt.timedelta = KEEP) -> DataFrame:
    """Each arriving scan beside the last one of its project and url (``prev_<column>``, null for the first, and where a score is null)."""
    made_of = Row("id", "project_id", "url", "created_at", "scores", "previous")

    def made(row: Row, before: tuple | None) -> Iterator[Row]:
        yield made_of(*row[:5], None if before is None else before[0])

    # scores cross to Python and back as one text, and not as a cell for each
    scores = F.concat_ws(",", *(F.coalesce(F.col(c).cast("int").cast("string"), F.lit("")) for c in columns))
    rows = scans.select(F.col("id").cast("long").alias("id"), F.col("project_id").cast("long").alias("project_id"), "url", "created_at", scores.alias("scores"))
    output = "id long, project_id long, url string, created_at timestamp_ntz, scores string, previous string"
    paired = _beside_last(rows, ["project_id", "url"], "created_at", late, LastRow(("scores",), "scores string", ("created_at", "id"), made, keep), output)
    split = paired.select("id", "project_id", "url", "created_at", F.split("scores", ",").alias("now"), F.split("previous", ",").alias("was"))
    of = lambda array, prefix: [F.nullif(F.get(array, F.lit(k)), F.lit("")).cast("int").alias(f"{prefix}{c}") for k, c in enumerate(columns)]
    return split.select("id", "project_id", "url", "created_at", *of("now", ""), F.col("was").isNotNull().alias("has_previous"), *of("was", "prev_"))


def alert_stream(scans: DataFrame, config: AlertConfig = AlertConfig(), late: str = LATE, keep: dt.timedelta = KEEP) -> DataFrame:
    """Alerts as scans arrive. The state only pairs scans; the rules are those of the batch form."""
    columns = ("score", *SUB_SCORES)
    paired = with_previous_scores(scans, columns, late, keep).where("has_previous")
    alerts = alert_list({c: F.col(c) for c in columns}, {c: F.col(f"prev_{c}") for c in columns}, F.col("url"), config)
    return paired.select("id", "project_id", "url", "created_at", F.inline(alerts))


def changed_page_stream(pages: DataFrame, late: str = LATE, keep: dt.timedelta = KEEP) -> DataFrame:
    """Pages (project_id, url, content_hash, ts, seq) whose hash differs from the last one seen of their url, or is null."""
    kept = ("project_id", "url", "content_hash", "ts", "seq")
    made_of = Row(*kept)

    def made(row: Row, before: tuple | None) -> Iterator[Row]:
        if before is None or row[2] is None or row[2] != before[0]:
            yield made_of(*row[:5])

    processor = LastRow(("content_hash",), "content_hash string", ("ts", "seq"), made, keep)
    return _beside_last(pages.select(*kept), ["project_id", "url"], "ts", late, processor, "project_id long, url string, content_hash string, ts timestamp_ntz, seq long")


def credit_stream(events: DataFrame) -> DataFrame:
    """T4: the balance of each organization after each micro-batch of its events (org_id, ts, seq, kind, amount)."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        monthly, left = state.get if state.exists else (5, 5)
        rows = _ordered(batches, "ts", "seq")
        for kind, amount in zip(rows["kind"], rows["amount"], strict=True):
            if kind == "scan":
                left -= 1
            elif kind == "crawl":
                left -= int(amount)
            elif kind == "plan_change":
                monthly = int(amount)
            elif kind == "cancelled":
                monthly = left = 5
            elif kind == "invoice_paid":
                left = monthly
        state.update((monthly, left))
        yield pd.DataFrame({"org_id": [key[0]], "seq": [int(rows["seq"].iloc[-1])], "monthly": [monthly], "remaining": [left]})

    return _stateful(events, ["org_id"], fold, "org_id long, seq long, monthly long, remaining long", "monthly long, remaining long")


def breaker_stream(deliveries: DataFrame, limit: int = 10) -> DataFrame:
    """T5: the failure run of each webhook after each micro-batch (webhook_id, ts, seq, ok); ``limit`` in a row disable it for good."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, active = state.get if state.exists else (0, True)
        rows = _ordered(batches, "ts", "seq")
        for ok in rows["ok"]:
            run = 0 if ok else run + 1
            active = active and run < limit
        state.update((run, active))
        yield pd.DataFrame({"webhook_id": [key[0]], "seq": [int(rows["seq"].iloc[-1])], "failure_count": [run], "active": [active]})

    return _stateful(deliveries, ["webhook_id"], fold, "webhook_id long, seq long, failure_count long, active boolean", "failure_count long, active boolean")


def last_of_each(states: DataFrame, key: str) -> DataFrame:
    """The newest emitted state of each key."""
    return states.groupBy(key).agg(F.max_by(F.struct(*(c for c in states.columns if c != key)), "seq").alias("x")).select(key, "x.*")


@contextmanager
def rocks(spark: SparkSession):
    """A stream that is started inside keeps its state in RocksDB, as ``transformWithState`` asks; the session is left as it was."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    try:
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all that has arrived by now, into the folder that driver and executors share, and reads it back.

    With ``keys`` the stream runs in "update" mode: each micro-batch writes what it changed under its own number, and the last row of each key counts. A restart
    goes on from the stream's own checkpoint.
    """
    spark: SparkSession = stream.sparkSession
    path = new_path(spark, name)
    out = stream.writeStream.trigger(availableNow=True).outputMode("update" if keys else "append").option("checkpointLocation", f"{path}/state")
    if keys:
        out = out.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}"))
    else:
        out = out.format("parquet").option("path", f"{path}/rows")
    with rocks(spark):
        query = out.start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())]) if keys else stream.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if not keys:
        return rows
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
