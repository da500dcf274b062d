"""Translation as a stream: what is known of each chunk's attempts is keyed state, and waits are timers.

Events come from a folder: a chunk to translate, a judged answer, or the clock's time. The state of a key holds the numbers of its
attempt, errors and answers with English prose, the feedback for the next request and the seconds it waited. A chunk is asked for at
once, an answer with a fault again at once with the fault as feedback, an error that may pass when its timer is due; so no task sleeps and
no request holds a place while it waits. Each micro-batch asks for what is due, judges the answers by the same rules as the rounds of
plans.translate, and puts them into the folder, from where the next one takes them.

A micro-batch that runs again after a failure writes the same folders again; an answer to another attempt than the state's is left
out, so answers that came twice count once. Time is event time. The clock is a function of the driver: in tests, one that leaps.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..constants import PREFERRED_TRANSLATIONS, PRESERVED_TERMS
from ..plans.translate import ACCEPTED, LEFT, MAX_ERRORS, MAX_UNTRANSLATED, STYLE, ask, outcomes, request
from ..storage import read_or_empty, stored

EVENTS = (
    "key string, at timestamp, kind string, attempt int, error string, http int, retryable boolean, bad boolean, english boolean, "
    "reason string, untranslated string, style_changed boolean, output string"
)
STEPS = "key string, kind string, attempt int, feedback string, due timestamp, status string, output string, warning string, waited long"
STATE = "attempt int, errors int, left_english int, feedback string, waited long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the processor gives: times as milliseconds, which no time zone changes.
_GIVEN = STEPS.replace("due timestamp", "due long")
_COLUMNS = [x.split()[0] for x in STEPS.split(", ")]


def pause(http: int | None, errors: int) -> int:
    """Seconds to wait after an error that may pass."""
    return min(30, 5 * errors) if http == 429 else min(10, 2 * errors)


@dataclass
class Attempts:
    """What is known of a chunk, as its state holds it."""

    attempt: int = 1
    errors: int = 0
    left_english: int = 0
    feedback: str = ""
    waited: int = 0

    def after(self, answer) -> tuple[str, dict]:
        """Takes an answer in. `done` with the result's columns; else `again`, with the seconds to wait before."""
        self.attempt += 1
        if answer.bad:
            self.errors += 1
            failed = answer.error is not None
            if self.errors >= MAX_ERRORS or failed and not answer.retryable:
                return "done", {"status": "failed", "warning": answer.error if failed else answer.reason}
            if not failed:
                self.feedback = answer.reason
                return "again", {"seconds": 0}
            return "again", {"seconds": pause(answer.http, self.errors) if answer.retryable else 0}
        if answer.english:
            self.left_english += 1
            self.feedback = LEFT + answer.untranslated
            if self.left_english < MAX_UNTRANSLATED:
                return "again", {"seconds": 0}
            return "done", {"status": "ok", "output": answer.output, "warning": ACCEPTED + answer.untranslated}
        return "done", {"status": "ok", "output": answer.output, "warning": STYLE if answer.style_changed else None}


class Retries(StatefulProcessor):
    """Rows of EVENTS by key, to rows of STEPS: requests that are due now, waits, and results."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("attempts", STATE)

    def _known(self) -> Attempts | None:
        held = self.state.get()
        return None if held is None else Attempts(*held)

    def _keep(self, known: Attempts) -> None:
        self.state.update((known.attempt, known.errors, known.left_english, known.feedback, known.waited))

    @staticmethod
    def _step(key, kind: str, known: Attempts, **more) -> Row:
        told = {"key": key[0], "kind": kind, "attempt": known.attempt, "feedback": known.feedback, "waited": known.waited} | more
        return Row(**{c: told.get(c) for c in _COLUMNS})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a call of the state crosses to the JVM and back, so a key's rows share one reading and one writing
        known = before = self._known()
        for row in rows:
            if row.kind == "item" and known is None:
                known = Attempts()
                yield self._step(key, "request", known)
            elif row.kind == "answer" and known is not None and row.attempt == known.attempt:
                known = replace(known)
                what, more = known.after(row)
                if what == "done":
                    # the attempt that ended it; a key that is done has no state, so nothing asks for it again
                    known.attempt -= 1
                    yield self._step(key, "done", known, **more)
                    known = None
                elif more["seconds"]:
                    due = row.ms + 1000 * more["seconds"]
                    known.waited += more["seconds"]
                    self.handle.registerTimer(due)
                    yield self._step(key, "wait", known, due=due)
                else:
                    yield self._step(key, "request", known)
        if known is None and before is not None:
            self.state.clear()
        elif known is not None and known is not before:
            self._keep(known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._known()
        if known is not None:
            yield self._step(key, "request", known)


class Clock:
    """The driver's time, and how it waits."""

    def now(self) -> datetime:
        return datetime.now(UTC)

    def until(self, due: datetime) -> None:
        time.sleep(max(0.0, (due - self.now()).total_seconds()))


class LeapingClock(Clock):
    """A clock that waits for nothing: it is then whatever time it is asked to wait for, and goes on a little each time it is looked at."""

    def __init__(self, start: datetime = datetime(2024, 1, 1, tzinfo=UTC)):
        self.time = start

    def now(self) -> datetime:
        self.time += timedelta(milliseconds=1)
        return self.time

    def until(self, due: datetime) -> None:
        self.time = max(self.time, due)


class TranslationStream:
    """Chunks through the stream. at: a folder of its own for events, steps, the chunks and the checkpoint; a run that was stopped goes on there."""

    def __init__(self, spark: SparkSession, at: str, translator=None, asked: Callable[[DataFrame], DataFrame] | None = None, clock: Clock | None = None, terms=PRESERVED_TERMS, pairs=PREFERRED_TRANSLATIONS):
        self.spark, self.at, self.clock = spark, at.rstrip("/"), clock or Clock()
        #: rows with key, attempt, request, chunk and route, to the same with output, error, http and retryable
        self.asked = asked or (lambda rows: ask(rows.withColumn("pause", F.lit(0)), translator, wait=False))
        self.terms, self.pairs = terms, pairs
        self.n_done, self.due, self.stamp = 0, set(), datetime.fromtimestamp(0, UTC)

    def add(self, items: DataFrame) -> None:
        """items: key (distinct), chunk, ctx_before, ctx_after, guide, route."""
        items.select("key", "chunk", "ctx_before", "ctx_after", "guide", "route").write.mode("append").parquet(f"{self.at}/items")
        self._put(items.select("key", F.lit("item").alias("kind"), F.lit(0).alias("attempt")), f"items-{self.clock.now().timestamp()}")

    def _stamp(self) -> datetime:
        """A later time at each call: events at the watermark's own time count as late."""
        self.stamp = max(self.clock.now(), self.stamp + timedelta(milliseconds=1))
        return self.stamp

    def _put(self, rows: DataFrame, name: str) -> None:
        told = rows.withColumn("at", F.lit(self._stamp()))
        columns = [F.col(c).cast(t) if c in told.columns else F.lit(None).cast(t) for c, t in (x.split() for x in EVENTS.split(", "))]
        told.select(*(c.alias(x.split()[0]) for c, x in zip(columns, EVENTS.split(", "), strict=True))).write.mode("overwrite").parquet(f"{self.at}/events/{name}")

    def _batch(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.at}/steps/batch={number}")
        steps = self.spark.read.schema(STEPS).parquet(f"{self.at}/steps/batch={number}")
        self._count(steps)
        due = steps.filter("kind = 'request'")
        if due.isEmpty():
            return
        items = self.spark.read.parquet(f"{self.at}/items").dropDuplicates(["key"])
        rows = due.select("key", "attempt", "feedback").join(items, "key").withColumn("request", request(self.terms, self.pairs))
        # answers are written down before they are judged
        answers = stored(self.asked(rows).select("key", "attempt", "chunk", "output", "error", "http", "retryable"), "answers")
        self._put(outcomes(answers, self.terms).withColumn("kind", F.lit("answer")), f"answers-{number}")

    def _count(self, steps: DataFrame) -> None:
        """Takes the results and the times at which timers are due of some steps in: one row, as answers of a batch share their time, and there are few lengths of waits."""
        told = steps.agg(F.count_if(F.col("kind") == "done").alias("done"), F.collect_set(F.col("due").cast("double")).alias("due")).first()
        self.n_done += told["done"]
        self.due |= set(told["due"])

    def steps(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.at}/steps", f"{STEPS}, batch long")

    def results(self) -> DataFrame:
        """key, output, status (ok, failed), warning, attempts, waited (seconds)."""
        done = self.steps().filter("kind = 'done'")
        return done.select("key", "output", "status", "warning", F.col("attempt").alias("attempts"), "waited")

    def start(self) -> StreamingQuery:
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
        events = self.spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{self.at}/events")
        # the time at which events end is theirs of all keys, so the clock's own events move it on
        stepped = (
            events.withWatermark("at", "0 seconds").withColumn("ms", F.unix_millis("at")).groupBy("key")
            .transformWithState(statefulProcessor=Retries(), outputStructType=_GIVEN, outputMode="append", timeMode="EventTime")
        ).withColumn("due", F.timestamp_millis("due"))
        started = stepped.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.at}/checkpoint").outputMode("append")
        # every micro-batch has a task with a store for each partition, however few keys it brings: as many as run at a time are enough
        key = "spark.sql.shuffle.partitions"
        partitions = self.spark.conf.get(key)
        self.spark.conf.set(key, min(int(partitions), self.spark.sparkContext.defaultParallelism))
        try:
            return started.start()
        finally:
            self.spark.conf.set(key, partitions)

    def run(self) -> DataFrame:
        """Goes on until every chunk that was added has its result, which it returns."""
        total = self.spark.read.parquet(f"{self.at}/items").select("key").distinct().count()
        self.n_done, self.due = 0, set()
        self._count(self.steps())
        query = self.start()
        try:
            while True:
                query.processAllAvailable()
                if self.n_done >= total:
                    return self.results()
                now = self.clock.now()
                self.due = {x for x in self.due if x > now.timestamp()}
                self.clock.until((datetime.fromtimestamp(min(self.due), UTC) if self.due else now) + timedelta(milliseconds=2))
                self._put(self.spark.createDataFrame([("", "tick")], "key string, kind string"), f"tick-{self.clock.now().timestamp()}")
        finally:
            while query.isActive and query.status["isTriggerActive"]:  # a batch without data may be at work still
                time.sleep(0.05)
            query.stop()
