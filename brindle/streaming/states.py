"""Streams with state and timers: vectors that come after the upload (X03, X04), sessions that fall silent (X06), files that are forgotten.

State lies in the state store of the stream's checkpoint, so a stream that is started again goes on where it was: what was pending is tried
again, what is ready is not made a second time. Both need the RocksDB state store (set_store()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A session is over after so long without a word of it.
SILENCE_SECONDS = 120
#: Texts that are embedded together, tries of one text, and the time between two of them.
TOGETHER, TRIES, RETRY_SECONDS = 64, 3, 30


def set_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Vectors(StatefulProcessor):
    """Per file: passages that have no vector yet, with the tries they had; and the keys of those that have one, for as long as files are kept."""

    def __init__(self, embed: Callable[[list[str]], list[list[float] | None]], tries: int, retry_seconds: float, keep_hours: float | None):
        self.embed, self.tries, self.retry_ms, self.keep_ms = embed, tries, int(retry_seconds * 1000), int(keep_hours * 3_600_000) if keep_hours else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "position long", "text string, tries int")
        self.ready = handle.getMapState("ready", "position long", "at long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = {}
        for row in rows:  # a passage that came before is not made again
            if not self.ready.containsKey((row.position,)) and not self.waiting.containsKey((row.position,)):
                fresh[row.position] = (row.text, 0)
        yield from self.tried(key, fresh, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        again = {position: tuple(value) for (position,), value in self.waiting.iterator()}
        yield from self.tried(key, again, timerValues.getCurrentProcessingTimeInMs())

    def tried(self, key, passages: dict[int, tuple[str, int]], now: int) -> Iterator[Row]:
        """Try passages, so many at once; one that fails waits for its next try, or has failed."""
        order, later = sorted(passages), False
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            try:
                found = self.embed([passages[p][0] for p in some])
            except Exception:  # the model is away: all of these failed this time
                found = [None] * len(some)
            for position, vector in zip(some, found, strict=True):
                text, tries = passages[position]
                if vector is not None:
                    self.ready.updateValue((position,), (now,))
                    self.waiting.removeKey((position,))
                    yield Row(name=key[0], position=position, status="ready", tries=tries + 1, vector=[float(x) for x in vector])
                elif tries + 1 < self.tries:
                    self.waiting.updateValue((position,), (text, tries + 1))
                    later = True
                    yield Row(name=key[0], position=position, status="pending", tries=tries + 1, vector=None)
                else:
                    self.waiting.removeKey((position,))
                    yield Row(name=key[0], position=position, status="failed", tries=tries + 1, vector=None)
        if later:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.retry_ms)

    def close(self) -> None:
        pass


def vectors(passages: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], tries: int = TRIES, retry_seconds: float = RETRY_SECONDS, keep_hours: float | None = None) -> DataFrame:
    """A stream of passages (name, position, text) to one of outcomes (name, position, status, tries, vector).

    embed takes texts and gives a vector or None for each. A passage is ready, or pending until its next try, or failed after `tries`
    ones; a passage that has failed is tried anew when it comes again. A file's passages meet in one group: files, not tables, bound it.
    """
    processor = Vectors(embed, tries, retry_seconds, keep_hours)
    own = passages.where("text is not null").select("name", F.col("position").cast("long").alias("position"), "text")
    return own.groupBy("name").transformWithState(processor, "name string, position long, status string, tries int, vector array<double>", "Append", "ProcessingTime")


def with_status(passages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """X03 as it is read: passages with what came of them last (ready before failed, failed before pending); those the stream hasn't met are pending.

    Words can be searched meanwhile: all passages are there, some without a vector.
    """
    rank = F.when(F.col("status") == "ready", 2).when(F.col("status") == "failed", 1).otherwise(0)
    last = outcomes.groupBy("name", "position").agg(F.max_by(F.struct("status", "vector"), F.struct(rank, "tries")).alias("last"))
    joined = passages.join(last, ["name", "position"], "left")
    return joined.select(*passages.columns, F.coalesce("last.status", F.lit("pending")).alias("status"), F.col("last.vector").alias("vector"))


class Silence(StatefulProcessor):
    """Per session: when it began, when it was heard last, and how many events it has; a timer ends it."""

    def __init__(self, seconds: float):
        self.wait_ms = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", "started long, heard long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, n = timerValues.getCurrentProcessingTimeInMs(), sum(1 for _ in rows)
        started, _, before = self.state.get() if self.state.exists() else (now, now, 0)
        self.state.update((started, now, before + n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.wait_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, heard, n = self.state.get()
        self.state.clear()
        yield Row(session=key[0], n=n, heard_ms=heard - started, silent_ms=timerValues.getCurrentProcessingTimeInMs() - heard)

    def close(self) -> None:
        pass


def ended_sessions(events: DataFrame, session_col: str, seconds: float = SILENCE_SECONDS) -> DataFrame:
    """A stream of events to one row (session, n, heard_ms, silent_ms) for each session that said nothing for so long."""
    own = events.select(F.col(session_col).cast("string").alias("session"))
    return own.groupBy("session").transformWithState(Silence(seconds), "session string, n long, heard_ms long, silent_ms long", "Append", "ProcessingTime")
