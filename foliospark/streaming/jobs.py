"""Jobs that are sent away and awaited: a file is uploaded, a job for it submitted and polled, its result fetched.

Each document has a state of its own, kept by the stream: in which phase its job is, how often it was polled, until when an
answer must be there. Replies move it on and give the next command; a timer ends it where none comes. A reply that doesn't
fit the phase, as one that comes twice, changes nothing, so no job is submitted twice, and a restarted stream goes on where
its checkpoint is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Reply that each phase waits for, the command it leads to, and the phase after it.
STEPS = {
    ("new", "asked"): ("upload", "uploading"),
    ("uploading", "uploaded"): ("submit", "submitting"),
    ("submitting", "submitted"): ("poll", "polling"),
    ("polling", "running"): ("poll", "polling"),
    ("polling", "done"): ("fetch", "fetching"),
    ("fetching", "fetched"): ("finished", "ended"),
}
TOO_LATE, TOO_OFTEN = "no answer in time", "polled too often"


@dataclass(frozen=True)
class Job:
    phase: str = "new"
    #: Where to ask, as the submission was answered.
    address: str | None = None
    polls: int = 0
    #: Milliseconds since 1970 until which the phase waits.
    deadline: int = 0
    #: Commands so far.
    sent: int = 0

    @property
    def waits(self) -> bool:
        return self.phase not in ("new", "ended")


@dataclass(frozen=True)
class Limits:
    wait_ms: int = 180_000
    polls: int = 100


#: When, the command's number, the command, what it is about.
Command = tuple[int, int, str, str | None]


def expired(job: Job) -> tuple[Job, Command]:
    return replace(job, phase="ended", sent=job.sent + 1), (job.deadline, job.sent + 1, "failed", TOO_LATE)


def answered(job: Job, at: int, kind: str, value: str | None, limits: Limits) -> tuple[Job, Command | None]:
    """The job after a reply, and the command that it leads to. A reply after the deadline finds the job failed at that time."""
    if job.waits and at > job.deadline:
        return expired(job)
    number = job.sent + 1
    if job.waits and kind == "failed":
        return replace(job, phase="ended", sent=number), (at, number, "failed", value)
    if (job.phase, kind) not in STEPS:
        return job, None
    command, phase = STEPS[job.phase, kind]
    address = value if kind == "submitted" else job.address
    polls = job.polls + (command == "poll")
    if polls > limits.polls:
        return replace(job, phase="ended", sent=number), (at, number, "failed", TOO_OFTEN)
    about = address if command == "poll" else value
    return replace(job, phase=phase, address=address, polls=polls, deadline=at + limits.wait_ms, sent=number), (at, number, command, about)


def in_order(rows: Iterator[pd.DataFrame]) -> list[tuple]:
    """micros, tie, kind, value of a document's replies in a batch in the order of their times, at one time without a tie last.

    They are few, so lists sort them in a fraction of the time that it takes to put frames together.
    """
    replies = [r for frame in rows for r in zip(*(frame[c].tolist() for c in ("micros", "tie", "kind", "value")))]
    return sorted(replies, key=lambda r: (r[0], True, 0) if r[1] is None or r[1] != r[1] else (r[0], False, r[1]))


class Jobs(StatefulProcessor):
    """answered() and expired() on the state of a document, with one timer at its deadline."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "phase string, address string, polls int, deadline bigint, sent bigint")

    def _load(self) -> Job:
        return Job(*(self.state.get() or ()))

    def _keep(self, before: Job, job: Job) -> None:
        if job == before:
            return
        if before.waits:
            self.handle.deleteTimer(before.deadline)
        if job.waits:
            self.handle.registerTimer(job.deadline)
        self.state.update(astuple(job))

    def _rows(self, key, commands: list[Command]) -> Iterator[pd.DataFrame]:
        if commands:
            yield pd.DataFrame(dict(enumerate(zip(*[(*key, *c) for c in commands]))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the API
        before = job = self._load()
        commands = []
        for micros, _, kind, value in in_order(rows):
            job, command = answered(job, micros // 1000, kind, value if isinstance(value, str) else None, self.limits)
            commands += [command] if command else []
        self._keep(before, job)
        yield from self._rows(key, commands)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._load()
        if before.waits and before.deadline <= expiredTimerInfo.getExpiryTimeInMs():
            job, command = expired(before)
            self.state.update(astuple(job))
            yield from self._rows(key, [command])

    def close(self) -> None:
        pass


def commands(replies: DataFrame, key: str, limits: Limits = Limits(), late: str = "0 seconds") -> DataFrame:
    """The stream of commands that a stream of replies leads to: key, at, number, command, about.

    replies: key, at (timestamp), tie (long, orders replies of one time), kind, value. A document's kinds are asked, then
    what its commands upload, submit, poll and fetch are answered with: uploaded, submitted, running or done, fetched; or
    failed. Commands are numbered by document, so that whoever sends them can tell a repeated one; the last is finished or
    failed, and a document that has ended stays so. Null keys, times and kinds are passed over. late: how far behind the
    newest reply others may come, before timers that they would have stopped have run off.
    """
    given = replies.select(key, F.col("at").cast("timestamp").alias("at"), "tie", "kind", "value").where(F.col(key).isNotNull() & F.col("at").isNotNull() & F.col("kind").isNotNull())
    schema = f"`{key}` {given.schema[key].dataType.simpleString()}, millis bigint, number bigint, command string, about string"
    # times cross to Python as numbers, which no time zone changes
    timed = given.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    found = timed.groupBy(key).transformWithStateInPandas(Jobs(limits), schema, "Append", "EventTime")
    return found.select(key, F.timestamp_millis("millis").alias("at"), "number", "command", "about")


def start(found: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Appends commands to a Parquet table, each once, until what is there is used up; goes on where checkpoint says."""
    conf, name = found.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS_DB)  # state with timers needs it; a query keeps what it is started with
    try:
        return found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)
