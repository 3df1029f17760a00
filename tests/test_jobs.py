"""Jobs that are sent away and awaited."""

import os
from datetime import datetime, timedelta

import pytest

from foliospark.streaming import jobs
from foliospark.streaming.jobs import Job, Limits

BEGIN = datetime(2026, 3, 1)
SCHEMA = "doc string, at timestamp, tie long, kind string, value string"


def reply(doc, minute, kind, value=None):
    return (doc, BEGIN + timedelta(minutes=minute), minute, kind, value)


def plainly(rows, limits, until):
    """The same rules, one document after the other in one list."""
    out, state = [], {}
    for doc, at, _, kind, value in sorted(rows, key=lambda r: (r[1], r[2])):
        job = state.get(doc, Job())
        ms = int((at - BEGIN).total_seconds() * 1000)
        state[doc], command = jobs.answered(job, ms, kind, value, limits)
        out += [(doc, *command)] if command else []
    for doc, job in state.items():
        if job.waits and job.deadline <= until:
            out.append((doc, *jobs.expired(job)[1]))
    return sorted(out)


def write(spark, folder, name, rows):
    """One file, put into the folder under its own name."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}-{name}")
    (part,) = [f for f in os.listdir(f"{folder}-{name}") if f.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def run(spark, folder, limits):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = jobs.start(jobs.commands(stream, "doc", limits, late="10 minutes"), f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    return sorted((r.doc, int((r.at - BEGIN).total_seconds() * 1000), r.number, r.command, r.about) for r in rows)


FIRST = [reply("a", 0, "asked"), reply("a", 1, "uploaded", "u1"), reply("a", 2, "submitted", "where"), reply("b", 0, "asked"), reply("b", 1, "asked"), reply("c", 3, "uploaded", "never asked for")]
SECOND = [reply("a", 4, "uploaded", "u1 again"), reply("a", 5, "running"), reply("a", 6, "submitted", "elsewhere"), reply("b", 2, "uploaded", "u2")]
THIRD = [reply("a", 8, "done", "asset"), reply("a", 9, "done", "asset"), reply("a", 10, "fetched", "bytes"), reply("d", 11, "asked"), reply("d", 12, "failed", "kaputt"), reply("a", 13, "asked"), reply("e", 40, "asked"), (None, BEGIN, 0, "asked", None)]


@pytest.mark.parametrize("crash", [False, True])
def test_a_restart_in_the_middle(spark, tmp_path, crash):
    limits = Limits(wait_ms=20 * 60_000, polls=5)
    write(spark, f"{tmp_path}/in", "1", FIRST)
    assert [r[3] for r in run(spark, tmp_path, limits) if r[0] == "a"] == ["upload", "submit", "poll"]
    write(spark, f"{tmp_path}/in", "2", SECOND)
    run(spark, tmp_path, limits)
    if crash:  # the last batch was written, but whether it was is no longer known
        commits = f"{tmp_path}/state/commits"
        last = max((int(f) for f in os.listdir(commits) if f.isdigit()))
        for f in (f"{last}", f".{last}.crc"):
            if os.path.exists(f"{commits}/{f}"):
                os.remove(f"{commits}/{f}")
    write(spark, f"{tmp_path}/in", "3", THIRD)
    got = run(spark, tmp_path, limits)
    assert got == plainly([r for r in FIRST + SECOND + THIRD if r[0]], limits, 30 * 60_000)
    assert [(r[3], r[4]) for r in got if r[0] == "a"] == [("upload", None), ("submit", "u1"), ("poll", "where"), ("poll", "where"), ("fetch", "asset"), ("finished", "bytes")]
    assert [r[3:] for r in got if r[0] == "b"] == [("upload", None), ("submit", "u2"), ("failed", jobs.TOO_LATE)]
    assert [r[3] for r in got if r[0] == "d"] == ["upload", "failed"] and not [r for r in got if r[0] == "c"]
    assert len([r for r in got if r[3] == "submit"]) == 2
    assert run(spark, tmp_path, limits) == got  # nothing new, nothing twice


def test_polls_are_limited_and_late_answers_do_not_count():
    limits = Limits(wait_ms=100, polls=2)
    job, sent = Job(), []
    for at, kind in ((0, "asked"), (50, "uploaded"), (90, "submitted"), (120, "running"), (130, "running"), (140, "done")):
        job, command = jobs.answered(job, at, kind, "v", limits)
        sent.append(command and command[2:])
    assert sent == [("upload", "v"), ("submit", "v"), ("poll", "v"), ("poll", "v"), ("failed", jobs.TOO_OFTEN), None]
    job, _ = jobs.answered(Job(), 0, "asked", None, limits)
    assert jobs.answered(job, 100, "uploaded", "x", limits)[1][2] == "submit"
    job, command = jobs.answered(job, 101, "uploaded", "x", limits)
    assert command == (100, 2, "failed", jobs.TOO_LATE) and not job.waits


def test_replies_of_a_batch_are_put_in_order_without_a_frame_of_all():
    import pandas as pd

    from foliospark.streaming.jobs import in_order

    frames = [pd.DataFrame({"micros": [5, 1], "tie": [2, 7], "kind": ["a", "b"], "value": ["x", None]}), pd.DataFrame({"micros": [5, 5, 1], "tie": [1.0, float("nan"), 7.0], "kind": ["c", "d", "e"], "value": [None, "y", "z"]})]
    want = pd.concat(frames).sort_values(["micros", "tie"], kind="stable")
    assert [r[2] for r in in_order(iter(frames))] == list(want["kind"]) == ["b", "e", "c", "a", "d"] and in_order(iter([])) == []
