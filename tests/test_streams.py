"""Streams over tables stored as folders of part files."""

import datetime as dt
import os
import random
import uuid

import pytest

from cilens import plans
from cilens.streaming import incidents, timers
from cilens.views import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The data folder with its tables cut into several files each."""
    folder = str(tmp_path_factory.mktemp("parts"))
    for name in ("events", "customer"):
        Tables(spark, FOLDER).table(name).repartition(5).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("stream, table", [("t6_current_state_stream", "t6_current_state"), ("t8_quota_windows_stream", "t8_quota_windows"),
                                           ("t3_until_terminal_stream", "t3_until_terminal")])
def test_stream_equals_its_table_form(spark, parts, stream, table):
    want = plans.QUERIES[table](spark, parts)
    got = plans.QUERIES[stream](spark, parts).select(*want.columns)
    assert want.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ingest_reads_every_part(spark, parts):
    assert plans.QUERIES["t1_ingest_stream"](spark, parts).count() == Tables(spark, FOLDER).table("events").count()


def batches(spark, folder, schema, *parts):
    """A stream that takes each part as a batch of its own, in order, and its parts as files."""
    for i, rows in enumerate(parts):
        path = f"{folder}/{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drain(stream, mode, folder):
    """All rows given out, and the number of keys that still have state."""
    name = "rows_" + uuid.uuid4().hex
    job = (stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder))
           .trigger(availableNow=True).start())
    job.awaitTermination()
    return stream.sparkSession.table(name).collect(), sum(op["numRowsTotal"] for op in job.lastProgress["stateOperators"])


def plain_use(requests, seconds=60):
    """provider, second -> requests, tokens and those of the seconds less than ``seconds`` before it."""
    use = {}
    for provider, second, tokens in requests:
        one = use.setdefault((provider or "", second), [0, 0])
        one[0] += 1
        one[1] += min(tokens or 0, 240_000)
    out = {}
    for (provider, second), own in use.items():
        before = [v for (p, s), v in use.items() if p == provider and second - seconds < s < second]
        out[provider, second] = (*own, sum(v[0] for v in before), sum(v[1] for v in before))
    return out


def test_sliding_use_over_batches_with_late_rows(spark, tmp_path):
    draw = random.Random(3)
    first = [("a" if draw.random() < 0.7 else None, draw.randrange(0, 1500), draw.choice([None, 5, 300_000])) for _ in range(400)]
    again = [("a", draw.randrange(905, 1600), 7) for _ in range(200)]  # out of order, inside the delay
    far = [("a", 100_000, 1), ("a", 100_059, 2), ("a", 100_060, 3), ("a", None, 9)]
    gone = [("a", 1400, 1), ("a", 100_050, 4)]  # the first is behind the watermark by now
    last = [("b", 300_000, 1)]
    stream = batches(spark, tmp_path / "in", "provider string, t_sec bigint, tokens bigint", first, again, far, gone, last, last)
    rows, live = drain(timers.sliding_use(stream), "update", tmp_path / "progress")
    got = {}
    for r in rows:  # the last row of a second holds
        got[r["provider"], r["t_sec"]] = tuple(r)[2:]
    taken = [*first, *again, *[r for r in far if r[1] is not None], gone[1], *last, *last]
    assert got == plain_use(taken)
    assert live == 1, "only the newest slice has state"


def test_sliding_use_without_rows(spark, tmp_path):
    rows, live = drain(timers.sliding_use(batches(spark, tmp_path / "in", "provider string, t_sec bigint, tokens bigint", [])), "update", tmp_path / "progress")
    assert rows == [] and live == 0


def event(incident, number, minute, action="VERIFY_PATCH_SANDBOX"):
    return incident, number, None if minute is None else dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute), action, None


def test_ended_incidents_leave_no_state(spark, tmp_path):
    halt = "PIPELINE_HALTED"
    parts = [
        [event("a", 2, 5, halt), event("a", 1, 4), event("a", 3, 6), event("b", 4, 1), event(None, 5, 2, halt), event("b", 6, None, halt), event("c", 7, 3, halt), event("c", 8, 3, halt)],
        [event("a", 9, 30), event("b", 10, 31), event("b", 11, 32, halt), event("b", 12, 33)],  # a has ended, b ends
        [event("d", 13, 2000)],  # moves the watermark behind everything above
        [event("d", 14, 2001), event("b", 15, 40)],  # b is late
        [event("a", 16, 2002)],  # a was forgotten and opens anew
        [event("d", 17, 2003)],
    ]
    stream = batches(spark, tmp_path / "in", "incident_id string, event_id bigint, at timestamp, action string, output_summary string", *parts)
    rows, live = drain(timers.until_terminal(stream, incidents.is_terminal(), "2 hours", 3600), "append", tmp_path / "progress")
    assert sorted(((r["incident_id"] or "", r["event_id"], r["terminal"]) for r in rows)) == [
        ("", 5, False), ("a", 1, False), ("a", 2, True), ("a", 16, False), ("b", 4, False), ("b", 10, False), ("b", 11, True), ("c", 7, True),
        ("d", 13, False), ("d", 14, False), ("d", 17, False)]
    assert live == 0
