"""Verdicts on run logs: the stream agrees with the finished log, whatever the batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import audit
from docketry.streaming import log_state

SCHEMA = "run_id string, event string, case_id string, at timestamp"


def log(run, cases, start=1, end=1):
    rows = [{"run_id": run, "event": "job_started", "at": f"2024-01-01T00:00:{i:02d}"} for i in range(start)]
    rows += [{"run_id": run, "event": "case_completed", "case_id": c, "at": f"2024-01-01T00:01:{i:02d}"} for i, c in enumerate(cases)]
    return rows + [{"run_id": run, "event": "evaluation_completed", "at": f"2024-01-01T00:02:{i:02d}"} for i in range(end)]


def late(run):
    return {"run_id": run, "event": "case_completed", "case_id": "c", "at": "2024-01-01T00:03:00"}


RUNS = {
    "fine": log("fine", "abc"), "open": log("open", "ab", end=0), "twice": log("twice", "abb"), "more": log("more", "abcd"), "two ends": log("two ends", "abc", end=2),
    "late": [*log("late", "ab"), late("late")], "no start": log("no start", "abc", start=0), "noise": [*log("noise", "abc"), {"run_id": "noise", "event": "other", "at": "2024-01-01T00:00:00"}],
}
WANT = {
    "fine": [], "open": ["incomplete", "no_end"], "twice": ["repeated"], "more": ["incomplete", "surplus"], "two ends": ["incomplete"], "late": ["disorder"],
    "no start": ["incomplete"], "noise": [], "silent": ["incomplete", "no_end"],
}


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_and_finished_log_agree(spark, tmp_path, batches):
    events = [e for rows in RUNS.values() for e in rows]
    random.Random(batches).shuffle(events)
    expected = spark.createDataFrame([(r, 3) for r in WANT], "run_id string, cases int")
    (tmp_path / "in").mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "log")
    for k in range(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(e) for e in events[k::batches]))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        log_state.watch_logs(stream, out, checkpoint).awaitTermination()
    got = log_state.verdicts(log_state.read_figures(spark, out), expected)
    finished = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    batch = log_state.verdicts(log_state.log_figures(finished), expected)
    assert sorted(got.collect()) == sorted(batch.collect())
    assert {r.run_id: sorted(r.violations) for r in got.collect()} == WANT
    bad = {r.run_id for r in audit.log_completeness(finished, expected).collect()}
    assert bad == {r.run_id for r in got.filter(F.array_contains("violations", "incomplete")).collect()}
