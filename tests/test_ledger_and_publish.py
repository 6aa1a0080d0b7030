"""Ledger of a run, records that are created once, and the published pointer."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.plans import run_audit
from docketry.sources import corpus, publish, run_files
from docketry.streaming.ledger import IncompleteRun, Ledger, evaluate_stream
from tests.test_run_files import run


def source(spark, folder):
    return spark.readStream.schema("case_id string").json(str(folder))


def put(folder, name, ids):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"case_id": i}) for i in ids))


def done(ledger):
    rows = ledger.results()
    return [] if rows is None else sorted(r.case_id for r in rows.collect())


def test_a_stop_between_write_and_record_runs_exactly_the_missing_cases(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "1", "abc")
    ledger = Ledger(spark, str(tmp_path / "run"), "r")
    seen = []

    def evaluate(batch):
        seen.append(sorted(r.case_id for r in batch.collect()))
        return batch.withColumn("ok", F.lit(True))

    evaluate_stream(source(spark, tmp_path / "in"), ledger, str(tmp_path / "log"), evaluate).awaitTermination()
    put(tmp_path / "in", "2", "def")

    class Stop(BaseException):
        """Ends the process's work at once; nothing after it is recorded."""

    def stop(*args, **fields):
        raise Stop

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "record", stop)
        with pytest.raises(Stop):
            ledger.run_batch(spark.createDataFrame([(i,) for i in "def"], "case_id string"), 1, evaluate)
    assert done(ledger) == ["a", "b", "c"] and len(list((tmp_path / "run" / "results").iterdir())) == 2
    # The restart has lost the stream's own progress as well: it sees all cases and runs the three without a record.
    again = Ledger(spark, str(tmp_path / "run"), "r")
    evaluate_stream(source(spark, tmp_path / "in"), again, str(tmp_path / "other-log"), evaluate).awaitTermination()
    assert done(again) == list("abcdef") and seen == [list("abc"), list("def"), list("def")]
    records = again.records().collect()
    assert sorted(r.cases for r in records) == [3, 3] and {r.status for r in records} == {"in_progress"}


def test_a_failing_case_is_recorded_beside_the_completed_ones(spark, tmp_path):
    put(tmp_path / "in", "1", [f"c{i}" for i in range(9)])
    ledger = Ledger(spark, str(tmp_path / "run"), "r")

    def evaluate(batch):
        return batch.withColumn("ok", F.when(F.col("case_id") == "c4", F.raise_error(F.lit("bad case"))).otherwise(F.lit("yes")))

    with pytest.raises(Exception, match="bad case"):
        evaluate_stream(source(spark, tmp_path / "in"), ledger, str(tmp_path / "log"), evaluate).awaitTermination()
    failed = [r for r in ledger.records().collect() if r.status == "failed"]
    assert [(r.failed_case_id, r.blocked_stage) for r in failed] == [("c4", "case_execution")]
    assert done(ledger) == [f"c{i}" for i in range(9) if i != 4]
    cases = spark.createDataFrame([(f"c{i}",) for i in range(9)], "case_id string")
    with pytest.raises(IncompleteRun, match="1 cases"):
        ledger.finish(cases, lambda rows: rows.select(F.lit("x").alias("value")))


def test_stages_of_a_failure(spark, tmp_path, monkeypatch):
    cases = spark.createDataFrame([("a",)], "case_id string")
    ledger = Ledger(spark, str(tmp_path / "run"), "r")
    with monkeypatch.context() as patch:
        patch.setattr(ledger, "commit", lambda *a: (_ for _ in ()).throw(PermissionError("denied")))
        with pytest.raises(PermissionError):
            ledger.run_batch(cases, 0, lambda batch: batch)
    ledger.run_batch(cases, 1, lambda batch: batch)
    with pytest.raises(Exception, match="no_such_column"):
        ledger.finish(cases, lambda rows: rows.select("no_such_column"))
    stages = [r.blocked_stage for r in ledger.records().collect() if r.status == "failed"]
    assert sorted(stages) == ["checkpoint_write", "evaluation_write"]
    assert not [r for r in ledger.records().collect() if r.status == "complete"]


def test_a_record_is_created_once(spark, tmp_path):
    path = str(tmp_path / "x" / "one.json")
    publish.create(spark, path, {"a": 1})
    with pytest.raises(publish.Taken):
        publish.create(spark, path, {"a": 2})
    assert (tmp_path / "x" / "one.json").read_text() == '{"a":1}' and publish.names(spark, str(tmp_path / "x")) == ["one.json"]


def finished(spark, folder, name="run-1", spoil=lambda document: None):
    """A finished run of two cases in a ledger."""
    document = run(name) | {"provenance": run()["provenance"] | {"source_commit": "abc"}}
    document["configuration"] = json.dumps(document["configuration"])
    scratch = folder.parent / f"{folder.name}-draft"
    scratch.mkdir(parents=True)
    (scratch / "r.json").write_text(json.dumps(document))
    tables = run_files.tables(run_files.scan_runs(spark, str(scratch)))
    document["metrics"] = run_audit.metrics_json(run_audit.recomputed_figures(tables)).first().metrics
    spoil(document)
    ledger = Ledger(spark, str(folder), name)
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    ledger.run_batch(cases, 0, lambda batch: batch)
    final = ledger.finish(cases, lambda rows: rows.limit(1).select(F.lit(json.dumps(document)).alias("value")))
    return ledger, final


def publish_it(spark, ledger, final, pointer, seen, commit="abc", run_id=None):
    return publish.publish_run(spark, run_id or ledger.run_id, final, ledger.records(), str(pointer), seen, F.lit(2), commit, "manifest.json", "2024-01-01T00:00:00")


def test_of_two_publishers_one_fails(spark, tmp_path):
    first, second = finished(spark, tmp_path / "one", "run-1"), finished(spark, tmp_path / "two", "run-2")
    pointer = tmp_path / "published"
    assert publish.current_pointer(spark, str(pointer)).count() == 0
    seen = publish.generation(spark, str(pointer))
    assert publish_it(spark, *second, pointer, seen) == 1
    with pytest.raises(publish.Taken):
        publish_it(spark, *first, pointer, seen)
    assert [r.run_id for r in publish.current_pointer(spark, str(pointer)).collect()] == ["run-2"]
    assert publish_it(spark, *first, pointer, publish.generation(spark, str(pointer))) == 2
    now = publish.current_pointer(spark, str(pointer)).first()
    assert (now.run_id, now.generation, now.source_commit) == ("run-1", 2, "abc")
    assert corpus.latest_pointer(publish.read_pointers(spark, str(pointer))).count() == 1
    # Both have seen generation 2.
    assert publish.move_pointer(spark, str(pointer), {"run_id": "a"}, 2) == 3
    with pytest.raises(publish.Taken):
        publish.move_pointer(spark, str(pointer), {"run_id": "b"}, 2)


def test_no_pointer_moves_after_a_failed_audit(spark, tmp_path):
    pointer = tmp_path / "published"

    def refused(ledger, final, **more):
        with pytest.raises(publish.Refused) as caught:
            publish_it(spark, ledger, final, pointer, 0, **more)
        assert publish.generation(spark, str(pointer)) == 0 and publish.read_pointers(spark, str(pointer)).count() == 0
        return caught.value.violations

    def wrong(document):
        metrics = json.loads(document["metrics"])
        metrics["overall"]["verified"] += 1
        document["metrics"] = json.dumps(metrics)

    assert refused(*finished(spark, tmp_path / "figures", spoil=wrong)) == ["metrics"]
    ledger, final = finished(spark, tmp_path / "fine")
    assert refused(ledger, final, commit="other") == ["source_commit"]
    assert refused(ledger, final, run_id="run-9") == ["not_complete", "run_id"]
    ledger.failure("case_execution", ValueError("late"), "a")
    assert refused(ledger, final) == ["failed_run"]
    changed, at = finished(spark, tmp_path / "changed")
    spark.read.text(at).select(F.concat("value", F.lit(" ")).alias("value")).write.text(str(tmp_path / "moved"))
    assert refused(changed, str(tmp_path / "moved")) == ["seal"]
