import json

import pytest
from pyspark.sql import functions as F

from docketry.plans import retrieval
from docketry.streaming import live


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"S{i:02d}", f"line about SAMPLE_{i % 4} and telemetry {i}\nsecond line {i}") for i in range(45)]
    spans = spark.createDataFrame(rows, "source_id string, content string").withColumns({
        "content_sha256": F.sha2("content", 256), "start_line": F.lit(1), "end_line": F.lit(2)})
    ids = spans.select("source_id", F.regexp_extract("content", "SAMPLE_[0-9]", 0).alias("identifier"), F.lit("macro").alias("kind"), F.lit("global").alias("scope"))
    return retrieval.SpanIndex(retrieval.build_forward(spans, F.col("content")), spans, retrieval.build_links(ids))


SECRET = "SAMPLE_1 must change, confidential wording"


def request(i, **changes):
    return {"query_id": f"r{i}", "artifact_type": "requirement", "title": None, "subsystem": None, "identifiers": [], "text": SECRET, **changes}


def test_live_reviews_fail_closed_and_hide_text(spark, corpus, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(json.dumps(r) for r in (request(1), request(2, text="  "), request(3, artifact_type="nope"))))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    live.live_reviews(spark, str(inbox), out, log, corpus, "review").awaitTermination()
    shown = spark.read.parquet(f"{out}/results")
    assert shown.count() == 10 and shown.filter("rank = 1").first().status == "VERIFIED_REVIEW"
    assert shown.filter("rank = 1").first().overall_status == "REVIEW_REQUIRED"
    rejected = {r.query_id: r.violations for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert rejected == {"r2": ["blank_text"], "r3": ["artifact_type"]}
    assert not shown.select(F.to_json(F.struct("*")).alias("row")).filter(F.col("row").contains("confidential")).count()
    # A second run only sees what is new.
    (inbox / "2.json").write_text(json.dumps(request(4)))
    live.live_reviews(spark, str(inbox), out, log, corpus, "review").awaitTermination()
    assert {r.query_id for r in spark.read.parquet(f"{out}/results").select("query_id").distinct().collect()} == {"r1", "r4"}


def test_failing_batch_is_recorded_and_resumed(spark, tmp_path):
    inbox = tmp_path / "cases"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"case_id": "a"}\n{"case_id": "b"}')
    paths = [str(tmp_path / n) for n in ("results", "failures", "log")]

    def source():
        return spark.readStream.schema("case_id string").json(str(inbox))

    def broken(batch):
        raise RuntimeError("boom")

    with pytest.raises(Exception, match="boom"):
        live.evaluate_stream(spark, source(), *paths, broken).awaitTermination()
    assert {(r.case_id, r.error_type) for r in spark.read.parquet(paths[1]).collect()} == {("a", "RuntimeError"), ("b", "RuntimeError")}
    live.evaluate_stream(spark, source(), *paths, lambda batch: batch.withColumn("ok", F.lit(True))).awaitTermination()
    done = spark.read.parquet(paths[0])
    assert done.count() == 2
    todo = spark.createDataFrame([("a",), ("c",)], "case_id string")
    assert [r.case_id for r in live.pending_cases(todo, done, ["case_id"]).collect()] == ["c"]


def test_only_the_failing_case_is_recorded(spark, tmp_path):
    spark.createDataFrame([(f"c{i}",) for i in range(9)], "case_id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("case_id string").parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / n) for n in ("results", "failures", "log")]

    def evaluate(batch):
        return batch.withColumn("ok", F.when(F.col("case_id") == "c4", F.raise_error(F.lit("bad case"))).otherwise(F.lit("yes")))

    with pytest.raises(Exception, match="bad case"):
        live.evaluate_stream(spark, source, *paths, evaluate).awaitTermination()
    failed = [tuple(r) for r in spark.read.parquet(paths[1]).select("case_id", "blocked_stage").collect()]
    assert failed == [("c4", "case_execution")]
    done = spark.read.option("recursiveFileLookup", True).parquet(paths[0])
    assert sorted(r.case_id for r in done.collect()) == [f"c{i}" for i in range(9) if i != 4]


def test_run_documents_have_one_layout_at_any_size(spark):
    cases = spark.range(95).select(F.lit("r").alias("run_id"), F.col("id").alias("case_id"), F.lit("s").alias("status"))
    runs = spark.createDataFrame([("r", "{}"), ("empty", "{}")], "run_id string, configuration string")
    rows = live.assemble_run(runs, cases).collect()
    assert sorted((r.run_id, r.body) for r in rows if r.part == "run") == [("empty", '{"configuration":"{}"}'), ("r", '{"configuration":"{}"}')]
    assert sorted(r.case_id for r in rows if r.part == "case") == list(range(95))
    assert {r.body for r in rows if r.part == "case"} == {'{"status":"s"}'}


def test_streams_read_tables_stored_as_folders(spark, tmp_path):
    import __spark_entry__ as entry

    events = spark.range(40).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.lit("click").alias("event_type"))
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    rows = entry.queries()["stream_event_counts"](spark, str(tmp_path)).collect()
    assert sorted((r.run_id, r.records) for r in rows) == [(0, 14), (1, 13), (2, 13)]
