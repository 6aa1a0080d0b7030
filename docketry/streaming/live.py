"""Micro-batch processing: live reviews, resumable evaluation and event audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry import schemas
from docketry.functions.rows import explode_rows
from docketry.operators import intake, review
from docketry.plans.retrieval import SpanIndex, retrieve_all
from docketry.session import mark, materialise, release


def review_batch(incoming: DataFrame, corpus: SpanIndex, live_outcome: str = "no_review") -> tuple[DataFrame | None, DataFrame]:
    """(projected results, rejected requests) for one set of raw incoming artifacts; no results if all are rejected.

    ``corpus.spans`` carries content, start_line and end_line. No output holds the
    incoming text.
    """
    checked = intake.normalise_incoming(incoming)
    rejected = checked.filter(F.size("violations") > 0).select("query_id", "violations")
    queries = intake.process_queries(checked.filter(F.size("violations") == 0))
    if queries.isEmpty():
        return None, rejected
    ids = explode_rows(queries, "extracted_identifiers", "identifier", "query_id")
    found = retrieve_all(corpus, queries.select("query_id", "query_text"), ids)
    docket = found.docket
    spark = incoming.sparkSession
    none = spark.createDataFrame([], "query_id string, source_id string")
    evidence = spark.createDataFrame([], "query_id string, source_id string, expected_evidence string, expected_impact string")
    failures = spark.createDataFrame([], schemas.FAILURE_TABLE)
    decisions = review.rule_decisions(docket, none, evidence, live=True, live_outcome=live_outcome)
    claims = review.valid_claims(review.validate(docket, decisions, failures))
    verdicts = review.rule_verdicts(claims, rejected=live_outcome == "rejected")
    results, _, overall = review.resolve(docket, decisions, verdicts, failures)
    shown = review.live_projection(results).join(overall, "query_id").join(
        queries.select("query_id", "query_fingerprint"), "query_id"
    ).join(found.summary.select("query_id", "final_docket_fingerprint"), "query_id")
    return shown, rejected


def run_reviews(requests: DataFrame, outbox: str, checkpoint: str, corpus: SpanIndex,
                live_outcome: str = "no_review") -> StreamingQuery:
    """Review a stream of requests against static index tables.

    Each micro-batch is written under its own batch id, so a replayed batch replaces
    its earlier output instead of repeating it.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        first = mark()
        shown, rejected = review_batch(batch, corpus, live_outcome)
        if shown is not None:
            shown.write.mode("overwrite").parquet(f"{outbox}/results/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{outbox}/rejected/batch={batch_id}")
        release(batch.sparkSession, first)

    return (
        requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def live_reviews(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, corpus: SpanIndex,
                 live_outcome: str = "no_review") -> StreamingQuery:
    """Review every JSON request file that arrives in ``inbox``."""
    requests = spark.readStream.schema(schemas.INCOMING).json(inbox)
    return run_reviews(requests, outbox, checkpoint, corpus, live_outcome)


# ---- resumable evaluation ---------------------------------------------------------


def pending_cases(cases: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    return cases.join(completed.select(*keys).distinct(), keys, "left_anti")


# Halvings of a failing batch on the way to the case that fails.
ISOLATION_DEPTH = 24


def evaluate_stream(spark: SparkSession, source: DataFrame, results_path: str, failures_path: str, checkpoint: str,
                    evaluate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Evaluate cases batch by batch; a restart resumes after the last finished batch.

    If a batch fails, it is halved by a hash of the case id until only failing cases are left: the other
    cases are completed and stored, each failing case leaves a record (case_id, blocked_stage, error_type), and the query stops.
    ``blocked_stage`` tells whether the case could not be evaluated (``case_execution``) or its result not be stored
    (``checkpoint_write``).
    """
    def attempt(cases: DataFrame, target: str) -> tuple[str, Exception] | None:
        try:
            done = materialise(evaluate(cases), "evaluated")
        except Exception as error:
            return "case_execution", error
        try:
            done.write.mode("overwrite").parquet(target)
        except Exception as error:
            return "checkpoint_write", error
        return None

    def isolate(cases: DataFrame, target: str, bit: int, failed: list[DataFrame]) -> Exception | None:
        found = attempt(cases, f"{target}/part={bit}-all")
        if found is None:
            return None
        stage, error = found
        if bit == ISOLATION_DEPTH or cases.select("case_id").distinct().limit(2).count() < 2:
            failed.append(cases.select("case_id", F.lit(stage).alias("blocked_stage"), F.lit(type(error).__name__).alias("error_type")))
            return error
        half = F.shiftright(F.xxhash64("case_id"), bit).bitwiseAND(F.lit(1)) == 0
        errors = [isolate(cases.filter(part), f"{target}/half={bit}-{i}", bit + 1, failed) for i, part in enumerate((half, ~half))]
        return next((e for e in errors if e is not None), None)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        target = f"{results_path}/batch={batch_id}"
        found = attempt(batch, target)
        if found is None:
            return
        failed: list[DataFrame] = []
        error = isolate(batch, target, 0, failed)
        if error is not None:
            reduce(DataFrame.unionByName, failed).write.mode("overwrite").parquet(f"{failures_path}/batch={batch_id}")
            raise error

    return (
        source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# ---- event stream -----------------------------------------------------------------


def event_counts(events: DataFrame) -> DataFrame:
    """Records per run and event; works on a batch or a stream."""
    return events.groupBy("run_id", "event").agg(F.count(F.lit(1)).alias("records"))


def stream_event_counts(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep running counts under ``path``: every micro-batch adds the counts it changed."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        event_counts(events).writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_event_counts(spark: SparkSession, path: str) -> DataFrame:
    """Latest count per run and event; counts only grow, so the latest is the largest."""
    return spark.read.parquet(path).groupBy("run_id", "event").agg(F.max("records").alias("records"))


# ---- run assembly -----------------------------------------------------------------


def assemble_run(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Run documents of any size in one layout: a header row per run, then a row per case.

    ``runs`` is one row per run with configuration, metrics and provenance; ``cases`` has run_id, case_id and more.
    Rows are (run_id, case_id, part, body): ``part`` is ``run`` or ``case``, ``body`` the remaining fields as JSON with sorted
    keys, case_id is null in a header. Cases of unknown runs are left out, as a document has one header.
    """
    def body(df: DataFrame, *keys: str):
        return F.to_json(F.struct(*sorted(c for c in df.columns if c not in keys))).alias("body")

    kind = dict(cases.dtypes)["case_id"]
    header = runs.select("run_id", F.lit(None).cast(kind).alias("case_id"), F.lit("run").alias("part"), body(runs, "run_id"))
    known = cases.join(runs.select("run_id").distinct(), "run_id", "left_semi")
    rows = known.select("run_id", "case_id", F.lit("case").alias("part"), body(cases, "run_id", "case_id"))
    return header.unionByName(rows)
