"""Evaluation runs with a ledger: exactly the cases without a committed result run again.

A batch's results are written to a folder of their own and count only once a record names that folder; the record is the last
thing a batch writes. Whatever a stopped run has left without a record is never read, and a restart evaluates the
cases that no record covers, even if the stream's own progress was lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.session import materialise
from docketry.sources import publish
from docketry.streaming.live import ISOLATION_DEPTH, pending_cases


class IncompleteRun(RuntimeError):
    """A run that cannot be finished because cases have no committed result."""


class Ledger:
    """Records and results of one run under ``path``."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path, run_id

    def record(self, status: str, **fields) -> None:
        """One record, created once; its name holds the part or a name of its own."""
        name = fields.get("part") or uuid.uuid4().hex
        at = datetime.now(UTC).isoformat()
        publish.create(self.spark, f"{self.path}/records/{name}.json", {"run_id": self.run_id, "status": status, "recorded_at": at, **fields})

    def records(self) -> DataFrame:
        if not publish.names(self.spark, f"{self.path}/records"):
            return self.spark.createDataFrame([], publish.RECORD)
        return self.spark.read.schema(publish.RECORD).option("mode", "FAILFAST").json(f"{self.path}/records/*.json")

    def results(self) -> DataFrame | None:
        """Rows of all committed parts; None before the first."""
        parts = [r.part for r in self.records().filter("status = 'in_progress'").select("part").collect()]
        return self.spark.read.parquet(*[f"{self.path}/results/{p}" for p in parts]) if parts else None

    def completed(self, cases: DataFrame) -> DataFrame:
        """(case_id) of the committed results; ``cases`` gives the type before there are any."""
        done = self.results()
        return cases.select("case_id").limit(0) if done is None else done.select("case_id").distinct()

    def failure(self, stage: str, error: Exception, case_id=None) -> None:
        """The completed cases are those of the records so far; the failed one stands here."""
        self.record("failed", blocked_stage=stage, error_type=type(error).__name__, failed_case_id=None if case_id is None else str(case_id))

    def commit(self, results: DataFrame, batch_id: int) -> None:
        part = uuid.uuid4().hex
        results.write.parquet(f"{self.path}/results/{part}")
        cases = self.spark.read.parquet(f"{self.path}/results/{part}").select("case_id").distinct().count()
        self.record("in_progress", part=part, batch_id=batch_id, cases=cases)

    def run_batch(self, batch: DataFrame, batch_id: int, evaluate: Callable[[DataFrame], DataFrame]) -> None:
        """Evaluate what is pending of ``batch``; failing cases are isolated and recorded, the others committed."""
        todo = materialise(pending_cases(batch, self.completed(batch), ["case_id"]), "pending")
        if todo.isEmpty():
            return
        errors = self._attempt(todo, batch_id, evaluate, 0)
        if errors:
            raise errors[0]

    def _attempt(self, cases: DataFrame, batch_id: int, evaluate: Callable[[DataFrame], DataFrame], bit: int) -> list[Exception]:
        stage = "case_execution"
        try:
            done = materialise(evaluate(cases), "evaluated")
            stage = "checkpoint_write"
            self.commit(done, batch_id)
            return []
        except Exception as error:
            one = cases.select("case_id").distinct().limit(2).collect()
            if bit == ISOLATION_DEPTH or len(one) < 2:
                self.failure(stage, error, one[0].case_id if one else None)
                return [error]
        half = F.shiftright(F.xxhash64("case_id"), bit).bitwiseAND(F.lit(1)) == 0
        parts = (cases.filter(half), cases.filter(~half))
        return [e for part in parts if not part.isEmpty() for e in self._attempt(part, batch_id, evaluate, bit + 1)]

    def finish(self, cases: DataFrame, assemble: Callable[[DataFrame], DataFrame]) -> str:
        """Write the final result, once every case has a committed one, and seal it with the record of completion.

        ``assemble`` makes the lines (value) of the run document from the committed results. The path of the result is returned.
        """
        missing = pending_cases(cases.select("case_id"), self.completed(cases), ["case_id"])
        if not missing.isEmpty():
            raise IncompleteRun(f"{missing.count()} cases of run {self.run_id} have no result")
        target = f"{self.path}/final"
        try:
            assemble(self.results()).write.mode("errorifexists").text(target)
            seal = publish.stored_seal(self.spark, target).first()
        except Exception as error:
            self.failure("evaluation_write", error)
            raise
        self.record("complete", part="complete", final_rows=seal.rows, final_sha256=seal.fingerprint, cases=cases.select("case_id").distinct().count())
        return target


def evaluate_stream(source: DataFrame, ledger: Ledger, checkpoint: str, evaluate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Evaluate a stream of cases; a restart runs those without a record, wherever the last one stopped."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        ledger.run_batch(batch, batch_id, evaluate)

    return (
        source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
