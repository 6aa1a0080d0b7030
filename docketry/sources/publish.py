"""The pointer to the published run.

It is a row of numbered records that are created once: a publisher names the generation it has seen, and its own record is the
next one or nothing. Before that, the run is audited from its files.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions.fingerprints import table_fingerprint
from docketry.plans import run_audit
from docketry.sources import run_files
from docketry.sources.records import Taken, create, names

__all__ = ["Refused", "Taken", "create", "current_pointer", "generation", "move_pointer", "names", "publish_run", "read_pointers"]

#: What a run's store records: parts in progress, failures, completion.
RECORD = (
    "run_id STRING, status STRING, part STRING, batch_id BIGINT, cases BIGINT, failed_case_id STRING, blocked_stage STRING, "
    "error_type STRING, final_rows BIGINT, final_sha256 STRING, recorded_at STRING"
)


class Refused(RuntimeError):
    """A run that must not be published; ``violations`` says why."""

    def __init__(self, run_id: str, violations: list[str]):
        super().__init__(f"run {run_id} is not published: {', '.join(violations)}")
        self.violations = violations


# ---- pointer ----------------------------------------------------------------------


def generation(spark: SparkSession, pointer_path: str) -> int:
    """The last published generation; 0 before the first."""
    return max((int(m[1]) for n in names(spark, pointer_path) if (m := re.fullmatch(r"(\d{12})\.json", n))), default=0)


def move_pointer(spark: SparkSession, pointer_path: str, pointer: Mapping, seen: int) -> int:
    """Publish ``pointer`` as the generation after ``seen``; :class:`Taken` if another publisher was faster."""
    create(spark, f"{pointer_path}/{seen + 1:012d}.json", {**pointer, "generation": seen + 1})
    return seen + 1


def read_pointers(spark: SparkSession, pointer_path: str) -> DataFrame:
    """Every published pointer, one row per generation; a malformed one fails the job."""
    if not generation(spark, pointer_path):
        return spark.createDataFrame([], schemas.POINTERS)
    return spark.read.schema(schemas.POINTERS).option("mode", "FAILFAST").json(f"{pointer_path}/*.json")


def current_pointer(spark: SparkSession, pointer_path: str) -> DataFrame:
    """The pointer of the last generation, if there is one."""
    return read_pointers(spark, pointer_path).filter(F.col("generation") == generation(spark, pointer_path))


# ---- publishing -------------------------------------------------------------------


def stored_seal(spark: SparkSession, final_path: str) -> DataFrame:
    """(rows, fingerprint) of a final result: its lines, whatever their order."""
    return table_fingerprint(spark.read.text(final_path), ["value"])


def publish_run(
    spark: SparkSession, run_id: str, final_path: str, records: DataFrame, pointer_path: str, seen: int, expected_cases: Column,
    source_commit: str, experiment_manifest: str, published_at: str, manifests: DataFrame | None = None,
) -> int:
    """Audit a stored run and move the pointer to it; the new generation.

    ``records`` (RECORD) are those of the run's store. Refused are runs with a failure record, without a record of completion, whose final
    result is not the one that record seals, that belong to another commit, or with any finding of the audit.
    """
    own = [r for r in records.filter(F.col("run_id") == run_id).filter(F.col("status") != "in_progress").collect()]
    complete = [r for r in own if r.status == "complete"]
    violations = []
    if any(r.status == "failed" for r in own):
        violations.append("failed_run")
    if len(complete) != 1:
        violations.append("not_complete")
    seal = stored_seal(spark, final_path).first()
    if complete and (seal.fingerprint, seal.rows) != (complete[0].final_sha256, complete[0].final_rows):
        violations.append("seal")
    scanned = run_files.readable(run_files.scan_runs(spark, final_path, lines=True))
    named = [tuple(r) for r in scanned.select("run_id", "experiment_id", "provenance.source_commit").limit(2).collect()]
    if [n[0] for n in named] != [run_id]:
        violations.append("run_id")
    if any(n[2] != source_commit for n in named):
        violations.append("source_commit")
    found = run_audit.audit_runs(spark, final_path, expected_cases, lines=True, manifests=manifests)
    violations += [r.violation for r in found.select("violation").distinct().orderBy("violation").collect()]
    if violations:
        raise Refused(run_id, violations)
    pointer = {
        "run_id": run_id, "experiment_id": named[0][1], "object_name": final_path, "sha256": seal.fingerprint, "published_at": published_at,
        "source_commit": source_commit, "experiment_manifest": experiment_manifest,
    }
    return move_pointer(spark, pointer_path, pointer, seen)
