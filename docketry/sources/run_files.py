"""Stored runs as files, read so that nothing is lost silently.

A run is one JSON document, a file of its own or a line. Whatever cannot be read, has no name or no cases is a row with a
violation. The documents are parsed once into a nested table; every list in it is a section keyed by run and case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators.intake import reasons
from docketry.operators.metrics import CASE
from docketry.session import materialise

BROKEN = "_broken"
#: Layouts from this version on have typed claims and one result per docket row.
CURRENT_VERSION = 6
FIRST_SEALED_VERSION = 5


def scan_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Every document under ``path`` with its file and, where it could not be parsed, its text in ``_broken``."""
    read = (
        spark.read.schema(f"{schemas.RUN_FILE}, {BROKEN} STRING").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN).option("multiLine", not lines).json(path)
    )
    return materialise(read.select("*", F.col("_metadata.file_path").alias("file")), "run-files")


def _place(file: Column) -> Column:
    """A file's path in one spelling, whichever reader names it."""
    return F.regexp_replace(F.url_decode(file), "^([a-z0-9]+):/+", "$1:/")


def scan_violations(spark: SparkSession, path: str, scanned: DataFrame) -> DataFrame:
    """(file, run_id, violation): what keeps a document or a file from being a run."""
    whole = scanned.withColumn(
        "violation",
        F.when(F.col(BROKEN).isNotNull(), F.array(F.lit("unreadable"))).otherwise(reasons(
            no_run_id=F.coalesce(F.length("run_id") == 0, F.lit(True)),
            no_cases=F.coalesce(F.size("cases") < 1, F.lit(True)),
            case_without_id=F.coalesce(F.exists("cases", lambda c: F.coalesce(F.length(c["case_id"]) == 0, F.lit(True))), F.lit(False)),
        )),
    )
    found = whole.select("file", "run_id", F.explode("violation").alias("violation"))
    again = readable(scanned).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).filter("n > 1")
    # A scan leaves out files without content; the file index, which the driver holds anyway, does not.
    names = [(name,) for name in spark.read.format("binaryFile").load(path).inputFiles()]
    listed = spark.createDataFrame(names, "file string").withColumn("place", _place(F.col("file")))
    empty = listed.join(scanned.select(_place(F.col("file")).alias("place")).distinct(), "place", "left_anti")
    return (
        found.unionByName(again.select("file", "run_id", F.lit("duplicate_run_id").alias("violation")))
        .unionByName(empty.select("file", F.lit(None).cast("string").alias("run_id"), F.lit("empty_file").alias("violation")))
    )


def readable(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col(BROKEN).isNull() & F.coalesce(F.length("run_id") > 0, F.lit(False)))


def version(experiment_id: Column) -> Column:
    """Layout version named by an experiment; 0 if none is named."""
    return F.coalesce(F.regexp_extract(experiment_id, r"-v(\d+)", 1).try_cast("int"), F.lit(0))


@dataclass
class RunTables:
    """Sections of all runs; every table has run_id, those below the runs case_id as well."""

    runs: DataFrame
    cases: DataFrame
    dockets: DataFrame
    results: DataFrame
    claims: DataFrame
    verdicts: DataFrame
    traces: DataFrame
    items: DataFrame
    reviews: DataFrame
    proposals: DataFrame
    targets: DataFrame
    slots: DataFrame
    broad: DataFrame
    expanded: DataFrame
    stored_metrics: DataFrame


def tables(scanned: DataFrame) -> RunTables:
    """Sections of the readable runs. Each is a narrow pass over the columns it needs."""
    good = readable(scanned)
    case = good.select("run_id", version(F.col("experiment_id")).alias("version"), F.explode("cases").alias("c"))

    def section(column: str, *fields: str | Column, place: str | None = None) -> DataFrame:
        items = F.posexplode(f"c.{column}").alias(place or "_place", "item")
        rows = case.select("run_id", "version", F.col("c.case_id").alias("case_id"), F.col("c.case_type").alias("case_type"), items)
        return rows.select(*CASE, *([place] if place else []), *[F.col(f"item.{f}") if isinstance(f, str) else f for f in fields])

    item = F.col("item")
    runs = good.select(
        "run_id", "experiment_id", version(F.col("experiment_id")).alias("version"), "provider", "model", "embedding_model",
        F.get_json_object("configuration", "$.top_k").cast("int").alias("top_k"),
        *[F.get_json_object("configuration", f"$.{n}_index_fingerprint").alias(f"config_{n}_index_fingerprint") for n in ("embedding", "identifier")],
        *[F.col(f"provenance.{n}_index_fingerprint").alias(f"provenance_{n}_index_fingerprint") for n in ("embedding", "identifier")],
        F.col("provenance.source_commit").alias("source_commit"), F.col("provenance.experiment_manifest").alias("experiment_manifest"),
    )
    cases = case.select(
        "run_id", "version", "c.case_id", "c.case_type", F.col("c.run_id").alias("case_run_id"), "c.provider", "c.model", "c.embedding_model",
        "c.candidate_fingerprint", "c.embedding_index_fingerprint", "c.identifier_index_fingerprint", "c.retrieval.final_docket_fingerprint",
        "c.retrieval.final_k", "c.retrieval.broad_k", "c.retrieval.expanded_count", "c.retrieval_hit",
        F.col("c.candidates.source_id").alias("candidate_ids"), "c.baseline_candidate_source_ids", "c.proposed_candidate_source_ids",
    )
    held = section("candidate_results", "source_id", item["verified_claims"].alias("claims"))
    claims = held.select(*CASE, "source_id", F.posexplode("claims").alias("claim_no", "claim")).select(
        *CASE, "source_id", "claim_no", "claim.claim_id", F.col("claim.source_id").alias("claim_source_id"), "claim.impact_type",
        "claim.evidence_exact_text", "claim.evidence_start_line", "claim.evidence_end_line")
    drafts = section("candidate_decisions", "source_id", item["claims"].alias("claims"), place="decision_no")
    proposals = drafts.select(*CASE, "source_id", "decision_no", F.posexplode("claims").alias("no", "claim")).select(
        *CASE, "source_id", F.struct("decision_no", "no").alias("claim_no"), "claim.impact_type", F.col("claim.evidence_exact_text").alias("evidence"))
    traces = section("role_traces", "role", "error", item["parsed"]["verifications"].alias("verifications"))
    items = traces.filter("role = 'evidence_verifier'").select(*CASE, F.explode("verifications").alias("v")).select(*CASE, "v.source_id", "v.supported")
    figures = F.from_json("metrics", "map<string,map<string,double>>")
    groups = good.select("run_id", F.explode(figures).alias("group", "figures"))
    return RunTables(
        runs, cases,
        section("candidates", "source_id", "rank", "content", "start_line", "end_line", "content_sha256"),
        section("candidate_results", "source_id", "status", item["blocked_count"].alias("blocked_count")), claims,
        section("claim_verifications", "claim_id", "verdict"), traces.drop("verifications"), items,
        section("final_reviews", "source_id", "status", "evidence", "short_reason", "verifier_reason"), proposals,
        section("expected_review_targets", item.alias("source_id")),
        section("expected_claims", "claim_slot_id", "source_id", "impact_type", item["acceptable_exact_evidence_spans"].alias("spans"), place="slot_no"),
        section("broad_candidate_source_ids", item.alias("source_id")), section("expanded_candidate_source_ids", item.alias("source_id")),
        groups.select("run_id", "group", F.explode("figures").alias("name", "value")).select(
            "run_id", F.concat_ws("/", "group", "name").alias("metric"), "value"),
    )
