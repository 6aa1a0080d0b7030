"""Audit of any number of stored runs from their files.

One plan reads the nested documents once, recomputes every figure from the cases and checks identity, seals, cardinality, exposure
and provenance of all runs together. An empty result means that every run may be shown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import audit, metrics
from docketry.operators.audit import differs
from docketry.operators.metrics import CASE, SPAN
from docketry.session import materialise
from docketry.sources import run_files
from docketry.sources.run_files import RunTables

FINDING = "run_id string, case_id string, source_id string, violation string, detail string"


def recomputed_figures(tables: RunTables) -> DataFrame:
    """Every figure of every run, by group, from the cases alone."""
    verified = tables.claims.select(*SPAN, "claim_no", "impact_type", F.col("evidence_exact_text").alias("evidence"))
    matched = metrics.match_slots(verified, tables.slots)
    rows = metrics.per_case(
        tables.cases, metrics.target_hits(tables.targets, tables.broad, tables.expanded, tables.dockets),
        tables.slots.groupBy(*CASE).agg(F.count(F.lit(1)).alias("eligible_claims")),
        metrics.slot_recall(metrics.match_slots(tables.proposals, tables.slots), "proposed_slots"),
        metrics.slot_recall(matched, "verified_slots"),
        metrics.claim_totals(tables.results, tables.proposals, verified, tables.verdicts),
        metrics.docket_sizes(tables.results, tables.expanded), metrics.extra_claims(matched),
    )
    return metrics.evaluate(rows, *metrics.all_figures())


def long_figures(figures: DataFrame) -> DataFrame:
    """(run_id, metric, value): one row per group and figure."""
    names = [c for c in figures.columns if c not in ("run_id", "group")]
    doubles = figures.select("run_id", "group", *[F.col(c).cast("double").alias(c) for c in names])
    long = doubles.unpivot(["run_id", "group"], names, "name", "value")
    return long.select("run_id", F.concat_ws("/", "group", "name").alias("metric"), "value")


def metrics_json(figures: DataFrame) -> DataFrame:
    """(run_id, metrics): the figures as the JSON text a run file carries."""
    names = [c for c in figures.columns if c not in ("run_id", "group")]
    group = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    entry = F.struct("group", group.alias("figures"))
    return figures.groupBy("run_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("metrics"))


def _metric_findings(tables: RunTables, recomputed: DataFrame) -> DataFrame:
    """Figures that differ, and figures only one side has."""
    stored = tables.stored_metrics.select("run_id", "metric", F.col("value").alias("stored"), F.lit(True).alias("s"))
    found = recomputed.select("run_id", "metric", F.col("value").alias("recomputed"), F.lit(True).alias("r"))
    joined = stored.join(found, ["run_id", "metric"], "full")
    wrong = F.col("s").isNull() | F.col("r").isNull() | differs(F.col("stored"), F.col("recomputed"))
    return joined.filter(wrong).select("run_id", F.lit("metrics").alias("violation"), F.col("metric").alias("detail"))


def findings(tables: RunTables, expected_cases: Column, manifests: DataFrame | None = None, provenance: DataFrame | None = None) -> DataFrame:
    """All violations of the runs in ``tables``: run_id, case_id, source_id, violation, detail.

    ``expected_cases`` is computed from the columns of ``tables.runs``. With ``manifests`` and the flattened ``provenance`` of the
    runs, these are compared as well.
    """
    current = F.col("version") >= run_files.CURRENT_VERSION
    new_cases, old_cases = tables.cases.filter(current), tables.cases.filter(~current)

    def of(df: DataFrame, cases: DataFrame) -> DataFrame:
        return df.join(cases.select(*CASE), CASE, "left_semi")

    runs = tables.runs.withColumn("expected_cases", expected_cases)
    seals = audit.index_seals(tables.cases, tables.runs.drop("provider", "model", "embedding_model", "version"))
    sealed_from = {"embedding_index": run_files.FIRST_SEALED_VERSION, "identifier_index": run_files.CURRENT_VERSION, "retrieval_seal": run_files.CURRENT_VERSION}
    since = F.create_map(*[x for name, v in sealed_from.items() for x in (F.lit(name), F.lit(v))])
    seals = seals.join(tables.runs.select("run_id", "version"), "run_id").filter(F.col("version") >= since[F.col("violation")]).drop("version")
    docket, results = of(tables.dockets, new_cases), of(tables.results, new_cases)
    claims = of(tables.claims, new_cases)
    foreign = claims.filter(differs(F.col("claim_source_id"), F.col("source_id"))).select(*SPAN, F.lit("claim_source").alias("violation"))
    parts = [
        _metric_findings(tables, long_figures(recomputed_figures(tables))),
        audit.case_count(runs, tables.cases).select("run_id", F.lit("case_count").alias("violation"), F.col("cases").cast("string").alias("detail")),
        audit.duplicate_keys(tables.cases, *CASE).select(*CASE, F.lit("duplicate_case").alias("violation")),
        audit.case_identity(tables.cases, tables.runs, tables.dockets), seals, audit.legacy_arms(old_cases),
        audit.result_cardinality(docket, results).drop("results"),
        audit.exposure(docket, results, claims, of(tables.verdicts, new_cases)), foreign,
        audit.legacy_exposure(of(tables.reviews, old_cases), of(tables.dockets, old_cases), of(tables.items, old_cases)),
        audit.role_errors(tables.traces),
    ]
    if manifests is not None and provenance is not None:
        parts.append(audit.provenance_match(provenance, manifests))
    empty = tables.runs.sparkSession.createDataFrame([], FINDING)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [empty, *[p.select(
        *[F.col(c).cast("string").alias(c) for c in p.columns if c in empty.columns]) for p in parts]])


def audit_runs(
    spark: SparkSession, path: str, expected_cases: Column, lines: bool = False, manifests: DataFrame | None = None,
) -> DataFrame:
    """All violations of the run files under ``path``, those of files that are no runs included (with the file as detail)."""
    scanned = run_files.scan_runs(spark, path, lines)
    files = run_files.scan_violations(spark, path, scanned).select("run_id", "violation", F.col("file").alias("detail"))
    provenance = None
    if manifests is not None:
        provenance = run_files.readable(scanned).select("run_id", "experiment_id", "model", "embedding_model", "provenance.*").withColumn(
            "prompt_hashes", F.to_json(F.array_sort(F.map_entries("prompt_hashes"))))
    found = findings(run_files.tables(scanned), expected_cases, manifests, provenance)
    return materialise(found.unionByName(files, allowMissingColumns=True), "run-findings")
