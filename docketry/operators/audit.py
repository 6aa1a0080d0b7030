"""Integrity audits. Each returns a table of violations; an empty table means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.rows import explode_rows, inline_rows
from docketry.operators.intake import reasons
from docketry.operators.metrics import CASE, SPAN
from docketry.operators.retrieve import sequence_fingerprint
from docketry.functions.scores import BROAD_K, FINAL_K, MAX_POOL


def differs(left: Column, right: Column) -> Column:
    """Null-safe inequality: a missing value never passes for a match."""
    return ~left.eqNullSafe(right)


def failed_checks(df: DataFrame, keys: list[str], **failed: Column) -> DataFrame:
    """One row per key and failed check, named by the check."""
    return explode_rows(df, reasons(**failed), "violation", *keys)


# ---- files and manifests ----------------------------------------------------------


def freeze(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, violation) where a listed file is missing or its hash differs."""
    joined = manifest.select("path", "sha256").join(
        files.select("path", F.col("sha256").alias("actual")), "path", "left"
    )
    missing = F.col("actual").isNull()
    return failed_checks(joined, ["path"], missing=missing, sha256=~missing & differs(F.col("sha256"), F.col("actual")))


def provenance(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """As ``freeze``, with byte counts too."""
    joined = manifest.select("path", "sha256", "bytes").join(
        files.select("path", F.col("sha256").alias("actual"), F.col("bytes").alias("actual_bytes")), "path", "left"
    )
    missing = F.col("actual").isNull()
    return failed_checks(
        joined, ["path"], missing=missing, sha256=~missing & differs(F.col("sha256"), F.col("actual")),
        bytes=~missing & differs(F.col("bytes"), F.col("actual_bytes")),
    )


def submodules(rows: DataFrame) -> DataFrame:
    """(path, violation) for recorded modules without url or at another commit."""
    return failed_checks(
        rows, ["path"], no_url=F.coalesce(F.length("url") == 0, F.lit(True)),
        commit=differs(F.col("commit"), F.col("checked_out_commit")),
    )


def distribution(expected: DataFrame, rows: DataFrame, key: str = "type") -> DataFrame:
    """Values whose row count is not the expected one: key, expected, actual."""
    actual = rows.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    return expected.select(key, "expected").join(actual, key, "full").filter(
        differs(F.col("expected"), F.col("actual"))
    )


def prompts(manifest: DataFrame, instructions: DataFrame) -> DataFrame:
    """Role prompt hashes against the instructions: (role, violation)."""
    joined = manifest.select("role", "sha256").join(instructions.select("role", "instruction"), "role", "full")
    blank = F.coalesce(F.length("instruction") == 0, F.lit(True))
    return failed_checks(
        joined, ["role"], role_set=F.col("sha256").isNull(), missing_instruction=blank,
        sha256=~blank & F.col("sha256").isNotNull() & differs(F.col("sha256"), F.sha2("instruction", 256)),
    )


def seals(sealed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sealed objects (path, generation, sha256) against the manifest's file hashes."""
    joined = manifest.select("path", F.col("sha256").alias("expected")).join(
        sealed.select("path", "generation", "sha256"), "path", "left"
    )
    return failed_checks(
        joined, ["path"], no_generation=F.col("generation").isNull(), sha256=differs(F.col("sha256"), F.col("expected"))
    )


# ---- cases and gold ---------------------------------------------------------------


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def gold_targets(cases: DataFrame) -> DataFrame:
    """(id, violation): targets equal the ordered distinct claim sources; slot ids unique."""
    sources = F.array_distinct(F.transform("expected_claims", lambda c: c["source_id"]))
    slots = F.transform("expected_claims", lambda c: c["claim_slot_id"])
    evidence = F.transform("expected_evidence_by_target", lambda e: e["source_id"])
    targets = F.col("expected_review_targets")
    current = F.col("incoming_artifact").isNotNull()
    unmatched = (F.size(F.array_except(evidence, targets)) > 0) | (F.size(F.array_except(targets, evidence)) > 0)
    return failed_checks(
        cases, ["id"], targets=current & differs(sources, targets),
        duplicate_slot=current & (F.size(F.array_distinct(slots)) != F.size(slots)),
        no_basis=current & (F.size("basis_source_ids") == 0),
        duplicate_evidence=F.size(F.array_distinct(evidence)) != F.size(evidence),
        evidence_targets=unmatched,
    )


def references(child: DataFrame, keys: list[str], foreign: str, parent: DataFrame, primary: str, label: str) -> DataFrame:
    """Rows of ``child`` that point at nothing: keys, reference, violation."""
    return (
        child.filter(F.col(foreign).isNotNull())
        .join(parent.select(F.col(primary).alias(foreign)), foreign, "left_anti")
        .select(*keys, F.col(foreign).cast("string").alias("reference"), F.lit(label).alias("violation"))
    )


def case_references(cases: DataFrame, spans: DataFrame) -> DataFrame:
    """Basis, target, evidence, claim and changed sources must exist."""
    lists = {
        "basis": F.col("basis_source_ids"), "target": F.col("expected_review_targets"),
        "evidence": F.transform("expected_evidence_by_target", lambda e: e["source_id"]),
        "claim": F.transform("expected_claims", lambda c: c["source_id"]),
        "changed": F.when(F.col("incoming_artifact").isNull(), F.array("changed_source_id")),
    }

    def tagged(kind: str, sources: Column) -> Column:
        known = F.coalesce(sources, F.array().cast("array<string>"))
        return F.transform(known, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("source_id")))

    named = F.concat(*[tagged(kind, sources) for kind, sources in lists.items()])
    return (
        inline_rows(cases, named, "id").join(spans.select("source_id"), "source_id", "left_anti")
        .select("id", F.concat(F.lit("unknown_"), "kind").alias("violation"), F.col("source_id").alias("reference"))
        .distinct()
    )


def gold_spans(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Gold texts (id, source_id, span) that are not exact parts of their source."""
    return gold.join(spans.select("source_id", "content"), "source_id").filter(
        ~F.contains("content", F.col("span"))
    ).select("id", "source_id", "span")


def gold_texts(cases: DataFrame) -> DataFrame:
    """All gold texts of the cases, from evidence lists, claim slots and changed content."""
    evidence = cases.select("id", F.inline("expected_evidence_by_target")).select(
        "id", "source_id", F.explode("spans").alias("span"))
    slots = cases.select("id", F.inline("expected_claims")).select(
        "id", "source_id", F.explode("acceptable_exact_evidence_spans").alias("span"))
    changed = cases.filter(
        F.col("incoming_artifact").isNull() & (F.col("type") != "clean") & (F.length("original_content") > 0)
    ).select("id", F.col("changed_source_id").alias("source_id"), F.col("original_content").alias("span"))
    return evidence.unionByName(slots).unionByName(changed)


# ---- stored runs ------------------------------------------------------------------


def stored_metrics(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(run_id, metric, value) tables that disagree in any figure."""
    right = recomputed.select("run_id", "metric", F.col("value").alias("recomputed"))
    return stored.select("run_id", "metric", F.col("value").alias("stored")).join(
        right, ["run_id", "metric"], "full"
    ).filter(differs(F.col("stored"), F.col("recomputed")))


def case_count(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Runs (run_id, expected_cases) that are not complete."""
    have = cases.groupBy("run_id").agg(F.count(F.lit(1)).alias("cases"))
    return runs.select("run_id", "expected_cases").join(have, "run_id", "left").withColumn(
        "cases", F.coalesce("cases", F.lit(0))
    ).filter(F.col("cases") != F.col("expected_cases"))


def case_identity(cases: DataFrame, runs: DataFrame, dockets: DataFrame) -> DataFrame:
    """(run_id, case_id, violation): run identity, docket size, docket fingerprint.

    ``cases``: CASE, case_run_id, provider, model, embedding_model, candidate_fingerprint;
    ``dockets``: SPAN, rank, content_sha256.
    """
    names = ("provider", "model", "embedding_model", "top_k")
    run = runs.select("run_id", *[F.col(n).alias(f"run_{n}") for n in names])
    sealed = dockets.select(F.struct(*CASE).alias("query_id"), "source_id", "rank", "content_sha256")
    prints = sequence_fingerprint(sealed, "rank", "recomputed").select("query_id.*", "recomputed")
    sizes = dockets.groupBy(*CASE).agg(F.count(F.lit(1)).alias("size"))
    joined = cases.join(run, "run_id", "left").join(prints, CASE, "left").join(sizes, CASE, "left")
    return failed_checks(
        joined, CASE, run_id=differs(F.col("case_run_id"), F.col("run_id")),
        runtime=reduce(lambda a, b: a | b, [differs(F.col(n), F.col(f"run_{n}")) for n in names[:3]]),
        top_k=differs(F.coalesce("size", F.lit(0)).cast("int"), F.col("run_top_k").cast("int")),
        candidate_fingerprint=differs(F.col("candidate_fingerprint"), F.col("recomputed")),
    )


def legacy_arms(cases: DataFrame) -> DataFrame:
    """Cases whose baseline or proposed list is not the candidate list, order included."""
    ids = F.col("candidate_ids")
    return cases.filter(
        differs(F.col("baseline_candidate_source_ids"), ids) | differs(F.col("proposed_candidate_source_ids"), ids)
    ).select(*CASE, F.lit("arms_differ").alias("violation"))


def index_seals(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Index fingerprints of case, configuration and provenance agree; retrieval limits hold."""
    joined = cases.join(runs, "run_id", "left")

    def drift(name: str) -> Column:
        own = F.col(f"{name}_index_fingerprint")
        return (
            F.coalesce(F.length(own) == 0, F.lit(True)) | differs(own, F.col(f"config_{name}_index_fingerprint"))
            | differs(own, F.col(f"provenance_{name}_index_fingerprint"))
        )

    return failed_checks(
        joined, CASE, embedding_index=drift("embedding"), identifier_index=drift("identifier"),
        retrieval_seal=differs(F.col("final_docket_fingerprint"), F.col("candidate_fingerprint"))
        | differs(F.col("final_k"), F.lit(FINAL_K)) | differs(F.col("broad_k"), F.lit(BROAD_K))
        | F.coalesce(F.col("expanded_count") > MAX_POOL, F.lit(True)),
    )


def result_cardinality(docket: DataFrame, results: DataFrame, keys: list[str] = SPAN) -> DataFrame:
    """Exactly one result per docket row and none elsewhere: keys, violation, results."""
    counted = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("results"))
    on_docket = docket.select(*keys).distinct().withColumn("on_docket", F.lit(True))
    joined = on_docket.join(counted, keys, "full").withColumn("results", F.coalesce("results", F.lit(0)))
    violation = (
        F.when(F.col("on_docket").isNull(), "off_docket").when(F.col("results") == 0, "missing_result")
        .when(F.col("results") > 1, "duplicate_result")
    )
    return joined.select(*keys, violation.alias("violation"), "results").filter(F.col("violation").isNotNull())


def exposure(docket: DataFrame, results: DataFrame, claims: DataFrame, verdicts: DataFrame,
             query_keys: list[str] = CASE) -> DataFrame:
    """Exposed claims that should not be: query_keys, source_id, violation.

    ``results``: status per docket row; ``claims``: exposed claims with claim_id and
    evidence fields; ``verdicts``: claim_id, verdict.
    """
    span = [*query_keys, "source_id"]
    exposed = claims.groupBy(*span).agg(F.count(F.lit(1)).alias("exposed"))
    rows = results.select(*span, "status").join(exposed, span, "left").withColumn(
        "exposed", F.coalesce("exposed", F.lit(0)))
    verified = F.col("status") == "VERIFIED_REVIEW"
    status = failed_checks(
        rows, span, verified_without_claim=verified & (F.col("exposed") == 0),
        unsupported_claim_exposed=~verified & (F.col("exposed") > 0),
    )
    given = verdicts.groupBy(*query_keys, "claim_id").agg(
        F.count(F.lit(1)).alias("verdicts"), F.min("verdict").alias("verdict"))
    joined = claims.join(docket.select(*span, "content", "start_line", "end_line"), span, "left").join(
        given, [*query_keys, "claim_id"], "left")
    bad = failed_checks(
        joined, span, off_docket_claim=F.col("content").isNull(),
        # Off the docket there is nothing to compare; on it, what is missing cannot be shown to be exact.
        not_exact=F.col("content").isNotNull() & F.coalesce(~F.contains("content", F.col("evidence_exact_text")), F.lit(True)),
        out_of_range=F.col("content").isNotNull() & F.coalesce(
            (F.col("evidence_start_line") < F.col("start_line")) | (F.col("evidence_end_line") > F.col("end_line")), F.lit(True)),
        verdict=differs(F.col("verdicts"), F.lit(1).cast("bigint")) | differs(F.col("verdict"), F.lit("SUPPORTED")),
    )
    return status.unionByName(bad)


def role_errors(traces: DataFrame) -> DataFrame:
    return traces.filter(F.length("error") > 0).select(*CASE, "role", F.lit("role_error").alias("violation"))


def legacy_exposure(reviews: DataFrame, docket: DataFrame, items: DataFrame) -> DataFrame:
    """Verified reviews of older runs: duplicates, evidence, reasons, one supporting verdict."""
    verified = reviews.filter(F.col("status") == "VERIFIED_REVIEW")
    duplicate = duplicate_keys(verified, *SPAN).select(*SPAN, F.lit("duplicate_review").alias("violation"))
    counted = items.groupBy(*SPAN).agg(
        F.count(F.lit(1)).alias("verdicts"), F.bool_and(F.coalesce("supported", F.lit(False))).alias("all_supported"))
    joined = verified.join(docket.select(*SPAN, "content"), SPAN, "left").join(counted, SPAN, "left")

    def blank(name: str) -> Column:
        return F.coalesce(F.length(name) == 0, F.lit(True))

    bad = failed_checks(
        joined, SPAN, evidence=blank("evidence") | F.coalesce(~F.contains("content", F.col("evidence")), F.lit(True)),
        reasons=blank("short_reason") | blank("verifier_reason"),
        verdict=differs(F.col("verdicts"), F.lit(1).cast("bigint")) | ~F.coalesce("all_supported", F.lit(False)),
    )
    return duplicate.unionByName(bad.distinct())


PROVENANCE_PAIRS = {
    "experiment_manifest": "manifest_name", "experiment_id": "manifest_experiment_id",
    "freeze_tag": "manifest_freeze_tag", "prompt_hashes": "manifest_prompt_hashes",
    "prompt_version": "manifest_prompt_version", "input_manifest_sha256": "manifest_sha256",
    "model": "manifest_model", "embedding_model": "manifest_embedding_model",
    "embedding_index_manifest": "manifest_embedding_index_file",
    "embedding_index_manifest_sha256": "manifest_embedding_index_sha256",
    "identifier_index_manifest": "manifest_identifier_index_file",
    "identifier_index_manifest_sha256": "manifest_identifier_index_sha256",
}
PROVENANCE_PRESENT = (
    "cloud_execution", "adk_version", "embedding_index_fingerprint", "identifier_index_fingerprint",
)


def provenance_match(runs: DataFrame, manifests: DataFrame, pairs: dict[str, str] = PROVENANCE_PAIRS,
                     present: tuple[str, ...] = PROVENANCE_PRESENT, store: str = "gcs") -> DataFrame:
    """Published runs against their manifests: (run_id, violation).

    ``runs`` has the provenance fields flattened, ``manifests`` is keyed by
    experiment_id; maps are given as sorted text.
    """
    on = manifests.withColumnRenamed("experiment_id", "manifest_experiment_id")
    joined = runs.join(on, F.col("experiment_id") == F.col("manifest_experiment_id"), "left")
    checks = {name: differs(F.col(name), F.col(other)) for name, other in pairs.items()}
    checks |= {f"no_{name}": F.coalesce(F.length(name) == 0, F.lit(True)) for name in present}
    checks["artifact_store"] = differs(F.col("artifact_store"), F.lit(store))
    checks["container_image_digest"] = ~F.coalesce(F.contains("container_image_digest", F.lit("@sha256:")), F.lit(False))
    return failed_checks(joined, ["run_id"], **checks)


def completion(checkpoints: DataFrame, finals: DataFrame, failures: DataFrame) -> DataFrame:
    """Runs that may not be published: (run_id, violation).

    A run needs a complete checkpoint that names the final object's generation and hash,
    and no failure record.
    """
    failed = failures.select("run_id").distinct().withColumn("failed", F.lit(True))
    joined = finals.select("run_id", "generation", "sha256").join(
        checkpoints.select("run_id", "status", "final_generation", "final_sha256"), "run_id", "left"
    ).join(failed, "run_id", "left")
    return failed_checks(
        joined, ["run_id"], failed_run=F.coalesce("failed", F.lit(False)),
        not_complete=differs(F.col("status"), F.lit("complete")),
        seal=differs(F.col("final_generation"), F.col("generation")) | differs(F.col("final_sha256"), F.col("sha256")),
    )


def pointer(pointers: DataFrame, finals: DataFrame, runs: DataFrame) -> DataFrame:
    """Published pointers whose run, hash, path or commit do not agree: (run_id, violation)."""
    joined = (
        pointers.join(finals.select(F.col("object_name"), F.col("sha256").alias("actual")), "object_name", "left")
        .join(runs.select("run_id", F.col("experiment_id").alias("run_experiment"),
                          F.col("source_commit").alias("run_commit"), F.col("experiment_manifest").alias("run_manifest")),
              "run_id", "left")
    )
    path = F.concat(F.lit("/"), "run_id", F.lit("/evaluation.json"))
    return failed_checks(
        joined, ["run_id"], sha256=differs(F.col("sha256"), F.col("actual")),
        identity=differs(F.col("experiment_id"), F.col("run_experiment")),
        object_name=~F.endswith("object_name", path),
        source_commit=differs(F.col("source_commit"), F.col("run_commit")),
        experiment_manifest=differs(F.col("experiment_manifest"), F.col("run_manifest")),
    )


# ---- logs -------------------------------------------------------------------------


def log_completeness(events: DataFrame, expected: DataFrame, start: str = "job_started",
                     step: str = "case_completed", end: str = "evaluation_completed") -> DataFrame:
    """Runs (run_id, cases) whose log lacks its start, end or a case record."""
    counted = events.groupBy("run_id").agg(*[
        F.count_if(F.col("event") == e).alias(n) for n, e in (("started", start), ("completed", step), ("ended", end))
    ])
    joined = expected.select("run_id", "cases").join(counted, "run_id", "left").fillna(0)
    return joined.filter(
        (F.col("started") != 1) | (F.col("completed") != F.col("cases")) | (F.col("ended") != 1)
    )


def prohibited_content(lines: DataFrame, body: str, pattern: str) -> DataFrame:
    return lines.filter(F.col(body).rlike(pattern))


def suite(*named: tuple[str, DataFrame]) -> DataFrame:
    """All violations in one table: (check, row) with the row as JSON text."""
    parts = [
        df.select(F.lit(name).alias("check"), F.to_json(F.struct(*sorted(df.columns))).alias("row")) for name, df in named
    ]
    return reduce(DataFrame.unionByName, parts)


def suite_counts(*named: tuple[str, DataFrame]) -> DataFrame:
    """Violations per check, with zero for checks that pass."""
    found = suite(*named).groupBy("check").agg(F.count(F.lit(1)).alias("violations"))
    names = F.array(*[F.lit(name) for name, _ in named])
    grid = named[0][1].sparkSession.range(1).select(F.explode(names).alias("check"))
    return grid.join(found, "check", "left").select("check", F.coalesce("violations", F.lit(0)).alias("violations"))
