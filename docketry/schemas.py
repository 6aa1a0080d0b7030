"""Fixed table schemas and value domains."""

from __future__ import annotations

# Enumerations of the data model.
DECISIONS = ("REVIEW", "NO_REVIEW", "INSUFFICIENT_EVIDENCE")
LEGACY_STATUSES = ("VERIFIED_REVIEW", "NO_REVIEW", "INSUFFICIENT_EVIDENCE", "REJECTED_UNSUPPORTED")
CANDIDATE_STATUSES = (
    "VERIFIED_REVIEW", "NO_REVIEW", "NO_SUPPORTED_CLAIM", "INSUFFICIENT_EVIDENCE", "BLOCKED",
)
VERDICTS = ("SUPPORTED", "REJECTED", "MISSING", "NOT_APPLICABLE")
CURRENT_VERDICTS = ("SUPPORTED", "REJECTED", "MISSING")
IMPACT_TYPES = (
    "REQUIREMENT_CONFLICT", "INTERFACE_IMPACT", "DESIGN_ASSUMPTION", "CONFIGURATION_IMPACT",
    "IMPLEMENTATION_IMPACT", "VERIFICATION_IMPACT", "DOCUMENTATION_IMPACT",
)
ARTIFACT_TYPES = (
    "requirement", "interface_change", "design_change", "configuration_change",
    "verification_change", "documentation_change", "other_engineering",
)
OVERALL_STATUSES = ("REVIEW_REQUIRED", "NO_SUPPORTED_REVIEW", "INCONCLUSIVE", "NO_REVIEW_FOUND")
CASE_TYPES = ("direct", "semantic", "cross_artifact", "clean", "benign")
IMPACT_CASE_TYPES = ("direct", "semantic", "cross_artifact")
CONTROL_CASE_TYPES = ("clean", "benign")

# Input limits.
MAX_TEXT = 20_000
MAX_TITLE = 200
MAX_SUBSYSTEM = 120
MAX_IDENTIFIERS = 20
MAX_IDENTIFIER_LENGTH = 120
MAX_CLAIMS = 3
MAX_CLAIMS_PER_REQUEST = 20
MAX_IMPACT_CLAIM = 500
MAX_EVIDENCE = 2_000
MAX_REASON = 500

# Fields a log record may carry.
LOG_FIELDS = (
    "event", "severity", "timestamp", "run_id", "request_id", "case_id", "artifact_type",
    "overall_status", "role", "model", "source_id", "claim_id", "decision", "verifier_verdict",
    "candidate_fingerprint", "verified", "blocked", "blocked_stage", "latency_ms", "error_type",
    "failure_write_error_type", "cases", "completed_cases",
)
LOG_INT_FIELDS = ("verified", "blocked", "latency_ms", "cases", "completed_cases")

SPANS = (
    "source_id STRING, type STRING, title STRING, path STRING, start_line INT, end_line INT, "
    "content STRING, component STRING, symbol STRING, source_file_sha256 STRING, "
    "content_sha256 STRING"
)
INCOMING = (
    "query_id STRING, artifact_type STRING, title STRING, subsystem STRING, "
    "identifiers ARRAY<STRING>, text STRING"
)
CLAIM_DRAFT = (
    "STRUCT<impact_type:STRING, impact_claim:STRING, evidence_exact_text:STRING, "
    "evidence_start_line:INT, evidence_end_line:INT>"
)
DECISION_TABLE = f"query_id STRING, source_id STRING, decision STRING, claims ARRAY<{CLAIM_DRAFT}>"
VERDICT_TABLE = "query_id STRING, claim_id STRING, verdict STRING, reason STRING"
FAILURE_TABLE = "query_id STRING, role STRING, error STRING"

INCOMING_STRUCT = (
    "STRUCT<artifact_type:STRING, title:STRING, subsystem:STRING, "
    "identifiers:ARRAY<STRING>, text:STRING>"
)
CLAIM_SLOTS = (
    "ARRAY<STRUCT<claim_slot_id:STRING, source_id:STRING, impact_type:STRING, "
    "acceptable_exact_evidence_spans:ARRAY<STRING>>>"
)
EVIDENCE = "ARRAY<STRUCT<source_id:STRING, spans:ARRAY<STRING>>>"
CHANGE = (
    "STRUCT<artifact_or_subsystem:STRING, parameter:STRING, old_value:STRING, "
    "new_value:STRING, change_type:STRING, related_terms:ARRAY<STRING>>"
)
# One document per file; the newer layouts leave the older fields null and vice versa.
CASE_FILE = (
    "schema_version INT, experiment_id STRING, frozen_at STRING, top_k INT, "
    "cases ARRAY<STRUCT<id:STRING, type:STRING, scenario:STRING, change_text:STRING, "
    f"incoming_artifact:{INCOMING_STRUCT}, basis_source_ids:ARRAY<STRING>, "
    f"expected_claims:{CLAIM_SLOTS}, expected_review_targets:ARRAY<STRING>, "
    f"expected_evidence_by_target:{EVIDENCE}, "
    "expected_evidence:STRUCT<source_id:STRING, span:STRING>, changed_source_id:STRING, "
    f"original_content:STRING, changed_content:STRING, change:{CHANGE}>>"
)

VERIFIED_CLAIM = (
    "STRUCT<claim_id:STRING, source_id:STRING, impact_type:STRING, impact_claim:STRING, "
    "evidence_exact_text:STRING, evidence_start_line:INT, evidence_end_line:INT, "
    "verifier_reason:STRING>"
)
CANDIDATE = (
    "STRUCT<source_id:STRING, type:STRING, title:STRING, path:STRING, start_line:INT, "
    "end_line:INT, content:STRING, component:STRING, symbol:STRING, source_file_sha256:STRING, "
    "content_sha256:STRING, `rank`:INT, bm25_score:DOUBLE, embedding_score:DOUBLE, "
    "hybrid_score:DOUBLE, retrieval_origins:ARRAY<STRING>, broad_rank:INT, "
    "relation_identifiers:ARRAY<STRING>, relation_score:DOUBLE, final_score:DOUBLE>"
)
CANDIDATE_RESULT = (
    f"STRUCT<source_id:STRING, status:STRING, verified_claims:ARRAY<{VERIFIED_CLAIM}>, "
    "blocked_count:INT, blocked_stages:ARRAY<STRING>, verifier_verdicts:ARRAY<STRING>>"
)
CASE_RESULT = (
    "STRUCT<run_id:STRING, case_id:STRING, case_type:STRING, scenario:STRING, provider:STRING, "
    "model:STRING, embedding_model:STRING, started_at:STRING, completed_at:STRING, "
    f"candidates:ARRAY<{CANDIDATE}>, candidate_fingerprint:STRING, "
    "embedding_index_fingerprint:STRING, identifier_index_fingerprint:STRING, "
    "query_processing:STRUCT<processor_version:STRING, extracted_identifiers:ARRAY<STRING>, "
    "query_fingerprint:STRING>, "
    "retrieval:STRUCT<baseline_count:INT, broad_k:INT, broad_count:INT, "
    "broad_candidate_fingerprint:STRING, relation_expansion_count:INT, expanded_count:INT, "
    "expanded_pool_fingerprint:STRING, final_k:INT, final_docket_fingerprint:STRING>, "
    f"candidate_decisions:ARRAY<STRUCT<source_id:STRING, decision:STRING, claims:ARRAY<{CLAIM_DRAFT}>>>, "
    "claim_verifications:ARRAY<STRUCT<claim_id:STRING, verdict:STRING, reason:STRING>>, "
    f"candidate_results:ARRAY<{CANDIDATE_RESULT}>, "
    "role_traces:ARRAY<STRUCT<role:STRING, provider:STRING, model:STRING, raw_output:STRING, "
    "parsed:STRUCT<verifications:ARRAY<STRUCT<source_id:STRING, claim_id:STRING, "
    "supported:BOOLEAN, verdict:STRING, evidence:STRING, reason:STRING>>>, error:STRING>>, "
    f"expected_review_targets:ARRAY<STRING>, expected_claims:{CLAIM_SLOTS}, "
    "broad_candidate_source_ids:ARRAY<STRING>, expanded_candidate_source_ids:ARRAY<STRING>, "
    f"retrieval_hit:BOOLEAN, incoming_artifact:{INCOMING_STRUCT}, overall_status:STRING, "
    "partial:BOOLEAN, baseline_candidate_source_ids:ARRAY<STRING>, "
    "proposed_candidate_source_ids:ARRAY<STRING>, "
    "proposed_reviews:ARRAY<STRUCT<source_id:STRING, decision:STRING, evidence:STRING, "
    "short_reason:STRING>>, "
    "final_reviews:ARRAY<STRUCT<source_id:STRING, status:STRING, evidence:STRING, "
    "short_reason:STRING, verifier_reason:STRING, blocked_stage:STRING>>>"
)
PROVENANCE = (
    "STRUCT<source_commit:STRING, freeze_tag:STRING, experiment_manifest:STRING, "
    "prompt_version:STRING, prompt_hashes:MAP<STRING,STRING>, input_manifest_sha256:STRING, "
    "embedding_index_manifest:STRING, embedding_index_manifest_sha256:STRING, "
    "embedding_index_fingerprint:STRING, identifier_index_manifest:STRING, "
    "identifier_index_manifest_sha256:STRING, identifier_index_fingerprint:STRING, "
    "artifact_store:STRING, cloud_execution:STRING, container_image_digest:STRING, "
    "adk_version:STRING>"
)
# The free-form configuration and metrics objects stay JSON text.
RUN_FILE = (
    "experiment_id STRING, run_id STRING, provider STRING, model STRING, "
    "embedding_model STRING, started_at STRING, completed_at STRING, "
    f"freeze_hashes MAP<STRING,STRING>, configuration STRING, cases ARRAY<{CASE_RESULT}>, "
    f"metrics STRING, provenance {PROVENANCE}"
)
POINTERS = (
    "run_id STRING, experiment_id STRING, object_name STRING, generation BIGINT, sha256 STRING, "
    "published_at STRING, source_commit STRING, experiment_manifest STRING"
)
