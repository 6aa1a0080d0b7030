"""Fault injection: every kind of bad reviewer or verifier output fails closed."""

import pytest
from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators import intake, review

CONTENT = "alpha one\nbeta two\n\ngamma three"
DOCKET = [("q", f"S{r:02d}", r, CONTENT, 11, 14) for r in range(1, 11)]
DOCKET_SCHEMA = "query_id string, source_id string, rank int, content string, start_line int, end_line int"
GOOD = ("INTERFACE_IMPACT", "claim", "beta two", 12, 12)


def tables(spark, decisions=None, verdicts=None, failures=()):
    docket = spark.createDataFrame(DOCKET, DOCKET_SCHEMA)
    if decisions is None:
        decisions = [("q", "S01", "REVIEW", [GOOD])] + [("q", f"S{r:02d}", "NO_REVIEW", []) for r in range(2, 11)]
    if verdicts is None:
        verdicts = [("q", "CLM-01-01", "SUPPORTED", "ok")]
    return (docket, spark.createDataFrame(decisions, schemas.DECISION_TABLE), spark.createDataFrame(verdicts, schemas.VERDICT_TABLE),
            spark.createDataFrame(list(failures), schemas.FAILURE_TABLE))


def resolve(spark, **changes):
    results, effective, overall = review.resolve(*tables(spark, **changes))
    return {r.source_id: r for r in results.collect()}, effective.collect(), overall.first()


REST = [("q", f"S{r:02d}", "NO_REVIEW", []) for r in range(2, 11)]


def test_supported_claim_is_verified(spark):
    rows, _, overall = resolve(spark)
    assert rows["S01"].status == "VERIFIED_REVIEW" and rows["S01"].verified_claims[0].verifier_reason == "ok"
    assert (overall.overall_status, overall.partial) == ("REVIEW_REQUIRED", False)


def test_text_absent_from_its_lines_is_blocked(spark):
    bad = ("INTERFACE_IMPACT", "claim", "gamma three", 12, 12)
    rows, _, overall = resolve(spark, decisions=[("q", "S01", "REVIEW", [GOOD]), ("q", "S02", "REVIEW", [bad]), *REST[1:]])
    assert rows["S02"].status == "BLOCKED" and rows["S02"].blocked_stages == ["deterministic_exact_span"]
    assert (overall.overall_status, overall.partial) == ("REVIEW_REQUIRED", True)


def test_partly_blocked_row_stays_verified_and_conclusive(spark):
    outside = ("INTERFACE_IMPACT", "claim", "beta two", 12, 15)
    rows, _, overall = resolve(spark, decisions=[("q", "S01", "REVIEW", [outside, GOOD]), *REST], verdicts=[("q", "CLM-01-02", "SUPPORTED", "ok")])
    assert rows["S01"].status == "VERIFIED_REVIEW" and rows["S01"].blocked_count == 1
    assert rows["S01"].blocked_stages == ["deterministic_line_range"] and rows["S01"].verified_claims[0].claim_id == "CLM-01-02"
    assert overall.partial is False


def test_rejected_claims_close_the_query(spark):
    rows, _, overall = resolve(spark, verdicts=[("q", "CLM-01-01", "REJECTED", "no")])
    assert rows["S01"].status == "NO_SUPPORTED_CLAIM" and overall.overall_status == "NO_SUPPORTED_REVIEW"


def test_duplicate_verdict(spark):
    rows, effective, _ = resolve(spark, verdicts=[("q", "CLM-01-01", "SUPPORTED", "a"), ("q", "CLM-01-01", "SUPPORTED", "b")])
    assert rows["S01"].status == "BLOCKED" and rows["S01"].blocked_stages == ["verifier_duplicate_verdict"]
    assert effective[0].verdict == "MISSING" and effective[0].reason == review.MISSING_REASON


def test_missing_verdict(spark):
    rows, _, overall = resolve(spark, verdicts=[])
    assert rows["S01"].blocked_stages == ["verifier_missing_verdict"] and rows["S01"].verifier_verdicts == ["MISSING"]
    assert overall.overall_status == "INCONCLUSIVE"


def test_explicit_missing_verdict_ends_blocked(spark):
    rows, _, _ = resolve(spark, verdicts=[("q", "CLM-01-01", "MISSING", "m")])
    assert rows["S01"].status == "BLOCKED" and rows["S01"].blocked_stages == ["no_valid_review_claim"] and rows["S01"].blocked_count == 1


def test_reviewer_failure_blocks_everything(spark):
    rows, effective, overall = resolve(spark, failures=[("q", "engineering_review", "TimeoutError")])
    assert {r.status for r in rows.values()} == {"BLOCKED"} and not effective
    assert all(r.blocked_stages == ["engineering_review_provider"] for r in rows.values())
    assert (overall.overall_status, overall.partial) == ("INCONCLUSIVE", False)


def test_verifier_failure(spark):
    rows, _, overall = resolve(spark, failures=[("q", "evidence_verifier", "TimeoutError")])
    assert rows["S01"].blocked_stages == ["evidence_verifier_provider"] and not rows["S01"].verified_claims
    assert overall.overall_status == "INCONCLUSIVE"


def test_missing_decisions_are_named(spark):
    rows, _, _ = resolve(spark, decisions=[("q", "S01", "REVIEW", [GOOD])])
    assert sum(r.blocked_stages == ["schema_missing_source"] for r in rows.values()) == 9


def test_duplicate_and_off_docket_decisions(spark):
    decisions = [("q", "S01", "REVIEW", [GOOD])] * 2 + [("q", "S02", "REVIEW", [GOOD])] + REST[1:] + [("q", "OUT", "NO_REVIEW", [])]
    rows, _, overall = resolve(spark, decisions=decisions, verdicts=[("q", "CLM-02-01", "SUPPORTED", "ok")])
    assert rows["S01"].blocked_stages == ["schema_duplicate_source"] and "OUT" not in rows
    assert rows["S02"].status == "VERIFIED_REVIEW" and overall.partial is True


def test_legacy_rows_log_and_live_projection(spark):
    results, _, overall = review.resolve(*tables(spark, verdicts=[("q", "CLM-01-01", "REJECTED", "no")]))
    legacy = {r.source_id: r for r in review.legacy_projection(results).collect()}
    assert legacy["S01"].status == "REJECTED_UNSUPPORTED" and legacy["S01"].blocked_stage == "independent_verifier_rejected"
    assert review.decision_log(results).count() == 10
    assert not {"content", "claims", "checked"} & set(review.live_projection(results).columns)
    seals = spark.createDataFrame([("q", "d", "i")], "query_id string, final_docket_fingerprint string, identifier_index_fingerprint string")
    one = review.result_seal(results, overall, seals).first().seal
    assert len(one) == 64 and one == review.result_seal(results.repartition(3), overall, seals).first().seal


@pytest.mark.parametrize("outcome, status, overall_status", [
    ("no_review", "NO_REVIEW", "NO_SUPPORTED_REVIEW"), ("review", "VERIFIED_REVIEW", "REVIEW_REQUIRED"),
    ("inconclusive", "INSUFFICIENT_EVIDENCE", "INCONCLUSIVE"), ("rejected", "NO_SUPPORTED_CLAIM", "NO_SUPPORTED_REVIEW")])
def test_live_rules(spark, outcome, status, overall_status):
    docket, _, _, failures = tables(spark)
    none = spark.createDataFrame([], "query_id string, source_id string, expected_evidence string, expected_impact string")
    decisions = review.rule_decisions(docket, none, none, live=True, live_outcome=outcome)
    claims = review.valid_claims(review.validate(docket, decisions, failures))
    results, _, overall = review.resolve(docket, decisions, review.rule_verdicts(claims, outcome == "rejected"), failures)
    assert results.filter("rank = 1").first().status == status and overall.first().overall_status == overall_status


def test_rules_use_gold_evidence_and_inject_one_bad_claim(spark):
    docket, _, _, failures = tables(spark)
    targets = spark.createDataFrame([("q", "S01")], "query_id string, source_id string")
    evidence = spark.createDataFrame([("q", "S01", "gamma three", "DESIGN_ASSUMPTION")],
                                     "query_id string, source_id string, expected_evidence string, expected_impact string")
    rows = {r.source_id: r for r in review.rule_decisions(docket, targets, evidence, inject_query="q").collect()}
    claim = rows["S01"].claims[0]
    assert (claim.evidence_exact_text, claim.evidence_start_line, claim.impact_type) == ("gamma three", 14, "DESIGN_ASSUMPTION")
    assert rows["S02"].claims[0].evidence_exact_text == review.BAD_EVIDENCE and rows["S03"].decision == "NO_REVIEW"
    decisions = review.rule_decisions(docket, targets, evidence, inject_query="q")
    claims = review.valid_claims(review.validate(docket, decisions, failures))
    results, _, overall = review.resolve(docket, decisions, review.rule_verdicts(claims), failures)
    assert results.filter("source_id = 'S02'").first().status == "BLOCKED"
    assert (overall.first().overall_status, overall.first().partial) == ("REVIEW_REQUIRED", True)


def test_contracts(spark):
    claim = list(GOOD)
    decisions = [("q", "A", "REVIEW", []), ("q", "B", "NO_REVIEW", [claim]), ("q", "C", "REVIEW", [claim] * 4), ("q", "D", "REVIEW", [claim[:3] + [5, 4]]), ("q", "E", "MAYBE", [])]
    decisions += [("p", f"S{i}", "REVIEW", [claim] * 3) for i in range(7)]
    got = {(r.query_id, r.source_id, r.violation) for r in intake.decision_contract(spark.createDataFrame(decisions, schemas.DECISION_TABLE)).collect()}
    assert got == {("q", "A", "review_without_claim"), ("q", "B", "claim_without_review"), ("q", "C", "too_many_claims"), ("q", "D", "draft_limits"),
                   ("q", "E", "unknown_decision"), ("p", None, "too_many_request_claims")}
    verdicts = spark.createDataFrame([("q", "c1", "NOT_APPLICABLE", "r"), ("q", "c2", "SUPPORTED", ""), ("q", "c3", "REJECTED", "r")], schemas.VERDICT_TABLE)
    assert {(r.claim_id, r.violation) for r in intake.verdict_contract(verdicts).collect()} == {("c1", "verdict"), ("c2", "reason_length")}


def test_incoming_limits(spark):
    rows = [("a", "requirement", " t ", "  ", [" X ", "", "X", "Y"], " body "), ("b", "nope", None, None, None, " "),
            ("c", "requirement", "t" * 201, "s" * 121, ["i" * 121] + ["x"] * 20, "b" * 20001)]
    got = {r.query_id: r for r in intake.normalise_incoming(spark.createDataFrame(rows, schemas.INCOMING)).collect()}
    assert (got["a"].title, got["a"].subsystem, got["a"].identifiers, got["a"].text, got["a"].violations) == ("t", None, ["X", "Y"], "body", [])
    assert got["b"].violations == ["artifact_type", "blank_text"]
    assert got["c"].violations == ["long_identifier", "long_subsystem", "long_text", "long_title", "many_identifiers"]
    queries = intake.process_queries(intake.normalise_incoming(spark.createDataFrame(rows[:1], schemas.INCOMING)))
    assert queries.first().query_text == "requirement\nt\n\nX\nY\nbody\n"
    assert queries.filter(F.length("query_fingerprint") == 64).count() == 1
