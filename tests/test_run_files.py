"""Stored run files: nothing lost in reading, every planted fault named."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docketry.operators import audit
from docketry.plans import run_audit
from docketry.sources import corpus, run_files

PRINT = "f" * 64


def seal(candidates):
    rows = [{"content_sha256": c["content_sha256"], "rank": c["rank"], "source_id": c["source_id"]} for c in candidates]
    return hashlib.sha256(json.dumps(rows, separators=(",", ":")).encode()).hexdigest()


def case(name, kind, current=True):
    candidates = [{"source_id": f"S{i}", "rank": i, "content": f"line one of {i}\nline two", "start_line": 5, "end_line": 6, "content_sha256": str(i) * 64} for i in (1, 2)]
    ids = [c["source_id"] for c in candidates]
    out = {
        "run_id": "R", "case_id": name, "case_type": kind, "provider": "p", "model": "m", "embedding_model": "e", "candidates": candidates,
        "candidate_fingerprint": seal(candidates), "embedding_index_fingerprint": PRINT, "retrieval_hit": True, "expected_review_targets": ["S1"],
        "role_traces": [{"role": "evidence_verifier", "parsed": {"verifications": [{"source_id": "S1", "supported": True}]}}],
    }
    if not current:
        review = {"source_id": "S1", "status": "VERIFIED_REVIEW", "evidence": "line one of 1", "short_reason": "r", "verifier_reason": "v"}
        return out | {"baseline_candidate_source_ids": ids, "proposed_candidate_source_ids": ids, "final_reviews": [review]}
    claim = {"claim_id": "C1", "source_id": "S1", "impact_type": "DESIGN_ASSUMPTION", "impact_claim": "x", "evidence_exact_text": "line one of 1",
             "evidence_start_line": 5, "evidence_end_line": 5, "verifier_reason": "v"}
    return out | {
        "identifier_index_fingerprint": PRINT, "broad_candidate_source_ids": ids, "expanded_candidate_source_ids": [*ids, "S3"],
        "retrieval": {"final_docket_fingerprint": seal(candidates), "final_k": 10, "broad_k": 40, "expanded_count": 3},
        "expected_claims": [{"claim_slot_id": "T1", "source_id": "S1", "impact_type": "DESIGN_ASSUMPTION", "acceptable_exact_evidence_spans": ["one of 1"]}],
        "candidate_decisions": [{"source_id": "S1", "decision": "REVIEW", "claims": [{k: claim[k] for k in list(claim)[2:7]}]}, {"source_id": "S2", "decision": "NO_REVIEW", "claims": []}],
        "claim_verifications": [{"claim_id": "C1", "verdict": "SUPPORTED", "reason": "v"}],
        "candidate_results": [{"source_id": "S1", "status": "VERIFIED_REVIEW", "verified_claims": [claim], "blocked_count": 0},
                              {"source_id": "S2", "status": "NO_REVIEW", "verified_claims": [], "blocked_count": 0}],
    }


def run(name="R", version=6):
    cases = [case("a", "direct", version >= 6), case("b", "clean", version >= 6)]
    for c in cases:
        c["run_id"] = name
    return {"run_id": name, "experiment_id": f"experiment-v{version}", "provider": "p", "model": "m", "embedding_model": "e", "cases": cases,
            "configuration": {"top_k": 2, "embedding_index_fingerprint": PRINT, "identifier_index_fingerprint": PRINT},
            "provenance": {"embedding_index_fingerprint": PRINT, "identifier_index_fingerprint": PRINT}}


def stored(spark, folder, runs):
    """Run files with the metrics a correct run carries."""
    folder.mkdir()
    for r in runs:
        (folder / f"{r['run_id']}.json").write_text(json.dumps(r, indent=1))
    tables = run_files.tables(run_files.scan_runs(spark, str(folder)))
    for r, m in ((r, m) for m in run_audit.metrics_json(run_audit.recomputed_figures(tables)).collect() for r in runs if r["run_id"] == m.run_id):
        r["metrics"] = json.loads(m.metrics)
        (folder / f"{r['run_id']}.json").write_text(json.dumps(r))
    return str(folder)


def found(spark, path):
    return {(r.run_id, r.case_id, r.source_id, r.violation) for r in run_audit.audit_runs(spark, path, F.lit(2)).collect()}


def test_figures_of_a_small_run(spark, tmp_path):
    path = stored(spark, tmp_path / "runs", [run()])
    metrics = json.loads((tmp_path / "runs" / "R.json").read_text())["metrics"]
    overall = metrics["overall"]
    assert overall["n_cases"] == 2 and overall["eligible_targets"] == overall["final_hits"] == 1 and overall["mean_rank"] == 1
    assert overall["verified"] == 2 and overall["verified_matched"] == 2 and overall["false_alarm_cases"] == 1 and overall["average_expanded_pool_size"] == 3
    assert metrics["benign"]["n_cases"] == 0 and metrics["benign"]["mean_rank"] is None
    assert found(spark, path) == set()


def test_every_planted_fault_is_named(spark, tmp_path):
    """Faults of current and older layouts, one per run, with correct runs between them."""
    def change(name, version, edit):
        r = run(name, version)
        return r, edit

    def arms(r): r["cases"][0]["proposed_candidate_source_ids"] = []
    def role(r): r["cases"][0]["role_traces"][0]["error"] = "simulated"
    def twice(r): r["cases"][0]["final_reviews"] *= 2
    def drift(r): r["cases"][0]["embedding_index_fingerprint"] = "0" * 64
    def no_evidence(r): r["cases"][0]["final_reviews"][0]["evidence"] = "elsewhere"
    def no_verdict(r): r["cases"][0]["role_traces"] = []
    def exposed(r): r["cases"][1]["candidate_results"][1]["verified_claims"] = [r["cases"][1]["candidate_results"][0]["verified_claims"][0]]
    def off(r): r["cases"][0]["candidate_results"][1]["source_id"] = "S9"
    def rejected(r): r["cases"][0]["claim_verifications"][0]["verdict"] = "REJECTED"
    def runtime(r): r["cases"][1]["provider"] = "another"
    def figure(r): r["metrics"]["clean"]["verified"] += 1
    def lost_figure(r): del r["metrics"]["overall"]["mean_rank"]
    def none(r): pass
    plan = [
        ("v5-arms", 5, arms, {("a", None, "arms_differ")}), ("v5-role", 5, role, {("a", None, "role_error")}),
        ("v5-twice", 5, twice, {("a", "S1", "duplicate_review")}), ("v5-drift", 5, drift, {("a", None, "embedding_index")}),
        ("v4-drift", 4, drift, set()), ("v5-evidence", 5, no_evidence, {("a", "S1", "evidence")}), ("v5-verdict", 5, no_verdict, {("a", "S1", "verdict")}),
        ("exposed", 6, exposed, {("b", "S2", "unsupported_claim_exposed"), ("b", "S2", "not_exact"), ("b", "S2", "claim_source"), (None, None, "metrics")}),
        ("off", 6, off, {("a", "S9", "off_docket"), ("a", "S2", "missing_result")}),
        ("rejected", 6, rejected, {("a", "S1", "verdict"), (None, None, "metrics")}),
        ("runtime", 6, runtime, {("b", None, "runtime")}), ("figure", 6, figure, {(None, None, "metrics")}), ("lost", 6, lost_figure, {(None, None, "metrics")}),
        ("v6-fine", 6, none, set()), ("v5-fine", 5, none, set()),
    ]
    runs = [run(name, version) for name, version, _, _ in plan]
    path = stored(spark, tmp_path / "runs", runs)
    for r, (name, _, edit, _) in zip(runs, plan):
        edit(r)
        (tmp_path / "runs" / f"{name}.json").write_text(json.dumps(r))
    want = {(name, *row) for name, _, _, rows in plan for row in rows}
    assert found(spark, path) == want


def test_broken_files_are_reported(spark, tmp_path):
    path = stored(spark, tmp_path / "runs", [run("fine"), run("lone")])
    folder = tmp_path / "runs"
    whole = (folder / "fine.json").read_text()
    (folder / "cut.json").write_text(whole[: len(whole) // 2])
    (folder / "empty.json").write_text("")
    (folder / "text.json").write_text("not a run")
    (folder / "kind.json").write_text(json.dumps(run("kind") | {"cases": "many"}))
    (folder / "nameless.json").write_text(json.dumps({k: v for k, v in json.loads(whole).items() if k != "run_id"}))
    (folder / "hollow.json").write_text(json.dumps(json.loads(whole) | {"run_id": "hollow", "cases": []}))
    (folder / "again.json").write_text((folder / "lone.json").read_text())
    unnamed = copy.deepcopy(json.loads(whole)) | {"run_id": "unnamed"}
    del unnamed["cases"][0]["case_id"]
    (folder / "unnamed.json").write_text(json.dumps(unnamed))
    scanned = run_files.scan_runs(spark, path)
    rows = {(r.file.rsplit("/", 1)[1], r.run_id, r.violation) for r in run_files.scan_violations(spark, path, scanned).collect()}
    rows = {r for r in rows if r[2] != "duplicate_run_id"} | {(r[1], r[2]) for r in rows if r[2] == "duplicate_run_id"}
    assert {r for r in rows if r[-1] != "unreadable"} == {
        ("empty.json", None, "empty_file"), ("nameless.json", None, "no_run_id"), ("hollow.json", "hollow", "no_cases"),
        ("unnamed.json", "unnamed", "case_without_id"), ("lone", "duplicate_run_id")}
    assert {r[0] for r in rows if r[-1] == "unreadable"} == {"cut.json", "text.json", "kind.json"}
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST|Malformed"):
        corpus.read_runs(spark, path).collect()


def test_a_run_without_cases_keeps_a_row(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(run("hollow") | {"cases": []}))
    rows = corpus.run_cases(corpus.read_runs(spark, str(tmp_path))).collect()
    assert [(r.stored_run_id, r.case_id) for r in rows] == [("hollow", None)]


def test_manifests_are_compared(spark, tmp_path):
    path = stored(spark, tmp_path / "runs", [run("fine")])
    manifests = spark.createDataFrame([("experiment-v6",)], "experiment_id string").withColumns(
        {other: F.lit(None).cast("string") for other in audit.PROVENANCE_PAIRS.values() if other != "manifest_experiment_id"} | {"manifest_model": F.lit("other")})
    rows = {(r.run_id, r.violation) for r in run_audit.audit_runs(spark, path, F.lit(2), manifests=manifests).collect()}
    assert ("fine", "model") in rows and ("fine", "artifact_store") in rows and ("fine", "embedding_model") in rows
