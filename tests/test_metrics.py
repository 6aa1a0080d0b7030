import pytest
from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators import audit, compare, metrics


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


CASES = [("r", "d1", "direct"), ("r", "d2", "direct"), ("r", "x1", "cross_artifact"), ("r", "c1", "clean"), ("r", "b1", "benign")]


@pytest.fixture()
def run(spark):
    """Two direct cases, one cross-artifact case with a listed-twice target, two controls."""
    keys = "run_id string, case_id string"
    cases = frame(spark, f"{keys}, case_type string", *CASES)
    span = f"{keys}, source_id string"
    targets = frame(spark, span, ("r", "d1", "A"), ("r", "d2", "B"), ("r", "x1", "C"), ("r", "x1", "C"), ("r", "x1", "D"))
    broad = frame(spark, span, ("r", "d1", "A"), ("r", "x1", "C"))
    expanded = frame(spark, span, ("r", "d1", "A"), ("r", "x1", "C"), ("r", "x1", "D"), ("r", "c1", "Z"))
    docket = frame(spark, f"{span}, rank int", ("r", "d1", "A", 2), ("r", "x1", "D", 4), ("r", "c1", "Z", 1))
    results = frame(spark, f"{span}, status string, blocked_count int", ("r", "d1", "A", "VERIFIED_REVIEW", 0), ("r", "x1", "D", "BLOCKED", 2), ("r", "c1", "Z", "VERIFIED_REVIEW", 0))
    claim = f"{span}, claim_no int, impact_type string, evidence string"
    proposed = frame(spark, claim, ("r", "d1", "A", 1, "I", "x = 1;"), ("r", "x1", "D", 1, "I", "y"), ("r", "c1", "Z", 1, "I", "z"), ("r", "c1", "Z", 2, "I", "zz"))
    verified = frame(spark, claim, ("r", "d1", "A", 1, "I", "x = 1;"), ("r", "d1", "A", 2, "I", "other"), ("r", "c1", "Z", 1, "I", "z"))
    verdicts = frame(spark, f"{keys}, verdict string", ("r", "d1", "SUPPORTED"), ("r", "c1", "REJECTED"), ("r", "c1", "SUPPORTED"))
    slots = frame(spark, f"{span}, impact_type string, slot_no int, claim_slot_id string, spans array<string>",
                  ("r", "d1", "A", "I", 1, "late", ["x"]), ("r", "d1", "A", "I", 0, "first", ["nope", "x = 1"]), ("r", "x1", "D", "OTHER", 0, "o", ["y"]))
    matched = metrics.match_slots(verified, slots)
    rows = metrics.per_case(
        cases, metrics.target_hits(targets, broad, expanded, docket),
        slots.groupBy(*metrics.CASE).agg(F.count(F.lit(1)).alias("eligible_claims")),
        metrics.slot_recall(metrics.match_slots(proposed, slots), "proposed_slots"), metrics.slot_recall(matched, "verified_slots"),
        metrics.claim_totals(results, proposed, verified, verdicts), metrics.docket_sizes(results, expanded), metrics.extra_claims(matched))
    figures = metrics.evaluate(rows, *metrics.all_figures())
    return {r.group: r for r in figures.collect()}, matched


def test_every_group_is_present(run):
    assert set(run[0]) == {"overall", *schemas.CASE_TYPES}
    empty = run[0]["semantic"]
    assert empty.n_cases == 0 and empty.eligible_targets == 0 and empty.broad_rate is None and empty.candidate_reduction is None


def test_target_figures(run):
    row = run[0]["overall"]
    # The denominator counts listed targets, hits count distinct ones.
    assert (row.eligible_targets, row.broad_hits, row.expanded_hits, row.final_hits, row.new_target_hits) == (5, 2, 3, 2, 1)
    assert (row.broad_rate, row.final_rate) == (0.4, 0.4)
    assert (row.broad_complete, row.expanded_complete, row.final_complete, row.eligible_cases) == (1, 2, 1, 3)
    assert (row.retrieved_targets, row.mean_rank, row.mean_reciprocal_rank) == (2, 3.0, 0.375)


def test_claim_figures(run):
    row = run[0]["overall"]
    assert (row.eligible_claims, row.proposed_matched, row.verified_matched) == (3, 1, 1)
    assert (row.proposed, row.blocked, row.rejected, row.verified) == (4, 2, 1, 3)
    assert (row.false_alarm_cases, row.eligible_controls, row.false_alarm_rate) == (1, 2, 0.5)
    assert row.unregistered == 1
    assert (row.average_expanded_pool_size, row.average_final_docket_size, row.candidate_reduction) == (0.8, 0.6, 0.333333)


def test_first_slot_wins(run):
    found = {(r.case_id, r.claim_no): r.claim_slot_id for r in run[1].collect()}
    assert found == {("d1", 1): "first", ("d1", 2): None, ("c1", 1): None}


# Published ranks of 13 expected targets in two runs, offline and remote vectors.
GOLDEN = {
    "offline": ([1, 1, 6, 1, 1, 2, 3, 1, 1, 2, 3, 1, 1], [1, 1, 1, 1, 1, 1, 2, 1, 3, 2, 4, 3, 1], (13, 1.846154, 0.75641), (13, 1.692308, 0.762821), (-0.153846, 0.006411)),
    "remote": ([1, 1, 5, 1, 1, 1, 3, None, 3, None, 2, 1, 1], [1, 1, 1, 1, 1, 1, 3, 1, 4, 4, 4, 2, 1], (11, 1.818182, 0.760606), (13, 1.923077, 0.737179), (0.104895, -0.023427)),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_published_comparison(spark, name):
    before, after, want_before, want_after, want_delta = GOLDEN[name]
    rows = [(run, f"c{i}", "T", r) for run, ranks in (("b", before), ("v", after)) for i, r in enumerate(ranks)]
    ranks = frame(spark, "run_id string, case_id string, source_id string, rank int", *rows)
    summary = {r.run_id: (r.targets, r.retrieved, r.mean_rank, r.mean_reciprocal_rank) for r in compare.rank_summary(ranks).collect()}
    assert summary == {"b": (13, *want_before), "v": (13, *want_after)}
    prints = frame(spark, "run_id string, case_id string, candidate_fingerprint string", *[(r, f"c{i}", f"{r if i else 'same'}{i}") for r in "bv" for i in range(18)])
    pairs = frame(spark, "baseline_run string, variant_run string", ("b", "v"))
    delta = compare.run_delta(pairs, prints, ranks).first()
    assert delta.candidate_sequences_changed == 17
    assert (delta.delta_mean_rank, delta.delta_mean_reciprocal_rank) == want_delta


def test_failure_lists_cover_every_case(spark):
    span = "run_id string, case_id string, source_id string"
    targets = frame(spark, span, ("r", "m", "A"), ("r", "m", "B"))
    docket = frame(spark, f"{span}, content string", ("r", "m", "A", "some text"), ("r", "k", "Z", "zed"))
    reviews = frame(spark, f"{span}, evidence string", ("r", "m", "A", "some"), ("r", "m", "Q", "q"), ("r", "k", "Z", ""))
    items = frame(spark, f"{span}, supported boolean, verdict string, evidence string", ("r", "m", "A", None, "SUPPORTED", None), ("r", "k", "Z", True, None, "other"))
    cases = frame(spark, "run_id string, case_id string", ("r", "m"), ("r", "k"), ("r", "quiet"))
    rows = {r.case_id: r for r in compare.failure_lists(cases, compare.failure_rows(targets, docket, reviews, items)).collect()}
    assert rows["m"].retrieval_miss == ["B"] and rows["m"].expected_target_miss == ["B"]
    assert rows["m"].mutation_unnecessary_warnings == ["Q"] and rows["m"].verifier_pass_error == ["Q"]
    assert rows["k"].control_false_alarm == ["Z"] and rows["k"].verifier_pass_error == ["Z"]
    assert all(rows["quiet"][f] == [] for f in compare.FAILURES)


def test_case_sets_and_completion(spark):
    cases = frame(spark, "run_id string, case_id string", ("r", "a"), ("r", "x"), ("s", "a"), ("s", "b"))
    expected = frame(spark, "case_id string", ("a",), ("b",))
    assert {tuple(r) for r in compare.case_set_difference(cases, expected).collect()} == {("r", "b", "missing_case"), ("r", "x", "unknown_case")}
    sizes = frame(spark, "run_id string, expected_cases int", ("r", 2), ("s", 3), ("t", 1))
    assert {r.run_id for r in audit.case_count(sizes, cases).collect()} == {"s", "t"}


def test_null_hash_never_passes(spark):
    manifest = frame(spark, "path string, sha256 string", ("a", "1"), ("b", None), ("c", "3"))
    files = frame(spark, "path string, sha256 string", ("a", "1"), ("b", "2"))
    assert {tuple(r) for r in audit.freeze(manifest, files).collect()} == {("b", "sha256"), ("c", "missing")}
    modules = frame(spark, "path string, url string, commit string, checked_out_commit string", ("m", "u", "1", "1"), ("n", None, "1", "2"))
    assert {tuple(r) for r in audit.submodules(modules).collect()} == {("n", "no_url"), ("n", "commit")}


def test_prompt_and_seal_drift(spark):
    import hashlib

    good = hashlib.sha256(b"do").hexdigest()
    manifest = frame(spark, "role string, sha256 string", ("a", good), ("b", good))
    texts = frame(spark, "role string, instruction string", ("a", "do"), ("b", "changed"), ("c", "new"))
    assert {tuple(r) for r in audit.prompts(manifest, texts).collect()} == {("b", "sha256"), ("c", "role_set")}
    sealed = frame(spark, "path string, generation bigint, sha256 string", ("a", 1, good), ("b", None, "x"))
    frozen = frame(spark, "path string, sha256 string", ("a", good), ("b", good))
    assert {tuple(r) for r in audit.seals(sealed, frozen).collect()} == {("b", "no_generation"), ("b", "sha256")}


def test_pointer_and_arms(spark):
    pointers = frame(spark, schemas.POINTERS, ("r", "e", "runs/r/evaluation.json", 1, "h", "t", "c", "m"), ("s", "e", "runs/x/evaluation.json", 1, "bad", "t", "c", "m"))
    finals = frame(spark, "object_name string, sha256 string", ("runs/r/evaluation.json", "h"), ("runs/x/evaluation.json", "h"))
    runs = frame(spark, "run_id string, experiment_id string, source_commit string, experiment_manifest string", ("r", "e", "c", "m"), ("s", "e", "other", "m"))
    assert {tuple(r) for r in audit.pointer(pointers, finals, runs).collect()} == {("s", "sha256"), ("s", "object_name"), ("s", "source_commit")}
    arms = frame(spark, "run_id string, case_id string, candidate_ids array<string>, baseline_candidate_source_ids array<string>, proposed_candidate_source_ids array<string>",
                 ("r", "a", ["1", "2"], ["1", "2"], ["1", "2"]), ("r", "b", ["1", "2"], ["2", "1"], ["1", "2"]))
    assert [r.case_id for r in audit.legacy_arms(arms).collect()] == ["b"]
    traces = frame(spark, "run_id string, case_id string, role string, error string", ("r", "a", "x", None), ("r", "b", "x", "boom"))
    assert [r.case_id for r in audit.role_errors(traces).collect()] == ["b"]
