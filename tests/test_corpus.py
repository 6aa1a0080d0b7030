import hashlib
import json
import random

import models
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators import chunking
from docketry.sources import corpus, sinks

C_FILE = "\n\n/* head */\nstatic int Do_Work(int a)\n{\n  return a;\n}\n\nvoid Other(void)\n{\n}\n"


@pytest.fixture()
def tree(tmp_path):
    def put(path, data):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("apps/sample/fsw/src/work.c", C_FILE.replace("\n", "\r\n"))
    put("apps/sample/eds/app.xml", '<Package name="P">\n<Entry id="E1" x="1"/>\n</Package>\n')
    put("docs/guide.md", "intro\n# First part\nbody é\n\n## Second!\nmore\n")
    put("apps/sample/unit-test/t.c", "int x;\n")
    put("vendor/skip.c", "int y;\n")
    put("README", "no suffix")
    put("LICENSE", "text")
    put("bad.txt", b"\xff\xfe")
    put("blank.txt", " \n\t\n")
    put("gen/Build/x.c", "int z;\n")
    return tmp_path


def files(spark, root):
    return corpus.source_files(corpus.read_tree(spark, str(root)))


def test_scan_keeps_text_sources_only(spark, tree):
    rows = {r.path: r for r in files(spark, tree).collect()}
    assert set(rows) == {"apps/sample/fsw/src/work.c", "apps/sample/eds/app.xml", "docs/guide.md", "apps/sample/unit-test/t.c"}
    work = rows["apps/sample/fsw/src/work.c"]
    assert work.component == "apps-sample" and "\r" not in work.text
    assert work.sha256 == hashlib.sha256((tree / work.path).read_bytes()).hexdigest()
    licenses = corpus.license_files(corpus.read_tree(spark, str(tree))).collect()
    assert [r.path for r in licenses] == ["LICENSE"]


def test_spans_follow_sections(spark, tree):
    rows = {r.source_id: r for r in chunking.spans(files(spark, tree)).collect()}
    work = "CFS::apps-sample::apps/sample/fsw/src/work.c::"
    # Blank lines ahead of the text are dropped from the content, not from the line numbers.
    first = rows[work + "document::L1-L3"]
    assert first.content == "/* head */" and first.symbol is None and first.type == "design"
    assert rows[work + "Do_Work::L4-L8"].symbol == "Do_Work"
    assert rows[work + "Other::L9-L11"].content == "void Other(void)\n{\n}"
    guide = rows["CFS::docs::docs/guide.md::Second::L5-L6"]
    assert guide.title == "docs: Second!" and guide.type == "documentation"
    assert guide.content_sha256 == hashlib.sha256(guide.content.encode()).hexdigest()
    assert "CFS::apps-sample::apps/sample/eds/app.xml::Entry-E1::L2-L3" in rows
    assert rows["CFS::apps-sample::apps/sample/unit-test/t.c::document::L1-L1"].type == "verification"
    assert chunking.duplicate_ids(chunking.spans(files(spark, tree))).count() == 0


def test_windows_match_model(spark):
    rng = random.Random(3)
    texts = ["\n".join("é" * rng.randint(0, 90) if rng.random() < 0.5 else "x" * rng.randint(0, 700) for _ in range(rng.randint(1, 230))) for _ in range(12)]
    texts += ["y" * 6000, "a\n" * 200]
    df = spark.createDataFrame([(i, t.splitlines()) for i, t in enumerate(texts)], "i int, lines array<string>")
    bounds = chunking.window_bounds(F.transform("lines", F.length), F.transform("lines", F.octet_length))
    got = {r.i: [(w.start, w.stop) for w in r.w] for r in df.select("i", bounds.alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == models.windows(t.splitlines())


def test_blank_window_uses_up_its_part_number(spark):
    body = "\n".join(["x" * 1700] + [" "] * 200 + ["end"])
    df = spark.createDataFrame([("p", "c", ".txt", body)], "path string, component string, suffix string, text string")
    rows = chunking.chunks(chunking.sections(chunking.with_anchors(df))).select("part").collect()
    parts = sorted(r.part for r in rows)
    assert parts[0] == 1 and len(parts) < parts[-1]


def test_package_round_trip_and_violations(spark, tree, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pkg") / "corpus")
    spans = chunking.spans(files(spark, tree))
    sinks.write_corpus(spans, out)
    back = corpus.read_corpus(spark, out)
    assert sorted(back.collect()) == sorted(spans.select(back.columns).collect())
    placed = corpus.with_positions(back)
    assert placed.select("position").distinct().count() == back.count()
    assert corpus.package_violations(placed).count() == 0
    broken = placed.unionByName(placed.filter("position = 0").withColumn("position", F.lit(10**6)))
    assert {r.violation for r in corpus.package_violations(broken).collect()} == {"duplicate_id"}
    swapped = placed.withColumn("position", -F.col("position"))
    assert {r.violation for r in corpus.package_violations(swapped).collect()} == {"not_sorted"}
    assert [r.violation for r in corpus.package_violations(placed.limit(0)).collect()] == ["empty"]


def test_sorted_package_in_files_of_rising_size(spark, tmp_path):
    """Spark reads large files first; positions follow file names all the same."""
    at = 0
    for i, n in enumerate((3, 300, 9000)):
        lines = [json.dumps({"source_id": f"S{at + k:06d}", "content": "x" * 50}) for k in range(n)]
        (tmp_path / f"part-{i}.json").write_text("\n".join(lines))
        at += n
    placed = corpus.with_positions(corpus.read_corpus(spark, str(tmp_path)))
    assert corpus.package_violations(placed).count() == 0
    ends = placed.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()
    assert tuple(ends) == (0, at - 1, at)
    (tmp_path / "part-3.json").write_text(json.dumps({"source_id": "S000000a"}))
    placed = corpus.with_positions(corpus.read_corpus(spark, str(tmp_path)))
    assert [tuple(r) for r in corpus.package_violations(placed).collect()] == [("not_sorted", 1)]


def test_malformed_package_row_is_fatal(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"source_id": "a", "start_line": "x"}\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        corpus.read_corpus(spark, str(tmp_path)).collect()


def test_inventory_and_sync_plan(spark):
    none = spark.createDataFrame([], "bytes bigint")
    assert corpus.inventory(none).first().violation == "no_frozen_inputs"
    local = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    remote = spark.createDataFrame([("b", "2"), ("c", "x")], "path string, sha256 string")
    assert dict(corpus.sync_plan(local, remote).select("path", "action").collect()) == {"a": "new", "b": "identical", "c": "conflict"}
    wanted = spark.createDataFrame([("a",), ("z",)], "path string")
    assert [r.path for r in corpus.missing_inputs(wanted, local).collect()] == ["z"]


CASES_V1 = {
    "experiment_id": "e1", "top_k": 6, "cases": [
        {"id": "A", "type": "direct", "scenario": "s", "change_text": "new text", "expected_review_targets": ["T"],
         "expected_evidence": {"source_id": "S", "span": "x = 1"}, "change": {"old_value": "1", "new_value": None}},
        {"id": "B", "type": "clean", "scenario": "s", "change_text": "same"}]}
CASES_V3 = {
    "schema_version": 3, "experiment_id": "e3", "top_k": 10, "cases": [
        {"id": "C", "type": "direct", "scenario": "s", "change_text": "",
         "incoming_artifact": {"artifact_type": "requirement", "title": None, "subsystem": None, "identifiers": [], "text": "t"},
         "basis_source_ids": ["S"], "expected_review_targets": ["S"],
         "expected_claims": [{"claim_slot_id": "C1", "source_id": "S", "impact_type": "INTERFACE_IMPACT", "acceptable_exact_evidence_spans": ["x"]}],
         "expected_evidence_by_target": [{"source_id": "S", "spans": ["x"]}]}]}


def test_oldest_cases_are_upgraded(spark, tmp_path):
    (tmp_path / "v1.json").write_text(json.dumps(CASES_V1))
    rows = {r.id: r for r in corpus.read_cases(spark, str(tmp_path / "v1.json")).collect()}
    assert rows["A"].changed_source_id == "S" and rows["A"].original_content == "1" and rows["A"].changed_content == "new text"
    assert rows["A"].expected_evidence_by_target[0].spans == ["x = 1"]
    assert rows["B"].changed_source_id == "CTX_README" and rows["B"].expected_review_targets == []


def test_current_cases_explode_to_gold(spark, tmp_path):
    (tmp_path / "v3.json").write_text(json.dumps(CASES_V3))
    cases = corpus.read_cases(spark, str(tmp_path / "v3.json"))
    assert [tuple(r) for r in corpus.gold_targets(cases).collect()] == [("C", "direct", 0, "S")]
    slot = corpus.gold_slots(cases).first()
    assert slot.claim_slot_id == "C1" and slot.spans == ["x"]


def test_events_reject_unlisted_fields(spark):
    raw = spark.createDataFrame([('{"event":"job_started","run_id":"r","timestamp":"t"}',), ('{"event":"x","evidence":"secret"}',), ("not json",)], "body string")
    records, rejected = sinks.split_events(raw)
    line = sinks.event_json(records).first().value
    assert line == '{"event":"job_started","run_id":"r","severity":"INFO","timestamp":"t"}'
    assert sorted(str(r.unexpected) for r in rejected.collect()) == ["None", "['evidence']"]


def test_run_store_never_overwrites_a_final(spark, tmp_path):
    run = spark.createDataFrame([("r1", "c1")], "run_id string, case_id string")
    path = str(tmp_path / "final")
    first = sinks.write_final(run, path).first()
    with pytest.raises(PySparkException):
        sinks.write_final(run, path)
    assert sinks.write_latest(run, str(tmp_path / "latest")).first() == first
    other = run.withColumn("case_id", F.lit("c2"))
    one = sinks.append_checkpoint(run, str(tmp_path / "check")).first()
    two = sinks.append_checkpoint(other, str(tmp_path / "check")).first()
    # Each append is sealed by what it wrote, not by what was there before.
    assert (one.rows, two.rows) == (1, 1) and one.fingerprint == first.fingerprint != two.fingerprint
    assert spark.read.parquet(str(tmp_path / "check")).count() == 2


def test_stored_run_explodes_in_order(spark, tmp_path):
    case = {"case_id": "A", "candidates": [{"source_id": "S2", "rank": 1}, {"source_id": "S1", "rank": 2}],
            "candidate_results": [{"source_id": "S2", "status": "VERIFIED_REVIEW", "verified_claims": [{"claim_id": "CLM-01-01"}]}]}
    (tmp_path / "run.json").write_text(json.dumps({
        "run_id": "r", "configuration": {"top_k": 10, "fusion": {"bm25": 0.5}}, "metrics": {}, "cases": [case],
        "provenance": {"prompt_hashes": {"b": "2", "a": "1"}}}))
    runs = corpus.read_runs(spark, str(tmp_path / "run.json"))
    cases = corpus.run_cases(runs)
    rows = corpus.run_rows(cases, "candidates").select("ordinal", "source_id", "rank").collect()
    assert [tuple(r) for r in rows] == [(0, "S2", 1), (1, "S1", 2)]
    from docketry.operators.compare import run_identity

    identity = run_identity(runs).first()
    assert identity.top_k == "10" and identity.fusion == '{"bm25":0.5}' and identity.query_version == "structured-change-v1"
    assert corpus.case_lookup(cases, "A").count() == 1 and corpus.case_lookup(cases, "Z").count() == 0
    assert schemas.RUN_FILE.startswith("experiment_id")
