"""Claim validation and review resolution.

Tables: ``docket`` (query_id, source_id, rank, content, start_line, end_line),
``decisions`` (query_id, source_id, decision, claims), ``verdicts`` (query_id, claim_id,
verdict, reason), ``failures`` (query_id, role, error). A docket row holds at most a few
claims, so claims are checked inside the row and only verdicts need a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions import text
from docketry.functions.rows import inline_rows

PAIR = ["query_id", "source_id"]
REVIEWER = "engineering_review"
VERIFIER = "evidence_verifier"
# Wording of exposed records.
MISSING_REASON = "Verifier verdict unavailable; claim withheld."
REASON_NO_REVIEW = "No review need proposed for this Final Docket candidate."
REASON_INSUFFICIENT = "Reviewer reported insufficient evidence."
REASON_WITHHELD = "No unsupported claim or evidence is exposed."
RULE_CLAIM = "Rule-made claim: the change may touch this span."
RULE_VERDICT = "Rule-made verdict."
BAD_EVIDENCE = "THIS SPAN DOES NOT EXIST IN THE SOURCE"
NO_CLAIMS = f"array<{schemas.CLAIM_DRAFT}>"


# ---- expressions ------------------------------------------------------------------


def in_range(claim: Column, start_line: Column, end_line: Column) -> Column:
    return (claim["evidence_start_line"] >= start_line) & (claim["evidence_end_line"] <= end_line)


def selected_lines(lines: Column, span_start: Column, first: Column, last: Column) -> Column:
    """Lines ``first``..``last`` of a span that starts at ``span_start``, joined by LF."""
    count = F.greatest(last - first + 1, F.lit(0))
    return F.array_join(F.slice(lines, F.greatest(first - span_start + 1, F.lit(1)), count), "\n")


def claim_id(rank: Column, ordinal: Column) -> Column:
    return F.format_string("CLM-%02d-%02d", rank, ordinal)


def first_line(content: Column, start_line: Column) -> Column:
    """First non-blank line, trimmed, with its number; else the whole content."""
    numbered = F.transform(
        text.split_lines(content),
        lambda l, i: F.struct(text.strip(l).alias("evidence"), (start_line + i).cast("int").alias("line")),
    )
    found = F.get(F.filter(numbered, lambda x: F.length(x["evidence"]) > 0), F.lit(0))
    return F.coalesce(
        found, F.struct(content.alias("evidence"), start_line.cast("int").alias("line"))
    )


def evidence_line(content: Column, evidence: Column, start_line: Column) -> Column:
    """Line number at which ``evidence`` first occurs; null when it does not."""
    at = F.position(evidence, content)
    before = F.substring(content, F.lit(1), at - 1)
    return F.when(at > 0, (start_line + text.count_newlines(before)).cast("int"))


# ---- reviewer stage ---------------------------------------------------------------


def decisions_per_source(decisions: DataFrame) -> DataFrame:
    """Decision count and one decision per (query, source); used only where the count is 1."""
    return decisions.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("decision_count"),
        F.first("decision").alias("decision"), F.first("claims").alias("claims"),
    )


def decision_cardinality(docket: DataFrame, decisions: DataFrame) -> DataFrame:
    """Docket rows with their decision and the schema stage that blocks them, if any."""
    joined = docket.join(decisions_per_source(decisions), PAIR, "left")
    n = F.coalesce("decision_count", F.lit(0))
    return joined.withColumns({
        "decision_count": n,
        "schema_stage": F.when(n == 0, "schema_missing_source").when(n > 1, "schema_duplicate_source"),
        "decision": F.when(n == 1, F.col("decision")),
        "claims": F.when((n == 1) & (F.col("decision") == "REVIEW"), F.col("claims")),
    })


def off_docket(docket: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queries whose reviewer decided on a source outside the docket."""
    return decisions.select(*PAIR).join(docket.select(*PAIR), PAIR, "left_anti").select(
        "query_id"
    ).distinct()


def role_flags(failures: DataFrame) -> DataFrame:
    """One row per query with a role error."""
    return failures.filter(F.col("error").isNotNull()).groupBy("query_id").agg(
        F.bool_or(F.col("role") == REVIEWER).alias("reviewer_failed"),
        F.bool_or(F.col("role") == VERIFIER).alias("verifier_failed"),
    )


def checked_claims(rows: DataFrame) -> DataFrame:
    """Add ``checked``: every draft with ordinal, claim id and blocking stage (or null)."""
    lines = text.split_lines(F.col("content"))

    def check(claim: Column, i: Column) -> Column:
        exact = F.contains(
            selected_lines(F.col("lines"), F.col("start_line"), claim["evidence_start_line"], claim["evidence_end_line"]),
            claim["evidence_exact_text"],
        )
        stage = F.when(
            ~in_range(claim, F.col("start_line"), F.col("end_line")), "deterministic_line_range"
        ).when(~exact, "deterministic_exact_span")
        ordinal = (i + 1).cast("int")
        return F.struct(
            ordinal.alias("ordinal"), claim_id(F.col("rank"), ordinal).alias("claim_id"), stage.alias("stage"),
            *[claim[f].alias(f) for f in (
                "impact_type", "impact_claim", "evidence_exact_text", "evidence_start_line", "evidence_end_line")],
        )

    claims = F.coalesce("claims", F.array().cast(NO_CLAIMS))
    needed = F.when(F.size(claims) > 0, lines).otherwise(text.empty_strings())
    return rows.withColumn("lines", needed).withColumn("checked", F.transform(claims, check)).drop("lines")


def validate(docket: DataFrame, decisions: DataFrame, failures: DataFrame) -> DataFrame:
    """Docket rows with checked claims, pre-verifier stages and preliminary status.

    A query whose reviewer failed keeps no decision: all its rows are blocked.
    """
    flags = role_flags(failures)
    rows = decision_cardinality(docket, decisions).join(flags, "query_id", "left").withColumns({
        "reviewer_failed": F.coalesce("reviewer_failed", F.lit(False)),
        "verifier_failed": F.coalesce("verifier_failed", F.lit(False)),
    })
    failed = F.col("reviewer_failed")
    rows = rows.withColumns({
        "decision": F.when(failed, "INSUFFICIENT_EVIDENCE").otherwise(F.col("decision")),
        "claims": F.when(~failed, F.col("claims")),
        "schema_stage": F.when(~failed, F.col("schema_stage")),
    })
    rows = checked_claims(rows)
    found = F.array_compact(F.concat(
        F.array("schema_stage"), F.transform("checked", lambda c: c["stage"]),
        F.array(F.when(failed, F.lit("engineering_review_provider"))),
    ))
    stages = F.col("stages")
    return rows.withColumn("stages", found).withColumns({
        "prelim_status": F.when(F.size(stages) > 0, "BLOCKED")
        .when(F.col("decision") == "NO_REVIEW", "NO_REVIEW")
        .when(F.col("decision") == "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE")
        .otherwise("BLOCKED"),
        "blocked_count": F.size(stages),
        "blocked_stages": F.array_distinct(stages),
    })


def valid_claims(validated: DataFrame) -> DataFrame:
    """Claims that passed the deterministic checks, one row each."""
    good = F.filter("checked", lambda c: c["stage"].isNull())
    return inline_rows(validated, good, "query_id", "source_id", "rank", "verifier_failed").drop("stage")


# ---- verifier stage ---------------------------------------------------------------


def effective_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each valid claim with exactly one verdict; anything else becomes MISSING."""
    counted = verdicts.groupBy("query_id", "claim_id").agg(
        F.count(F.lit(1)).alias("verdict_count"), F.first("verdict").alias("given"),
        F.first("reason").alias("given_reason"),
    )
    n = F.coalesce("verdict_count", F.lit(0))
    failed = F.col("verifier_failed")
    stage = (
        F.when(failed, "evidence_verifier_provider")
        .when(n > 1, "verifier_duplicate_verdict").when(n == 0, "verifier_missing_verdict")
    )
    return claims.join(counted, ["query_id", "claim_id"], "left").withColumn("verdict_stage", stage).withColumns({
        "verdict": F.when(F.col("verdict_stage").isNull(), F.col("given")).otherwise("MISSING"),
        "reason": F.when(F.col("verdict_stage").isNull(), F.col("given_reason")).otherwise(MISSING_REASON),
        "verdict_count": n,
    }).drop("given", "given_reason")


def verified_claims(effective: DataFrame) -> DataFrame:
    return effective.filter(F.col("verdict") == "SUPPORTED").withColumnRenamed("reason", "verifier_reason")


def candidate_results(validated: DataFrame, effective: DataFrame) -> DataFrame:
    """Final status per docket row. Groups are a row's own claims, at most three."""
    verified = F.struct(
        "ordinal", "claim_id", "source_id", "impact_type", "impact_claim", "evidence_exact_text",
        "evidence_start_line", "evidence_end_line", F.col("reason").alias("verifier_reason"),
    )
    per_row = effective.groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.when(F.col("verdict") == "SUPPORTED", verified))).alias("v"),
        F.array_sort(F.collect_list(F.struct("ordinal", "verdict", "verdict_stage"))).alias("o"),
    )
    review = (F.col("decision") == "REVIEW") & ~F.col("reviewer_failed")
    joined = validated.join(per_row, PAIR, "left")
    joined = joined.withColumns({
        "verified_claims": F.transform(
            F.coalesce("v", F.array().cast("array<" + schemas.VERIFIED_CLAIM.replace("STRUCT<", "STRUCT<ordinal:INT, ", 1) + ">")),
            lambda c: c.dropFields("ordinal"),
        ),
        "verifier_verdicts": F.coalesce(F.transform("o", lambda x: x["verdict"]), text.empty_strings()),
        "late": F.coalesce(
            F.array_compact(F.transform("o", lambda x: x["verdict_stage"])), text.empty_strings()
        ),
    })
    blocked = F.col("blocked_count") + F.size("late")
    rejected = (F.size("verifier_verdicts") > 0) & F.forall("verifier_verdicts", lambda v: v == "REJECTED")
    status = (
        F.when(~review | F.col("decision").isNull(), F.col("prelim_status"))
        .when(F.size("verified_claims") > 0, "VERIFIED_REVIEW")
        .when(blocked > 0, "BLOCKED").when(rejected, "NO_SUPPORTED_CLAIM").otherwise("NONE")
    )
    none = F.col("status") == "NONE"
    return (
        joined.withColumn("status", status)
        .withColumns({
            "blocked_count": (blocked + F.when(none, 1).otherwise(0)).cast("int"),
            "blocked_stages": F.concat(
                "blocked_stages", "late",
                F.when(none, F.array(F.lit("no_valid_review_claim"))).otherwise(text.empty_strings()),
            ),
            "status": F.when(none, "BLOCKED").otherwise(F.col("status")),
        })
        .drop("v", "o", "late", "stages")
    )


def overall_status(results: DataFrame, off_docket_queries: DataFrame) -> DataFrame:
    """One row per query: overall_status and partial."""
    flagged = off_docket_queries.select("query_id", F.lit(True).alias("off_docket"))
    grouped = results.groupBy("query_id").agg(
        F.bool_or(F.col("status") == "VERIFIED_REVIEW").alias("has_verified"),
        F.bool_or(F.col("status").isin("BLOCKED", "INSUFFICIENT_EVIDENCE")).alias("open_row"),
        F.bool_or("reviewer_failed").alias("reviewer_failed"),
        F.bool_or(F.col("reviewer_failed") | F.col("verifier_failed")).alias("role_error"),
    ).join(flagged, "query_id", "left")
    outside = F.coalesce("off_docket", F.lit(False)) & ~F.col("reviewer_failed")
    open_query = F.col("open_row") | F.col("role_error") | outside
    return grouped.select(
        "query_id",
        F.when(F.col("has_verified"), "REVIEW_REQUIRED").when(open_query, "INCONCLUSIVE")
        .otherwise("NO_SUPPORTED_REVIEW").alias("overall_status"),
        (F.col("has_verified") & open_query).alias("partial"),
    )


def resolve(docket: DataFrame, decisions: DataFrame, verdicts: DataFrame, failures: DataFrame
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidate results, effective verdicts, overall status per query)."""
    return resolve_validated(validate(docket, decisions, failures), docket, decisions, verdicts)


def resolve_validated(validated: DataFrame, docket: DataFrame, decisions: DataFrame, verdicts: DataFrame
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`resolve`, from validated rows, which are read twice; nothing needs their content any more."""
    effective = effective_verdicts(valid_claims(validated), verdicts)
    results = candidate_results(validated, effective)
    return results, effective, overall_status(results, off_docket(docket, decisions))


def retrieval_hit(queries: DataFrame, targets: DataFrame, docket: DataFrame) -> DataFrame:
    """Are all expected targets in the docket? True when nothing is expected."""
    found = targets.select(*PAIR).distinct().join(
        docket.select(*PAIR, F.lit(True).alias("present")), PAIR, "left"
    ).groupBy("query_id").agg(F.bool_and(F.coalesce("present", F.lit(False))).alias("hit"))
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("hit", F.lit(True)).alias("retrieval_hit")
    )


# ---- rule-based reviewer and verifier ---------------------------------------------


def first_evidence(cases: DataFrame) -> DataFrame:
    """Evidence text and impact type a case expects of a source: first slot, else evidence."""
    slots = cases.select(
        F.col("id").alias("query_id"), F.posexplode("expected_claims").alias("no", "s")
    ).select("query_id", "s.source_id", "no", F.col("s.impact_type").alias("impact_type"),
             F.get("s.acceptable_exact_evidence_spans", F.lit(0)).alias("evidence"), F.lit(0).alias("tier"))
    listed = cases.select(
        F.col("id").alias("query_id"), F.posexplode("expected_evidence_by_target").alias("no", "e")
    ).select("query_id", "e.source_id", "no", F.lit(None).cast("string").alias("impact_type"),
             F.get("e.spans", F.lit(0)).alias("evidence"), F.lit(1).alias("tier"))
    return slots.unionByName(listed).groupBy(*PAIR).agg(
        F.min_by("evidence", F.struct("tier", "no")).alias("expected_evidence"),
        F.min_by("impact_type", F.struct("tier", "no")).alias("expected_impact"),
    )


def rule_decisions(docket: DataFrame, targets: DataFrame, evidence: DataFrame,
                   inject_query: object = None, live: bool = False, live_outcome: str = "no_review") -> DataFrame:
    """Deterministic decisions: gold rows get REVIEW with one claim, others NO_REVIEW.

    ``live`` marks queries without gold, ruled by ``live_outcome`` on their first row.
    ``inject_query`` gets one bad claim on its best-ranked row that is no target.
    """
    if live_outcome not in ("no_review", "review", "inconclusive", "rejected"):
        raise ValueError("unknown live outcome")
    rows = (
        docket.join(targets.select(*PAIR).distinct().withColumn("target", F.lit(True)), PAIR, "left")
        .join(evidence, PAIR, "left").withColumn("target", F.coalesce("target", F.lit(False)))
    )
    if inject_query is None:
        rows = rows.withColumn("inject", F.lit(False))
    else:
        first = rows.filter((F.col("query_id") == F.lit(inject_query)) & ~F.col("target")).agg(
            F.min("rank").alias("r")
        ).scalar()
        rows = rows.withColumn(
            "inject", F.coalesce((F.col("query_id") == F.lit(inject_query)) & (F.col("rank") == first) & ~F.col("target"), F.lit(False))
        )
    lead = F.lit(live) & (F.col("rank") == 1)
    live_review = lead & F.lit(live_outcome in ("review", "rejected"))
    unsure = lead & F.lit(live_outcome == "inconclusive")
    opening = first_line(F.col("content"), F.col("start_line"))
    text_used = F.coalesce("expected_evidence", F.col("opening.evidence"))
    line = F.coalesce(
        evidence_line(F.col("content"), F.col("expected_evidence"), F.col("start_line")), F.col("opening.line")
    )
    shown = F.when(F.col("inject"), F.lit(BAD_EVIDENCE)).otherwise(text_used)
    impact = F.when(live_review, F.lit("IMPLEMENTATION_IMPACT")).otherwise(
        F.coalesce("expected_impact", F.lit("IMPLEMENTATION_IMPACT"))
    )
    claim = F.struct(
        impact.alias("impact_type"), F.lit(RULE_CLAIM).alias("impact_claim"),
        shown.alias("evidence_exact_text"), line.alias("evidence_start_line"),
        (line + text.count_newlines(shown)).cast("int").alias("evidence_end_line"),
    )
    review = ~unsure & (live_review | F.col("inject") | F.col("target"))
    return rows.withColumn("opening", opening).select(
        *PAIR,
        F.when(unsure, "INSUFFICIENT_EVIDENCE").when(review, "REVIEW").otherwise("NO_REVIEW").alias("decision"),
        F.when(review, F.array(claim)).otherwise(F.array().cast(NO_CLAIMS)).alias("claims"),
    )


def rule_verdicts(claims: DataFrame, rejected: bool = False) -> DataFrame:
    return claims.select(
        "query_id", "claim_id", F.lit("REJECTED" if rejected else "SUPPORTED").alias("verdict"),
        F.lit(RULE_VERDICT).alias("reason"),
    )


# ---- projections ------------------------------------------------------------------


def legacy_projection(results: DataFrame) -> DataFrame:
    """Four-value review rows of the older result format."""
    status, first = F.col("status"), F.get("verified_claims", F.lit(0))
    verified = status == "VERIFIED_REVIEW"
    known = status.isin("VERIFIED_REVIEW", "NO_REVIEW", "INSUFFICIENT_EVIDENCE")
    return results.select(
        *PAIR, "rank",
        F.when(known, status).otherwise("REJECTED_UNSUPPORTED").alias("status"),
        F.when(verified, first["evidence_exact_text"]).alias("evidence"),
        F.when(verified, first["impact_claim"]).when(status == "NO_REVIEW", REASON_NO_REVIEW)
        .when(status == "INSUFFICIENT_EVIDENCE", REASON_INSUFFICIENT).otherwise(REASON_WITHHELD).alias("short_reason"),
        F.when(verified, first["verifier_reason"]).alias("verifier_reason"),
        F.when(~known, F.coalesce(F.get("blocked_stages", F.lit(0)), F.lit("independent_verifier_rejected"))).alias("blocked_stage"),
    )


def result_seal(results: DataFrame, overall: DataFrame, seals: DataFrame) -> DataFrame:
    """Hash of each query's result; ``seals`` has the docket and identifier-index hashes.

    A docket has at most ten rows, which bounds the collected list.
    """
    item = F.struct(
        "rank",
        F.struct("blocked_count", "blocked_stages", F.col("source_id").cast("string").alias("source_id"),
                 "status", "verified_claims", "verifier_verdicts").alias("r"),
    )
    listed = results.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("candidate_results")
    )
    return listed.join(overall, "query_id").join(seals, "query_id").select(
        "query_id",
        text.canonical_sha(
            case_id=F.col("query_id").cast("string"), candidate_results=F.col("candidate_results"),
            final_docket_fingerprint=F.col("final_docket_fingerprint"),
            identifier_index_fingerprint=F.col("identifier_index_fingerprint"),
            overall_status=F.col("overall_status"), partial=F.col("partial"),
        ).alias("seal"),
    )


def decision_log(results: DataFrame) -> DataFrame:
    """One record per docket row and one per verified claim; ids and statuses only."""
    shown = F.when(F.size("verified_claims") > 0, F.lit("SUPPORTED")).otherwise(
        F.get("verifier_verdicts", F.lit(0))
    )
    rows = results.select(
        F.lit("decision_recorded").alias("event"), F.col("query_id").alias("case_id"),
        F.lit(VERIFIER).alias("role"), "source_id", F.lit(None).cast("string").alias("claim_id"),
        F.col("status").alias("decision"), shown.alias("verifier_verdict"),
        F.get("blocked_stages", F.lit(0)).alias("blocked_stage"),
    )
    claims = results.select("query_id", "source_id", F.explode("verified_claims").alias("c")).select(
        F.lit("verified_claim_recorded").alias("event"), F.col("query_id").alias("case_id"),
        F.lit(None).cast("string").alias("role"), "source_id", F.col("c.claim_id").alias("claim_id"),
        F.lit(None).cast("string").alias("decision"), F.lit("SUPPORTED").alias("verifier_verdict"),
        F.lit(None).cast("string").alias("blocked_stage"),
    )
    return rows.unionByName(claims)


def docket_summary(results: DataFrame) -> DataFrame:
    """Per query: verified rows, withheld rows with their claims and stages, and the row to open first."""
    priority = F.when(F.col("status") == "VERIFIED_REVIEW", 0).when(F.col("status") == "BLOCKED", 1).otherwise(2)
    return results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("docket_size"),
        F.count_if(F.col("status") == "VERIFIED_REVIEW").alias("verified_count"),
        F.sum("blocked_count").alias("blocked_count"),
        F.count_if(F.col("blocked_count") > 0).alias("withheld_rows"),
        # A docket has at most ten rows, which bounds the list.
        F.array_sort(F.collect_list(F.when(
            F.col("blocked_count") > 0, F.struct("rank", "source_id", "blocked_count", "blocked_stages")))).alias("withheld"),
        F.min_by("source_id", F.struct(priority, "rank")).alias("preferred_source_id"),
    )


def live_projection(results: DataFrame) -> DataFrame:
    """What a live caller may see: no incoming text, no raw role output."""
    return results.select(
        *PAIR, "rank", "status", "verified_claims", "blocked_count", "blocked_stages", "verifier_verdicts"
    )
