"""Evaluation metrics over runs of cases.

All tables carry run_id and case_id, so many runs are evaluated in one job. Work is
done per case first; group figures are sums of the per-case table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions.scores import safe_rate

CASE = ["run_id", "case_id"]
SPAN = [*CASE, "source_id"]


def is_impact(case_type: Column) -> Column:
    return case_type.isin(*schemas.IMPACT_CASE_TYPES)


def is_control(case_type: Column) -> Column:
    return case_type.isin(*schemas.CONTROL_CASE_TYPES)


def _flag(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select(*SPAN, *more).distinct().withColumn(name, F.lit(True))


# ---- per case ---------------------------------------------------------------------


def target_hits(targets: DataFrame, broad: DataFrame, expanded: DataFrame, docket: DataFrame) -> DataFrame:
    """Gold targets of each case found at each stage, with ranks of the retrieved ones.

    ``eligible`` counts the listed targets, hits count distinct ones.
    """
    listed = targets.groupBy(*SPAN).agg(F.count(F.lit(1)).alias("listed"))
    joined = (
        listed.join(_flag(broad, "b"), SPAN, "left").join(_flag(expanded, "e"), SPAN, "left")
        .join(docket.select(*SPAN, "rank"), SPAN, "left")
    )
    b, e, f = F.coalesce("b", F.lit(False)), F.coalesce("e", F.lit(False)), F.col("rank").isNotNull()
    return joined.groupBy(*CASE).agg(
        F.sum("listed").alias("eligible_targets"),
        F.count_if(b).alias("broad_hits"), F.count_if(e).alias("expanded_hits"),
        F.count_if(f).alias("final_hits"), F.count_if(e & ~b).alias("new_target_hits"),
        F.bool_and(b).alias("broad_complete"), F.bool_and(e).alias("expanded_complete"),
        F.bool_and(f).alias("final_complete"),
        F.sum("rank").alias("rank_sum"), F.sum(1.0 / F.col("rank")).alias("reciprocal_sum"),
    )


def match_slots(claims: DataFrame, slots: DataFrame) -> DataFrame:
    """First gold slot of each claim: same source and impact type, texts nested either way.

    ``claims``: CASE, source_id, claim_no, impact_type, evidence. Claims without a slot
    keep a null claim_slot_id.
    """
    keys = [*SPAN, "impact_type"]
    nested = F.exists("spans", lambda s: F.contains(F.col("evidence"), s) | F.contains(s, F.col("evidence")))
    found = (
        claims.join(slots.select(*keys, "slot_no", "claim_slot_id", "spans"), keys).filter(nested)
        .groupBy(*SPAN, "claim_no").agg(F.min_by("claim_slot_id", "slot_no").alias("claim_slot_id"))
    )
    return claims.join(found, [*SPAN, "claim_no"], "left")


def slot_recall(matched: DataFrame, out: str) -> DataFrame:
    return matched.groupBy(*CASE).agg(F.count_distinct("claim_slot_id").alias(out))


def claim_totals(results: DataFrame, proposed: DataFrame, verified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Proposed, blocked, rejected and verified claims per case, from one aggregation."""
    zero = F.lit(0)

    def part(df: DataFrame, name: str, value: Column) -> DataFrame:
        names = ("proposed", "blocked", "rejected", "verified")
        return df.select(*CASE, *[(value if n == name else zero).cast("bigint").alias(n) for n in names])

    rows = (
        part(proposed, "proposed", F.lit(1))
        .unionByName(part(results, "blocked", F.col("blocked_count")))
        .unionByName(part(verdicts.filter(F.col("verdict") == "REJECTED"), "rejected", F.lit(1)))
        .unionByName(part(verified, "verified", F.lit(1)))
    )
    return rows.groupBy(*CASE).agg(*[F.sum(c).alias(c) for c in ("proposed", "blocked", "rejected", "verified")])


def docket_sizes(results: DataFrame, expanded: DataFrame) -> DataFrame:
    """Expanded pool, docket and verified docket size per case."""
    rows = results.select(
        *CASE, F.lit(0).alias("expanded_size"), F.lit(1).alias("docket_size"),
        (F.col("status") == "VERIFIED_REVIEW").cast("int").alias("verified_docket_size"),
    ).unionByName(expanded.select(
        *CASE, F.lit(1).alias("expanded_size"), F.lit(0).alias("docket_size"), F.lit(0).alias("verified_docket_size"),
    ))
    return rows.groupBy(*CASE).agg(
        *[F.sum(c).alias(c) for c in ("expanded_size", "docket_size", "verified_docket_size")]
    )


def per_case(cases: DataFrame, *parts: DataFrame) -> DataFrame:
    """Left-join per-case parts to ``cases`` (run_id, case_id, case_type)."""
    out = cases.select(*CASE, "case_type")
    for part in parts:
        out = out.join(part, CASE, "left")
    return out


# ---- groups -----------------------------------------------------------------------


def by_group(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates per run: one overall row and one row for each of the five case types.

    Types without a case are present too, through an explicit grid.
    """
    figures = rows.groupingSets([["run_id"], ["run_id", "case_type"]], "run_id", "case_type").agg(
        F.grouping("case_type").alias("is_overall"), *aggregates
    ).withColumn("group", F.when(F.col("is_overall") == 1, "overall").otherwise(F.col("case_type"))).drop(
        "is_overall", "case_type"
    )
    names = F.array(*[F.lit(t) for t in ("overall", *schemas.CASE_TYPES)])
    grid = rows.select("run_id").distinct().select("run_id", F.explode(names).alias("group"))
    return grid.join(figures, ["run_id", "group"], "left")


def total(column: str, where: Column | None = None) -> Column:
    value = F.col(column).cast("bigint") if where is None else F.when(where, F.col(column).cast("bigint"))
    return F.coalesce(F.sum(value), F.lit(0))


def count_where(where: Column) -> Column:
    return F.coalesce(F.count_if(where), F.lit(0))


def _filled(df: DataFrame) -> DataFrame:
    """Counts of an empty group are zero; rates stay null."""
    return df.fillna(0, [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer")])


@dataclass(frozen=True)
class Figures:
    """Aggregates over per-case rows, values derived from them, and the columns to show."""

    aggregates: list[Column]
    derived: dict[str, Column]
    columns: list[str]


def evaluate(rows: DataFrame, *parts: Figures) -> DataFrame:
    """All parts in one pass over the per-case table."""
    grouped = _filled(by_group(rows, *[a for part in parts for a in part.aggregates]))
    derived = {name: value for part in parts for name, value in part.derived.items()}
    return grouped.withColumns(derived).select("run_id", "group", *[c for part in parts for c in part.columns])


def _rate(numerator: str, denominator: str) -> Column:
    return safe_rate(F.col(numerator), F.col(denominator))


def _impact() -> Column:
    return is_impact(F.col("case_type"))


def _control() -> Column:
    return is_control(F.col("case_type"))


def size_figures() -> Figures:
    return Figures(
        [F.count(F.lit(1)).alias("n_cases"), count_where(_impact()).alias("impact_cases"),
         count_where(_control()).alias("control_cases")],
        {}, ["n_cases", "impact_cases", "control_cases"],
    )


def hit_figures() -> Figures:
    hits = ["broad_hits", "expanded_hits", "final_hits", "new_target_hits"]
    rates = {"broad_rate": "broad_hits", "expanded_rate": "expanded_hits", "final_rate": "final_hits", "gain_rate": "new_target_hits"}
    return Figures(
        [total(c, _impact()).alias(c) for c in ("eligible_targets", *hits)],
        {rate: _rate(hit, "eligible_targets") for rate, hit in rates.items()},
        ["eligible_targets", *hits, *rates],
    )


def coverage_figures() -> Figures:
    """Impact cases whose whole gold set is covered; a case without gold is covered."""
    stages = ["broad_complete", "expanded_complete", "final_complete"]
    covered = [count_where(_impact() & F.coalesce(F.col(c), F.lit(True))).alias(c) for c in stages]
    return Figures([*covered, count_where(_impact()).alias("eligible_cases")], {}, [*stages, "eligible_cases"])


def rank_figures() -> Figures:
    return Figures(
        [total("final_hits", _impact()).alias("retrieved_targets"), total("rank_sum", _impact()).alias("rank_total"),
         F.sum(F.when(_impact(), F.col("reciprocal_sum"))).alias("reciprocal_total")],
        {"mean_rank": _rate("rank_total", "retrieved_targets"),
         "mean_reciprocal_rank": _rate("reciprocal_total", "retrieved_targets")},
        ["retrieved_targets", "mean_rank", "mean_reciprocal_rank"],
    )


def recall_figures() -> Figures:
    """Needs eligible_claims, proposed_slots and verified_slots per case."""
    return Figures(
        [total("eligible_claims", _impact()).alias("eligible_claims"), total("proposed_slots").alias("proposed_matched"),
         total("verified_slots").alias("verified_matched")],
        {"proposal_rate": _rate("proposed_matched", "eligible_claims"), "verified_rate": _rate("verified_matched", "eligible_claims")},
        ["eligible_claims", "proposed_matched", "verified_matched", "proposal_rate", "verified_rate"],
    )


def alarm_figures() -> Figures:
    return Figures(
        [count_where(_control() & (F.col("verified") > 0)).alias("false_alarm_cases"),
         count_where(_control()).alias("eligible_controls")],
        {"false_alarm_rate": _rate("false_alarm_cases", "eligible_controls")},
        ["false_alarm_cases", "eligible_controls", "false_alarm_rate"],
    )


def claim_figures() -> Figures:
    names = ["proposed", "blocked", "rejected", "verified"]
    return Figures([total(c).alias(c) for c in names], {}, names)


def selection_figures() -> Figures:
    sizes = ["expanded_size", "docket_size", "verified_docket_size"]
    return Figures(
        [F.count(F.lit(1)).alias("cases"), *[total(c).alias(c) for c in sizes]],
        {"average_expanded_pool_size": _rate("expanded_size", "cases"), "average_final_docket_size": _rate("docket_size", "cases"),
         "average_verified_docket_size": _rate("verified_docket_size", "cases"),
         "candidate_reduction": safe_rate(F.col("docket_size") - F.col("verified_docket_size"), F.col("docket_size"))},
        ["cases", "average_expanded_pool_size", "average_final_docket_size", "average_verified_docket_size", "candidate_reduction"],
    )


def unregistered_figures() -> Figures:
    """Verified claims outside every slot; controls do not count. Needs extra_claims."""
    return Figures([total("extra_claims", _impact()).alias("unregistered")], {}, ["unregistered"])


def extra_claims(verified_matched: DataFrame) -> DataFrame:
    return verified_matched.filter(F.col("claim_slot_id").isNull()).groupBy(*CASE).agg(
        F.count(F.lit(1)).alias("extra_claims"))


def all_figures() -> tuple[Figures, ...]:
    return (
        size_figures(), hit_figures(), coverage_figures(), rank_figures(), recall_figures(), alarm_figures(),
        claim_figures(), selection_figures(), unregistered_figures(),
    )


# ---- older result format ----------------------------------------------------------


def legacy_cases(cases: DataFrame, reviews: DataFrame, targets: DataFrame, proposals: DataFrame) -> DataFrame:
    """Per-case figures of the older format.

    ``cases``: CASE, case_type, retrieval_hit, candidates; ``reviews``: SPAN, status,
    evidence, short_reason; ``proposals``: SPAN, decision.
    """
    verified = F.col("status") == "VERIFIED_REVIEW"
    filled = (F.length("evidence") > 0) & (F.length("short_reason") > 0)
    figures = reviews.groupBy(*CASE).agg(
        F.count_distinct(F.when(verified, F.col("source_id"))).alias("verified_sources"),
        F.count_if(verified).alias("verified_rows"),
        F.count_if(F.col("status") == "REJECTED_UNSUPPORTED").alias("blocked"),
        F.count_if(verified & F.coalesce(filled, F.lit(False))).alias("evidence_complete"),
    )
    kept = targets.select(*SPAN).distinct().join(_flag(reviews.filter(verified), "kept"), SPAN, "left").groupBy(
        *CASE
    ).agg(F.bool_and(F.coalesce("kept", F.lit(False))).alias("targets_kept"))
    proposed = proposals.groupBy(*CASE).agg(F.count_if(F.col("decision") == "REVIEW").alias("proposed"))
    rows = cases.join(figures, CASE, "left").join(kept, CASE, "left").join(proposed, CASE, "left")
    return rows.withColumn("targets_kept", F.coalesce("targets_kept", F.lit(True))).fillna(0)


def legacy_coverage(rows: DataFrame) -> DataFrame:
    impact, control = is_impact(F.col("case_type")), is_control(F.col("case_type"))
    hit = impact & F.col("retrieval_hit")
    grouped = _filled(by_group(
        rows, F.count(F.lit(1)).alias("n_cases"), count_where(hit).alias("hits"), count_where(impact).alias("eligible"),
        count_where(hit & F.col("targets_kept")).alias("successes"),
        count_where(control & (F.col("verified_sources") > 0)).alias("false_alarm_cases"),
        count_where(control).alias("eligible_controls"),
    ))
    return grouped.withColumns({
        "coverage_rate": safe_rate(F.col("hits"), F.col("eligible")),
        "success_rate": safe_rate(F.col("successes"), F.col("hits")),
        "false_alarm_rate": safe_rate(F.col("false_alarm_cases"), F.col("eligible_controls")),
    })


def legacy_added_value(rows: DataFrame) -> DataFrame:
    """Selection figures; the overall row counts verified rows, type rows distinct sources."""
    impact = is_impact(F.col("case_type"))
    grouped = _filled(by_group(
        rows, total("candidates").alias("baseline_candidates"), total("verified_sources").alias("verified_sources"),
        total("verified_rows").alias("verified_rows"), count_where(impact & F.col("targets_kept")).alias("target_retained_cases"),
        total("evidence_complete").alias("evidence_complete"), total("proposed").alias("proposed_reviews"),
        total("blocked").alias("blocked"),
    ))
    shown = F.when(F.col("group") == "overall", F.col("verified_rows")).otherwise(F.col("verified_sources"))
    return grouped.withColumn("final_verified_reviews", shown).withColumn(
        "candidate_reduction_ratio",
        safe_rate(F.col("baseline_candidates") - F.col("final_verified_reviews"), F.col("baseline_candidates")),
    ).drop("verified_sources", "verified_rows")
