"""Comparing runs of the same cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.metrics import CASE, SPAN

# Failure class names.
FAILURES = (
    "retrieval_miss", "expected_target_miss", "mutation_unnecessary_warnings",
    "control_false_alarm", "verifier_pass_error",
)
SAME_FIELDS = (
    "provider", "model", "embedding_model", "embedding_index_fingerprint", "top_k", "fusion", "prompt_hashes",
)
DEFAULT_QUERY_VERSION = "structured-change-v1"


def verifier_support(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Verified reviews backed by a verifier item: SPAN, evidence.

    ``items``: SPAN, supported, verdict, evidence (null evidence matches any).
    """
    yes = items.filter(F.coalesce(F.col("supported"), F.lit(False)) | F.coalesce(F.col("verdict") == "SUPPORTED", F.lit(False)))
    given = yes.select(*SPAN, F.col("evidence").alias("item_evidence")).distinct()
    return (
        reviews.join(given, SPAN)
        .filter(F.col("item_evidence").isNull() | (F.col("item_evidence") == F.col("evidence")))
        .select(*SPAN, "evidence").distinct()
    )


def failure_rows(targets: DataFrame, docket: DataFrame, reviews: DataFrame, items: DataFrame) -> DataFrame:
    """(run_id, case_id, failure, source_id), one row per failure.

    ``docket`` has SPAN and content, ``reviews`` the verified reviews (SPAN, evidence).
    Membership in gold, docket and verified set is folded into one row per span by a
    single aggregation; whether a case has gold at all comes from the same rows.
    """
    def member(df: DataFrame, **flags: bool) -> DataFrame:
        names = ("gold", "in_docket", "verified")
        return df.select(*SPAN, *[F.lit(flags.get(n, False)).alias(n) for n in names])

    flags = (
        member(targets, gold=True).unionByName(member(docket, in_docket=True))
        .unionByName(member(reviews, verified=True))
        .groupBy(*SPAN).agg(*[F.bool_or(n).alias(n) for n in ("gold", "in_docket", "verified")])
    )
    has_gold = targets.select(*CASE).distinct().withColumn("has_gold", F.lit(True))
    known = flags.join(has_gold, CASE, "left").withColumn("has_gold", F.coalesce("has_gold", F.lit(False)))
    gold, verified = F.col("gold"), F.col("verified")
    found = F.array_compact(F.array(
        F.when(gold & ~F.col("in_docket"), F.lit(FAILURES[0])),
        F.when(gold & ~verified, F.lit(FAILURES[1])),
        F.when(verified & ~gold & F.col("has_gold"), F.lit(FAILURES[2])),
        F.when(verified & ~F.col("has_gold"), F.lit(FAILURES[3])),
    ))
    membership = known.select(*CASE, F.explode(found).alias("failure"), "source_id")
    return membership.unionByName(pass_errors(docket, reviews, items))


def pass_errors(docket: DataFrame, reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Verified reviews whose evidence is absent, not exact or not supported."""
    supported = verifier_support(items, reviews).withColumn("ok", F.lit(True))
    exact = F.contains("content", F.col("evidence")) & (F.length("evidence") > 0)
    return (
        reviews.join(docket.select(*SPAN, "content"), SPAN, "left")
        .join(supported, [*SPAN, "evidence"], "left")
        .filter(~(F.coalesce(exact, F.lit(False)) & F.coalesce("ok", F.lit(False))))
        .select(*CASE, F.lit(FAILURES[4]).alias("failure"), "source_id")
    )


def failure_lists(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """Sorted source lists per class and case; cases without failures get empty lists."""
    lists = rows.groupBy(*CASE).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("failure") == f, F.col("source_id")))).alias(f) for f in FAILURES
    ])
    kind = rows.schema["source_id"].dataType.simpleString()
    empty = F.array().cast(f"array<{kind}>")
    return cases.select(*CASE).join(lists, CASE, "left").withColumns(
        {f: F.coalesce(F.col(f), empty) for f in FAILURES}
    )


def target_ranks(targets: DataFrame, docket: DataFrame) -> DataFrame:
    """Docket rank of every expected target, null when it was not retrieved."""
    return targets.select(*SPAN).distinct().join(docket.select(*SPAN, "rank"), SPAN, "left")


def rank_summary(ranks: DataFrame, *keys: str) -> DataFrame:
    def mean(value: Column) -> Column:
        return F.coalesce(F.bround(F.avg(value), 6), F.lit(0.0))

    return ranks.groupBy(*(keys or ("run_id",))).agg(
        F.count(F.lit(1)).alias("targets"), F.count("rank").alias("retrieved"),
        mean(F.col("rank").cast("double")).alias("mean_rank"),
        mean(1.0 / F.col("rank")).alias("mean_reciprocal_rank"),
    )


def run_identity(runs: DataFrame) -> DataFrame:
    """Comparable fields of stored runs; maps become sorted text."""
    config = F.col("configuration")
    return runs.select(
        "run_id", "experiment_id", "provider", "model", "embedding_model",
        F.get_json_object(config, "$.embedding_index_fingerprint").alias("embedding_index_fingerprint"),
        F.get_json_object(config, "$.top_k").alias("top_k"), F.get_json_object(config, "$.fusion").alias("fusion"),
        F.to_json(F.array_sort(F.map_entries("provenance.prompt_hashes"))).alias("prompt_hashes"),
        F.coalesce(F.get_json_object(config, "$.query_version"), F.lit(DEFAULT_QUERY_VERSION)).alias("query_version"),
    )


def run_invariants(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Pairs (baseline_run, variant_run) with the names of broken invariants.

    All fields but the query version must agree; prompt hashes must be present.
    """
    fields = [*SAME_FIELDS, "query_version"]

    def side(role: str) -> DataFrame:
        return runs.select(F.col("run_id").alias(f"{role}_run"), *[F.col(f).alias(f"{role}_{f}") for f in fields])

    joined = pairs.join(side("baseline"), "baseline_run", "left").join(side("variant"), "variant_run", "left")

    def broken(field: str) -> Column:
        same = F.col(f"baseline_{field}").eqNullSafe(F.col(f"variant_{field}"))
        if field == "prompt_hashes":
            same = same & F.col(f"baseline_{field}").isNotNull()
        return F.when(~same, F.lit(field))

    changed = F.col("baseline_query_version").eqNullSafe(F.col("variant_query_version"))
    failed = F.array_compact(F.array(
        *[broken(f) for f in SAME_FIELDS], F.when(changed, F.lit("query_version_changed"))
    ))
    return joined.select("baseline_run", "variant_run", failed.alias("failed"))


# Cases in a bucket of the case list; a run is held against the buckets it lacks something of.
BUCKET_CASES = 1000
# Parts of a run that meet a comparison one by one.
RUN_PARTS = 32


def case_set_difference(run_cases: DataFrame, expected: DataFrame) -> DataFrame:
    """Cases a run lacks or has in excess: run_id, case_id, violation.

    Cases are dealt into buckets of about BUCKET_CASES. Per run and bucket the known cases are
    counted; only incomplete pairs of run and bucket are held against the bucket's cases.
    """
    have = run_cases.select(*CASE).distinct()
    wanted = expected.select("case_id").distinct()
    known = have.join(wanted.withColumn("known", F.lit(True)), "case_id", "left")
    buckets = max(1, -(-wanted.count() // BUCKET_CASES))
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = wanted.select("case_id", bucket)
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("wanted"))
    counted = known.filter("known").groupBy("run_id", bucket).agg(F.count(F.lit(1)).alias("n"))
    every = have.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    incomplete = every.join(sizes, "bucket").join(counted, ["run_id", "bucket"], "left").filter(
        F.coalesce("n", F.lit(0)) < F.col("wanted")).select("run_id", "bucket")
    missing = incomplete.join(dealt, "bucket").select(*CASE).join(have, CASE, "left_anti").select(
        *CASE, F.lit("missing_case").alias("violation"))
    extra = known.filter(F.col("known").isNull()).select(*CASE, F.lit("unknown_case").alias("violation"))
    return missing.unionByName(extra)


def run_delta(pairs: DataFrame, case_results: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per pair: changed candidate sequences, both rank summaries and their difference."""
    summary = rank_summary(ranks)
    # A run of many cases is one key; its cases meet the pairs in parts.
    prints = case_results.select(*CASE, "candidate_fingerprint")

    def side(df: DataFrame, role: str, *columns: str) -> DataFrame:
        return df.select(
            F.col("run_id").alias(f"{role}_run"), *[F.col(c) if c == "case_id" else F.col(c).alias(f"{role}_{c}") for c in columns]
        )

    changed = (
        _in_parts(pairs).join(side(prints, "baseline", "case_id", "candidate_fingerprint").withColumn("part", _part("case_id")), ["baseline_run", "part"])
        .join(side(prints, "variant", "case_id", "candidate_fingerprint"), ["variant_run", "case_id"])
        .groupBy("baseline_run", "variant_run").agg(
            F.count_if(~F.col("baseline_candidate_fingerprint").eqNullSafe(F.col("variant_candidate_fingerprint")))
            .alias("candidate_sequences_changed")
        )
    )
    figures = ("targets", "retrieved", "mean_rank", "mean_reciprocal_rank")
    return (
        changed.join(side(summary, "baseline", *figures), "baseline_run")
        .join(side(summary, "variant", *figures), "variant_run")
        .withColumns({
            "delta_mean_rank": F.bround(F.col("variant_mean_rank") - F.col("baseline_mean_rank"), 6),
            "delta_mean_reciprocal_rank": F.bround(
                F.col("variant_mean_reciprocal_rank") - F.col("baseline_mean_reciprocal_rank"), 6),
        })
    )


def _part(case_id: str) -> Column:
    return F.pmod(F.xxhash64(case_id), F.lit(RUN_PARTS)).cast("int").alias("part")


def _in_parts(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(RUN_PARTS - 1))))


def rank_changes(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Before and after rank of every target: pair, case_id, source_id."""
    before = ranks.select(
        F.col("run_id").alias("baseline_run"), "case_id", "source_id", F.col("rank").alias("baseline_rank"), _part("case_id"))
    after = ranks.select(F.col("run_id").alias("variant_run"), "case_id", "source_id", F.col("rank").alias("variant_rank"))
    return _in_parts(pairs).join(before, ["baseline_run", "part"]).drop("part").join(after, ["variant_run", "case_id", "source_id"])
