"""Incoming artifacts and reviewer output: normalisation and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions import text
from docketry.functions.rows import explode_rows

PROCESSOR_VERSION = "incoming-query-v2-deterministic"


def reasons(**failed: Column) -> Column:
    """Sorted names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(failed[k], F.lit(k)) for k in sorted(failed)]))


def normalise_incoming(raw: DataFrame) -> DataFrame:
    """Trimmed fields plus ``violations``; rows with an empty list are valid."""
    ids = F.coalesce("identifiers", text.empty_strings())
    trimmed = F.filter(F.transform(ids, text.strip), lambda v: F.length(v) > 0)
    body = text.strip(F.col("text"))
    blank_to_null = {
        c: F.when(F.length(text.strip(F.col(c))) > 0, text.strip(F.col(c))) for c in ("title", "subsystem")
    }
    return raw.withColumn("violations", reasons(
        artifact_type=F.coalesce(~F.col("artifact_type").isin(*schemas.ARTIFACT_TYPES), F.lit(True)),
        blank_text=F.coalesce(F.length(body) == 0, F.lit(True)),
        long_text=F.length("text") > schemas.MAX_TEXT,
        long_title=F.length("title") > schemas.MAX_TITLE,
        long_subsystem=F.length("subsystem") > schemas.MAX_SUBSYSTEM,
        many_identifiers=F.size(ids) > schemas.MAX_IDENTIFIERS,
        long_identifier=F.exists(trimmed, lambda v: F.length(v) > schemas.MAX_IDENTIFIER_LENGTH),
    )).withColumns({"text": body, "identifiers": F.array_distinct(trimmed), **blank_to_null})


def process_queries(incoming: DataFrame) -> DataFrame:
    """Normalised artifacts to query_id, extracted_identifiers, query_text, fingerprint.

    ``query_text`` serves scoring only; drop it before any sink.
    """
    ids = F.coalesce("identifiers", text.empty_strings())
    found = incoming.withColumn(
        "extracted_identifiers",
        text.query_identifiers(ids, F.col("title"), F.col("subsystem"), F.col("text")),
    )
    fields = [
        F.col("artifact_type"), F.coalesce("title", F.lit("")), F.coalesce("subsystem", F.lit("")),
        F.array_join(ids, "\n"), F.col("text"),
        F.array_join(F.array_except("extracted_identifiers", ids), "\n"),
    ]
    return found.withColumn("query_text", F.concat_ws("\n", *fields)).select(
        "query_id", F.lit(PROCESSOR_VERSION).alias("processor_version"), "extracted_identifiers",
        "query_text",
        text.canonical_sha(
            processor_version=F.lit(PROCESSOR_VERSION), query_text=F.col("query_text"),
            extracted_identifiers=F.col("extracted_identifiers"),
        ).alias("query_fingerprint"),
    )


def draft_violations(claims: Column) -> Column:
    """Does any claim draft break its field limits?"""
    return F.exists(claims, lambda c: F.coalesce(
        ~c["impact_type"].isin(*schemas.IMPACT_TYPES)
        | ~F.length(c["impact_claim"]).between(1, schemas.MAX_IMPACT_CLAIM)
        | ~F.length(c["evidence_exact_text"]).between(1, schemas.MAX_EVIDENCE)
        | (c["evidence_start_line"] < 1) | (c["evidence_end_line"] < c["evidence_start_line"]),
        F.lit(True),
    ))


def decision_contract(decisions: DataFrame) -> DataFrame:
    """(query_id, source_id, violation) over decisions; a request-level row has no source."""
    claims = F.coalesce("claims", F.array().cast(f"array<{schemas.CLAIM_DRAFT}>"))
    review = F.col("decision") == "REVIEW"
    rows = explode_rows(decisions, reasons(
        unknown_decision=F.coalesce(~F.col("decision").isin(*schemas.DECISIONS), F.lit(True)),
        review_without_claim=review & (F.size(claims) == 0),
        claim_without_review=~review & (F.size(claims) > 0),
        too_many_claims=F.size(claims) > schemas.MAX_CLAIMS,
        draft_limits=draft_violations(claims),
    ), "violation", "query_id", "source_id")
    total = (
        decisions.groupBy("query_id").agg(F.sum(F.size(claims)).alias("claims"))
        .filter(F.col("claims") > schemas.MAX_CLAIMS_PER_REQUEST)
        .select("query_id", F.lit(None).cast(decisions.schema["source_id"].dataType).alias("source_id"),
                F.lit("too_many_request_claims").alias("violation"))
    )
    return rows.unionByName(total)


def verdict_contract(verdicts: DataFrame) -> DataFrame:
    return explode_rows(verdicts, reasons(
        verdict=F.coalesce(~F.col("verdict").isin(*schemas.CURRENT_VERDICTS), F.lit(True)),
        reason_length=F.coalesce(~F.length("reason").between(1, schemas.MAX_REASON), F.lit(True)),
    ), "violation", "query_id", "claim_id")


def enum_violations(df: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """Values outside their domain, counted: (field, value, rows).

    Only offending values survive the filter, so the aggregation stays small.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), (~F.col(c).isin(*v)).alias("bad"))
        for c, v in domains.items()
    ])
    return (
        df.select(F.inline(pairs)).filter("bad").groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def span_integrity(spans: DataFrame, source_files: DataFrame) -> DataFrame:
    """(source_id, violation): content hash, line range, file hash. Null-safe throughout."""
    files = source_files.select("path", F.col("sha256").alias("expected_file_sha256"))
    joined = spans.join(files, "path", "left")
    return explode_rows(joined, reasons(
        content_sha256=~F.col("content_sha256").eqNullSafe(F.sha2("content", 256)),
        line_range=F.coalesce(
            (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), F.lit(True)
        ),
        source_file_sha256=~F.col("source_file_sha256").eqNullSafe(F.col("expected_file_sha256")),
    ), "violation", "source_id")
