"""Reading source trees, corpus packages, case files and stored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions import text

# File suffixes that hold source text.
SUFFIXES = (
    ".c", ".cc", ".cpp", ".h", ".hh", ".hpp", ".xml", ".eds", ".md", ".dox", ".txt", ".cmake",
    ".mk", ".in", ".json", ".yaml", ".yml", ".py", ".sh",
)
# Path parts that exclude a file.
EXCLUDED_PARTS = (
    ".git", ".github", "actions", "build", "dist", "target", "generated", "vendor",
    "third_party", "node_modules", "__pycache__",
)
EXCLUDED_NAMES = ("LICENSE", "NOTICE")
# Top folders whose second part belongs to the component name.
COMPONENT_ROOTS = ("apps", "libs", "tools")
DEFAULT_CHANGED_SOURCE = "CTX_README"


# ---- source tree ------------------------------------------------------------------


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, content, bytes) of every file below ``root``."""
    def plain(value: Column) -> Column:
        return F.regexp_replace(value, r"\A[A-Za-z0-9]+:/*", "/")

    base = root.rstrip("/") + "/"
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(
            F.substring(plain(F.col("path")), F.length(plain(F.lit(base))) + 1, F.lit(2**31 - 1)).alias("path"),
            "content", F.col("length").alias("bytes"),
        )
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\A\.*[^.].*(\.[^.]+)\z", 1))


def component(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(
        parts[0].isin(*COMPONENT_ROOTS) & (F.size(parts) > 1), F.concat(parts[0], F.lit("-"), F.get(parts, F.lit(1)))
    ).when(F.length(path) == 0, "bundle").otherwise(parts[0])


def _contains_any(value: Column, *needles: str) -> Column:
    hit = value.contains(needles[0])
    for needle in needles[1:]:
        hit = hit | value.contains(needle)
    return hit


def artifact_type(path: Column, file_suffix: Column) -> Column:
    """Ordered rules; the first that holds decides."""
    lower = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.lower(file_name(path))
    return (
        F.when(_contains_any(lower, "unit-test", "unit_test", "/tests/", "/test/"), "verification")
        .when(lower.contains("requirement") | name.contains("req") | (file_suffix == ".dox"), "requirement")
        .when(
            file_suffix.isin(".xml", ".eds")
            | _contains_any(lower, "msgdef", "interface", "/inc/", "topicid"),
            "interface",
        )
        .when(_contains_any(lower, "/config/", "mission_inc", "platform_inc", "sample_defs"), "configuration")
        .when(file_suffix.isin(".md", ".txt") | lower.contains("/docs/"), "documentation")
        .otherwise("design")
    )


def is_source_path(path: Column) -> Column:
    """Path rules only, so a scan can drop files before their content is read."""
    parts = F.transform(F.split(path, "/"), F.lower)
    return (
        ~F.arrays_overlap(parts, text.lit_array(EXCLUDED_PARTS))
        & ~file_name(path).isin(*EXCLUDED_NAMES)
        & suffix(path).isin(*SUFFIXES)
    )


def source_files(tree: DataFrame) -> DataFrame:
    """Text files of the tree: path, component, suffix, sha256 (raw bytes), bytes, text."""
    body = F.col("content").cast("string")
    return (
        tree.filter(is_source_path(F.col("path")))
        .filter(F.is_valid_utf8(body))
        .select(
            "path", component(F.col("path")).alias("component"),
            suffix(F.col("path")).alias("suffix"), F.sha2("content", 256).alias("sha256"),
            "bytes", text.normalise_newlines(body).alias("text"),
        )
        .filter(F.length(text.strip(F.col("text"))) > 0)
    )


def license_files(tree: DataFrame) -> DataFrame:
    in_git = F.array_contains(F.split("path", "/"), ".git")
    return tree.filter(file_name(F.col("path")).startswith("LICENSE") & ~in_git).select(
        "path", F.sha2("content", 256).alias("sha256")
    )


def inventory(objects: DataFrame) -> DataFrame:
    """Object count and total bytes of a frozen input; none at all is a violation."""
    return objects.agg(
        F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    ).withColumn("violation", F.when(F.col("objects") == 0, F.lit("no_frozen_inputs")))


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What an upload would do per object: new, identical or conflicting."""
    there = remote.select("path", F.col("sha256").alias("remote_sha256"))
    return local.select("path", "sha256").join(there, "path", "left").select(
        "path", "sha256", "remote_sha256",
        F.when(F.col("remote_sha256").isNull(), "new")
        .when(F.col("sha256") == F.col("remote_sha256"), "identical")
        .otherwise("conflict").alias("action"),
    )


def missing_inputs(wanted: DataFrame, local: DataFrame) -> DataFrame:
    return wanted.select("path").distinct().join(local.select("path"), "path", "left_anti")


# ---- corpus package ---------------------------------------------------------------


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Spans of a JSON-lines package; a malformed row fails the job."""
    return spark.read.schema(schemas.SPANS).option("mode", "FAILFAST").json(path)


def package_violations(rows: DataFrame, key: str = "source_id", position: str = "position") -> DataFrame:
    """Package rules as (violation, rows): empty, duplicate ids, ids out of order.

    Order is checked by joining each position with the next one, so no global sort or
    single-partition window is needed.
    """
    empty = rows.agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") == 0).select(
        F.lit("empty").alias("violation"), F.lit(1).cast("bigint").alias("rows")
    )
    copies = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
    duplicate = copies.agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 0).select(
        F.lit("duplicate_id").alias("violation"), "rows"
    )
    before = rows.select((F.col(position) + 1).alias(position), F.col(key).alias("before"))
    disorder = (
        rows.join(before, position).filter(F.col(key) < F.col("before"))
        .agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 0)
        .select(F.lit("not_sorted").alias("violation"), "rows")
    )
    return empty.unionByName(duplicate).unionByName(disorder)


def with_positions(rows: DataFrame) -> DataFrame:
    """Dense row positions by file name and place in the file, without moving rows.

    ``rows`` must come straight from files. Spark reads files in an order of its own, so a row is
    placed by its file, the block of the file it was read from and its number within the block. Only
    one count per block meets in one task, a table as long as the number of file splits.
    """
    block = ["_file", "_block"]
    marked = rows.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    sizes = marked.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = marked.join(offsets, block).withColumn("position", F.col("_offset") + F.col("_id") - F.col("_first"))
    return placed.drop(*block, "_id", "_first", "_offset")


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, metadata) of a stored index; ``vectors.audit_vectors`` checks one against the other."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/metadata")


# ---- curated slices ---------------------------------------------------------------


def line_slices(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Spans named by line ranges, with ``violation`` where the range is not valid.

    ``manifest``: source_id, path, start_line, end_line and more; ``files``: path, text.
    """
    lines = files.select("path", text.split_lines(F.col("text")).alias("lines"))
    joined = manifest.join(lines, "path", "left")
    n = F.size("lines")
    violation = (
        F.when(F.col("lines").isNull(), "missing_file")
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > n),
              "invalid_line_range")
    )
    span = F.array_join(
        F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"
    )
    return joined.withColumn("violation", violation).withColumn(
        "content", F.when(F.col("violation").isNull(), span)
    ).drop("lines")


# ---- cases ------------------------------------------------------------------------


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per case; the oldest layout is raised to the current one. A file is one document, or with ``lines`` one per line."""
    document = spark.read.schema(schemas.CASE_FILE).option("multiLine", not lines).json(path)
    case = document.select(
        "experiment_id", "top_k", F.coalesce("schema_version", F.lit(1)).alias("schema_version"),
        F.explode("cases").alias("case"),
    ).select("experiment_id", "top_k", "schema_version", "case.*")
    return upgrade_cases(case)


def upgrade_cases(case: DataFrame) -> DataFrame:
    old = F.col("schema_version") < 2
    evidence = F.col("expected_evidence")
    no_evidence = F.array().cast(schemas.EVIDENCE)
    single = F.array(F.struct(
        evidence["source_id"].alias("source_id"), F.array(evidence["span"]).alias("spans")
    )).cast(schemas.EVIDENCE)
    targets = F.coalesce("expected_review_targets", text.empty_strings())
    changed = F.coalesce(evidence["source_id"], F.get(targets, F.lit(0)), F.lit(DEFAULT_CHANGED_SOURCE))
    return case.withColumns({
        "changed_source_id": F.when(old, changed).otherwise(F.col("changed_source_id")),
        "original_content": F.when(old, F.coalesce("change.old_value", "change_text")).otherwise(F.col("original_content")),
        "changed_content": F.when(old, F.coalesce("change.new_value", "change_text")).otherwise(F.col("changed_content")),
        "expected_evidence_by_target": F.when(
            old, F.when(evidence.isNotNull(), single).otherwise(no_evidence)
        ).otherwise(F.coalesce("expected_evidence_by_target", no_evidence)),
        "expected_review_targets": targets,
        "expected_claims": F.coalesce("expected_claims", F.array().cast(schemas.CLAIM_SLOTS)),
        "basis_source_ids": F.coalesce("basis_source_ids", text.empty_strings()),
    }).drop("expected_evidence")


def gold_targets(cases: DataFrame) -> DataFrame:
    """(case_id, case_type, ordinal, source_id) per expected target."""
    return cases.select(
        F.col("id").alias("case_id"), F.col("type").alias("case_type"),
        F.posexplode("expected_review_targets").alias("ordinal", "source_id"),
    )


def gold_slots(cases: DataFrame) -> DataFrame:
    """(case_id, case_type, slot_no, claim_slot_id, source_id, impact_type, spans)."""
    return cases.select(
        F.col("id").alias("case_id"), F.col("type").alias("case_type"),
        F.posexplode("expected_claims").alias("slot_no", "slot"),
    ).select(
        "case_id", "case_type", "slot_no", "slot.claim_slot_id", "slot.source_id",
        "slot.impact_type", F.col("slot.acceptable_exact_evidence_spans").alias("spans"),
    )


# ---- stored runs ------------------------------------------------------------------


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run documents; a malformed one fails the job. ``run_files.scan_runs`` reports instead what it cannot read."""
    return spark.read.schema(schemas.RUN_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def run_cases(runs: DataFrame) -> DataFrame:
    """One row per case; a run without cases keeps a row whose case fields are null."""
    return runs.select(F.col("run_id").alias("stored_run_id"), F.explode_outer("cases").alias("case")).select(
        "stored_run_id", "case.*"
    )


def run_rows(cases: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows of one nested list of the cases, keyed by run and case, in stored order."""
    return cases.select(
        "stored_run_id", "case_id", *keys, F.posexplode(column).alias("ordinal", "item")
    ).select("stored_run_id", "case_id", *keys, "ordinal", "item.*")


def case_lookup(cases: DataFrame, case_id) -> DataFrame:
    """One published case; an empty result means not found."""
    return cases.filter(F.col("case_id") == F.lit(case_id))


def latest_pointer(pointers: DataFrame, *keys: str) -> DataFrame:
    """Newest pointer per key; equal times resolve to the larger run id."""
    newest = F.max_by(F.struct(*pointers.columns), F.struct("published_at", "run_id")).alias("p")
    grouped = pointers.groupBy(*keys).agg(newest) if keys else pointers.agg(newest)
    return grouped.filter(F.col("p").isNotNull()).select("p.*")
