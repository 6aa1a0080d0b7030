"""Registered queries of the training-data operators and their SQL statements."""

from __future__ import annotations

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession

from docketry.llm import (
    ann, fingerprint, jaccard, lattice, licenses, lines, manifest, packing, periodic, sharding, simhash, statements, token_counts, toxicity,
)
from docketry.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_rows(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs(table(spark, sf_dir, "documents"), perturb=True)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_token_counts, op3_sentencepiece_encoding, op4_best_fit_packing, op5_simhash_near_dedup, op6_license_scan,
    op7_nearest_neighbours, op8_document_fingerprints, op9_hilbert_sharding, op10_line_dedup,
    op11_periodic_runs, op12_merkle_manifest, op13_jaccard_join,
)}


def _license_sql() -> str:
    known = ", ".join(f"'{sentence}': '{name}'" for name, sentence in licenses.SENTENCES.items())

    def holds(license: str) -> str:
        return " OR ".join(
            f"contains(path, ',{','.join(sequence)},')" for name, sequence in licenses.RULES if name == license
        )

    cases = []
    for license in sorted({name for name, _ in licenses.RULES}):
        condition = f"({holds(license)})"
        for longer, shorter in licenses.REPLACES.items():
            if shorter == license:
                condition += f" AND NOT ({holds(longer)})"
        cases.append(f"CASE WHEN {condition} THEN '{license}' END")
    return f"""
WITH k AS (SELECT MAP {{{known}}} AS names),
s AS (SELECT doc_id, list_transform(regexp_split_to_array(lower(coalesce(text, '')),
        '[.!?;:]+[ \\t\\r]*(?:\\n|\\z)|[.!?;]+[ \\t\\r]+|\\n'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS parts FROM documents),
i AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: names[x]), lambda x: x IS NOT NULL) AS ids FROM s, k),
p AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS path FROM i)
SELECT doc_id, len(ids)::INT AS n_known, array_to_string(ids, ',') AS known,
  concat_ws(',', {', '.join(cases)}) AS licenses FROM p"""


ORACLES = {
    "op11_periodic_runs": statements.periodic(),
    "op12_merkle_manifest": statements.manifest(),
    "op13_jaccard_join": statements.jaccard(),
    "op6_license_scan": _license_sql(),
    "op10_line_dedup": f"""
WITH l AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT source, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
b AS (SELECT c.source, list(line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n >= {lines.MIN_PAGES} AND n / pages > {lines.MAX_RATIO} GROUP BY 1),
d AS (SELECT doc_id, d.source, string_split(text, chr(10)) AS parts,
  list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad, []), x)) AS kept
  FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, coalesce(len(parts), 0)::BIGINT AS n_lines,
  (coalesce(len(parts), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped FROM d""",
}
