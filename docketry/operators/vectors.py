"""Dense vectors: deterministic hash embedding, cached embedding, dot-product top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import scores
from docketry.functions.fingerprints import exact_number, table_fingerprint
from docketry.functions.rows import explode_rows
from docketry.operators import blocks
from docketry.session import materialise

HASH_DIM = 384
MAX_INPUT_BYTES = 2_000
EMBED_BATCH = 100
#: Tokens whose features are hashed together.
BLOCK_TOKENS = 1_000_000


# ---- hash embedding ---------------------------------------------------------------


def hash_features(tokens: Column) -> Column:
    """Tokens followed by adjacent pairs joined with '::'."""
    n = F.size(tokens)
    heads = F.slice(tokens, 1, F.greatest(n - 1, F.lit(0)))
    tails = F.slice(tokens, 2, F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(heads, tails, lambda a, b: F.concat(a, F.lit("::"), b))
    return F.concat(tokens, F.when(n > 1, pairs).otherwise(F.slice(tokens, 1, 0)))


def hash_codes(tokens: Column, dim: int = HASH_DIM) -> Column:
    """Per feature its index and sign bit packed as ``2 * index + (1 if positive)``."""

    def code(feature: Column) -> Column:
        head = F.conv(F.substring(F.sha2(feature, 256), 1, 10), 16, 10).cast("bigint")
        return ((F.shiftright(head, 8) % dim) * 2 + head % 2).cast("int")

    return F.transform(hash_features(tokens), code)


def _packed(digests: Iterator[bytes], dim: int) -> np.ndarray:
    """As :func:`hash_codes`, of sha256 digests."""
    rows = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)
    head = np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.int64)
    return head % dim * 2 + rows[:, 4] % 2


def _signed_counts(tokens: pa.ListArray, dim: int) -> np.ndarray:
    """Signed feature counts of a block of rows; each distinct token and pair of the block is hashed once."""
    n = len(tokens)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    known = tokens.flatten().dictionary_encode()
    words = known.dictionary.cast(pa.binary()).to_pylist()
    token = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), sizes)
    inner = row[1:] == row[:-1]
    which, pairs = pd.factorize(token[:-1][inner] * len(words) + token[1:][inner])
    heads = [word + b"::" for word in words]
    firsts, seconds = (part.tolist() for part in np.divmod(pairs, max(len(words), 1)))
    codes = np.concatenate([
        _packed((sha256(word).digest() for word in words), dim)[token],
        _packed((sha256(heads[a] + words[b]).digest() for a, b in zip(firsts, seconds)), dim)[which],
    ])
    cells = np.concatenate([row, row[1:][inner]]) * dim + codes // 2
    return np.bincount(cells, weights=codes % 2 * 2.0 - 1, minlength=n * dim).reshape(n, dim)


def _blocks(tokens: pa.ListArray) -> Iterator[pa.ListArray]:
    """Runs of rows with about ``BLOCK_TOKENS`` tokens, a longer row alone."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(tokens):
        before = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, before + BLOCK_TOKENS, side="right")), at + 1)
        yield tokens.slice(at, stop - at)
        at = stop


def hash_vectors(tokens: Column, dim: int = HASH_DIM) -> Column:
    """Signed feature counts as a dense row. Counts are small integers, exact in float."""

    @F.arrow_udf("array<float>")
    def kernel(batch: pa.Array) -> pa.Array:
        dense = [_signed_counts(part, dim).astype(np.float32) for part in _blocks(batch)]
        flat = np.concatenate(dense).ravel() if dense else np.zeros(0, dtype=np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim), pa.array(flat))

    return kernel(tokens)


def hash_embed(tokens: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """Add ``vec`` (integer counts) and ``norm``; the unit vector is vec / norm.

    Features repeat, so they are hashed in Arrow batches, each distinct one of a block once. Dot products of counts
    are exact in any summation order, so rankings do not depend on partitioning. A zero vector gets norm 1 and stays zero, a null list gives a zero vector.
    """
    dense = tokens.withColumn("vec", hash_vectors(F.col("tokens"), dim))
    norm = scores.l2_norm(F.col("vec"))
    return dense.withColumn("norm", F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def hash_embed_sparse(tokens: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """(source_id, ix, value) with non-zero entries only, built-in expressions only."""
    codes = explode_rows(tokens, hash_codes(F.col("tokens"), dim), "code", "source_id")
    cells = (
        codes.groupBy("source_id", F.expr("code div 2").alias("ix"))
        .agg(F.sum(F.when(F.col("code") % 2 == 1, 1).otherwise(-1)).alias("count"))
        .filter(F.col("count") != 0)
    )
    norms = cells.groupBy("source_id").agg(
        F.sqrt(F.sum(F.col("count") * F.col("count")).cast("double")).alias("norm")
    )
    return cells.join(norms, "source_id").select(
        "source_id", "ix", (F.col("count") / F.col("norm")).alias("value")
    )


# ---- cached embedding -------------------------------------------------------------


def embed_key(model: str, dim: int, purpose: str, body: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}|{dim}|{purpose}|"), body), 256)


def embed_plan(texts: DataFrame, cache: DataFrame, model: str, dim: int, purpose: str) -> DataFrame:
    """Distinct texts that still need a provider call: (cache_key, text).

    Copies collapse map-side before the shuffle. Queries are never cached, so every
    distinct query text is planned.
    """
    keyed = texts.filter(F.col("text").isNotNull()).select(embed_key(model, dim, purpose, F.col("text")).alias("cache_key"), "text")
    wanted = keyed.groupBy("cache_key").agg(F.min("text").alias("text"))
    if purpose != "document":
        return wanted
    return wanted.join(cache.select("cache_key"), "cache_key", "left_anti")


def embed_missing(
    plan: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH
) -> DataFrame:
    """Call ``provider`` with at most ``batch`` texts at a time inside the tasks."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                vectors = provider(part["text"].tolist())
                if len(vectors) != len(part):
                    raise RuntimeError("embedding response count mismatch")
                if any(len(v) == 0 for v in vectors):
                    raise RuntimeError("embedding response had no values")
                yield pd.DataFrame({"cache_key": part["cache_key"], "vec": vectors})

    return plan.select("cache_key", "text").mapInPandas(call, "cache_key string, vec array<double>")


def embed_cached(
    texts: DataFrame, cache: DataFrame, provider: Callable[[list[str]], list[list[float]]],
    model: str, dim: int, purpose: str,
) -> tuple[DataFrame, DataFrame]:
    """(texts with vec, rows to append to the cache)."""
    fresh = embed_missing(embed_plan(texts, cache, model, dim, purpose), provider)
    known = fresh if purpose != "document" else cache.select("cache_key", "vec").unionByName(fresh)
    keyed = texts.withColumn("cache_key", embed_key(model, dim, purpose, F.col("text")))
    return keyed.join(known.dropDuplicates(["cache_key"]), "cache_key", "left").drop("cache_key"), fresh


def embed_stored(
    texts: DataFrame, cache_path: str, provider: Callable[[list[str]], list[list[float]]], model: str, dim: int
) -> DataFrame:
    """Document texts with their vectors, through a cache kept under ``cache_path``.

    Texts the cache lacks are embedded once and appended before anything is joined, so neither a later
    reading of the result nor another run calls the provider for them again.
    """
    spark = texts.sparkSession
    schema = "cache_key string, vec array<double>"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(cache_path)

    fresh = embed_missing(embed_plan(texts, stored(), model, dim, "document"), provider)
    materialise(fresh, "embedded").write.mode("append").parquet(cache_path)
    keyed = texts.withColumn("cache_key", embed_key(model, dim, "document", F.col("text")))
    return keyed.join(stored().dropDuplicates(["cache_key"]), "cache_key", "left").drop("cache_key")


# ---- audits -----------------------------------------------------------------------


def preflight(vectors: DataFrame, dim: int) -> DataFrame:
    """Per row violations before an index is written: source_id, violation.

    ``vectors`` holds source_id, text (may be null when only vectors are checked), vec.
    """
    return vectors.select(
        "source_id",
        F.explode(F.array_compact(F.array(
            F.when(F.octet_length("text") > MAX_INPUT_BYTES, F.lit("input_too_long")),
            F.when(F.col("vec").isNull(), F.lit("missing_vector")),
            F.when(F.size("vec") != dim, F.lit("dimension_mismatch")),
            F.when(F.exists("vec", lambda x: x.isNull() | F.isnan(x)), F.lit("value_not_finite")),
        ))).alias("violation"),
    )


def vector_summary(vectors: DataFrame) -> DataFrame:
    """One metadata row: counts plus order-free hashes of ids and of (id, vector)."""
    shape = vectors.agg(
        F.count(F.lit(1)).alias("artifact_count"),
        F.coalesce(F.sum(F.size("vec").cast("bigint")), F.lit(0)).alias("value_count"),
    )
    ids = table_fingerprint(vectors, ["source_id"]).select(
        F.col("fingerprint").alias("source_ids_sha256")
    )
    body = vectors.select(
        "source_id",
        F.array_join(F.transform("vec", exact_number), ",").alias("v"),
    )
    values = table_fingerprint(body, ["source_id", "v"]).select(
        F.col("fingerprint").alias("vector_sha256")
    )
    return shape.withColumn("source_ids_sha256", ids.scalar()).withColumn(
        "vector_sha256", values.scalar()
    )


def audit_vectors(vectors: DataFrame, spans: DataFrame, metadata: DataFrame, dim: int) -> DataFrame:
    """Violations of a stored vector index against its metadata row and the spans."""
    expected = table_fingerprint(spans, ["source_id"])
    row = vector_summary(vectors).select(
        *[F.col(c).alias(f"actual_{c}") for c in
          ("artifact_count", "value_count", "source_ids_sha256", "vector_sha256")],
        expected.select("rows").scalar().alias("span_count"),
        expected.select("fingerprint").scalar().alias("span_ids"),
        *[metadata.select(c).scalar().alias(c) for c in
          ("artifact_count", "source_ids_sha256", "vector_sha256")],
    )
    checks = {
        "vector_hash": F.col("actual_vector_sha256").eqNullSafe(F.col("vector_sha256")),
        "artifact_count": F.col("artifact_count").eqNullSafe(F.col("span_count")),
        "source_ids": (F.col("source_ids_sha256").eqNullSafe(F.col("span_ids")))
        & (F.col("actual_source_ids_sha256").eqNullSafe(F.col("span_ids"))),
        "value_count": F.col("actual_value_count").eqNullSafe(F.col("span_count") * dim),
    }
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return row.select(F.explode(failed).alias("violation"))


def audit_index_metadata(metadata: DataFrame, model: str, dim: int) -> DataFrame:
    """Violations of a stored index's metadata against the model and dimension a query needs."""
    ok = {"model": F.col("model").eqNullSafe(F.lit(model)), "dimension": F.col("dimension").eqNullSafe(F.lit(dim))}
    failed = F.array_compact(F.array(*[F.when(~good, F.lit(name)) for name, good in ok.items()]))
    return metadata.select(F.explode(failed).alias("violation"))


# ---- similarity -------------------------------------------------------------------


def dot_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` vectors per query by plain dot product: query_id, source_id, score, rank.

    Spans are scored where they lie; each task keeps its own best ``k`` per query, so
    the shuffle carries k rows per query and task and never every pair.
    """
    local = [blocks.top_k(vectors, group, k, "dense") for group in blocks.query_groups(materialise(queries, "queries"))]
    if not local:
        kinds = dict(vectors.dtypes)["source_id"], dict(queries.dtypes)["query_id"]
        return vectors.sparkSession.createDataFrame([], "query_id {1}, source_id {0}, score double, rank int".format(*kinds))
    best = reduce(DataFrame.unionByName, local).select(
        "query_id", "source_id", F.col("embedding_score").alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc(scores.rank_key(F.col("score"))), F.asc("source_id")
    )
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
