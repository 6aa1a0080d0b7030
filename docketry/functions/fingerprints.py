"""Fingerprints of sequences and of whole tables.

A ranked sequence (at most the pool size per query) is hashed as one canonical JSON
array. A whole table is hashed as a three-level tree, so that no task ever holds more
than a small bucket of row hashes and the result does not depend on partitioning.
Canonical JSON is Spark's compact form with alphabetical keys and unescaped non-ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import sha256

# Hex digits of the row hash that name a leaf bucket and a middle bucket: 16.7 million
# leaves keep a bucket small at 10^10 rows, and no level has over 4,096 children.
LEAF_DIGITS = 6
MIDDLE_DIGITS = 3


def row_sha(columns: list[str]) -> Column:
    """Hash of one row; nulls keep their place and differ from empty strings."""
    fields = [
        F.concat(F.lit("v"), F.col(c).cast("string")) for c in columns
    ]
    return sha256(F.concat_ws("\x1f", *[F.coalesce(f, F.lit("n")) for f in fields]))


def exact_number(x: Column) -> Column:
    """A float as text without rounding: ``<53-bit integer>p<power of two>``; equal texts are equal values.

    Scaling by powers of two is exact, and the exponent a logarithm gives is corrected by one where it was rounded.
    """
    value = x.cast("double")
    size = F.abs(value)
    tiny = size < 2.0**-900
    scaled = F.when(tiny, size * 2.0**200).otherwise(size)
    guess = F.floor(F.log2(scaled))
    lead = scaled * F.pow(F.lit(2.0), -guess)
    power = guess + F.when(lead >= 2, 1).when(lead < 1, -1).otherwise(0)
    digits = (F.signum(value) * scaled * F.pow(F.lit(2.0), -power) * 2.0**52).cast("bigint")
    return (
        F.when(x.isNull(), "null").when(F.isnan(value), "nan").when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(size == 0, "0")
        .otherwise(F.concat(digits.cast("string"), F.lit("p"), (power - 52 - F.when(tiny, 200).otherwise(0)).cast("string")))
    )


def _fold(nodes: DataFrame, digits: int, keys: list[str]) -> DataFrame:
    return (
        nodes.groupBy(*keys, F.substring("h", 1, digits).alias("b"))
        .agg(
            sha256(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("node"),
            F.sum("copies").alias("copies"),
        )
        .select(*keys, F.concat("b", "node").alias("h"), "copies")
    )


def _folded(df: DataFrame, columns: list[str], keys: list[str], parts: int | None = None) -> DataFrame:
    """Middle nodes of the hash tree of each group.

    Equal rows are counted before the tree is built, so copies do not pile up in one
    bucket. With ``parts`` rows are dealt to so many tasks before they are counted.
    """
    hashed = df.select(*keys, row_sha(columns).alias("r"))
    dealt = hashed.repartition(parts, *keys, "r") if parts else hashed
    counted = dealt.groupBy(*keys, "r").agg(
        F.count(F.lit(1)).alias("copies")
    )
    leaves = counted.select(
        *keys, F.concat_ws(":", "r", F.col("copies").cast("string")).alias("h"), "copies"
    )
    return _fold(_fold(leaves, LEAF_DIGITS, keys), MIDDLE_DIGITS, keys)


def _tree() -> list[Column]:
    return [
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        sha256(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("fingerprint"),
    ]


def table_fingerprint(df: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """One row (rows, fingerprint) over the multiset of rows of ``df``, counted in ``parts`` tasks where given."""
    return _folded(df, columns, [], parts).agg(*_tree())


def group_fingerprints(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, rows, fingerprint): the same hash for the rows of each group."""
    return _folded(df, columns, list(keys)).groupBy(*keys).agg(*_tree())


def sequence_sha(items: Column) -> Column:
    """Hash of an array of structs whose fields are in alphabetical order."""
    return sha256(F.to_json(items))
