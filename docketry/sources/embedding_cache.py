"""Embedding cache in shared storage: one row per key, whoever writes.

Vectors lie in parts; a part counts once a numbered record names it. The next number goes to one writer only, and a writer that
finds it taken first removes the keys that the faster one has stored. So the first writer of a key wins, no key is
stored twice, and a reader needs neither grouping nor order. Compaction replaces all parts by one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import vectors
from docketry.session import materialise
from docketry.sources import records

SCHEMA = "cache_key string, vec array<double>"
COMMIT = "number bigint, part string, replaces bigint, rows bigint"


class EmbeddingCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _last(self) -> int:
        found = (re.fullmatch(r"(\d{12})\.json", n) for n in records.names(self.spark, f"{self.path}/commits"))
        return max((int(m[1]) for m in found if m), default=0)

    def _parts(self) -> list[str]:
        """Parts that count: the last compaction and what was committed since, or all."""
        if not self._last():
            return []
        commits = self.spark.read.schema(COMMIT).option("mode", "FAILFAST").json(f"{self.path}/commits/*.json").collect()
        base = max((c.number for c in commits if c.replaces is not None), default=0)
        return [c.part for c in sorted(commits) if c.number >= base]

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/parts/{p}" for p in parts])

    def rows(self) -> DataFrame:
        """(cache_key, vec), each key once."""
        return self._read(self._parts())

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Rows as a part that no record names yet, dealt by key so that look-ups find few files."""
        part = uuid.uuid4().hex
        rows.select("cache_key", "vec").repartition("cache_key").sortWithinPartitions("cache_key").write.parquet(f"{self.path}/parts/{part}")
        return part, self.spark.read.schema(SCHEMA).parquet(f"{self.path}/parts/{part}")

    def _commit(self, part: str, stored: DataFrame, seen: int, replaces: int | None = None) -> None:
        record = {"number": seen + 1, "part": part, "replaces": replaces, "rows": stored.count()}
        records.create(self.spark, f"{self.path}/commits/{seen + 1:012d}.json", record)

    def stage(self, rows: DataFrame) -> tuple[str, DataFrame, int]:
        """A part with the keys the cache lacks, and the commit it was compared with."""
        seen = self._last()
        once = rows.filter(F.col("cache_key").isNotNull()).groupBy("cache_key").agg(F.min("vec").alias("vec"))
        part, stored = self._write(once.join(self._read(self._parts()).select("cache_key"), "cache_key", "left_anti"))
        return part, stored, seen

    def commit(self, staged: tuple[str, DataFrame, int]) -> int:
        """Add a staged part; keys that others have committed meanwhile are left out. The number of rows added."""
        part, stored, seen = staged
        while True:
            rows = stored.count()
            if not rows:
                return 0
            try:
                self._commit(part, stored, seen)
                return rows
            except records.Taken:
                # A compaction only repeats what was there; comparing with all parts is right in every case.
                now = self._last()
                there = self._read(self._parts()).join(stored.select("cache_key"), "cache_key", "left_semi")
                if not there.isEmpty():
                    part, stored = self._write(stored.join(there.select("cache_key"), "cache_key", "left_anti"))
                seen = now

    def add(self, rows: DataFrame) -> int:
        """Store ``rows`` (cache_key, vec) whose keys are not there yet; repeating it adds nothing. Rows without a key are left out."""
        return self.commit(self.stage(rows))

    def compact(self) -> int:
        """Replace all parts by one; the number of its rows. Another writer's commit in between makes it start again."""
        while True:
            seen = self._last()
            if not seen:
                return 0
            part, stored = self._write(self._read(self._parts()))
            try:
                self._commit(part, stored, seen, replaces=seen)
                return stored.count()
            except records.Taken:
                continue


def embed_stored(
    texts: DataFrame, cache: EmbeddingCache, provider: Callable[[list[str]], list[list[float]]], model: str, dim: int
) -> DataFrame:
    """``texts`` with ``vec``, through the cache: every row once; null texts keep their row with a null vector."""
    key = vectors.embed_key(model, dim, "document", F.col("text"))
    plan = vectors.embed_plan(texts.filter("text is not null"), cache.rows(), model, dim, "document")
    cache.add(materialise(vectors.embed_missing(plan, provider), "embedded"))
    return texts.withColumn("cache_key", key).join(cache.rows(), "cache_key", "left").drop("cache_key")
