"""The embedding cache: the first writer of a key wins, rows are neither multiplied nor lost."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import vectors
from docketry.sources import records
from docketry.sources.embedding_cache import EmbeddingCache, embed_stored


def rows(spark, start, stop, value):
    return spark.range(start, stop).select(F.concat(F.lit("k"), "id").alias("cache_key"), F.array(F.lit(float(value))).alias("vec"))


def held(cache):
    return sorted((r.cache_key, r.vec[0]) for r in cache.rows().collect())


def test_overlapping_writers_leave_one_row_per_key(spark, tmp_path):
    first, second = EmbeddingCache(spark, str(tmp_path)), EmbeddingCache(spark, str(tmp_path))
    assert held(first) == []
    one, two = first.stage(rows(spark, 0, 6, 1)), second.stage(rows(spark, 4, 9, 2))
    assert held(first) == []
    assert second.commit(two) == 5 and first.commit(one) == 4
    want = [(f"k{i}", 1.0 if i < 4 else 2.0) for i in range(9)]
    assert held(first) == held(second) == want
    assert first.add(rows(spark, 0, 9, 3)) == 0 and held(first) == want
    assert first.compact() == 9 and held(second) == want
    assert second.add(rows(spark, 8, 11, 4).union(rows(spark, 9, 10, 5))) == 2
    assert [v for _, v in held(first)][-2:] == [2.0, 4.0] or len(held(first)) == 11


def test_a_compaction_and_a_writer_do_not_lose_each_other(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path))
    cache.add(rows(spark, 0, 3, 1))
    staged = cache.stage(rows(spark, 2, 6, 2))
    cache.compact()
    assert cache.commit(staged) == 3
    assert held(cache) == [(f"k{i}", 1.0 if i < 3 else 2.0) for i in range(6)]


def test_a_part_without_a_record_is_never_read(spark, tmp_path, monkeypatch):
    cache = EmbeddingCache(spark, str(tmp_path))
    with monkeypatch.context() as patch:
        patch.setattr(records, "create", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            cache.add(rows(spark, 0, 3, 1))
    assert held(cache) == [] and cache.add(rows(spark, 0, 3, 2)) == 3 and held(cache) == [(f"k{i}", 2.0) for i in range(3)]


def test_null_and_repeated_texts_keep_their_rows(spark, tmp_path):
    calls = []
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "a"), (5, "")], "id int, text string")

    def provider(batch):
        return [[float(len(t))] for t in batch]

    cache = EmbeddingCache(spark, str(tmp_path / "new"))
    got = {r.id: r.vec for r in embed_stored(texts, cache, provider, "m", 1).collect()}
    assert got == {1: [1.0], 2: [2.0], 3: None, 4: [1.0], 5: [0.0]} and not calls
    assert vectors.embed_plan(texts, cache.rows(), "m", 1, "document").count() == 0
    # A file-based cache that holds a key twice neither multiplies nor drops rows.
    path = str(tmp_path / "old")
    vectors.embed_stored(texts, path, provider, "m", 1)
    spark.read.parquet(path).write.mode("append").parquet(str(tmp_path / "twice"))
    spark.read.parquet(path).write.mode("append").parquet(str(tmp_path / "twice"))
    again = vectors.embed_stored(texts, str(tmp_path / "twice"), provider, "m", 1)
    assert sorted(r.id for r in again.collect()) == [1, 2, 3, 4, 5]
