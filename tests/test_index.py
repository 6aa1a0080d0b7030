from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry import session
from docketry.functions.fingerprints import exact_number, table_fingerprint
from docketry.operators import index, vectors

CODE = """
#define SAMPLE_MAX 5
CFE_SB_MsgId_t mid = SAMPLE_APP_CMD_MID; SAMPLE_NOOP_CC
SAMPLE_TblHandle = Get_Table(x); uint8_t z; if (SAMPLE_MAX) DoThing (a); Some_Symbol ERROR
<Entry name="Pkt.Id" type='Other' class="no"/> éLatin_t ab
"""


def identifiers(spark, kind, content=CODE, symbol=None):
    df = spark.createDataFrame([("s", kind, symbol, content)], "source_id string, type string, symbol string, content string")
    return {(r.identifier, r.kind) for r in index.typed_identifiers(df).collect()}


def test_kinds_in_order(spark):
    assert identifiers(spark, "design") == {
        ("SAMPLE_MAX", "macro"), ("CFE_SB_MsgId_t", "type"), ("SAMPLE_APP_CMD_MID", "message_id"), ("SAMPLE_NOOP_CC", "command_code"),
        ("SAMPLE_TblHandle", "table"), ("Get_Table", "table"), ("DoThing", "function"), ("Pkt.Id", "eds_xml"), ("Other", "eds_xml")}


def test_kind_depends_on_span_type_and_symbol(spark):
    assert ("Some_Symbol", "symbol") in identifiers(spark, "interface")
    assert identifiers(spark, "verification", "Test_Run UtAssert_True plain", "Test_Run") == {("Test_Run", "test_target"), ("UtAssert_True", "test_target")}
    assert identifiers(spark, "design", "x", "Main_Loop") == {("Main_Loop", "symbol")}
    assert identifiers(spark, "design", "x", "while") == set()
    assert identifiers(spark, "design", "x", "two words") == set()


@pytest.fixture()
def rows(spark):
    data = [("COMMON", "macro", f"s{i}") for i in range(60)] + [("PAIR", k, s) for k in ("macro", "table") for s in ("s1", "s2")]
    data += [("PAIR", "table", "s3"), ("ONE", "macro", "s1")] + [(f"I{n}", "macro", s) for n in range(10) for s in ("s1", "s5")]
    return spark.createDataFrame([(i, k, "global", s) for i, k, s in data], "identifier string, kind string, scope string, source_id string")


def test_eligible_postings_and_seeds(spark, rows):
    got = index.eligible_postings(rows)
    assert {r.identifier for r in got.select("identifier").distinct().collect()} == {"PAIR", *[f"I{n}" for n in range(10)]}
    links = index.identifier_links(got)
    assert {(r.source_id, r.df) for r in links.filter("identifier = 'PAIR'").collect()} == {("s1", 2), ("s2", 2), ("s3", 3)}
    seeds = index.seed_identifiers(links).filter("source_id = 's1'").orderBy("seed_no").collect()
    assert [r.identifier for r in seeds] == [f"I{n}" for n in range(8)]


def test_heavy_entries_are_cut_before_the_join(spark, rows, monkeypatch):
    monkeypatch.setattr(index, "HEAVY_ENTRIES", 3)
    assert index.eligible_postings(rows).filter("identifier = 'COMMON'").count() == 0
    assert index.eligible_postings(rows, 1, 60).filter("identifier = 'COMMON'").count() == 60


def test_index_audit_finds_tampering(spark, rows, tmp_path):
    spans = spark.createDataFrame([(f"s{i}",) for i in range(60)], "source_id string")
    from docketry.sources.corpus import with_positions
    from docketry.sources.sinks import write_index

    path = str(tmp_path / "index")
    write_index(index.index_table(rows), path, *index.ENTRY_KEY, "source_id")
    stored = with_positions(spark.read.parquet(path))
    # All entries are stored, also those above the eligible frequency.
    assert stored.filter("identifier = 'COMMON'").count() == 60
    assert index.audit_index(stored, spans).count() == 0
    assert {r.violation for r in index.audit_index(stored, spans.filter("source_id <> 's3'")).collect()} == {"unknown_source"}
    bad = stored.withColumn("df", F.col("df") + 1)
    assert {r.violation for r in index.audit_index(bad, spans).collect()} == {"df_mismatch"}
    twisted = stored.withColumn("position", -F.col("position"))
    assert {r.violation for r in index.audit_index(twisted, spans).collect()} >= {"postings_not_sorted_unique", "entries_not_ordered"}


def test_cached_embedding(spark):
    def provider(texts):
        if len(texts) > 100:
            raise RuntimeError("batch too large")
        return [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([(f"s{i}", f"text {i % 101}") for i in range(250)], "source_id string, text string").coalesce(1)
    cache = spark.createDataFrame([], "cache_key string, vec array<double>")
    out, fresh = vectors.embed_cached(texts, cache, provider, "m", 2, "document")
    fresh = fresh.persist()
    assert out.count() == 250 and fresh.count() == 101
    assert vectors.embed_plan(texts, fresh, "m", 2, "document").count() == 0
    assert vectors.embed_plan(texts, fresh, "m", 2, "query").count() == 101
    assert vectors.embed_plan(texts, fresh, "other", 2, "document").count() == 101


def test_provider_count_mismatch_is_fatal(spark):
    plan = spark.createDataFrame([("k", "t")], "cache_key string, text string")
    with pytest.raises(Exception, match="count mismatch"):
        vectors.embed_missing(plan, lambda texts: []).collect()
    with pytest.raises(Exception, match="no values"):
        vectors.embed_missing(plan, lambda texts: [[]]).collect()


def test_vector_audit(spark):
    vecs = spark.createDataFrame([(f"s{i}", [float(i), 0.5]) for i in range(20)], "source_id string, vec array<double>")
    spans = vecs.select("source_id")
    metadata = vectors.vector_summary(vecs)
    assert vectors.audit_vectors(vecs.repartition(3), spans, metadata, 2).count() == 0
    changed = vecs.withColumn("vec", F.when(F.col("source_id") == "s3", F.array(F.lit(9.0), F.lit(9.0))).otherwise(F.col("vec")))
    assert [r.violation for r in vectors.audit_vectors(changed, spans, metadata, 2).collect()] == ["vector_hash"]
    fewer = spans.filter("source_id <> 's3'")
    assert {r.violation for r in vectors.audit_vectors(vecs, fewer, metadata, 2).collect()} == {"artifact_count", "source_ids", "value_count"}
    assert [r.violation for r in vectors.preflight(vecs.withColumn("text", F.lit("x" * 2001)).limit(1), 2).collect()] == ["input_too_long"]


def test_vector_hash_knows_every_bit(spark):
    """No rounding: neighbouring floats, ties at nine digits, the smallest and the largest values differ."""
    values = [2.0**-15, -0.27392578125, float(np.nextafter(np.float32(-0.27392578125), np.float32(1))), 1.0, float(np.nextafter(1.0, 0)),
              5e-324, 2.5e-308, 2.0**-149, 1.7976931348623157e308, 3.4028234663852886e38, 0.1, -7.0, 1e-280, 2.0**-900, 2.0**-901, 3.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for r in rows.select("x", exact_number(F.col("x")).alias("t")).collect():
        digits, power = map(int, r.t.split("p"))
        assert Fraction(digits) * Fraction(2) ** power == Fraction(r.x)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (0.0,)], "x double")
    assert [r.t for r in odd.select(exact_number(F.col("x")).alias("t")).collect()] == ["null", "nan", "inf", "-inf", "0"]
    near = [spark.createDataFrame([(1, [x])], "source_id int, vec array<float>") for x in values[1:3]]
    assert len({vectors.vector_summary(v).first().vector_sha256 for v in near}) == 2


def test_tasks_of_the_index_follow_its_rows(spark, monkeypatch):
    """More rows are grouped and joined by more tasks, each once, with the same results."""
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rows = spark.range(2000).select(
        (F.col("id") % 90).alias("identifier"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("kind"),
        F.lit("global").alias("scope"), (F.col("id") % 700).alias("source_id"))
    parts = session.tasks_for(rows.count(), spark)
    assert parts == 40 and session.tasks_for(1, spark) == session.bucket_count(spark)
    found = index.postings(rows, parts)
    assert found.rdd.getNumPartitions() == parts
    assert sorted(found.collect()) == sorted(index.postings(rows).collect())
    columns = [*index.ENTRY_KEY, "source_id"]
    assert table_fingerprint(found, columns, parts).first() == table_fingerprint(rows.distinct(), columns).first()
    order = Window.orderBy(*columns)
    stored = index.index_table(found).withColumn("position", F.row_number().over(order).cast("bigint").bitwiseXOR(F.lit(1)))
    spans = spark.range(650).toDF("source_id")
    got = sorted(index.audit_index(stored, spans, parts).collect())
    assert got == sorted(index.audit_index(stored, spans).collect()) and len({r.violation for r in got}) >= 2
