import hashlib
import random

import models
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.functions import scores, text
from docketry.operators import blocks, index, retrieve, vectors
from docketry.plans import retrieval

DIM = 48
WORDS = ["alpha", "beta", "gamma", "delta", "noop", "telemetry", "camelCase", "x1", "loop", "mode"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    bodies = {f"S{i:03d}": " ".join(rng.choices(WORDS, weights=range(1, 11), k=rng.randint(1, 25))) for i in range(70)}
    bodies["S070"] = bodies["S003"]  # an exact copy: equal scores, order by id
    bodies["S071"] = "..."  # no token at all
    ids = [("ID_A", "macro"), ("ID_A", "table"), ("ID_B", "macro"), ("ID_C", "type"), ("ID_D", "macro"), *[(f"ID_{i}", "symbol") for i in range(12)]]
    postings = {key: set(rng.sample(sorted(bodies), rng.randint(1, 9))) for key in ids}
    postings[("ID_ALL", "macro")] = set(bodies)  # in every span: never eligible
    queries = {"q1": ("alpha camelCase noop", ["ID_A"]), "q2": ("mode loop telemetry x1", ["ID_B", "ID_ALL", "id_a"]), "q3": ("zzz unseen", []), "q4": ("beta", ["ID_D"])}
    return bodies, postings, queries


def tables(spark, corpus):
    bodies, postings, queries = corpus
    spans = spark.createDataFrame(list(bodies.items()), "source_id string, body string")
    rows = spark.createDataFrame([(n, k, "global", s) for (n, k), sources in postings.items() for s in sources],
                                 "identifier string, kind string, scope string, source_id string")
    texts = spark.createDataFrame([(q, t) for q, (t, _) in queries.items()], "query_id string, query_text string")
    named = spark.createDataFrame([(q, i) for q, (_, ids) in queries.items() for i in ids], "query_id string, identifier string")
    return spans, rows, texts, named


@pytest.fixture(scope="module")
def small_dim():
    return DIM


def run(spark, corpus, monkeypatch):
    spans, rows, texts, named = tables(spark, corpus)
    forward = retrieval.build_forward(spans.repartition(5, "source_id"), F.col("body"), DIM)
    monkeypatch.setattr(retrieval, "query_table", lambda q: vectors.hash_embed(
        q.select("query_id", text.tokenize(F.col("query_text")).alias("tokens")), DIM))
    hashed = spans.select("source_id", F.sha2("body", 256).alias("content_sha256"))
    return retrieval.retrieve_all(retrieval.SpanIndex(forward, hashed, retrieval.build_links(rows)), texts, named)


def test_whole_retrieval_matches_model(spark, corpus, monkeypatch):
    found = run(spark, corpus, monkeypatch)
    rows = retrieve.candidate_rows(found.ordered).collect()
    bodies, postings, queries = corpus
    for q, (body, ids) in queries.items():
        got = sorted(((r.source_id, r.rank, r.final_score, r.broad_rank) for r in rows if r.query_id == q), key=lambda r: r[1])
        want = models.retrieve(body, ids, bodies, postings, DIM)
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-7)
    docket = found.docket.groupBy("query_id").count().collect()
    assert {r["count"] for r in docket} == {10}
    summary = {r.query_id: r for r in found.summary.collect()}
    assert summary["q1"].broad_count == 40 and summary["q1"].expanded_count <= 200 and summary["q1"].baseline_count == 72


def test_partitioning_and_batching_do_not_change_seals(spark, corpus, monkeypatch):
    first = sorted(run(spark, corpus, monkeypatch).summary.collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(blocks, "MAX_BATCH", 2)
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 30)
    monkeypatch.setattr(blocks, "GROUP_BATCHES", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(run(spark, corpus, monkeypatch).summary.collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_posting_joins_equal_block_scores(spark, corpus):
    spans, _, texts, _ = tables(spark, corpus)
    tokens = index.tokenized(spans, F.col("body"))
    terms = texts.select("query_id", F.explode(F.array_distinct(text.tokenize(F.col("query_text")))).alias("token"))
    stats = index.corpus_stats(tokens)
    matches = retrieve.bm25_matches(terms, index.term_freq(tokens), index.doc_freq(tokens), stats)
    bodies, _, queries = corpus
    docs = {s: models.tokens(b) for s, b in sorted(bodies.items())}
    for q, (body, _) in queries.items():
        want = dict(zip(docs, models.bm25(models.tokens(body), list(docs.values()))))
        got = {r.source_id: r.bm25_score for r in matches.filter(F.col("query_id") == q).collect()}
        assert got == pytest.approx({s: v for s, v in want.items() if v > 0})


def test_minmax_of_a_single_span(spark):
    df = spark.createDataFrame([(2.0, 2.0, 2.0), (0.0, 0.0, 0.0), (3.0, 1.0, 5.0)], "v double, lo double, hi double")
    assert [r[0] for r in df.select(scores.min_max(F.col("v"), F.col("lo"), F.col("hi"))).collect()] == [1.0, 0.0, 0.5]


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        retrieve.fuse(None, None, 0.6, 0.5)


def test_dot_topk_breaks_ties_by_id(spark):
    vecs = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)], "source_id int, vec array<double>").repartition(4)
    queries = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "query_id string, vec array<double>")
    rows = vectors.dot_topk(vecs, queries, 4).collect()
    picked = {q: [r.source_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in "ab"}
    assert picked == {"a": [2, 5, 8, 11], "b": [0, 1, 2, 3]}


def test_hash_vectors_match_model(spark):
    bodies = ["alpha beta alpha", "", "x", "fooBar 12 é"]
    df = spark.createDataFrame([(i, models.tokens(b)) for i, b in enumerate(bodies)], "source_id int, tokens array<string>")
    dense = {r.source_id: [v / r.norm for v in r.vec] for r in vectors.hash_embed(df, 16).collect()}
    for i, b in enumerate(bodies):
        assert dense[i] == pytest.approx(models.hash_vector(models.tokens(b), 16))
    sparse = {(r.source_id, r.ix): r.value for r in vectors.hash_embed_sparse(df, 16).collect()}
    for (i, ix), value in sparse.items():
        assert value == pytest.approx(dense[i][ix])
    assert len(sparse) == sum(v != 0 for row in dense.values() for v in row)


def test_repeated_features_are_hashed_once(spark, monkeypatch):
    """Blocks of rows hash each token and pair they hold once; a null list gives a zero vector."""
    lists = [["a", "b"] * 50, None, [], ["b", "a", "é"], ["c"], ["a-b", "c"]]
    calls = []
    monkeypatch.setattr(vectors, "sha256", lambda data: calls.append(data) or hashlib.sha256(data))
    counts = vectors._signed_counts(pa.array(lists, pa.list_(pa.string())), 16)
    assert len(calls) == len(set(calls)) == 5 + 4
    for tokens, row in zip(lists, counts):
        assert (row / (np.sqrt((row * row).sum()) or 1)).tolist() == pytest.approx(models.hash_vector(tokens or [], 16))
    monkeypatch.setattr(vectors, "BLOCK_TOKENS", 3)
    parts = list(vectors._blocks(pa.array(lists, pa.list_(pa.string()))))
    assert [len(p) for p in parts] == [1, 3, 2]
    df = spark.createDataFrame(list(enumerate(lists)), "source_id int, tokens array<string>").coalesce(1)
    got = {r.source_id: (r.vec, r.norm) for r in vectors.hash_embed(df, 16).collect()}
    assert [got[i][0] for i in range(len(lists))] == counts.tolist() and got[1][1] == got[2][1] == 1


def test_hot_identifier_is_split(spark):
    """Nineteen of twenty hops name one identifier; adaptive execution divides it and the edges stay the same."""
    hops = spark.range(200_000).select(
        F.concat(F.lit("query number "), F.col("id")).alias("query_id"), F.lit(1.0).alias("strength"),
        F.when(F.col("id") % 20 > 0, F.lit("hot")).otherwise(F.concat(F.lit("i"), F.col("id") % 4000)).alias("identifier")).repartition(8)
    links = spark.range(4000).select(
        F.col("id").alias("source_id"), F.when(F.col("id") < 3, F.lit("hot")).otherwise(F.concat(F.lit("i"), F.col("id"))).alias("identifier"),
        F.lit(3).alias("df"))
    want = hops.join(F.broadcast(links), "identifier").count()
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        edges = retrieve.edges(hops, links, F.lit(4000))
        assert len(edges.collect()) == want
        assert "skew=true" in edges._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
