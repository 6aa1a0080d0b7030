"""One-hop expansion against plain Python: what a query's strongest hops reach decides, repeats and ties included."""

import random
import time
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docketry import session
from docketry.functions import scores
from docketry.operators import retrieve
from docketry.plans import catalog_retrieval, retrieval

N = 4000


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    links = {(s, i): 2 + (i + s) % 3 * 9 for i in range(60) for s in rng.sample(range(300), 25)}
    # Identifiers 60 to 79 reach the same ten spans, so many strong hops reach few spans.
    links |= {(s, i): 2 for i in range(60, 80) for s in range(10)}
    hops = {("a", i): 1.0 / (1 + i % 4) for i in range(40)} | {("b", i): 1.0 for i in range(60, 80)}
    hops |= {("b", i): 0.25 for i in range(0, 30)} | {("c", 5): 1.0}
    broad = {("a", s) for s in range(0, 300, 40)} | {("b", 3), ("c", 299)}
    tables = (
        spark.createDataFrame([(s, i, d) for (s, i), d in links.items()], "source_id long, identifier long, df long"),
        spark.createDataFrame([(q, i, x) for (q, i), x in hops.items()], "query_id string, identifier long, strength double"),
        spark.createDataFrame(sorted(broad), "query_id string, source_id long"),
    )
    spec = {r.df: r.s for r in spark.range(40).select(F.col("id").alias("df"), scores.specificity(F.col("id"), F.lit(N)).alias("s")).collect()}
    edges = defaultdict(dict)
    for (q, i), strength in hops.items():
        for (s, j), df in links.items():
            if i == j:
                edges[q, s][i] = strength * spec[df]
    return tables, dict(edges), broad, links


@pytest.mark.parametrize("k,reach", [(20, None), (20, 1), (120, 130), (500, None)])
def test_shortlist_equals_brute_force(spark, graph, k, reach):
    (links, hops, broad), edges, inside, _ = graph
    found = retrieve.relation_shortlist(hops, retrieve.link_levels(links), F.lit(N), broad, k, reach).collect()
    want = {}
    for q in "abc":
        mine = {s: round(max(e.values()) * 1e12) for (p, s), e in edges.items() if p == q and (q, s) not in inside}
        last = sorted(mine.values(), reverse=True)[:k][-1]
        want |= {(q, s): x for s, x in mine.items() if x >= last}
    assert {(r.query_id, r.source_id): round(r.relation_score * 1e12) for r in found} == want
    assert len(found) == len(want)


def test_few_hops_are_expanded(spark, graph):
    """Spans that a query's weaker hops alone reach are never made, as long as its stronger ones reach enough."""
    (links, hops, broad), edges, _, _ = graph
    only = hops.filter("query_id = 'a'")
    found = retrieve.relation_shortlist(only, retrieve.link_levels(links), F.lit(N), broad, 20, 60)
    assert 20 <= found.count() < sum(q == "a" for q, _ in edges) / 2


def test_totals_and_looked_up_scores(spark, graph, monkeypatch):
    monkeypatch.setattr(retrieve, "TASK_EDGES", 50)
    (links, hops, broad), edges, inside, _ = graph
    totals = retrieve.relation_totals(hops, retrieve.link_levels(links), F.lit(N))
    assert "hashpartitioning(query_id" in totals._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.source_id): (r.relation_score, r.identifiers, r.first) for r in totals.collect()}
    assert got == {p: (pytest.approx(max(e.values())), len(e), min(e)) for p, e in edges.items()}
    own = {(r.query_id, r.source_id): r.relation_score for r in retrieve.relation_of(broad, links, hops, F.lit(N)).collect()}
    assert own == {p: pytest.approx(max(edges[p].values())) for p in inside if p in edges}
    named = retrieve.with_identifiers(broad, links, hops)
    assert {(r.query_id, r.source_id): r.relation_identifiers for r in named.collect()} == {
        p: sorted(edges[p]) if p in edges else None for p in inside}


def test_edges_are_counted_without_making_them(spark, graph):
    (links, hops, _), _, _, _ = graph
    made = retrieve.edges(hops, links, F.lit(N)).groupBy("query_id", "identifier").agg(
        F.count(F.lit(1)).alias("spans"), F.sum("source_id").alias("source_sum"), F.min("edge").alias("low"), F.max("edge").alias("high"))
    counted = retrieve.edge_summary(hops, links, F.lit(N))
    assert sorted(counted.select(*made.columns).collect()) == sorted(made.collect())


@pytest.mark.parametrize("k,reach", [(20, 30), (20, 1), (120, 130), (500, 600)])
def test_pool_equals_brute_force(spark, graph, k, reach):
    """The pool comes from one shuffle by query, with scores that travel in the lists; every broad row and the best others are in it."""
    (links, hops, broad), edges, inside, _ = graph
    known = spark.range(300).select(
        F.col("id").alias("source_id"), F.lit(1.5).alias("bm25_score"), F.lit(0.25).alias("embedding_score"),
        ((F.col("id") * 7) % 11 / 11.0).alias("hybrid_score"))
    levels = retrieve.link_levels(links, known, ["hybrid_score"])
    rows = broad.join(known, "source_id").withColumn("broad_rank", F.lit(1))
    needed = retrieve.needed_levels(hops, levels, F.lit(N), rows, k, reach)
    pool = retrieve.reached_pool(rows, retrieve.relation_of(rows, links, hops, F.lit(N)), needed, levels, k)
    shuffled = pool._jdf.queryExecution().optimizedPlan().toString()
    assert "bm25_score" not in shuffled
    got = {(r.query_id, r.source_id): (r.relation_score, r.relation_rank, r.hybrid_score) for r in pool.collect()}
    want = {p: (max(edges[p].values()) if p in edges else 0.0, None) for p in inside}
    for q in "abc":
        mine = [(round(max(e.values()) * 1e12), round((s * 7) % 11 / 11 * 1e12), -s, max(e.values())) for (p, s), e in edges.items() if p == q and (q, s) not in inside]
        want |= {(q, -s): (edge, i) for i, (_, _, s, edge) in enumerate(sorted(mine, reverse=True)[:k], 1)}
    assert {p: x[:2] for p, x in got.items()} == {p: (pytest.approx(x[0]), x[1]) for p, x in want.items()}
    assert all(x[2] == pytest.approx((s * 7) % 11 / 11) for (_, s), x in got.items())


@pytest.mark.parametrize("k,reach", [(20, 30), (20, 1), (120, 130), (500, 600)])
def test_listed_pool_equals_brute_force(spark, graph, k, reach):
    """One list per query in final order; queries whose strongest hops do not fill the pool are left out and found by all they need."""
    (links, hops, broad), edges, inside, _ = graph
    known = spark.range(300).select(
        F.col("id").alias("source_id"), F.lit(1.5).alias("bm25_score"), F.lit(0.25).alias("embedding_score"),
        F.when(F.col("id") % 50 != 7, ((F.col("id") * 7) % 11 / 11.0)).alias("hybrid_score"))
    score = {s: (s * 7) % 11 / 11 if s % 50 != 7 else None for s in range(300)}
    levels = retrieve.link_levels(links, known, ["hybrid_score"], 3)
    rows = broad.join(known, "source_id").withColumn("broad_rank", F.lit(1))
    sizes = retrieve.level_sizes(levels)

    def pools(followed):
        found = retrieve.listed_pool(rows, links, hops, followed, levels, F.lit(N), k, 5)
        return {(r.query_id, r.source_id): r for r in retrieve.pool_rows(found).collect()}

    want = {}
    for q in "abc":
        mine = {s: (max(edges[q, s].values()) if (q, s) in edges else 0.0) for s in range(300) if (q, s) in edges or (q, s) in inside}

        def key(s, first):
            h = score[s]
            return (-round(first * 1e12) if first is not None else 1, -round(h * 1e12) if h is not None else 1, s)

        others = sorted((s for s in mine if (q, s) not in inside), key=lambda s: key(s, mine[s]))[:k]
        kept = [*others, *(s for p, s in inside if p == q)]
        final = {s: None if score[s] is None else 0.75 * score[s] + 0.25 * mine[s] for s in kept}
        ordered = sorted(kept, key=lambda s: key(s, final[s]))
        want |= {(q, s): (mine[s], others.index(s) + 1 if s in others else None, ordered.index(s) + 1, final[s]) for s in kept}
    whole = pools(retrieve.needed_levels(hops, levels, F.lit(N), rows, k, reach))
    assert {p: (r.relation_rank, r.rank, r.broad_rank) for p, r in whole.items()} == {
        p: (x[1], x[2], 1 if p in inside else None) for p, x in want.items()}
    assert all(r.relation_score == pytest.approx(want[p][0]) and r.final_score == (x if (x := want[p][3]) is None else pytest.approx(x)) for p, r in whole.items())
    first = pools(retrieve.first_levels(hops, sizes, F.lit(N), reach))
    assert {p: r.rank for p, r in first.items()} == {p: r.rank for p, r in whole.items() if p[0] in {q for q, _ in first}}
    if reach in (1, 600):
        assert {q for q, _ in first} == {1: {"a"}, 600: {"c"}}[reach]


def test_pieces_give_the_same_totals(spark, graph, monkeypatch):
    (links, hops, _), edges, _, _ = graph
    levels = retrieve.link_levels(links)
    assert retrieve.reached(hops, levels) == sum(len(e) for e in edges.values())
    monkeypatch.setattr(retrieval, "PIECE_EDGES", 50)
    got = retrieval.per_piece(spark, 100, lambda mine, tasks: retrieve.relation_totals(mine(hops), levels, F.lit(N), tasks))
    assert len(got.inputFiles()) > 1
    assert {(r.query_id, r.source_id): r.identifiers for r in got.collect()} == {p: len(e) for p, e in edges.items()}


def test_stored_tables_leave_no_shuffle_files(spark):
    """Files of a shuffle go when the table made with it is stored, and the setting is as before."""
    before = spark.conf.get(session.CLEANUP, "false")
    root = Path(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0])
    held = {p for p in root.rglob("shuffle_*.data")}
    session.materialise(spark.range(1000).repartition(7, "id"), "dealt")
    deadline = time.time() + 10
    while {p for p in root.rglob("shuffle_*.data")} - held and time.time() < deadline:
        time.sleep(0.1)
    assert not {p for p in root.rglob("shuffle_*.data")} - held
    assert spark.conf.get(session.CLEANUP, "false") == before


def test_rows_left_out_of_a_piece_follow(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PIECE_EDGES", 10)
    rows = session.materialise(spark.range(100).withColumnRenamed("id", "query_id"), "before")

    def rest(mine, tasks, done):
        return mine(rows).join(done, "query_id", "left_anti")

    assert sorted(r.query_id for r in retrieval.per_piece(spark, 40, lambda mine, tasks: mine(rows).filter("query_id % 3 = 0"), rest=rest).collect()) == list(range(100))


def test_a_piece_leaves_its_result_only(spark, monkeypatch):
    """Tables that the job of a piece stores go with the piece; those made before stay."""
    monkeypatch.setattr(retrieval, "PIECE_EDGES", 10)
    rows = session.materialise(spark.range(100).withColumnRenamed("id", "query_id"), "before")
    held = []

    def job(mine, tasks):
        held.append(len(session.written()))
        return session.materialise(mine(rows), "within")

    first = session.mark()
    got = retrieval.per_piece(spark, 40, job)
    assert got.count() == 100 and rows.count() == 100
    assert len(held) == 4 and len(set(held)) == 1
    assert [p.rpartition("/")[2].partition("-")[0] for p in session.written(first)] == ["pieces"]


def test_lists_of_spans_stay_in_their_buckets(spark, graph):
    """However many pieces join them, levels in buckets are not moved; only the side that asks is."""
    (links, hops, _), edges, _, _ = graph
    levels = session.materialise_by(retrieve.link_levels(links), "levels", "identifier", "df")
    assert sorted(levels.collect()) == sorted(spark.read.parquet(levels.inputFiles()[0].rpartition("/")[0]).select(levels.columns).collect())
    joined = hops.withColumn("df", F.col("identifier") % 3 * 9 + 2).hint("merge").join(levels, ["identifier", "df"])
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    path = session.written()[-1]
    session.discard(spark, [path])
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_packed_scores_are_the_same_doubles(spark):
    rows = spark.range(5000).select(F.rand(7).alias("score")).union(spark.createDataFrame([(0.0,), (1.0,), (1e-8,), (0.123456785,)], "score double"))
    stored = session.materialise(rows, "scores")
    kept = session.materialise(stored.select(catalog_retrieval.packed("score")), "packed")
    assert dict(kept.dtypes)["score"] == "bigint"
    assert sorted(catalog_retrieval.unpacked(kept, "score").collect()) == sorted(stored.select(F.bround("score", 8).alias("score")).collect())
