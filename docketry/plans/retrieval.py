"""End-to-end retrieval for a table of queries against an index of spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import scores, text
from docketry.functions.rows import explode_rows
from docketry.operators import blocks, index, retrieve, vectors
from docketry.session import brief_shuffles, bucket_count, discard, mark, materialise, materialise_by, scratch, written


@dataclass
class SpanIndex:
    """Index tables of one corpus. ``forward`` has source_id, tokens, vec and norm;
    ``spans`` has source_id, content_sha256 and whatever the docket should carry;
    ``links`` has source_id, identifier and df."""

    forward: DataFrame
    spans: DataFrame
    links: DataFrame


@dataclass
class Retrieval:
    broad: DataFrame
    ordered: DataFrame
    summary: DataFrame

    @property
    def docket(self) -> DataFrame:
        return self.ordered.filter(F.col("rank") <= scores.FINAL_K)


def build_forward(spans: DataFrame, body, dim: int = vectors.HASH_DIM) -> DataFrame:
    """Tokens and hash vectors per span: one narrow pass, stored once for all scans."""
    tokens = index.tokenized(spans, body)
    return materialise(vectors.hash_embed(tokens, dim), "forward")


def build_links(identifiers: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Identifier links of the eligible entries, stored once by span: every stage reads them.

    ``repeated`` may hold the identifiers with repeats, so that distinct ones are shuffled for their counts only.
    """
    rows = index.eligible_postings(identifiers, repeated=repeated)
    dealt = rows.repartition(bucket_count(rows.sparkSession), "source_id")
    return materialise_by(index.identifier_links(dealt), "links", "source_id", dealt=True)


def query_table(queries: DataFrame, dim: int = vectors.HASH_DIM) -> DataFrame:
    """Scoring form of (query_id, query_text)."""
    tokens = queries.select("query_id", text.tokenize(F.col("query_text")).alias("tokens"))
    return vectors.hash_embed(tokens, dim)


def scored_groups(forward: DataFrame, queries: DataFrame) -> Iterator[list[blocks.QueryBatch]]:
    """Groups of query batches with document frequencies, corpus figures and score extremes.

    Corpus figures and the frequencies of all query terms are computed once, in two narrow scans, whatever
    the number of queries; the extremes of a group need one scan. What a group fetches is
    bounded by it: a row per query term and two per query.
    """
    for group in weighted_groups(forward.select("source_id", "tokens"), query_table(queries)):
        for row in blocks.extremes(forward, group).collect():
            group[row.b].low[row.q] = row.lexical_low, row.dense_low
            group[row.b].high[row.q] = row.lexical_high, row.dense_high
        yield group


def weighted_groups(tokens: DataFrame, queries: DataFrame) -> Iterator[list[blocks.QueryBatch]]:
    """Groups of batches of ``queries`` (query_id, tokens, perhaps vec and norm) with document frequencies and corpus figures."""
    table = materialise(queries, "queries")
    stats = index.corpus_stats(tokens).first()
    terms = table.select(F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    frequencies = materialise(
        explode_rows(tokens, F.array_distinct("tokens"), "token").join(terms, "token", "left_semi")
        .groupBy("token").agg(F.count(F.lit(1)).alias("df")), "term-frequencies",
    )
    for group in blocks.query_groups(table):
        ids = table.sparkSession.createDataFrame([(t,) for t in sorted({t for b in group for t in b.terms})], "token string")
        df = {row.token: row.df for row in frequencies.join(ids, "token", "left_semi").collect()}
        for batch in group:
            found = np.array([df.get(t, 0) for t in batch.terms], dtype=np.float64)
            batch.idf = np.log(1.0 + (stats.n - found + 0.5) / (found + 0.5))
            batch.avg_length = stats.avg_length
            batch_size = (len(batch.ids), 2)
            batch.low, batch.high = np.zeros(batch_size), np.zeros(batch_size)
        yield group


def broad_candidates(forward: DataFrame, group: list[blocks.QueryBatch]) -> DataFrame:
    return retrieve.broad(blocks.top_k(forward, group, scores.BROAD_K))


def per_group(forward: DataFrame, queries: DataFrame, job: Callable[[list[blocks.QueryBatch]], DataFrame]) -> DataFrame | None:
    """Results of ``job`` for every group of queries, stored group by group; None without queries."""
    return _collected(forward, scored_groups(forward, queries), job)


def per_lexical_group(tokens: DataFrame, queries: DataFrame, job: Callable[[list[blocks.QueryBatch]], DataFrame]) -> DataFrame:
    """As :func:`per_group`, for jobs on ``tokens`` (source_id, tokens) that need lexical scores only; ``queries`` has query_id, tokens.

    Without queries there are no rows.
    """
    found = _collected(tokens, weighted_groups(tokens, queries), job)
    return job([blocks.empty_batch(queries)]).limit(0) if found is None else found


def _collected(spans: DataFrame, groups: Iterator[list[blocks.QueryBatch]], job: Callable) -> DataFrame | None:
    path, schema = scratch(spans.sparkSession, "groups"), None
    for group in groups:
        part = job(group)
        schema = part.schema
        with brief_shuffles(spans.sparkSession):
            part.write.mode("append").parquet(path)
    return None if schema is None else spans.sparkSession.read.schema(schema).parquet(path)


#: Most pieces of the queries that :func:`per_piece` takes one after the other, and edges from which on there is another.
PIECES = 32
PIECE_EDGES = 8_000_000
Mine = Callable[[DataFrame], DataFrame]


def per_piece(spark: SparkSession, edges: int, job: Callable[[Mine, int], DataFrame], label: str = "pieces",
              rest: Callable[[Mine, int, DataFrame], DataFrame | None] | None = None) -> DataFrame:
    """Results of ``job`` on every piece of the queries, stored piece by piece: only one piece's shuffles and tables are on disk at a time.

    ``job`` is given a function that cuts a table with query_id down to the piece, and the number of tasks that a piece of all ``edges`` needs.
    ``rest`` is also given what the piece's job has stored, and may return rows that were left out of it.
    """
    path = scratch(spark, label)
    pieces = max(1, min(PIECES, -(-edges // PIECE_EDGES)))
    tasks = retrieve.tasks_for(edges // pieces, spark)
    for piece in range(pieces):
        def mine(rows: DataFrame, piece: int = piece) -> DataFrame:
            return rows if pieces == 1 else rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(pieces)) == piece)

        def store(part: DataFrame, place: str = f"{path}/{piece}") -> DataFrame:
            with brief_shuffles(spark):
                part.write.mode("append").option("compression", "zstd").parquet(place)
            return spark.read.schema(part.schema).parquet(place)

        first = mark()
        done = store(job(mine, tasks))
        more = rest(mine, tasks, done) if rest else None
        if more is not None:
            store(more)
        discard(spark, written(first))
    return spark.read.schema(done.schema).option("recursiveFileLookup", "true").parquet(path)


def retrieve_all(corpus: SpanIndex, queries: DataFrame, query_ids: DataFrame) -> Retrieval:
    """Broad cut, one-hop expansion, final order and seals.

    ``queries``: query_id, query_text. ``query_ids``: query_id, identifier. A group of some thousand queries
    goes through all stages together; spans are read twice per group and never shuffled for scoring.
    """
    n = corpus.forward.agg(F.count(F.lit(1)).alias("n")).scalar()
    levels = materialise(retrieve.link_levels(corpus.links), "levels")

    def job(group: list[blocks.QueryBatch]) -> DataFrame:
        ids = [(i,) for b in group for i in b.ids]
        kind = T.StructType([T.StructField("query_id", group[0].id_type)])
        mine = query_ids.join(corpus.forward.sparkSession.createDataFrame(ids, kind), "query_id", "left_semi")
        # The broad cut (40 rows per query) feeds four branches; compute it once.
        broad = materialise(broad_candidates(corpus.forward, group), "broad")
        in_broad = corpus.links.join(broad.select("source_id").distinct(), "source_id", "left_semi")
        hops = materialise(retrieve.merge_hops(
            retrieve.named_hops(mine), retrieve.seed_hops(broad, index.seed_identifiers(in_broad))
        ), "hops")
        shortlist = retrieve.relation_shortlist(hops, levels, n, broad)
        hybrid = blocks.chosen_pairs(corpus.forward, group, shortlist.select(*retrieve.PAIR))
        only = retrieve.relation_only(shortlist.join(hybrid, retrieve.PAIR))
        pool = retrieve.expanded_pool(broad, only, retrieve.relation_of(broad, corpus.links, hops, n))
        rows = retrieve.final_order(retrieve.with_identifiers(pool, corpus.links, hops))
        return corpus.spans.join(rows, "source_id")

    ordered = per_group(corpus.forward, queries, job)
    if ordered is None:
        raise ValueError("no queries")
    columns = [*retrieve.PAIR, "bm25_score", "embedding_score", "hybrid_score", "broad_rank"]
    broad = ordered.filter(F.col("broad_rank").isNotNull()).select(*columns)
    return Retrieval(broad, ordered, retrieve.retrieval_summary(ordered, n))
