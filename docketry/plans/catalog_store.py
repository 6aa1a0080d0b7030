"""Driver queries over stored indexes and stored runs: written, reopened, checked, used."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions import scores, text
from docketry.operators import bounds, index, metrics, retrieve, review, vectors
from docketry.plans import catalog_retrieval as ranking
from docketry.plans import catalog_review as standin
from docketry.plans import run_audit
from docketry.plans.catalog_audit import stream_path
from docketry.plans.catalog_retrieval import text_sizes
from docketry.plans.catalog_text import document_tokens, documents, line_identifiers
from docketry.session import materialise, materialise_by, scratch, table
from docketry.sources import corpus, identifier_store, sinks
from docketry.sources.embedding_cache import EmbeddingCache, embed_stored
from docketry.streaming import live, log_state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return register


# ---- identifier index -------------------------------------------------------------

PACKAGE = "package-of-order-lines"


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders", "o_orderkey").toDF("source_id")


def _stored(spark: SparkSession, sf: str) -> str:
    path = scratch(spark, "identifier-store")
    identifier_store.write_store(index.postings(line_identifiers(spark, sf)), path, PACKAGE)
    return path


def open_stored(spark: SparkSession, sf: str) -> identifier_store.IdentifierStore:
    return identifier_store.open_store(spark, _stored(spark, sf), PACKAGE, _sources(spark, sf))


def altered_copy(spark: SparkSession, path: str, rows: DataFrame) -> str:
    """A store of ``rows`` under the seals and the metadata of the one at ``path``."""
    copy = scratch(spark, "identifier-copy")
    buckets = spark.read.parquet(f"{path}/metadata").first().buckets
    identifier_store.write_rows(rows, f"{copy}/rows", buckets)
    for part in ("seals", "metadata"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{copy}/{part}")
    return copy


@query("""WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT t.* FROM n, (VALUES ('altered', 'bucket_sha256'), ('altered', 'df_mismatch'), ('other extractor', 'extractor_version'),
 ('other package', 'package_sha256'), ('other schema', 'schema_version'), ('repeated', 'bucket_sha256'), ('repeated', 'df_mismatch'), ('repeated', 'postings_not_unique')) t(index, violation) WHERE n > 0
 UNION ALL SELECT DISTINCT 'fewer sources', 'unknown_source' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'""")
def stored_index_audit(spark, sf):
    """An index written, reopened and checked: as it is, against other versions and sources, with a frequency changed, with a posting repeated."""
    path, sources = _stored(spark, sf), _sources(spark, sf)
    rows = spark.read.parquet(f"{path}/rows")
    first = rows.agg(F.min("identifier")).scalar()
    raised = altered_copy(spark, path, rows.withColumn("df", F.when(F.col("identifier") == first, F.col("df") + 1).otherwise(F.col("df"))))
    again = altered_copy(spark, path, rows.unionByName(rows.filter(F.col("identifier") == first)))
    open_orders = table(spark, sf, "orders", "o_orderkey", "o_orderstatus").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source_id"))

    checks = {place: identifier_store.check_rows(spark, place) for place in (path, raised, again)}

    def audit(path: str, package: str = PACKAGE, **more) -> DataFrame:
        return identifier_store.audit_store(spark, path, package, **{"sources": sources, "checked": checks[path], **more})

    cases = {
        "intact": audit(path), "other package": audit(path, "another package"), "other schema": audit(path, schema_version=2),
        "other extractor": audit(path, extractor_version="typed-identifiers-0"), "altered": audit(raised), "repeated": audit(again),
        "fewer sources": audit(path, sources=sources.join(open_orders, "source_id", "left_anti")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("index"), "violation").distinct() for name, df in cases.items()])


@query(ranking.ORACLES["query_edges"])
def stored_index_edges(spark, sf):
    """Named identifiers looked up in the reopened index, bucket by bucket."""
    store = open_stored(spark, sf)
    graph = ranking.Graph(spark, sf, store.links())
    return store.edges(retrieve.named_hops(graph.query_ids), graph.n).withColumn("edge", F.bround("edge", 8))


@query(ranking.ORACLES["final_docket"])
def stored_index_docket(spark, sf):
    """The final docket with seeds and edges from the reopened index alone."""
    store = open_stored(spark, sf)
    graph = ranking.Graph(spark, sf, materialise_by(store.links(), "stored-links", "source_id"))
    return graph.in_pool(ranking.docket)


# ---- top-k with block bounds --------------------------------------------------------


@query(ranking.ORACLES["bm25_topk"])
def impact_topk(spark, sf):
    """The best lexical matches of every benchmark text from stored postings, reading only blocks that can hold one."""
    path = scratch(spark, "impacts")
    bounds.write_impacts(document_tokens(spark, sf), path)
    terms = ranking.benchmark_queries(spark, sf).select("query_id", F.explode(F.array_distinct(text.tokenize(F.col("query_text")))).alias("token"))
    found, _ = bounds.lexical_topk(bounds.read_impacts(spark, path), terms, scores.BROAD_K)
    return found.select(*retrieve.PAIR, F.bround("score", 6).alias("bm25_score"), "rank")


@query(ranking.ORACLES["dot_topk"])
def ball_topk(spark, sf):
    """The best dot products of every label's first vector, reading only blocks whose ball can hold one."""
    vecs = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    asked = vecs.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vec"))
    balls = bounds.build_balls(vecs.select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("vec")))
    return bounds.dense_topk(balls, asked, scores.BROAD_K)[0].withColumn("score", F.bround("score", 6))


# ---- stored runs ------------------------------------------------------------------

RUN_CASES = 5


class StoredEvaluation(standin.Evaluation):
    """The stand-in evaluation in runs of few cases, as run documents."""

    def keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("query_id", "case_id").withColumn("run_id", F.expr(f"case_id div {RUN_CASES}"))

    def figures(self, results: DataFrame, effective: DataFrame) -> DataFrame:
        """Every metric from the tables, before anything is written."""
        slots, proposed, verified = self.slots(), self.proposed(), self.verified(effective)
        matched = metrics.match_slots(verified, slots)
        rows = metrics.per_case(
            self.cases, metrics.target_hits(self.targets, self.pool(4), self.pool(20), self.final),
            slots.groupBy(*metrics.CASE).agg(F.count(F.lit(1)).alias("eligible_claims")),
            metrics.slot_recall(metrics.match_slots(proposed, slots), "proposed_slots"), metrics.slot_recall(matched, "verified_slots"),
            metrics.claim_totals(self.keyed(results), proposed, verified, self.keyed(effective)),
            metrics.docket_sizes(self.keyed(results), self.pool(20)), metrics.extra_claims(matched))
        return metrics.evaluate(rows, *metrics.all_figures())

    def documents(self) -> DataFrame:
        """One nested row per run, in the layout of run files."""
        results, effective = (materialise(df, name) for df, name in zip(self.resolved()[:2], ("results", "verdicts")))
        case = ["run_id", "case_id"]

        def listed(df: DataFrame, name: str, *fields) -> DataFrame:
            """One list per case, in the order of the first fields; at most a pool long."""
            return df.groupBy(*case).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

        sealed = self.final.withColumn("content_sha256", F.sha2("content", 256)).withColumn("source_id", F.col("source_id").cast("string"))
        prints = retrieve.sequence_fingerprint(sealed.withColumn("query_id", F.struct(*case)), "rank", "candidate_fingerprint").select(
            "query_id.*", "candidate_fingerprint")
        failed = self.failures.filter(F.col("role") == review.REVIEWER).select("query_id")
        given = self.keyed(self.decisions.join(failed, "query_id", "left_anti"))
        shown = self.keyed(results).withColumn("source_id", F.col("source_id").cast("string"))
        parts = [
            listed(sealed, "candidates", "rank", "source_id", "content", "start_line", "end_line", "content_sha256"), prints,
            listed(shown, "candidate_results", "rank", "source_id", "status", "blocked_count", F.transform(
                "verified_claims", lambda c: c.withField("source_id", c["source_id"].cast("string"))).alias("verified_claims")),
            listed(self.keyed(effective), "claim_verifications", "claim_id", "verdict", "reason"),
            listed(given, "candidate_decisions", F.col("source_id").cast("string").alias("source_id"), "decision", "claims"),
            listed(self.targets, "expected_review_targets", F.col("source_id").cast("string").alias("s")).withColumn(
                "expected_review_targets", F.col("expected_review_targets.s")),
            listed(self.slots(), "expected_claims", F.col("slot_no").alias("n"), F.col("claim_slot_id").cast("string").alias("claim_slot_id"),
                   F.col("source_id").cast("string").alias("source_id"), "impact_type", F.col("spans").alias("acceptable_exact_evidence_spans")),
            *[listed(self.pool(k), name, F.col("source_id").cast("string").alias("s")).withColumn(name, F.col(f"{name}.s"))
              for k, name in ((4, "broad_candidate_source_ids"), (20, "expanded_candidate_source_ids"))],
        ]
        rows = reduce(lambda a, b: a.join(b, case, "left"), parts, self.cases)
        run, fingerprint = F.concat(F.lit("run-"), "run_id"), F.sha2(F.lit("index"), 256)
        rows = rows.withColumns({
            "provider": F.lit("rules"), "model": F.lit("m"), "embedding_model": F.lit("e"), "embedding_index_fingerprint": fingerprint,
            "identifier_index_fingerprint": fingerprint, "role_traces": F.array(F.struct(F.lit("engineering_reviewer").alias("role"), F.lit(None).cast("string").alias("error"))),
            "retrieval": F.struct(F.lit(40).alias("broad_k"), F.lit(200).alias("expanded_count"), F.lit(10).alias("final_k"), F.col("candidate_fingerprint").alias("final_docket_fingerprint")),
        })
        entry = F.struct(F.col("case_id").alias("no"), F.struct(
            run.alias("run_id"), F.col("case_id").cast("string").alias("case_id"), *[c for c in rows.columns if c not in case]).alias("case"))
        runs = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(entry)).alias("cases"))
        figures = run_audit.metrics_json(materialise(self.figures(results, effective), "figures"))
        return runs.join(figures, "run_id").select(
            F.col("run_id").alias("no"), run.alias("run_id"), F.lit("stand-in-v6").alias("experiment_id"), F.lit("rules").alias("provider"), F.lit("m").alias("model"),
            F.lit("e").alias("embedding_model"), F.to_json(F.struct(
                F.lit(10).alias("top_k"), fingerprint.alias("embedding_index_fingerprint"), fingerprint.alias("identifier_index_fingerprint"))).alias("configuration"),
            F.col("cases.case").alias("cases"), "metrics", F.struct(F.lit("commit").alias("source_commit"), fingerprint.alias("embedding_index_fingerprint"),
                                                                  fingerprint.alias("identifier_index_fingerprint")).alias("provenance"))


#: Fault planted in run no. 16 k + i, and what an audit must say of it.
FAULTS = (
    (), ("metrics",), ("metrics",), ("case_count", "metrics"), ("run_id",), ("runtime",), ("candidate_fingerprint",), ("embedding_index",),
    ("metrics", "not_exact", "out_of_range", "unsupported_claim_exposed", "verdict"), ("duplicate_result", "metrics"), ("metrics", "missing_result"), ("role_error",),
    ("identifier_index",), ("retrieval_seal",), ("unreadable",), ("case_count", "metrics", "no_cases"),
)


def with_faults(runs: DataFrame) -> DataFrame:
    """(value): run documents as JSON lines, most with a fault by their number."""
    fault = F.col("no") % len(FAULTS)

    def first(change) -> Column:
        """The cases with the first of them changed."""
        return F.transform("cases", lambda c, i: F.when(i == 0, change(c)).otherwise(c))

    def results(change):
        return first(lambda c: c.withField("candidate_results", change(c["candidate_results"])))

    def invented(r):
        claim = F.struct(*[F.lit(v).alias(n) for n, v in (
            ("claim_id", "none"), ("impact_type", "DESIGN_ASSUMPTION"), ("impact_claim", "claim"), ("evidence_exact_text", standin.NO_SUCH + "!"),
            ("evidence_start_line", 0), ("evidence_end_line", 10**8), ("verifier_reason", "none"))]).withField("source_id", r["source_id"])
        like = F.from_json(F.to_json(F.array(claim, claim)), f"array<{schemas.VERIFIED_CLAIM}>")
        own = F.from_json(F.to_json(r["verified_claims"]), f"array<{schemas.VERIFIED_CLAIM}>")
        return F.to_json(r.withField("status", F.lit("BLOCKED")).withField("verified_claims", F.concat(own, like)))

    text_of = F.to_json(F.struct("run_id", "experiment_id", "provider", "model", "embedding_model", "configuration", "cases", "metrics", "provenance"))
    kind = runs.schema["cases"].dataType
    one = kind.elementType["candidate_results"].dataType.elementType.simpleString()
    other = F.lit("0" * 64)
    changed = {
        3: F.slice("cases", 2, 10**6), 4: first(lambda c: c.withField("run_id", F.lit("another"))), 5: first(lambda c: c.withField("model", F.lit("another"))),
        6: first(lambda c: c.withField("candidates", F.transform(c["candidates"], lambda x, i: F.when(i == 0, x.withField("content_sha256", other)).otherwise(x)))),
        7: first(lambda c: c.withField("embedding_index_fingerprint", other)),
        8: results(lambda rs: F.transform(rs, lambda r, i: F.when(i == 0, F.from_json(invented(r), one)).otherwise(r))),
        9: results(lambda rs: F.concat(rs, F.slice(rs, 1, 1))), 10: results(lambda rs: F.slice(rs, 2, 10**6)),
        11: first(lambda c: c.withField("role_traces", F.transform(c["role_traces"], lambda t: t.withField("error", F.lit("simulated"))))),
        13: first(lambda c: c.withField("retrieval", c["retrieval"].withField("final_docket_fingerprint", other))),
        15: F.slice("cases", 1, 0),
    }
    cases = reduce(lambda kept, k: F.when(fault == k, changed[k]).otherwise(kept), changed, F.col("cases"))
    figures = F.from_json("metrics", "map<string,map<string,double>>")

    def falsified(group: str, name: str, value) -> Column:
        inner = F.transform_values(figures[group], lambda k, v: F.when(k == name, value(v)).otherwise(v))
        return F.to_json(F.transform_values(figures, lambda k, v: F.when(k == group, inner).otherwise(v)))

    told = F.when(fault == 1, falsified("overall", "final_hits", lambda v: v + 1)).when(
        fault == 2, falsified("direct", "mean_reciprocal_rank", lambda v: F.lit(2.0))).otherwise(F.col("metrics"))
    seal = F.when(fault == 12, F.col("provenance").withField("identifier_index_fingerprint", other)).otherwise(F.col("provenance"))
    rows = runs.withColumns({"cases": cases, "metrics": told, "provenance": seal}).withColumn("value", text_of)
    return rows.select(F.when(fault == 14, F.expr("left(value, length(value) div 2)")).otherwise(F.col("value")).alias("value"))


def _fault_rows() -> str:
    return ", ".join(f"({k}, '{name}')" for k, names in enumerate(FAULTS) for name in names)


@query(f"""WITH r AS (SELECT DISTINCT doc_id // {10 * RUN_CASES} AS no FROM documents), f(fault, violation) AS (VALUES {_fault_rows()})
 SELECT CASE WHEN violation = 'unreadable' THEN NULL ELSE 'run-' || no END AS run_id, violation, count(*)::BIGINT AS runs FROM r JOIN f ON no % {len(FAULTS)} = fault GROUP BY ALL""")
def stored_runs_audit(spark, sf):
    """Run files written, faults planted in most of them, all read back and audited in one plan; the written figures come from the tables."""
    path = scratch(spark, "runs")
    runs = materialise(StoredEvaluation(spark, sf).documents(), "run-documents")
    with_faults(runs).write.text(path)
    found = run_audit.audit_runs(spark, path, F.lit(RUN_CASES), lines=True)
    kinds = found.groupBy("run_id", "violation").agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("run_id", "violation", F.when(F.col("run_id").isNull(), F.col("n")).otherwise(1).cast("bigint").alias("runs"))


# ---- embedding cache --------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN lang <> 'fr' THEN length(text)::DOUBLE END AS chars, (SELECT count(DISTINCT text) FROM documents WHERE lang <> 'fr') AS keys FROM documents""")
def shared_embedding_cache(spark, sf):
    """Two writers embed overlapping documents at the same time; then all are looked up, French ones without a text."""
    cache = EmbeddingCache(spark, scratch(spark, "embedding-cache"))
    docs = documents(spark, sf, "doc_id", "text", "lang").withColumn("text", F.when(F.col("lang") != "fr", F.col("text"))).drop("lang")

    def staged(part: DataFrame):
        plan = vectors.embed_plan(part, cache.rows(), "sizes", 2, "document")
        return cache.stage(materialise(vectors.embed_missing(plan, text_sizes), "embedded"))

    late, early = staged(docs.filter("doc_id % 3 <> 0")), staged(docs.filter("doc_id % 3 <> 1"))
    cache.commit(early)
    cache.commit(late)
    cache.compact()
    found = embed_stored(docs, cache, text_sizes, "sizes", 2)
    keys = cache.rows().agg(F.count(F.lit(1))).scalar()
    return found.select("doc_id", F.get("vec", F.lit(0)).alias("chars"), keys.alias("keys"))


# ---- logs -------------------------------------------------------------------------

LOG_CASES = 6


@query(f"""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS started, count(*) FILTER (WHERE event_type = 'click') AS completed, count(*) FILTER (WHERE event_type = 'purchase') AS ended,
 count(DISTINCT CASE WHEN event_type = 'click' THEN event_id % 7 END) AS different, min(ts) FILTER (WHERE event_type = 'signup') AS s, min(ts) FILTER (WHERE event_type = 'click') AS f,
 max(ts) FILTER (WHERE event_type = 'click') AS l, max(ts) FILTER (WHERE event_type = 'purchase') AS e FROM events GROUP BY 1),
 j AS (SELECT c_custkey AS run_id, coalesce(started, 0) AS started, coalesce(completed, 0) AS completed, coalesce(ended, 0) AS ended, coalesce(different, 0) AS different, s, f, l, e FROM customer LEFT JOIN c ON user_id = c_custkey)
 SELECT run_id, {LOG_CASES} AS cases, started::BIGINT AS started, completed::BIGINT AS completed, ended::BIGINT AS ended, array_to_string(list_filter([
 CASE WHEN started <> 1 OR completed <> {LOG_CASES} OR ended <> 1 THEN 'incomplete' END, CASE WHEN completed > different THEN 'repeated' END, CASE WHEN different > {LOG_CASES} THEN 'surplus' END,
 CASE WHEN f < s OR l > e THEN 'disorder' END, CASE WHEN ended = 0 THEN 'no_end' END], lambda x: x IS NOT NULL), ',') AS violations FROM j""")
def stream_log_verdicts(spark, sf):
    """Customers as runs, their events as logs: verdicts kept by a stateful stream that reads the event table to its end."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(stream_path(sf, "events")).select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("event"), (F.col("event_id") % 7).alias("case_id"), F.col("ts").alias("at"))
    path = scratch(spark, "log-figures")
    log_state.watch_logs(events, path, scratch(spark, "log-state"), log_state.kinds("signup", "click", "purchase")).awaitTermination()
    expected = table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("run_id"), F.lit(LOG_CASES).alias("cases"))
    found = log_state.verdicts(log_state.read_figures(spark, path), expected)
    return found.withColumn("violations", F.array_join("violations", ","))


# ---- package, cases and run results ------------------------------------------------


@query("""SELECT doc_id::VARCHAR AS source_id, sha256(text) AS content_sha256, n_chars::BIGINT AS chars, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS position, 0::BIGINT AS violations FROM documents""")
def package_sink(spark, sf):
    """Documents as spans of a package: written in order, read back with the place of each, and checked."""
    spans = documents(spark, sf, "doc_id", "text", "n_chars").select(
        F.col("doc_id").cast("string").alias("source_id"), F.lit("documentation").alias("type"), F.lit(None).cast("string").alias("symbol"),
        F.col("n_chars").cast("int").alias("end_line"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_sha256"))
    path = scratch(spark, "package")
    sinks.write_corpus(spans, path)
    placed = materialise(corpus.with_positions(corpus.read_corpus(spark, path)), "package-rows")
    bad = corpus.package_violations(placed).agg(F.count(F.lit(1))).scalar()
    return placed.select("source_id", F.sha2("content", 256).alias("content_sha256"), F.col("end_line").cast("bigint").alias("chars"), "position", bad.alias("violations"))


@query("""WITH c AS (SELECT doc_id, doc_id % 3 = 0 AS old, coalesce(toxic, 0) = 1 AS bad, text FROM documents LEFT JOIN labels USING (doc_id))
 SELECT 'C' || doc_id AS case_id, CASE WHEN old THEN 1 ELSE 2 END AS schema_version, CASE WHEN old AND bad THEN 'E' || doc_id WHEN old THEN 'T' || doc_id ELSE 'X' || doc_id END AS changed_source_id,
 sha256(CASE WHEN old THEN 'new ' || doc_id ELSE text END) AS changed_sha256, 'T' || doc_id AS targets, CASE WHEN old AND NOT bad THEN 0 ELSE 1 END AS evidence, CASE WHEN old THEN 0 ELSE 1 END AS slots FROM c""")
def case_source(spark, sf):
    """Documents as review cases in files of both layouts, read back in the current one."""
    docs = documents(spark, sf, "doc_id", "text").join(table(spark, sf, "labels", "doc_id", "toxic"), "doc_id", "left")
    name, old = F.col("doc_id").cast("string"), F.col("doc_id") % 3 == 0
    own, target = F.concat(F.lit("E"), name), F.concat(F.lit("T"), name)
    evidence = F.when(F.col("toxic") == 1, F.struct(own.alias("source_id"), F.lit("span").alias("span")))
    first = F.struct(
        F.concat(F.lit("C"), name).alias("id"), F.lit("direct").alias("type"), F.lit("text").alias("change_text"), F.array(target).alias("expected_review_targets"),
        evidence.alias("expected_evidence"), F.struct(F.concat(F.lit("old "), name).alias("old_value"), F.concat(F.lit("new "), name).alias("new_value")).alias("change"))
    later = F.struct(
        F.concat(F.lit("C"), name).alias("id"), F.lit("direct").alias("type"), F.array(target).alias("expected_review_targets"), F.concat(F.lit("X"), name).alias("changed_source_id"),
        F.col("text").alias("changed_content"), F.array(F.struct(own.alias("source_id"), F.array(F.lit("span")).alias("spans"))).alias("expected_evidence_by_target"),
        F.array(F.struct(F.lit("slot").alias("claim_slot_id"), target.alias("source_id"))).alias("expected_claims"))
    path = scratch(spark, "cases")

    def written(rows: DataFrame, version: int, case: Column) -> None:
        head = F.struct(F.lit(version).alias("schema_version"), F.lit("experiment").alias("experiment_id"), F.lit(10).alias("top_k"), F.array(case).alias("cases"))
        # A reader of whole documents takes one per file; here a document per line.
        rows.select(F.to_json(head).alias("value")).write.mode("append").text(path)

    written(docs.filter(old), 1, first)
    written(docs.filter(~old), 2, later)
    read = corpus.read_cases(spark, path, lines=True)
    return read.select(
        F.col("id").alias("case_id"), "schema_version", "changed_source_id", F.sha2("changed_content", 256).alias("changed_sha256"),
        F.array_join("expected_review_targets", ",").alias("targets"), F.size("expected_evidence_by_target").alias("evidence"), F.size("expected_claims").alias("slots"))


@query(f"""WITH r AS (SELECT '{{{{"case_id":' || o_orderkey || ',"overall_status":"' || o_orderstatus || '"}}}}' AS row, o_orderkey % 4 AS part FROM orders),
 a AS (SELECT * FROM r WHERE part < 3) SELECT 'final' AS result, (SELECT count(*) FROM r) AS rows, {ranking.fold_duck('r', ['row'])} AS sha256
 UNION ALL SELECT 'latest', (SELECT count(*) FROM a), {ranking.fold_duck('a', ['row'])} UNION ALL SELECT 'again', 1, 'refused' UNION ALL SELECT 'checkpoint', (SELECT count(*) FROM r), 'read back'""".replace("{{", "{").replace("}}", "}"))
def run_sinks(spark, sf):
    """Orders as case results: the final result once and for all, the latest one replaced, checkpoints appended."""
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderstatus").toDF("case_id", "overall_status")
    final, latest, checkpoint = (scratch(spark, n) for n in ("final", "latest", "checkpoint"))
    hashes = {"final": sinks.write_final(rows, final)}
    try:
        sinks.write_final(rows.limit(1), final)
        again = "written"
    except AnalysisException:
        again = "refused"
    sinks.write_latest(rows, latest)
    hashes["latest"] = sinks.write_latest(rows.filter("case_id % 4 < 3"), latest)
    for k in range(4):
        sinks.append_checkpoint(rows.filter(F.col("case_id") % 4 == k).withColumn("run_id", F.lit("run")), checkpoint)
    stored = spark.read.parquet(checkpoint).select("case_id", "overall_status")
    kept = stored.join(rows, ["case_id", "overall_status"]).agg(F.count(F.lit(1)).alias("rows"))
    parts = [h.select(F.lit(n).alias("result"), "rows", F.col("fingerprint").alias("sha256")) for n, h in hashes.items()]
    parts.append(spark.range(1).select(F.lit("again").alias("result"), F.lit(1).cast("bigint").alias("rows"), F.lit(again).alias("sha256")))
    parts.append(kept.select(F.lit("checkpoint").alias("result"), "rows", F.lit("read back").alias("sha256")))
    return reduce(DataFrame.unionByName, parts)


@query("""WITH c AS (SELECT o_custkey AS run_id, count(*) AS cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, min(o_orderkey) AS first FROM orders GROUP BY 1)
 SELECT o_custkey AS run_id, o_orderkey AS case_id, 'case' AS part, '{"overall_status":"' || o_orderstatus || '"}' AS body FROM orders
 UNION ALL SELECT run_id, NULL, 'run', to_json({'configuration': '{"broad_k":40,"top_k":10}', 'metrics': '{"cases":' || cases || ',"finished":' || finished || '}',
 'provenance': {'freeze_tag': 'frozen', 'source_commit': sha256(first::VARCHAR)}})::VARCHAR FROM c""")
def assemble_whole_run(spark, sf):
    """Run documents with configuration, metrics from the cases and provenance in their header."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").toDF("case_id", "run_id", "overall_status")
    figures = F.struct(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("overall_status") == "F").alias("finished"))
    source = F.struct(F.lit("frozen").alias("freeze_tag"), F.sha2(F.min("case_id").cast("string"), 256).alias("source_commit"))
    limits = F.to_json(F.struct(F.lit(scores.BROAD_K).alias("broad_k"), F.lit(scores.FINAL_K).alias("top_k")))
    runs = orders.groupBy("run_id").agg(F.to_json(figures).alias("metrics"), source.alias("provenance")).withColumn("configuration", limits)
    return live.assemble_run(runs, orders)
