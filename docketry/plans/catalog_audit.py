"""Driver queries over integrity audits and micro-batch processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions import scores, text
from docketry.functions.rows import explode_rows
from docketry.operators import audit, compare, index, metrics, retrieve, review
from docketry.plans import catalog_retrieval, catalog_text
from docketry.plans import catalog_review as standin
from docketry.plans import fragments as sql
from docketry.plans import retrieval
from docketry.plans.catalog_review import _E0, _F2, _H0, NO_SUCH
from docketry.plans.catalog_text import documents
from docketry.session import materialise, scratch, table
from docketry.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return register


def listed_violations(checks: str) -> str:
    return f"unnest(list_filter([{checks}], lambda x: x IS NOT NULL)) AS violation"


# ---- files and manifests ----------------------------------------------------------
# The manifest lists labelled documents plus their successors; toxic ones carry a wrong hash.


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "doc_id", "text")
    listed = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("path"), F.when(F.col("toxic") == 1, F.sha2("text", 512)).otherwise(F.sha2("text", 256)).alias("sha256"),
        (F.octet_length("text") + F.col("quality")).cast("bigint").alias("bytes"))
    beyond = listed.select((F.col("path") + 1_000_000_000).alias("path"), "sha256", "bytes")
    return listed.unionByName(beyond)


def stored_files(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text").select(
        F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("""SELECT doc_id AS path, 'sha256' AS violation FROM labels JOIN documents USING (doc_id) WHERE toxic = 1
 UNION ALL SELECT doc_id + 1000000000, 'missing' FROM labels JOIN documents USING (doc_id)""")
def freeze_audit(spark, sf):
    return audit.freeze(manifest(spark, sf), stored_files(spark, sf))


@query("""SELECT doc_id AS path, 'sha256' AS violation FROM labels JOIN documents USING (doc_id) WHERE toxic = 1
 UNION ALL SELECT doc_id, 'bytes' FROM labels JOIN documents USING (doc_id) WHERE quality = 1
 UNION ALL SELECT doc_id + 1000000000, 'missing' FROM labels JOIN documents USING (doc_id)""")
def provenance_audit(spark, sf):
    return audit.provenance(manifest(spark, sf), stored_files(spark, sf))


@query("""WITH e AS (SELECT p_brand AS type, count(*) AS expected FROM part WHERE p_size > 10 GROUP BY 1), a AS (SELECT p_brand AS type, count(*) AS actual FROM part GROUP BY 1)
 SELECT type, expected::BIGINT AS expected, actual::BIGINT AS actual FROM e FULL JOIN a USING (type) WHERE expected IS DISTINCT FROM actual""")
def distribution_audit(spark, sf):
    parts = table(spark, sf, "part", "p_brand", "p_size").withColumnRenamed("p_brand", "type")
    expected = parts.filter("p_size > 10").groupBy("type").agg(F.count(F.lit(1)).alias("expected"))
    return audit.distribution(expected, parts)


@query("""SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dup_keys(spark, sf):
    return audit.duplicate_keys(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


# ---- cases and gold ---------------------------------------------------------------


def case_table(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as cases: the distinct opening words of their lines are targets.

    Slots come from all lines (sources may repeat); odd-length texts lose a target.
    """
    lines = F.transform(text.split_lines(F.col("text")), lambda l: F.regexp_extract(l, r"^(\S*)", 1))
    return documents(spark, sf, "doc_id", "text", "lang", "n_chars").withColumn("heads", lines).select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("type"), "heads", "text", "n_chars",
        F.transform("heads", lambda h, i: F.struct(
            F.concat(F.lit("C"), F.least(i, F.lit(5)).cast("string")).alias("claim_slot_id"), h.alias("source_id"),
            F.lit("INTERFACE_IMPACT").alias("impact_type"), F.array(h).alias("acceptable_exact_evidence_spans"))).alias("expected_claims"),
        F.when(F.col("n_chars") % 2 == 1, F.slice(F.array_distinct("heads"), 2, F.size("heads"))).otherwise(F.array_distinct("heads")).alias("expected_review_targets"),
        F.transform(F.array_distinct("heads"), lambda h: F.struct(h.alias("source_id"), F.array(h).alias("spans"))).alias("expected_evidence_by_target"),
        F.when(F.col("lang") == "fr", text.empty_strings()).otherwise(F.array("lang")).alias("basis_source_ids"),
        F.struct(F.lit("requirement").alias("artifact_type")).alias("incoming_artifact"),
        F.lit(None).cast("string").alias("changed_source_id"), F.lit(None).cast("string").alias("original_content"),
    )


_HEADS = f"""h AS (SELECT doc_id::VARCHAR AS id, lang, n_chars, list_transform({sql.lines('text')}, lambda l: regexp_extract(l, '^([^\\t\\n\\v\\f\\r ]*)', 1)) AS hs FROM documents),
 c AS (SELECT *, list_filter(hs, lambda v, i: list_position(hs, v) = i) AS d FROM h),
 t AS (SELECT *, CASE WHEN n_chars % 2 = 1 THEN d[2:] ELSE d END AS tg FROM c)"""


@query(f"""WITH {_HEADS} SELECT id, {listed_violations("CASE WHEN len(hs) > 6 THEN 'duplicate_slot' END, CASE WHEN len(tg) <> len(d) THEN 'evidence_targets' END, CASE WHEN lang = 'fr' THEN 'no_basis' END, CASE WHEN tg <> d THEN 'targets' END")} FROM t""")
def gold_target_audit(spark, sf):
    return audit.gold_targets(case_table(spark, sf))


@query("""SELECT o_orderkey, o_custkey::VARCHAR AS reference, 'unknown_customer' AS violation FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
 UNION ALL SELECT c_custkey, c_nationkey::VARCHAR, 'unknown_nation' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)""")
def ref_audit(spark, sf):
    customer = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    solvent, known = customer.filter("c_acctbal >= 0"), table(spark, sf, "nation").filter("n_regionkey <> 1")
    orders = audit.references(table(spark, sf, "orders", "o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey", solvent, "c_custkey", "unknown_customer")
    people = audit.references(customer, ["c_custkey"], "c_nationkey", known, "n_nationkey", "unknown_nation")
    return orders.unionByName(people.withColumnRenamed("c_custkey", "o_orderkey"))


@query(f"""WITH {_HEADS}, k AS (SELECT DISTINCT lower(source) AS s FROM documents UNION SELECT DISTINCT lang FROM documents WHERE lang <> 'de' UNION SELECT DISTINCT d[1] FROM c WHERE len(d) > 0),
 r AS (SELECT DISTINCT id, 'unknown_basis' AS violation, lang AS reference FROM t WHERE lang <> 'fr' UNION SELECT id, 'unknown_target', unnest(tg) FROM t
 UNION SELECT id, 'unknown_evidence', unnest(d) FROM t UNION SELECT id, 'unknown_claim', unnest(d) FROM t)
 SELECT id, violation, reference FROM r WHERE reference NOT IN (SELECT s FROM k)""")
def case_references(spark, sf):
    cases = case_table(spark, sf)
    names = documents(spark, sf, "source", "doc_id").select(F.lower("source").alias("source_id")).union(
        cases.filter("type <> 'de'").select("type")).union(cases.filter(F.size("heads") > 0).select(F.get("heads", F.lit(0)))).distinct()
    return audit.case_references(cases, names)


@query(f"""WITH {_HEADS}, g AS (SELECT DISTINCT id, unnest(d) AS span FROM t), n AS (SELECT doc_id, text, lead(text) OVER (ORDER BY doc_id) AS nxt FROM documents)
 SELECT id, span FROM g JOIN n ON n.doc_id::VARCHAR = id WHERE nxt IS NOT NULL AND NOT contains(nxt, span)""")
def gold_span_audit(spark, sf):
    """Opening words of each document's lines looked up in the following document."""
    cases = case_table(spark, sf)
    gold = audit.gold_texts(cases).select("id", F.col("id").alias("source_id"), "span").distinct()
    spans = documents(spark, sf, "doc_id", "text").select((F.col("doc_id") - 1).cast("string").alias("source_id"), F.col("text").alias("content"))
    return audit.gold_spans(gold, spans).select("id", "span")


# ---- stored runs ------------------------------------------------------------------


@query("""WITH m AS (SELECT o_custkey AS run_id, o_orderpriority AS metric, count(*) AS v FROM orders GROUP BY ALL), s AS (SELECT o_custkey AS run_id, o_orderpriority AS metric, count(*) AS v
 FROM orders WHERE o_totalprice < 490000 GROUP BY ALL) SELECT run_id, metric, s.v::BIGINT AS stored, m.v::BIGINT AS recomputed FROM s FULL JOIN m USING (run_id, metric) WHERE s.v IS DISTINCT FROM m.v""")
def metric_recompute(spark, sf):
    orders = table(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_totalprice").toDF("run_id", "metric", "price")

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("value"))

    return audit.stored_metrics(counted(orders.filter("price < 490000")), counted(orders))


class StoredCases:
    """Dockets of the review stand-in as stored cases, some with altered identity."""

    def __init__(self, spark: SparkSession, sf: str):
        rows = standin.labelled(spark, sf)
        keyed = rows.withColumn("run_id", F.expr("query_id div 50")).withColumnRenamed("query_id", "case_id")
        self.docket = keyed.select(*metrics.SPAN, "rank", F.sha2("content", 256).alias("content_sha256"))
        sealed = self.docket.withColumn("query_id", F.struct(*metrics.CASE))
        prints = retrieve.sequence_fingerprint(sealed, "rank", "fp").select("query_id.*", "fp")
        odd = F.col("case_id") % 7 == 3
        self.cases = prints.select(
            *metrics.CASE, (F.col("run_id") + F.when(F.col("case_id") % 11 == 5, 1).otherwise(0)).alias("case_run_id"), F.lit("p").alias("provider"),
            F.when(F.col("case_id") % 13 == 1, "other").otherwise("m").alias("model"), F.lit("e").alias("embedding_model"),
            F.when(odd, F.reverse("fp")).otherwise(F.col("fp")).alias("candidate_fingerprint"))
        self.runs = self.cases.select("run_id").distinct().select(
            "run_id", F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("e").alias("embedding_model"), F.lit(10).alias("top_k"))
        kept = (F.col("case_id") % 9 != 2) | (F.col("rank") < 10)
        self.short_docket = self.docket.filter(kept)


_K = "SELECT DISTINCT query_id // 50 AS run_id, query_id AS case_id FROM lb"


@query(f"""WITH {_F2}, k AS ({_K}), s AS (SELECT query_id AS case_id, count(*) AS n, count(*) FILTER (WHERE query_id % 9 <> 2 OR rank < 10) AS kept FROM lb GROUP BY 1)
 SELECT run_id, case_id, {listed_violations("CASE WHEN kept <> n OR case_id % 7 = 3 THEN 'candidate_fingerprint' END, CASE WHEN case_id % 11 = 5 THEN 'run_id' END, CASE WHEN case_id % 13 = 1 THEN 'runtime' END, CASE WHEN kept <> 10 THEN 'top_k' END")} FROM k JOIN s USING (case_id)""")
def run_case_audit(spark, sf):
    stored = StoredCases(spark, sf)
    return audit.case_identity(stored.cases, stored.runs, stored.short_docket)


@query("""WITH c AS (SELECT o_orderkey AS case_id, o_custkey AS run_id, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS p FROM orders)
 SELECT run_id, case_id, unnest(list_filter([CASE WHEN st = 'P' THEN 'embedding_index' END, CASE WHEN pr = '5-LOW' THEN 'identifier_index' END,
 CASE WHEN p > 400000 OR st = 'O' THEN 'retrieval_seal' END], lambda x: x IS NOT NULL)) AS violation FROM c""")
def seal_audit(spark, sf):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    cases = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("case_id"), F.when(status == "P", F.lit(None)).otherwise(F.lit("e")).alias("embedding_index_fingerprint"),
        F.when(F.col("o_orderpriority") == "5-LOW", "drift").otherwise("i").alias("identifier_index_fingerprint"), F.lit("d").alias("final_docket_fingerprint"),
        F.lit("d").alias("candidate_fingerprint"), F.when(status == "O", 11).otherwise(10).alias("final_k"), F.lit(40).alias("broad_k"),
        F.when(price > 400000, 201).otherwise(200).alias("expanded_count"))
    runs = table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("run_id"), *[
        F.lit(v).alias(f"{side}_{name}_index_fingerprint") for side in ("config", "provenance") for name, v in (("embedding", "e"), ("identifier", "i"))])
    return audit.index_seals(cases, runs)


@query(f"""WITH {_F2}, rr AS (SELECT query_id, source_id FROM res WHERE NOT (quality = 0 AND lang = 'en') UNION ALL SELECT query_id, source_id FROM res WHERE toxic = 1 UNION ALL SELECT query_id + 1, source_id FROM res WHERE toxic = 1 AND lang = 'fr'),
 n AS (SELECT query_id, source_id, count(*) AS n FROM rr GROUP BY ALL)
 SELECT query_id, source_id, CASE WHEN lb.query_id IS NULL THEN 'off_docket' WHEN n IS NULL THEN 'missing_result' ELSE 'duplicate_result' END AS violation, coalesce(n, 0)::BIGINT AS results
 FROM (SELECT query_id, source_id, 1 AS one FROM lb) lb FULL JOIN n USING (query_id, source_id) WHERE lb.one IS NULL OR n IS NULL OR n > 1""".replace("CASE WHEN lb.query_id IS NULL", "CASE WHEN lb.one IS NULL"))
def result_cardinality(spark, sf):
    case = standin.Case(spark, sf)
    found = case.resolved()[0].select("query_id", "source_id", "quality", "toxic", "lang") if "quality" in case.docket.columns else (
        case.resolved()[0].select("query_id", "source_id").join(case.rows.select("source_id", "quality", "toxic", "lang"), "source_id"))
    kept = found.filter(F.coalesce(~((F.col("quality") == 0) & (F.col("lang") == "en")), F.col("lang") != "en"))
    again = found.filter("toxic = 1")
    moved = found.filter("toxic = 1 and lang = 'fr'").withColumn("query_id", F.col("query_id") + 1)
    return audit.result_cardinality(case.docket, kept.unionByName(again).unionByName(moved), ["query_id", "source_id"])


@query(f"""WITH {_F2}, ex AS (SELECT e.query_id, e.source_id, e.claim_id, CASE WHEN lang = 'fr' THEN '{NO_SUCH}' ELSE evidence END AS evidence, e.line + CASE WHEN lang = 'de' THEN 1000000 ELSE 0 END AS line, verdict, l.content, l.end_line
  FROM eff e JOIN lb l USING (query_id, source_id)),
 xc AS (SELECT query_id, source_id, count(*) AS n FROM ex GROUP BY ALL)
 SELECT query_id, source_id, 'unsupported_claim_exposed' AS violation FROM res JOIN xc USING (query_id, source_id) WHERE status <> 'VERIFIED_REVIEW'
 UNION ALL SELECT query_id, source_id, {listed_violations("CASE WHEN NOT contains(content, evidence) THEN 'not_exact' END, CASE WHEN line > end_line THEN 'out_of_range' END, CASE WHEN verdict <> 'SUPPORTED' THEN 'verdict' END")} FROM ex""")
def exposure_audit(spark, sf):
    """All valid claims exposed, supported or not, some with altered evidence."""
    case = standin.Case(spark, sf)
    results, effective, _ = case.resolved()
    lang = case.rows.select("source_id", "lang")
    far = F.when(F.col("lang") == "de", 1_000_000).otherwise(0)
    claims = effective.join(lang, "source_id").select(
        "query_id", "source_id", "claim_id", F.when(F.col("lang") == "fr", NO_SUCH).otherwise(F.col("evidence_exact_text")).alias("evidence_exact_text"),
        (F.col("evidence_start_line") + far).alias("evidence_start_line"), (F.col("evidence_end_line") + far).alias("evidence_end_line"))
    return audit.exposure(case.docket, results, claims, effective.select("query_id", "claim_id", "verdict"), ["query_id"])


@query(f"""WITH {_H0}, it AS (SELECT run_id, case_id, source_id, n_chars % 3 = 0 AS ok FROM pk UNION ALL SELECT run_id, case_id, source_id, true FROM pk WHERE n_chars % 10 = 0),
 ic AS (SELECT run_id, case_id, source_id, count(*) AS n, bool_and(ok) AS ok FROM it GROUP BY ALL)
 SELECT run_id, case_id, source_id, {listed_violations("CASE WHEN NOT coalesce(contains(dk.content, evidence) AND length(evidence) > 0, false) THEN 'evidence' END, CASE WHEN n_chars % 4 = 1 THEN 'reasons' END, CASE WHEN n <> 1 OR NOT ok THEN 'verdict' END")}
 FROM pk LEFT JOIN dk USING (run_id, case_id, source_id) JOIN ic USING (run_id, case_id, source_id)
 UNION ALL SELECT run_id, case_id, source_id, 'duplicate_review' FROM pk WHERE n_chars % 8 = 0""")
def legacy_exposure_audit(spark, sf):
    runs = standin.Runs(spark, sf)
    sizes = documents(spark, sf, "doc_id", "n_chars").withColumnRenamed("doc_id", "source_id")
    base = runs.reviews.join(sizes, "source_id").withColumns({
        "status": F.lit("VERIFIED_REVIEW"), "short_reason": F.lit("r"), "verifier_reason": F.when(F.col("n_chars") % 4 != 1, F.lit("v"))})
    reviews = base.unionByName(base.filter("n_chars % 8 = 0"))
    items = runs.items.join(sizes, "source_id").select(*metrics.SPAN, "supported", "n_chars")
    twice = items.filter("n_chars % 10 = 0").withColumn("supported", F.lit(True))
    return audit.legacy_exposure(reviews, runs.docket, items.unionByName(twice))


# For each compared field how a run's value derives from its order, so that every check has rows on both sides.
_FIELD = {name: i + 2 for i, name in enumerate([*audit.PROVENANCE_PAIRS, *audit.PROVENANCE_PRESENT]) if name != "experiment_id"}
_PAIRED = [name for name in audit.PROVENANCE_PAIRS if name != "experiment_id"]


def _provenance_duck() -> str:
    pairs = [f"CASE WHEN m.experiment_id IS NULL OR (run_id + {_FIELD[n]}) % {_FIELD[n]} = 0 THEN '{n}' END" for n in _PAIRED]
    present = [f"CASE WHEN (run_id + {_FIELD[n]}) % {_FIELD[n]} = 0 THEN 'no_{n}' END" for n in audit.PROVENANCE_PRESENT]
    return f"""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS experiment_id, o_totalprice AS p FROM orders),
 m AS (SELECT c_custkey AS experiment_id FROM customer WHERE c_acctbal >= 0)
 SELECT run_id, unnest(list_filter([CASE WHEN p < 50000 THEN 'artifact_store' END, CASE WHEN p > 300000 THEN 'container_image_digest' END,
 CASE WHEN m.experiment_id IS NULL THEN 'experiment_id' END, {", ".join(pairs + present)}], lambda x: x IS NOT NULL)) AS violation FROM r LEFT JOIN m USING (experiment_id)"""


@query(_provenance_duck())
def provenance_match(spark, sf):
    """All compared fields and all that must be present; each is wrong or missing for some orders."""
    price, run = F.col("o_totalprice"), F.col("o_orderkey")
    wrong = {n: (run + k) % k == 0 for n, k in _FIELD.items()}
    runs = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice").select(
        run.alias("run_id"), F.col("o_custkey").alias("experiment_id"),
        F.when(price < 50000, "local").otherwise("gcs").alias("artifact_store"), F.when(price > 300000, "image:latest").otherwise("image@sha256:1").alias("container_image_digest"),
        *[F.when(wrong[n], "drift").otherwise("as planned").alias(n) for n in _PAIRED],
        *[F.when(~wrong[n], "1.0").otherwise(F.when(run % 2 == 0, "")).alias(n) for n in audit.PROVENANCE_PRESENT])
    manifests = table(spark, sf, "customer", "c_custkey", "c_acctbal").filter("c_acctbal >= 0").select(
        F.col("c_custkey").alias("experiment_id"), *[F.lit("as planned").alias(audit.PROVENANCE_PAIRS[n]) for n in _PAIRED])
    return audit.provenance_match(runs, manifests)


@query("""SELECT conv_id AS run_id, turn AS case_id, role, 'role_error' AS violation FROM conversations WHERE length(text) % 5 = 0 AND length(text) > 0""")
def role_error_audit(spark, sf):
    """Turns as role traces; some carry their text as an error."""
    traces = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("case_id"), "role",
        F.when(F.length("text") % 5 == 0, F.col("text")).when(F.length("text") % 5 == 1, F.lit("")).alias("error"))
    return audit.role_errors(traces)


@query("""WITH l AS (SELECT o_custkey AS run_id, o_orderkey AS case_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids, any_value(o_orderstatus) AS st
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
 SELECT run_id, case_id, 'arms_differ' AS violation FROM l WHERE st = 'P' OR (st = 'O' AND list_reverse(ids) <> ids)""")
def legacy_arm_audit(spark, sf):
    """Parts of an order as candidates; partial orders lack an arm, open ones have it in another order."""
    items = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    orders = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus").toDF("run_id", "case_id", "status")
    ids = F.col("items.l_partkey")
    return audit.legacy_arms(orders.join(items, "case_id").select(
        "run_id", "case_id", ids.alias("candidate_ids"), F.when(F.col("status") != "P", ids).alias("baseline_candidate_source_ids"),
        F.when(F.col("status") == "O", F.reverse(ids)).otherwise(ids).alias("proposed_candidate_source_ids")))


@query(r"""SELECT event_id, props FROM events WHERE regexp_matches(props, '"k": ?[0-9]*7[,}]') OR contains(props, 'evidence')""")
def prohibited_log_content(spark, sf):
    return audit.prohibited_content(table(spark, sf, "events", "event_id", "props"), "props", r'"k": ?[0-9]*7[,}]|evidence')


@query("""SELECT run_id, unnest(list_filter([CASE WHEN f THEN 'failed_run' END, CASE WHEN st IS DISTINCT FROM 'F' THEN 'not_complete' END, CASE WHEN sealed IS DISTINCT FROM p THEN 'seal' END], lambda x: x IS NOT NULL)) AS violation
 FROM (SELECT o_orderkey AS run_id, o_orderstatus AS st, o_totalprice AS p, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AS f,
 CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS sealed FROM orders)""")
def completion_audit(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    price = F.col("o_totalprice").cast("string")
    finals = orders.select("run_id", F.lit(1).alias("generation"), F.sha2(price, 256).alias("sha256"))
    seal = F.when(F.col("o_orderpriority") != "5-LOW", F.sha2(price, 256))
    checkpoints = orders.select(
        "run_id", F.when(F.col("o_orderstatus") == "F", "complete").otherwise("in_progress").alias("status"), F.lit(1).alias("final_generation"), seal.alias("final_sha256"))
    failures = table(spark, sf, "lineitem", "l_orderkey", "l_quantity").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("run_id"))
    return audit.completion(checkpoints, finals, failures)


@query("""WITH c AS (SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'signup') AS started, count(*) FILTER (WHERE event_type = 'click') AS completed,
 count(*) FILTER (WHERE event_type = 'purchase') AS ended FROM events GROUP BY 1), e AS (SELECT c_custkey AS run_id, 10 AS cases FROM customer)
 SELECT run_id, cases, coalesce(started, 0)::BIGINT AS started, coalesce(completed, 0)::BIGINT AS completed, coalesce(ended, 0)::BIGINT AS ended FROM e LEFT JOIN c USING (run_id)
 WHERE NOT (coalesce(started, 0) = 1 AND coalesce(completed, 0) = cases AND coalesce(ended, 0) = 1)""")
def log_completeness(spark, sf):
    events = table(spark, sf, "events", "user_id", "event_type").toDF("run_id", "event")
    expected = table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("run_id"), F.lit(10).alias("cases"))
    return audit.log_completeness(events, expected, "signup", "click", "purchase")


# Audits of the suite: files, provenance, manifest, ids, gold, references, stored indexes.
_SUITE = (
    "freeze_audit", "provenance_audit", "prompt_audit", "sealed_file_audit", "dup_keys", "gold_target_audit", "ref_audit", "case_references",
    "gold_span_audit", "stored_vector_audit", "index_audit",
)


@query("""WITH m AS (SELECT doc_id AS role, CASE WHEN toxic = 1 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM labels JOIN documents USING (doc_id)),
 i AS (SELECT doc_id AS role, CASE WHEN lang = 'es' THEN '' ELSE text END AS t FROM documents WHERE lang <> 'de'), j AS (SELECT role, h, t, coalesce(length(t) = 0, true) AS blank FROM m FULL JOIN i USING (role))
 SELECT role, unnest(list_filter([CASE WHEN h IS NULL THEN 'role_set' END, CASE WHEN blank THEN 'missing_instruction' END, CASE WHEN NOT blank AND h IS NOT NULL AND h <> sha256(t) THEN 'sha256' END],
 lambda x: x IS NOT NULL)) AS violation FROM j""")
def prompt_audit(spark, sf):
    """Documents as role instructions; labelled ones are listed, some with a wrong hash."""
    docs = documents(spark, sf, "doc_id", "text", "lang")
    listed = table(spark, sf, "labels", "doc_id", "toxic").join(docs, "doc_id").select(
        F.col("doc_id").alias("role"), F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    given = docs.filter("lang <> 'de'").select(F.col("doc_id").alias("role"), F.when(F.col("lang") == "es", "").otherwise(F.col("text")).alias("instruction"))
    return audit.prompts(listed, given)


@query("""SELECT path, unnest(list_filter([CASE WHEN found IS NULL OR quality = 0 THEN 'no_generation' END, CASE WHEN found IS NULL OR toxic = 1 THEN 'sha256' END], lambda x: x IS NOT NULL)) AS violation
 FROM (SELECT l.doc_id AS path, quality, toxic, d.doc_id AS found FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang <> 'fr')""")
def sealed_file_audit(spark, sf):
    """Labelled documents as a manifest against the stored ones; some lack a generation, some have another content."""
    labels = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    stored = labels.join(documents(spark, sf, "doc_id", "text", "lang").filter("lang <> 'fr'"), "doc_id").select(
        F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, F.lit(1)).alias("generation"),
        F.when(F.col("toxic") == 1, F.lit("other")).otherwise(F.col("doc_id").cast("string")).alias("sha256"))
    return audit.seals(stored, labels.select(F.col("doc_id").alias("path"), F.col("doc_id").cast("string").alias("sha256")))


def _suite_duck() -> str:
    every = ORACLES | catalog_retrieval.ORACLES | catalog_text.ORACLES
    return " UNION ALL ".join(f"""SELECT '{name}' AS "check", count(*)::BIGINT AS violations FROM ({every[name]})""" for name in _SUITE)


@query(_suite_duck())
def audit_suite(spark, sf):
    """Violations of every stored input and index, with zero for audits that pass."""
    every = QUERIES | catalog_retrieval.QUERIES | catalog_text.QUERIES
    return audit.suite_counts(*[(name, every[name](spark, sf)) for name in _SUITE])


_STORED = ("eligible_targets", "broad_hits", "expanded_hits", "final_hits")


@query(f"""WITH m AS (UNPIVOT (SELECT run_id, "group", {", ".join(_STORED)} FROM ({standin.ORACLES["hit_rates"]})) ON {", ".join(_STORED)} INTO NAME metric VALUE v)
 SELECT run_id, "group" || '/' || metric AS metric, CASE WHEN metric = 'final_hits' THEN v + 1 END AS stored, v AS recomputed FROM m
 WHERE (metric = 'final_hits' AND "group" = 'overall') OR (metric = 'broad_hits' AND "group" = 'clean')""")
def stored_run_audit(spark, sf):
    """Figures of all stored runs against those recomputed from their cases; overall final hits are falsified, one figure is missing."""
    figures = metrics.evaluate(standin.Evaluation(spark, sf).hits(), metrics.hit_figures())
    long = figures.select("run_id", "group", *_STORED).unpivot(["run_id", "group"], list(_STORED), "metric", "value").select(
        "run_id", F.concat_ws("/", "group", "metric").alias("metric"), "value")
    recomputed = materialise(long, "recomputed")
    stored = recomputed.filter("metric <> 'clean/broad_hits'").withColumn(
        "value", F.when(F.col("metric") == "overall/final_hits", F.col("value") + 1).otherwise(F.col("value")))
    return audit.stored_metrics(stored, recomputed)


# ---- incremental ------------------------------------------------------------------


@query("SELECT o_orderkey AS case_id, o_custkey AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark, sf):
    cases = table(spark, sf, "orders", "o_orderkey", "o_custkey").toDF("case_id", "run_id")
    done = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"))
    return live.pending_cases(cases, done, ["case_id"])


def stream_path(sf: str, name: str) -> str:
    """A pattern for one table: a stream takes a plain path for a folder only, a pattern for a file as well."""
    return f"{sf}/{name[:-1]}[{name[-1]}].parquet"


@query("SELECT user_id AS run_id, event_type AS event, count(*)::BIGINT AS records FROM events GROUP BY ALL")
def stream_event_counts(spark, sf):
    """Counts kept by a streaming query that reads the event table to its end."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(stream_path(sf, "events")).select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("event"))
    path = scratch(spark, "event-counts")
    live.stream_event_counts(events, path, scratch(spark, "events")).awaitTermination()
    return live.read_event_counts(spark, path)


@query()
def micro_batch_retrieve(spark, sf):
    """Benchmark texts arrive as a stream of requests and leave as reviewed dockets."""
    docs = documents(spark, sf, "doc_id", "source", "text").withColumnRenamed("doc_id", "source_id")
    forward = retrieval.build_forward(docs.withColumn("source_id", F.col("source_id").cast("string")), index.span_text("source", "text"))
    words = explode_rows(forward, F.array_distinct("tokens"), "identifier", "source_id").withColumns(
        {"kind": F.lit("word"), "scope": F.lit(index.SCOPE)})
    spans = docs.select(
        F.col("source_id").cast("string").alias("source_id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_sha256"),
        F.lit(1).alias("start_line"), F.size(text.split_lines(F.col("text"))).alias("end_line"))
    corpus = retrieval.SpanIndex(forward, spans, retrieval.build_links(words))
    requests = spark.readStream.schema("item_id BIGINT, text STRING").parquet(stream_path(sf, "benchmark")).select(
        F.col("item_id").cast("string").alias("query_id"), F.lit("requirement").alias("artifact_type"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("subsystem"), text.empty_strings().alias("identifiers"), "text")
    out = scratch(spark, "reviews")
    live.run_reviews(requests, out, scratch(spark, "review-log"), corpus, "review").awaitTermination()
    shown = spark.read.parquet(f"{out}/results")
    return shown.select("query_id", "source_id", "rank", "status", "blocked_count", "overall_status", "partial", "query_fingerprint", "final_docket_fingerprint")


@query("""SELECT o_custkey AS run_id, o_orderkey AS case_id, 'case' AS part, '{"overall_status":"' || o_orderstatus || '"}' AS body FROM orders
 UNION ALL SELECT DISTINCT o_custkey, NULL, 'run', '{"configuration":"{}"}' FROM orders""")
def assemble_run(spark, sf):
    """Run documents: a header and the cases of each run."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").toDF("case_id", "run_id", "overall_status")
    runs = orders.select("run_id").distinct().withColumn("configuration", F.lit("{}"))
    return live.assemble_run(runs, orders)
