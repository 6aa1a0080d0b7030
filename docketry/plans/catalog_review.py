"""Driver queries over claim validation, resolution, metrics and run comparison.

Stand-ins: ten consecutive documents form one docket (query = doc_id div 10, rank = place
in the ten). Labels give decisions: quality 1 is REVIEW with one to three claims cut from
the text, other rows are NO_REVIEW or INSUFFICIENT_EVIDENCE; unlabelled documents have no
decision. Repeated, off-docket and failing rows come from fixed properties of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry import schemas
from docketry.functions import text
from docketry.functions.rows import inline_rows
from docketry.operators import audit, compare, metrics, retrieve, review
from docketry.plans import fragments as sql
from docketry.plans.catalog_text import documents
from docketry.session import materialise, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return register


NO_SUCH = "no such text anywhere"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with labels (null where unlabelled), docket place and opening line."""
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    lines = text.split_lines(F.col("text"))
    return rows.select(
        F.expr("doc_id div 10").alias("query_id"), F.col("doc_id").alias("source_id"),
        (F.col("doc_id") % 10 + 1).cast("int").alias("rank"), F.col("text").alias("content"),
        F.lit(1).alias("start_line"), F.size(lines).alias("end_line"), "lang", "source", "n_chars", "quality", "toxic",
    ).withColumn("opening", review.first_line(F.col("content"), F.col("start_line")))


def docket(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "source_id", "rank", "content", "start_line", "end_line")


def decisions(rows: DataFrame) -> DataFrame:
    kinds = text.lit_array(schemas.IMPACT_TYPES)

    def draft(evidence, first):
        return F.struct(
            F.element_at(kinds, (F.col("source_id") % 7 + 1).cast("int")).alias("impact_type"),
            F.lit("claim").alias("impact_claim"), evidence.alias("evidence_exact_text"),
            first.cast("int").alias("evidence_start_line"), first.cast("int").alias("evidence_end_line"))

    claims = F.array_compact(F.array(
        F.when(F.col("n_chars") % 5 != 4, draft(F.col("opening.evidence"), F.col("opening.line"))),
        F.when(F.col("toxic") == 1, draft(F.lit(NO_SUCH), F.lit(1))),
        F.when(F.col("n_chars") % 2 == 0, draft(F.col("opening.evidence"), F.col("end_line") + 1)),
    ))
    given = rows.filter("quality is not null")
    decision = F.when(F.col("quality") == 1, "REVIEW").when(F.col("toxic") == 1, "INSUFFICIENT_EVIDENCE").otherwise("NO_REVIEW")
    base = given.select(
        "query_id", "source_id", decision.alias("decision"),
        F.when(F.col("quality") == 1, claims).otherwise(F.array().cast(review.NO_CLAIMS)).alias("claims"), "toxic", "lang", "quality")
    repeated = base.filter("toxic = 1 and lang = 'fr'")
    stray = base.filter("quality = 0 and toxic = 1").withColumn("query_id", F.col("query_id") + 1)
    return base.unionByName(repeated).unionByName(stray).drop("toxic", "lang", "quality")


def verdicts(rows: DataFrame) -> DataFrame:
    """Verdicts for first claims: none, one or two of them by text length."""
    turn = F.col("n_chars") % 6
    given = F.when(turn == 0, F.array(F.lit("REJECTED"))).when(turn == 1, F.array().cast("array<string>")).when(
        turn == 2, F.array(F.lit("SUPPORTED"), F.lit("REJECTED"))).when(turn == 3, F.array(F.lit("MISSING"))).otherwise(
        F.array(F.lit("SUPPORTED")))
    return rows.select("query_id", review.claim_id(F.col("rank"), F.lit(1)).alias("claim_id"), F.explode(given).alias("verdict")).withColumn(
        "reason", F.concat(F.lit("because "), "verdict"))


def failures(rows: DataFrame) -> DataFrame:
    reviewer = rows.filter("lang = 'de' and source = 'src9'").select("query_id", F.lit(review.REVIEWER).alias("role"))
    verifier = rows.filter("lang = 'fr' and source = 'src8'").select("query_id", F.lit(review.VERIFIER).alias("role"))
    return reviewer.unionByName(verifier).distinct().withColumn("error", F.lit("TimeoutError"))


class Case:
    """All stages of the stand-in review."""

    def __init__(self, spark: SparkSession, sf: str):
        whole = labelled(spark, sf)
        self.docket = docket(whole)
        # Every table below reads these rows; stored, texts are split into lines once and not for each of them.
        self.rows = materialise(whole.drop("content"), "labelled")
        self.decisions = decisions(self.rows)
        self.verdicts = verdicts(self.rows)
        self.failures = failures(self.rows)

    def validated(self) -> DataFrame:
        return review.validate(self.docket, self.decisions, self.failures)

    def effective(self) -> DataFrame:
        return review.effective_verdicts(review.valid_claims(self.validated()), self.verdicts)

    def resolved(self):
        # Claims are checked against the texts once; the texts go no further.
        validated = materialise(self.validated().drop("content"), "validated")
        return review.resolve_validated(validated, self.docket, self.decisions, self.verdicts)


_IMPACTS = "['" + "', '".join(schemas.IMPACT_TYPES) + "']"
_F0 = f"""lb0 AS (SELECT doc_id // 10 AS query_id, doc_id AS source_id, (doc_id % 10 + 1)::INT AS rank, text AS content, {sql.lines('text')} AS ls, lang, source, n_chars, quality, toxic
 FROM documents LEFT JOIN labels USING (doc_id)),
 lb1 AS (SELECT *, len(ls)::INT AS end_line, list_filter(list_transform(range(1, len(ls) + 1), lambda i: {{'e': {sql.strip('ls[i]')}, 'l': i}}), lambda x: length(x.e) > 0) AS op FROM lb0),
 lb AS (SELECT *, CASE WHEN len(op) > 0 THEN op[1].e ELSE content END AS opening, CASE WHEN len(op) > 0 THEN op[1].l ELSE 1 END::INT AS opening_line FROM lb1),
 dec0 AS (SELECT query_id, source_id, CASE WHEN quality = 1 THEN 'REVIEW' WHEN toxic = 1 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NO_REVIEW' END AS decision, toxic, lang, quality FROM lb WHERE quality IS NOT NULL),
 dec AS (SELECT * FROM dec0 UNION ALL SELECT * FROM dec0 WHERE toxic = 1 AND lang = 'fr'
  UNION ALL SELECT query_id + 1, source_id, decision, toxic, lang, quality FROM dec0 WHERE quality = 0 AND toxic = 1),
 dcount AS (SELECT query_id, source_id, count(*) AS n, any_value(decision) AS decision FROM dec GROUP BY ALL),
 fail AS (SELECT query_id, bool_or(lang = 'de' AND source = 'src9') AS rf, bool_or(lang = 'fr' AND source = 'src8') AS vf FROM lb GROUP BY query_id),
 card AS (SELECT lb.*, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN decision END AS decision, CASE WHEN n IS NULL THEN 'schema_missing_source' WHEN n > 1 THEN 'schema_duplicate_source' END AS schema_stage,
  rf, vf FROM lb LEFT JOIN dcount USING (query_id, source_id) JOIN fail USING (query_id)),
 dr0 AS (SELECT query_id, source_id, unnest(list_filter([CASE WHEN n_chars % 5 <> 4 THEN {{'e': opening, 'l': opening_line}} END, CASE WHEN toxic = 1 THEN {{'e': '{NO_SUCH}', 'l': 1}} END,
  CASE WHEN n_chars % 2 = 0 THEN {{'e': opening, 'l': end_line + 1}} END], lambda x: x IS NOT NULL)) AS c,
  generate_subscripts(list_filter([CASE WHEN n_chars % 5 <> 4 THEN 1 END, CASE WHEN toxic = 1 THEN 1 END, CASE WHEN n_chars % 2 = 0 THEN 1 END], lambda x: x IS NOT NULL), 1) AS ordinal FROM lb WHERE quality = 1),
 draft AS (SELECT c.query_id, c.source_id, c.rank, c.vf, ordinal, printf('CLM-%02d-%02d', c.rank, ordinal) AS claim_id, {_IMPACTS}[c.source_id % 7 + 1] AS impact_type, dr0.c.e AS evidence, dr0.c.l::INT AS line,
  CASE WHEN dr0.c.l < 1 OR dr0.c.l > c.end_line THEN 'deterministic_line_range' WHEN NOT contains(c.ls[dr0.c.l], dr0.c.e) THEN 'deterministic_exact_span' END AS stage
  FROM card c JOIN dr0 USING (query_id, source_id) WHERE c.decision = 'REVIEW' AND NOT rf),
 st AS (SELECT query_id, source_id, list(stage ORDER BY ordinal) FILTER (WHERE stage IS NOT NULL) AS stages FROM draft GROUP BY ALL),
 val AS (SELECT c.*, CASE WHEN rf THEN 'INSUFFICIENT_EVIDENCE' ELSE decision END AS dec2,
  CASE WHEN rf THEN ['engineering_review_provider'] WHEN schema_stage IS NOT NULL THEN [schema_stage] ELSE coalesce(stages, []) END AS stages FROM card c LEFT JOIN st USING (query_id, source_id)),
 pre AS (SELECT *, CASE WHEN len(stages) > 0 THEN 'BLOCKED' WHEN dec2 IN ('NO_REVIEW', 'INSUFFICIENT_EVIDENCE') THEN dec2 ELSE 'BLOCKED' END AS prelim,
  list_filter(stages, lambda v, i: list_position(stages, v) = i) AS dstages FROM val)"""
_F1 = f"""{_F0}, vd AS (SELECT query_id, printf('CLM-%02d-01', rank) AS claim_id, unnest(CASE n_chars % 6 WHEN 0 THEN ['REJECTED'] WHEN 1 THEN [] WHEN 2 THEN ['SUPPORTED', 'REJECTED'] WHEN 3 THEN ['MISSING'] ELSE ['SUPPORTED'] END) AS verdict FROM lb),
 vc AS (SELECT query_id, claim_id, count(*) AS n, any_value(verdict) AS v FROM vd GROUP BY ALL),
 eff AS (SELECT d.*, coalesce(n, 0)::BIGINT AS verdict_count, CASE WHEN vf THEN 'evidence_verifier_provider' WHEN n > 1 THEN 'verifier_duplicate_verdict' WHEN n IS NULL THEN 'verifier_missing_verdict' END AS verdict_stage,
  CASE WHEN vf OR n IS NULL OR n > 1 THEN 'MISSING' ELSE v END AS verdict FROM draft d LEFT JOIN vc USING (query_id, claim_id) WHERE d.stage IS NULL)"""
_F2 = f"""{_F1}, er AS (SELECT query_id, source_id, count(*) FILTER (WHERE verdict = 'SUPPORTED') AS nv, count(*) AS nc, count(*) FILTER (WHERE verdict = 'REJECTED') AS nr,
  list(verdict ORDER BY ordinal) AS verdicts, list(verdict_stage ORDER BY ordinal) FILTER (WHERE verdict_stage IS NOT NULL) AS late,
  arg_min(evidence, ordinal) FILTER (WHERE verdict = 'SUPPORTED') AS first_evidence FROM eff GROUP BY ALL),
 r0 AS (SELECT p.*, coalesce(nv, 0) AS nv, coalesce(verdicts, []) AS verdicts, coalesce(late, []) AS late, len(stages) + coalesce(len(late), 0) AS b, first_evidence,
  CASE WHEN rf OR dec2 IS NULL OR dec2 <> 'REVIEW' THEN prelim WHEN nv > 0 THEN 'VERIFIED_REVIEW' WHEN len(stages) + coalesce(len(late), 0) > 0 THEN 'BLOCKED'
  WHEN nc > 0 AND nr = nc THEN 'NO_SUPPORTED_CLAIM' ELSE 'NONE' END AS s FROM pre p LEFT JOIN er USING (query_id, source_id)),
 res AS (SELECT *, CASE WHEN s = 'NONE' THEN 'BLOCKED' ELSE s END AS status, (b + (s = 'NONE')::INT)::INT AS blocked_count,
  list_concat(list_concat(dstages, late), CASE WHEN s = 'NONE' THEN ['no_valid_review_claim'] ELSE [] END) AS blocked_stages FROM r0),
 off AS (SELECT DISTINCT query_id FROM dec WHERE query_id <> source_id // 10),
 ov0 AS (SELECT query_id, bool_or(status = 'VERIFIED_REVIEW') AS hv, bool_or(status IN ('BLOCKED', 'INSUFFICIENT_EVIDENCE')) OR bool_or(rf OR vf)
  OR (bool_or(off.query_id IS NOT NULL) AND NOT bool_or(rf)) AS open FROM res LEFT JOIN off USING (query_id) GROUP BY query_id),
 ov AS (SELECT query_id, CASE WHEN hv THEN 'REVIEW_REQUIRED' WHEN open THEN 'INCONCLUSIVE' ELSE 'NO_SUPPORTED_REVIEW' END AS overall_status, hv AND open AS partial FROM ov0)"""


@query(f"WITH {_F0} SELECT query_id, source_id, n::BIGINT AS decision_count, decision, schema_stage FROM card")
def decision_cardinality(spark, sf):
    case = Case(spark, sf)
    return review.decision_cardinality(case.docket, case.decisions).select(
        "query_id", "source_id", "decision_count", "decision", "schema_stage")


@query(f"WITH {_F2} SELECT query_id FROM off")
def off_docket(spark, sf):
    case = Case(spark, sf)
    return review.off_docket(case.docket, case.decisions)


_CHECKED = f"WITH {_F0} SELECT source_id, ordinal::INT AS ordinal, claim_id, line AS evidence_line, "


def _checked(spark, sf) -> DataFrame:
    return inline_rows(Case(spark, sf).validated(), "checked", "source_id").withColumnRenamed("evidence_start_line", "evidence_line")


@query(_CHECKED + "stage IS NOT DISTINCT FROM 'deterministic_line_range' AS out_of_range FROM draft")
def line_range(spark, sf):
    return _checked(spark, sf).select(
        "source_id", "ordinal", "claim_id", "evidence_line", F.col("stage").eqNullSafe("deterministic_line_range").alias("out_of_range"))


_AT = "(j % greatest(len(ls), 1))"


@query(f"""WITH d AS (SELECT doc_id, {sql.lines('text')} AS ls FROM documents),
 p AS (SELECT a.doc_id, a.ls, list_concat(a.ls, b.ls) AS ev FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
 SELECT doc_id, len(ev)::INT AS claims, len(list_filter(range(len(ev)), lambda j: contains(array_to_string(ls[{_AT} + 1:{_AT} + 3], chr(10)), ev[j + 1])))::INT AS exact FROM p""")
def exact_span(spark, sf):
    """Every line of a document and of the next one, claimed for three lines of the first."""
    docs = documents(spark, sf, "doc_id", "text").select("doc_id", text.split_lines(F.col("text")).alias("lines"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lines").alias("more"))
    both = docs.join(following, "doc_id").withColumn("n", F.greatest(F.size("lines"), F.lit(1)))
    claims = F.transform(F.concat("lines", "more"), lambda l, j: F.struct(l.alias("evidence"), (j % F.col("n") + 1).alias("first")))
    exact = F.filter("claims", lambda c: F.contains(
        review.selected_lines(F.col("lines"), F.lit(1), c["first"], c["first"] + 2), c["evidence"]))
    return both.withColumn("claims", claims).select("doc_id", F.size("claims").alias("claims"), F.size(exact).alias("exact"))


@query(_CHECKED + "stage, sha256(evidence) AS evidence_sha256 FROM draft")
def claim_ids(spark, sf):
    return _checked(spark, sf).select(
        "source_id", "ordinal", "claim_id", "evidence_line", "stage", F.sha2("evidence_exact_text", 256).alias("evidence_sha256"))


@query(f"WITH {_F0} SELECT query_id, source_id, prelim AS prelim_status, len(stages)::INT AS blocked_count, array_to_string(dstages, ',') AS blocked_stages FROM pre")
def prelim_status(spark, sf):
    return Case(spark, sf).validated().select(
        "query_id", "source_id", "prelim_status", "blocked_count", F.array_join("blocked_stages", ",").alias("blocked_stages"))


@query(f"WITH {_F0} SELECT source_id, opening_line AS line, sha256(opening) AS evidence_sha256 FROM lb")
def first_line(spark, sf):
    return labelled(spark, sf).select("source_id", "opening.line", F.sha2("opening.evidence", 256).alias("evidence_sha256"))


@query(f"""WITH {_F0}, t AS (SELECT source_id, content, CASE WHEN len(ls) > 0 THEN ls[len(ls)] ELSE '' END AS e FROM lb)
 SELECT source_id, (1 + length(substr(content, 1, instr(content, e) - 1)) - length(replace(substr(content, 1, instr(content, e) - 1), chr(10), '')))::INT AS line
 FROM t WHERE length(e) > 0""")
def evidence_line(spark, sf):
    rows = labelled(spark, sf).withColumn("e", F.try_element_at(text.split_lines(F.col("content")), F.lit(-1))).filter(F.length("e") > 0)
    return rows.select("source_id", review.evidence_line(F.col("content"), F.col("e"), F.col("start_line")).alias("line"))


@query(f"""WITH {_F0} SELECT query_id, source_id, CASE WHEN quality = 1 THEN 'REVIEW' ELSE 'NO_REVIEW' END AS decision,
 CASE WHEN quality = 1 THEN 1 ELSE 0 END AS claims, CASE WHEN quality = 1 THEN opening_line END AS line, CASE WHEN quality = 1 THEN sha256(opening) END AS evidence_sha256 FROM lb""")
def rule_decisions(spark, sf):
    rows = labelled(spark, sf)
    targets = rows.filter("quality = 1").select("query_id", "source_id")
    evidence = targets.select("*", F.lit(None).cast("string").alias("expected_evidence"), F.lit(None).cast("string").alias("expected_impact"))
    made = review.rule_decisions(docket(rows), targets, evidence)
    claim = F.get("claims", F.lit(0))
    return made.select("query_id", "source_id", "decision", F.size("claims").alias("claims"),
                       claim["evidence_start_line"].alias("line"), F.sha2(claim["evidence_exact_text"], 256).alias("evidence_sha256"))


@query(f"""WITH {_F0}, o AS (SELECT unnest(['review', 'inconclusive', 'rejected', 'inject']) AS outcome), bad AS (SELECT min(rank) AS r FROM lb WHERE query_id = 3 AND quality IS DISTINCT FROM 1),
 d AS (SELECT outcome, query_id, source_id, opening, opening_line, outcome = 'inject' AND query_id = 3 AND rank = r AND quality IS DISTINCT FROM 1 AS bad,
 CASE WHEN outcome = 'inject' THEN coalesce(quality = 1, false) OR (query_id = 3 AND rank = r AND quality IS DISTINCT FROM 1) ELSE rank = 1 AND outcome <> 'inconclusive' END AS yes,
 rank = 1 AND outcome = 'inconclusive' AS unsure FROM lb, o, bad)
 SELECT outcome, query_id, source_id, CASE WHEN unsure THEN 'INSUFFICIENT_EVIDENCE' WHEN yes THEN 'REVIEW' ELSE 'NO_REVIEW' END AS decision,
 CASE WHEN yes THEN sha256(CASE WHEN bad THEN '{review.BAD_EVIDENCE}' ELSE opening END) END AS evidence_sha256, CASE WHEN yes THEN opening_line END AS line FROM d""")
def rule_outcomes(spark, sf):
    """Decisions without gold for every live outcome, and with one injected bad claim."""
    rows = labelled(spark, sf)
    none = rows.select("query_id", "source_id").limit(0)

    def evidence(targets):
        return targets.select("*", F.lit(None).cast("string").alias("expected_evidence"), F.lit(None).cast("string").alias("expected_impact"))

    targets = rows.filter("quality = 1").select("query_id", "source_id")
    made = {o: review.rule_decisions(docket(rows), none, evidence(none), live=True, live_outcome=o) for o in ("review", "inconclusive", "rejected")}
    made["inject"] = review.rule_decisions(docket(rows), targets, evidence(targets), inject_query=3)
    claim = F.get("claims", F.lit(0))
    return reduce(DataFrame.unionByName, [df.select(
        F.lit(name).alias("outcome"), "query_id", "source_id", "decision", F.sha2(claim["evidence_exact_text"], 256).alias("evidence_sha256"),
        claim["evidence_start_line"].alias("line")) for name, df in made.items()])


@query(f"WITH {_F1} SELECT query_id, claim_id, verdict_count, verdict_stage, verdict FROM eff")
def verdict_cardinality(spark, sf):
    return Case(spark, sf).effective().select("query_id", "claim_id", "verdict_count", "verdict_stage", "verdict")


@query(f"WITH {_F1} SELECT query_id, claim_id, source_id, 'because SUPPORTED' AS verifier_reason FROM eff WHERE verdict = 'SUPPORTED'")
def verified_claims(spark, sf):
    return review.verified_claims(Case(spark, sf).effective()).select("query_id", "claim_id", "source_id", "verifier_reason")


@query(f"WITH {_F2} SELECT query_id, source_id, status, array_to_string(blocked_stages, ',') AS blocked_stages FROM res WHERE rf")
def failed_query_fallback(spark, sf):
    results, _, _ = Case(spark, sf).resolved()
    return results.filter("reviewer_failed").select("query_id", "source_id", "status", F.array_join("blocked_stages", ",").alias("blocked_stages"))


@query(f"""WITH {_F2} SELECT query_id, source_id, status, blocked_count, array_to_string(blocked_stages, ',') AS blocked_stages, nv::INT AS verified,
 array_to_string(verdicts, ',') AS verdicts FROM res""")
def candidate_status(spark, sf):
    results, _, _ = Case(spark, sf).resolved()
    return results.select("query_id", "source_id", "status", "blocked_count", F.array_join("blocked_stages", ",").alias("blocked_stages"),
                          F.size("verified_claims").alias("verified"), F.array_join("verifier_verdicts", ",").alias("verdicts"))


@query(f"WITH {_F2} SELECT * FROM ov")
def overall_status(spark, sf):
    return Case(spark, sf).resolved()[2]


# Gold: quality-1 documents belong to their own docket's query, toxic ones to the query two
# dockets back, the rest ten dockets back.


def gold(rows: DataFrame) -> DataFrame:
    back = F.when(F.col("quality") == 1, 0).when(F.col("toxic") == 1, 2).otherwise(10)
    return rows.filter("quality is not null").select(
        (F.col("query_id") - back).alias("query_id"), "source_id", *[c for c in ("content", "opening", "lang") if c in rows.columns]).filter("query_id >= 0")


_GOLD = """gold AS (SELECT * FROM (SELECT query_id - CASE WHEN quality = 1 THEN 0 WHEN toxic = 1 THEN 2 ELSE 10 END AS query_id, source_id, opening, lang FROM lb WHERE quality IS NOT NULL) WHERE query_id >= 0)"""


@query(f"""WITH {_F0}, {_GOLD}, h AS (SELECT query_id, bool_and(source_id // 10 = query_id) AS hit FROM gold GROUP BY query_id)
 SELECT DISTINCT lb.query_id, coalesce(hit, true) AS retrieval_hit FROM lb LEFT JOIN h USING (query_id)""")
def retrieval_hit(spark, sf):
    case = Case(spark, sf)
    return review.retrieval_hit(case.docket.select("query_id").distinct(), gold(case.rows), case.docket)


@query(f"""WITH {_F2} SELECT query_id, source_id, rank, CASE WHEN status IN ('VERIFIED_REVIEW', 'NO_REVIEW', 'INSUFFICIENT_EVIDENCE') THEN status ELSE 'REJECTED_UNSUPPORTED' END AS status,
 CASE WHEN status = 'VERIFIED_REVIEW' THEN sha256(first_evidence) END AS evidence_sha256, CASE WHEN status = 'VERIFIED_REVIEW' THEN 'claim' WHEN status = 'NO_REVIEW' THEN '{review.REASON_NO_REVIEW}'
 WHEN status = 'INSUFFICIENT_EVIDENCE' THEN '{review.REASON_INSUFFICIENT}' ELSE '{review.REASON_WITHHELD}' END AS short_reason,
 CASE WHEN status = 'VERIFIED_REVIEW' THEN 'because SUPPORTED' END AS verifier_reason,
 CASE WHEN status NOT IN ('VERIFIED_REVIEW', 'NO_REVIEW', 'INSUFFICIENT_EVIDENCE') THEN coalesce(blocked_stages[1], 'independent_verifier_rejected') END AS blocked_stage FROM res""")
def legacy_projection(spark, sf):
    shown = review.legacy_projection(Case(spark, sf).resolved()[0])
    return shown.select("query_id", "source_id", "rank", "status", F.sha2("evidence", 256).alias("evidence_sha256"), "short_reason", "verifier_reason", "blocked_stage")


@query(f"""WITH {_F2} SELECT 'decision_recorded' AS event, query_id AS case_id, '{review.VERIFIER}' AS role, source_id, NULL AS claim_id, status AS decision,
 CASE WHEN nv > 0 THEN 'SUPPORTED' ELSE verdicts[1] END AS verifier_verdict, blocked_stages[1] AS blocked_stage FROM res
 UNION ALL SELECT 'verified_claim_recorded', query_id, NULL, source_id, claim_id, NULL, 'SUPPORTED', NULL FROM eff WHERE verdict = 'SUPPORTED'""")
def decision_log(spark, sf):
    return review.decision_log(Case(spark, sf).resolved()[0])


@query(f"""WITH {_F2} SELECT query_id, count(*)::BIGINT AS docket_size, count(*) FILTER (WHERE status = 'VERIFIED_REVIEW')::BIGINT AS verified_count, sum(blocked_count)::BIGINT AS blocked_count,
 count(*) FILTER (WHERE blocked_count > 0)::BIGINT AS withheld_rows, arg_min(source_id, (CASE status WHEN 'VERIFIED_REVIEW' THEN 0 WHEN 'BLOCKED' THEN 1 ELSE 2 END, rank)) AS preferred_source_id,
 coalesce(string_agg(rank || ':' || source_id || ':' || blocked_count || ':' || array_to_string(blocked_stages, '+'), ' ' ORDER BY rank) FILTER (WHERE blocked_count > 0), '') AS withheld FROM res GROUP BY query_id""")
def docket_summary(spark, sf):
    found = review.docket_summary(Case(spark, sf).resolved()[0])
    shown = F.transform("withheld", lambda w: F.concat_ws(
        ":", w["rank"], w["source_id"], w["blocked_count"], F.array_join(w["blocked_stages"], "+")))
    return found.withColumn("withheld", F.array_join(shown, " "))


# ---- metrics ----------------------------------------------------------------------
# Fifty dockets form a run; case types follow the docket number.


class Evaluation(Case):
    def keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("query_id", "case_id").withColumn("run_id", F.expr("case_id div 50"))

    def __init__(self, spark: SparkSession, sf: str):
        super().__init__(spark, sf)
        kinds = text.lit_array(schemas.CASE_TYPES)
        self.cases = self.keyed(self.docket.select("query_id").distinct()).withColumn(
            "case_type", F.element_at(kinds, (F.col("case_id") % 5 + 1).cast("int")))
        self.targets = self.keyed(gold(self.rows))
        self.final = self.keyed(self.docket)

    def pool(self, dockets: int) -> DataFrame:
        """Every document lies in the pools of its own docket and of the ones before it."""
        first = F.greatest(F.lit(0), F.col("query_id") - (dockets - 1))
        spread_rows = self.rows.select("source_id", F.explode(F.sequence(first, F.col("query_id"))).alias("query_id"))
        return self.keyed(spread_rows)

    def slots(self) -> DataFrame:
        kinds = text.lit_array(schemas.IMPACT_TYPES)
        spans = F.when(F.col("lang") == "fr", F.array(F.lit("zzz"))).otherwise(F.array(F.lit("zzz"), F.col("opening.evidence")))
        return self.targets.select(
            *metrics.SPAN, F.element_at(kinds, (F.col("source_id") % 7 + 1).cast("int")).alias("impact_type"),
            F.col("source_id").alias("slot_no"), F.col("source_id").alias("claim_slot_id"), spans.alias("spans"))

    def proposed(self) -> DataFrame:
        # A failed reviewer leaves no decision, so its queries propose nothing.
        failed = self.failures.filter(F.col("role") == review.REVIEWER).select("query_id")
        given = self.decisions.join(failed, "query_id", "left_anti")
        # Numbered by content, so that every reading of the table gives a decision the same number.
        order = Window.partitionBy("query_id", "source_id").orderBy(F.to_json(F.struct("decision", "claims")))
        numbered = given.withColumn("decision_no", F.row_number().over(order))
        return self.keyed(numbered.select("query_id", "source_id", "decision_no", F.posexplode("claims").alias("no", "c"))).select(
            *metrics.SPAN, F.struct("decision_no", "no").alias("claim_no"), "c.impact_type", F.col("c.evidence_exact_text").alias("evidence"))

    def verified(self, effective: DataFrame) -> DataFrame:
        return self.keyed(review.verified_claims(effective)).select(
            *metrics.SPAN, F.col("ordinal").alias("claim_no"), "impact_type", F.col("evidence_exact_text").alias("evidence"))

    def hits(self) -> DataFrame:
        return metrics.per_case(self.cases, metrics.target_hits(self.targets, self.pool(4), self.pool(20), self.final))

    def claims(self) -> DataFrame:
        results, effective, _ = self.resolved()
        totals = metrics.claim_totals(self.keyed(results), self.proposed(), self.verified(effective), self.keyed(effective))
        return metrics.per_case(self.cases, totals)


_E0 = f"""{_F2}, {_GOLD}, kase AS (SELECT DISTINCT query_id AS case_id, query_id // 50 AS run_id, ['direct', 'semantic', 'cross_artifact', 'clean', 'benign'][query_id % 5 + 1] AS case_type FROM lb),
 hit AS (SELECT query_id AS case_id, source_id, source_id // 10 - query_id AS back, source_id % 10 + 1 AS rank FROM gold),
 pc AS (SELECT case_id, count(*) AS eligible, count(*) FILTER (WHERE back BETWEEN 0 AND 3) AS broad, count(*) FILTER (WHERE back BETWEEN 0 AND 19) AS expanded, count(*) FILTER (WHERE back = 0) AS final,
  sum(rank) FILTER (WHERE back = 0) AS rank_sum, sum(1e0 / rank) FILTER (WHERE back = 0) AS rr FROM hit GROUP BY case_id),
 kc AS (SELECT kase.*, case_type IN ('direct', 'semantic', 'cross_artifact') AS impact, coalesce(eligible, 0) AS eligible, coalesce(broad, 0) AS broad, coalesce(expanded, 0) AS expanded,
  coalesce(final, 0) AS final, coalesce(rank_sum, 0) AS rank_sum, coalesce(rr, 0) AS rr FROM kase LEFT JOIN pc USING (case_id)),
 grid AS (SELECT DISTINCT run_id, unnest(['overall', 'direct', 'semantic', 'cross_artifact', 'clean', 'benign']) AS "group" FROM kase)"""


def _grouped(figures: str, extra: str = "", source: str = "kc") -> str:
    """Figures per run and group; empty groups get zero counts."""
    return f"""WITH {_E0}{extra}, kg AS (SELECT *, unnest(['overall', case_type]) AS "group" FROM {source}),
 m AS (SELECT g.run_id, g."group", kg.* EXCLUDE (run_id, "group") FROM grid g LEFT JOIN kg ON kg.run_id = g.run_id AND kg."group" = g."group") SELECT run_id, "group", {figures} FROM m GROUP BY ALL"""


def _n(expression: str) -> str:
    return f"coalesce(sum({expression}), 0)::BIGINT"


_EL, _B, _E, _FI = (_n(f"CASE WHEN impact THEN {c} END") for c in ("eligible", "broad", "expanded", "final"))


@query(_grouped(f"""{_EL} AS eligible_targets, {_B} AS broad_hits, {_E} AS expanded_hits, {_FI} AS final_hits, {sql.safe_rate(_B, _EL)} AS broad_rate,
 {sql.safe_rate(_E, _EL)} AS expanded_rate, {sql.safe_rate(_FI, _EL)} AS final_rate"""))
def hit_rates(spark, sf):
    return metrics.evaluate(Evaluation(spark, sf).hits(), metrics.hit_figures()).drop("new_target_hits", "gain_rate")


_NEW = _n("CASE WHEN impact THEN expanded - broad END")


@query(_grouped(f"{_EL} AS eligible_targets, {_NEW} AS new_target_hits, {sql.safe_rate(_NEW, _EL)} AS gain_rate"))
def expansion_gain(spark, sf):
    return metrics.evaluate(Evaluation(spark, sf).hits(), metrics.hit_figures()).select("run_id", "group", "eligible_targets", "new_target_hits", "gain_rate")


@query(_grouped(f"""{_n('(impact AND broad = eligible)::INT')} AS broad_complete, {_n('(impact AND expanded = eligible)::INT')} AS expanded_complete,
 {_n('(impact AND final = eligible)::INT')} AS final_complete, {_n('impact::INT')} AS eligible_cases"""))
def complete_coverage(spark, sf):
    return metrics.evaluate(Evaluation(spark, sf).hits(), metrics.coverage_figures())


@query(_grouped(f"""{_FI} AS retrieved_targets, {sql.safe_rate(_n('CASE WHEN impact THEN rank_sum END'), _FI)} AS mean_rank,
 {sql.safe_rate('coalesce(sum(CASE WHEN impact THEN rr END), 0)', _FI)} AS mean_reciprocal_rank"""))
def rank_mrr(spark, sf):
    return metrics.evaluate(Evaluation(spark, sf).hits(), metrics.rank_figures())


# Gold texts hold the opening line unless the language is French; claims carry the opening line.
_SLOTS = f""", slot AS (SELECT query_id AS case_id, source_id, {_IMPACTS}[source_id % 7 + 1] AS impact_type, opening, lang FROM gold),
 prop AS (SELECT d.query_id AS case_id, d.source_id, {_IMPACTS}[d.source_id % 7 + 1] AS impact_type, dr0.c.e AS evidence FROM dec d JOIN dr0 USING (source_id) JOIN fail f ON f.query_id = d.query_id
  WHERE d.decision = 'REVIEW' AND NOT coalesce(f.rf, false)),
 ver AS (SELECT query_id AS case_id, source_id, impact_type, evidence, claim_id FROM eff WHERE verdict = 'SUPPORTED'),
 pm AS (SELECT p.case_id, s.source_id AS slot_id FROM prop p JOIN slot s USING (case_id, source_id, impact_type) WHERE contains('zzz', evidence) OR contains(evidence, 'zzz')
  OR (lang <> 'fr' AND (contains(evidence, opening) OR contains(opening, evidence)))),
 vm AS (SELECT p.case_id, p.claim_id, p.source_id, s.source_id AS slot_id FROM ver p LEFT JOIN slot s ON p.case_id = s.case_id AND p.source_id = s.source_id AND p.impact_type = s.impact_type
  AND (contains('zzz', evidence) OR contains(evidence, 'zzz') OR (lang <> 'fr' AND (contains(evidence, opening) OR contains(opening, evidence)))))"""


@query(f"WITH {_E0}{_SLOTS} SELECT case_id, source_id, claim_id, slot_id AS claim_slot_id FROM vm")
def slot_match(spark, sf):
    case = Evaluation(spark, sf)
    effective = case.effective()
    matched = metrics.match_slots(case.verified(effective), case.slots())
    rank = (F.col("source_id") % 10 + 1).cast("int")
    return matched.select("case_id", "source_id", review.claim_id(rank, F.col("claim_no")).alias("claim_id"), "claim_slot_id")


_RECALL = """, sc AS (SELECT kc.*, coalesce(p.c, 0) AS ps, coalesce(v.c, 0) AS vs FROM kc LEFT JOIN (SELECT case_id, count(DISTINCT slot_id) AS c FROM pm GROUP BY 1) p USING (case_id)
 LEFT JOIN (SELECT case_id, count(DISTINCT slot_id) AS c FROM vm GROUP BY 1) v USING (case_id))"""


@query(_grouped(f"""{_EL} AS eligible_claims, {_n('ps')} AS proposed_matched, {_n('vs')} AS verified_matched, {sql.safe_rate(_n('ps'), _EL)} AS proposal_rate,
 {sql.safe_rate(_n('vs'), _EL)} AS verified_rate""", _SLOTS + _RECALL, "sc"))
def claim_recall(spark, sf):
    case = Evaluation(spark, sf)
    slots = case.slots()
    eligible = slots.groupBy(*metrics.CASE).agg(F.count(F.lit(1)).alias("eligible_claims"))
    rows = metrics.per_case(
        case.cases, eligible, metrics.slot_recall(metrics.match_slots(case.proposed(), slots), "proposed_slots"),
        metrics.slot_recall(metrics.match_slots(case.verified(case.effective()), slots), "verified_slots"))
    return metrics.evaluate(rows, metrics.recall_figures())


_TOTALS = _SLOTS + """, tc AS (SELECT kc.*, coalesce(a.c, 0) AS proposed, coalesce(b.c, 0) AS blocked, coalesce(d.c, 0) AS rejected, coalesce(v.c, 0) AS verified FROM kc
 LEFT JOIN (SELECT case_id, count(*) AS c FROM prop GROUP BY 1) a USING (case_id) LEFT JOIN (SELECT query_id AS case_id, sum(blocked_count) AS c FROM res GROUP BY 1) b USING (case_id)
 LEFT JOIN (SELECT query_id AS case_id, count(*) AS c FROM eff WHERE verdict = 'REJECTED' GROUP BY 1) d USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS c FROM ver GROUP BY 1) v USING (case_id))"""
_CONTROL = "case_type IN ('clean', 'benign')"


@query(_grouped(f"""{_n(f'({_CONTROL} AND verified > 0)::INT')} AS false_alarm_cases, {_n(f'({_CONTROL})::INT')} AS eligible_controls,
 {sql.safe_rate(_n(f'({_CONTROL} AND verified > 0)::INT'), _n(f'({_CONTROL})::INT'))} AS rate""", _TOTALS, "tc"))
def false_alarm(spark, sf):
    return metrics.evaluate(Evaluation(spark, sf).claims(), metrics.alarm_figures()).withColumnRenamed("false_alarm_rate", "rate")


@query(_grouped(", ".join(f"{_n(c)} AS {c}" for c in ("proposed", "blocked", "rejected", "verified")), _TOTALS, "tc"))
def claim_counts(spark, sf):
    return metrics.evaluate(Evaluation(spark, sf).claims(), metrics.claim_figures())


_SIZES = """, zc AS (SELECT kc.*, (SELECT count(*) FROM lb WHERE lb.query_id BETWEEN kc.case_id AND kc.case_id + 19) AS es, (SELECT count(*) FROM res WHERE res.query_id = kc.case_id) AS ds,
 (SELECT count(*) FROM res WHERE res.query_id = kc.case_id AND status = 'VERIFIED_REVIEW') AS vs FROM kc)"""


@query(_grouped(f"""count(case_id)::BIGINT AS cases, {sql.safe_rate(_n('es'), 'count(case_id)')} AS average_expanded_pool_size, {sql.safe_rate(_n('ds'), 'count(case_id)')} AS average_final_docket_size,
 {sql.safe_rate(_n('vs'), 'count(case_id)')} AS average_verified_docket_size, {sql.safe_rate(f"({_n('ds')} - {_n('vs')})", _n('ds'))} AS candidate_reduction""", _SIZES, "zc"))
def selection_stats(spark, sf):
    case = Evaluation(spark, sf)
    sizes = metrics.docket_sizes(case.keyed(case.resolved()[0]), case.pool(20))
    return metrics.evaluate(metrics.per_case(case.cases, sizes), metrics.selection_figures())


_EXTRA = _SLOTS + ", xc AS (SELECT kc.*, (SELECT count(*) FROM vm WHERE vm.case_id = kc.case_id AND slot_id IS NULL) AS extra FROM kc)"


@query(_grouped(f"{_n('CASE WHEN impact THEN extra END')} AS unregistered", _EXTRA, "xc"))
def unregistered(spark, sf):
    case = Evaluation(spark, sf)
    extra = metrics.extra_claims(metrics.match_slots(case.verified(case.effective()), case.slots()))
    return metrics.evaluate(metrics.per_case(case.cases, extra), metrics.unregistered_figures())


_ALL_METRICS = ("hit_rates", "expansion_gain", "complete_coverage", "rank_mrr", "claim_recall", "false_alarm", "claim_counts", "selection_stats", "unregistered")


def _all_metrics() -> str:
    """The statements of the single metrics side by side, with the case counts."""
    sizes = _grouped(f"count(case_id)::BIGINT AS n_cases, {_n('impact::INT')} AS impact_cases, {_n(f'({_CONTROL})::INT')} AS control_cases")
    parts = {name: f"SELECT * FROM ({ORACLES[name]})" for name in _ALL_METRICS}
    parts["expansion_gain"] = parts["expansion_gain"].replace("*", "* EXCLUDE (eligible_targets)", 1)
    parts["false_alarm"] = parts["false_alarm"].replace("*", "* RENAME (rate AS false_alarm_rate)", 1)
    joins = " ".join(f'JOIN ({statement}) {name} USING (run_id, "group")' for name, statement in parts.items())
    return f"SELECT * FROM ({sizes}) sizes {joins}"


@query(_all_metrics())
def metrics_by_type(spark, sf):
    """Every metric in one table, from one aggregation over the per-case figures."""
    case = Evaluation(spark, sf)
    # Results and verdicts feed several parts; as in a stored run they are tables.
    results, effective = (materialise(df, name) for df, name in zip(case.resolved()[:2], ("results", "verdicts")))
    slots, proposed, verified = case.slots(), case.proposed(), case.verified(effective)
    matched = metrics.match_slots(verified, slots)
    rows = metrics.per_case(
        case.cases, metrics.target_hits(case.targets, case.pool(4), case.pool(20), case.final),
        slots.groupBy(*metrics.CASE).agg(F.count(F.lit(1)).alias("eligible_claims")),
        metrics.slot_recall(metrics.match_slots(proposed, slots), "proposed_slots"), metrics.slot_recall(matched, "verified_slots"),
        metrics.claim_totals(case.keyed(results), proposed, verified, case.keyed(effective)),
        metrics.docket_sizes(case.keyed(results), case.pool(20)), metrics.extra_claims(matched))
    return metrics.evaluate(rows, *metrics.all_figures())


def legacy_rows(spark: SparkSession, sf: str) -> DataFrame:
    case = Evaluation(spark, sf)
    reviews = case.keyed(review.legacy_projection(case.resolved()[0]))
    hit = case.keyed(review.retrieval_hit(case.docket.select("query_id").distinct(), gold(case.rows), case.docket))
    sizes = case.final.groupBy(*metrics.CASE).agg(F.count(F.lit(1)).alias("candidates"))
    cases = case.cases.join(hit, metrics.CASE).join(sizes, metrics.CASE)
    return metrics.legacy_cases(cases, reviews, case.targets, case.keyed(case.decisions.select("query_id", "source_id", "decision")))


_LEGACY = """, lc AS (SELECT kc.*, kc.final = kc.eligible AS rh, (SELECT count(*) FROM lb WHERE lb.query_id = kc.case_id) AS candidates,
 (SELECT count(*) FROM res WHERE res.query_id = kc.case_id AND status = 'VERIFIED_REVIEW') AS vs,
 (SELECT count(*) FROM res WHERE res.query_id = kc.case_id AND status IN ('BLOCKED', 'NO_SUPPORTED_CLAIM')) AS bl,
 (SELECT count(*) FROM res WHERE res.query_id = kc.case_id AND status = 'VERIFIED_REVIEW' AND length(first_evidence) > 0) AS ec,
 (SELECT count(*) FROM dec WHERE dec.query_id = kc.case_id AND decision = 'REVIEW') AS pr,
 (SELECT coalesce(bool_and(coalesce(r.status = 'VERIFIED_REVIEW', false)), true) FROM hit h LEFT JOIN res r ON r.source_id = h.source_id AND r.query_id = h.case_id WHERE h.case_id = kc.case_id) AS kept FROM kc)"""
_H, _EC, _HK = _n("(impact AND rh)::INT"), _n(f"({_CONTROL})::INT"), _n("(impact AND rh AND kept)::INT")
_FA = _n(f"({_CONTROL} AND vs > 0)::INT")


@query(_grouped(f"""count(case_id)::BIGINT AS n_cases, {_H} AS hits, {_n('impact::INT')} AS eligible, {_HK} AS successes, {_FA} AS false_alarm_cases, {_EC} AS eligible_controls,
 {sql.safe_rate(_H, _n('impact::INT'))} AS coverage_rate, {sql.safe_rate(_HK, _H)} AS success_rate, {sql.safe_rate(_FA, _EC)} AS false_alarm_rate""", _LEGACY, "lc"))
def legacy_metrics(spark, sf):
    return metrics.legacy_coverage(legacy_rows(spark, sf))


@query(_grouped(f"""{_n('candidates')} AS baseline_candidates, {_n('(impact AND kept)::INT')} AS target_retained_cases, {_n('ec')} AS evidence_complete, {_n('pr')} AS proposed_reviews,
 {_n('bl')} AS blocked, {_n('vs')} AS final_verified_reviews, {sql.safe_rate(f"({_n('candidates')} - {_n('vs')})", _n('candidates'))} AS candidate_reduction_ratio""", _LEGACY, "lc"))
def legacy_added_value(spark, sf):
    return metrics.legacy_added_value(legacy_rows(spark, sf))


# ---- run comparison ---------------------------------------------------------------
# The baseline run shows all ten documents of a docket in order; the variant drops texts
# whose length is a multiple of four and ranks the rest from the back.


class Runs:
    def __init__(self, spark: SparkSession, sf: str):
        rows = labelled(spark, sf).withColumnRenamed("query_id", "case_id")
        both = rows.select("*", F.explode(text.lit_array(("base", "variant"))).alias("run_id"))
        shown = both.filter("run_id = 'base' or n_chars % 4 <> 0").withColumn(
            "rank", F.when(F.col("run_id") == "base", F.col("rank")).otherwise(F.lit(11) - F.col("rank")))
        self.docket = shown.select(*metrics.SPAN, "rank", "content")
        targets = gold(rows.withColumnRenamed("case_id", "query_id")).withColumnRenamed("query_id", "case_id")
        self.targets = targets.select(F.explode(text.lit_array(("base", "variant"))).alias("run_id"), "case_id", "source_id")
        picked = both.filter("(run_id = 'base' and quality = 1) or (run_id = 'variant' and toxic = 0)")
        evidence = F.when(F.col("lang") == "fr", F.lit(NO_SUCH)).otherwise(F.col("opening.evidence"))
        self.reviews = picked.select(*metrics.SPAN, evidence.alias("evidence"))
        self.items = picked.select(
            *metrics.SPAN, (F.col("n_chars") % 3 == 0).alias("supported"),
            F.when(F.col("n_chars") % 3 == 1, F.lit("SUPPORTED")).otherwise(F.lit("REJECTED")).alias("verdict"),
            F.when(F.col("n_chars") % 7 == 0, F.lit("other")).when(F.col("n_chars") % 7 == 1, F.lit(None)).otherwise(evidence).alias("evidence"))
        self.cases = both.select(*metrics.CASE).distinct()

    def ranks(self) -> DataFrame:
        return compare.target_ranks(self.targets, self.docket)


_H0 = f"""{_F0}, {_GOLD}, bo AS (SELECT *, unnest(['base', 'variant']) AS run_id FROM lb),
 dk AS (SELECT run_id, query_id AS case_id, source_id, CASE WHEN run_id = 'base' THEN rank ELSE 11 - rank END AS rank, content FROM bo WHERE run_id = 'base' OR n_chars % 4 <> 0),
 tg AS (SELECT run_id, query_id AS case_id, source_id FROM gold, (SELECT unnest(['base', 'variant']) AS run_id)),
 pk AS (SELECT run_id, query_id AS case_id, source_id, content, n_chars, CASE WHEN lang = 'fr' THEN '{NO_SUCH}' ELSE opening END AS evidence FROM bo
  WHERE (run_id = 'base' AND quality = 1) OR (run_id = 'variant' AND toxic = 0)),
 sup AS (SELECT *, n_chars % 3 IN (0, 1) AND n_chars % 7 <> 0 AS ok FROM pk),
 tr AS (SELECT tg.*, dk.rank FROM tg LEFT JOIN dk USING (run_id, case_id, source_id))"""


@query(f"WITH {_H0} SELECT run_id, case_id, source_id, sha256(evidence) AS evidence_sha256 FROM sup WHERE ok")
def verifier_support(spark, sf):
    runs = Runs(spark, sf)
    return compare.verifier_support(runs.items, runs.reviews).select(*metrics.SPAN, F.sha2("evidence", 256).alias("evidence_sha256"))


@query(f"""WITH {_H0} SELECT run_id, case_id, 'retrieval_miss' AS failure, source_id FROM tr WHERE rank IS NULL
 UNION ALL SELECT run_id, case_id, 'expected_target_miss', source_id FROM tg ANTI JOIN pk USING (run_id, case_id, source_id)
 UNION ALL SELECT run_id, case_id, CASE WHEN g.case_id IS NULL THEN 'control_false_alarm' ELSE 'mutation_unnecessary_warnings' END, source_id FROM pk ANTI JOIN tg USING (run_id, case_id, source_id)
  LEFT JOIN (SELECT DISTINCT case_id FROM tg) g USING (case_id)
 UNION ALL SELECT s.run_id, s.case_id, 'verifier_pass_error', s.source_id FROM sup s LEFT JOIN dk USING (run_id, case_id, source_id)
  WHERE NOT (coalesce(contains(dk.content, s.evidence) AND length(s.evidence) > 0, false) AND ok)""")
def failure_classes(spark, sf):
    runs = Runs(spark, sf)
    return compare.failure_rows(runs.targets, runs.docket, runs.reviews, runs.items)


@query(f"""WITH {_H0} SELECT run_id, count(*)::BIGINT AS targets, count(rank)::BIGINT AS retrieved, coalesce(round_even(avg(rank), 6), 0) AS mean_rank,
 coalesce(round_even(avg(1e0 / rank), 6), 0) AS mean_reciprocal_rank FROM tr GROUP BY run_id""")
def rank_summary(spark, sf):
    return compare.rank_summary(Runs(spark, sf).ranks())


@query("""WITH r AS (SELECT c_custkey AS run_id, c_mktsegment AS provider, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey % 2 END AS ph, c_nationkey % 3 AS qv FROM customer)
 SELECT a.run_id AS baseline_run, a.run_id + 1 AS variant_run, array_to_string(list_filter([CASE WHEN a.provider IS DISTINCT FROM b.provider THEN 'provider' END,
 CASE WHEN b.run_id IS NULL THEN 'model' END, CASE WHEN b.run_id IS NULL THEN 'embedding_model' END, CASE WHEN b.run_id IS NULL THEN 'embedding_index_fingerprint' END,
 CASE WHEN b.run_id IS NULL THEN 'top_k' END, CASE WHEN b.run_id IS NULL THEN 'fusion' END, CASE WHEN a.ph IS NULL OR a.ph IS DISTINCT FROM b.ph THEN 'prompt_hashes' END,
 CASE WHEN a.qv IS NOT DISTINCT FROM b.qv THEN 'query_version_changed' END], lambda x: x IS NOT NULL), ',') AS failed FROM r a LEFT JOIN r b ON b.run_id = a.run_id + 1""")
def run_invariants(spark, sf):
    runs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("provider"), F.lit("m").alias("model"), F.lit("e").alias("embedding_model"),
        F.lit("f").alias("embedding_index_fingerprint"), F.lit(10).alias("top_k"), F.lit("{}").alias("fusion"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey") % 2).alias("prompt_hashes"), (F.col("c_nationkey") % 3).alias("query_version"))
    pairs = runs.select(F.col("run_id").alias("baseline_run"), (F.col("run_id") + 1).alias("variant_run"))
    return compare.run_invariants(pairs, runs).withColumn("failed", F.array_join("failed", ","))


@query(f"""WITH {_H0}, have AS (SELECT DISTINCT run_id, case_id FROM pk), want AS (SELECT DISTINCT query_id AS case_id FROM lb WHERE quality IS NOT NULL AND lang <> 'fr')
 SELECT run_id, case_id, 'missing_case' AS violation FROM (SELECT r.run_id, case_id FROM want, (SELECT DISTINCT run_id FROM have) r) ANTI JOIN have USING (run_id, case_id)
 UNION ALL SELECT run_id, case_id, 'unknown_case' FROM have ANTI JOIN want USING (case_id)""")
def case_set_diff(spark, sf):
    expected = labelled(spark, sf).filter("quality is not null and lang <> 'fr'").select(F.col("query_id").alias("case_id"))
    return compare.case_set_difference(Runs(spark, sf).reviews, expected)


@query(f"""WITH {_H0}, fp AS (SELECT run_id, case_id, sha256('[' || string_agg('{{"content_sha256":"' || sha256(content) || '","rank":' || rank || ',"source_id":"' || source_id || '"}}', ',' ORDER BY rank, sha256(content)) || ']') AS f
 FROM dk GROUP BY ALL), s AS (SELECT run_id, count(*) AS t, count(rank) AS r, coalesce(round_even(avg(rank), 6), 0) AS m, coalesce(round_even(avg(1e0 / rank), 6), 0) AS rr FROM tr GROUP BY run_id)
 SELECT (SELECT count(*) FROM fp a JOIN fp b USING (case_id) WHERE a.run_id = 'base' AND b.run_id = 'variant' AND a.f <> b.f)::BIGINT AS candidate_sequences_changed, b.t::BIGINT AS baseline_targets,
 v.r::BIGINT AS variant_retrieved, round_even(v.m - b.m, 6) AS delta_mean_rank, round_even(v.rr - b.rr, 6) AS delta_mean_reciprocal_rank FROM s b, s v WHERE b.run_id = 'base' AND v.run_id = 'variant'""")
def run_delta(spark, sf):
    runs = Runs(spark, sf)
    sealed = runs.docket.withColumn("content_sha256", F.sha2("content", 256)).withColumn("query_id", F.struct(*metrics.CASE))
    prints = retrieve.sequence_fingerprint(sealed, "rank", "candidate_fingerprint").select("query_id.*", "candidate_fingerprint")
    pairs = spark.range(1).select(F.lit("base").alias("baseline_run"), F.lit("variant").alias("variant_run"))
    return compare.run_delta(pairs, prints, runs.ranks()).select(
        "candidate_sequences_changed", "baseline_targets", "variant_retrieved", "delta_mean_rank", "delta_mean_reciprocal_rank")


@query(f"""WITH {_H0} SELECT a.case_id, a.source_id, a.rank::INT AS baseline_rank, b.rank::INT AS variant_rank FROM tr a JOIN tr b USING (case_id, source_id) WHERE a.run_id = 'base' AND b.run_id = 'variant'""")
def rank_changes(spark, sf):
    pairs = spark.range(1).select(F.lit("base").alias("baseline_run"), F.lit("variant").alias("variant_run"))
    return compare.rank_changes(pairs, Runs(spark, sf).ranks()).select("case_id", "source_id", "baseline_rank", "variant_rank")


# ---- rules with gold evidence, verdicts, projections and seals ----------------------


@query(f"""WITH {_F0}, g AS (SELECT *, CASE WHEN quality = 1 AND lang <> 'fr' AND len(ls) > 0 AND length(ls[len(ls)]) > 0 THEN ls[len(ls)] END AS e FROM lb),
 d AS (SELECT *, coalesce(e, opening) AS shown, CASE WHEN e IS NULL THEN opening_line ELSE 1 + length(substr(content, 1, instr(content, e) - 1)) - length(replace(substr(content, 1, instr(content, e) - 1), chr(10), '')) END AS line FROM g)
 SELECT query_id, source_id, CASE WHEN quality = 1 THEN 'REVIEW' ELSE 'NO_REVIEW' END AS decision,
 CASE WHEN quality = 1 THEN CASE WHEN e IS NULL THEN 'IMPLEMENTATION_IMPACT' ELSE 'DESIGN_ASSUMPTION' END END AS impact_type, CASE WHEN quality = 1 THEN sha256(shown) END AS evidence_sha256,
 CASE WHEN quality = 1 THEN line::INT END AS first_line, CASE WHEN quality = 1 THEN (line + length(shown) - length(replace(shown, chr(10), '')))::INT END AS last_line FROM d""")
def rule_evidence(spark, sf):
    """Decisions of the rule-based reviewer with gold evidence: the last line of a target, but for French ones the opening line."""
    rows = labelled(spark, sf)
    targets = rows.filter("quality = 1").withColumn("last", F.try_element_at(text.split_lines(F.col("content")), F.lit(-1)))
    known = (F.col("lang") != "fr") & (F.length("last") > 0)
    evidence = targets.select("query_id", "source_id", F.when(known, F.col("last")).alias("expected_evidence"), F.when(known, "DESIGN_ASSUMPTION").alias("expected_impact"))
    claim = F.get("claims", F.lit(0))
    return review.rule_decisions(docket(rows), targets.select("query_id", "source_id"), evidence).select(
        "query_id", "source_id", "decision", claim["impact_type"].alias("impact_type"), F.sha2(claim["evidence_exact_text"], 256).alias("evidence_sha256"),
        claim["evidence_start_line"].alias("first_line"), claim["evidence_end_line"].alias("last_line"))


@query(f"""WITH {_F1}, o AS (SELECT unnest(['SUPPORTED', 'REJECTED']) AS verdict) SELECT query_id, claim_id, o.verdict, '{review.RULE_VERDICT}' AS reason FROM draft, o WHERE stage IS NULL""")
def rule_verdicts(spark, sf):
    """Verdicts of the rule-based verifier on every valid claim, once as the supporting and once as the rejecting one."""
    claims = review.valid_claims(Case(spark, sf).validated())
    return review.rule_verdicts(claims).unionByName(review.rule_verdicts(claims, rejected=True))


_SHOWN = "query_id,source_id,rank,status,verified_claims,blocked_count,blocked_stages,verifier_verdicts"


@query(f"""WITH {_F2}, vc2 AS (SELECT query_id, source_id, string_agg(claim_id || ':' || sha256(evidence), ',' ORDER BY ordinal) AS claims FROM eff WHERE verdict = 'SUPPORTED' GROUP BY ALL)
 SELECT query_id, source_id, rank, status, blocked_count, array_to_string(blocked_stages, ',') AS blocked_stages, array_to_string(verdicts, ',') AS verdicts,
 CASE WHEN status = 'VERIFIED_REVIEW' THEN coalesce(claims, '') ELSE '' END AS claims, '{_SHOWN}' AS fields FROM res LEFT JOIN vc2 USING (query_id, source_id)""")
def live_projection(spark, sf):
    """What a live caller may see of every docket row, with the names of all fields that leave."""
    shown = review.live_projection(Case(spark, sf).resolved()[0])
    claims = F.transform("verified_claims", lambda c: F.concat_ws(":", c["claim_id"], F.sha2(c["evidence_exact_text"], 256)))
    return shown.select(
        "query_id", "source_id", "rank", "status", "blocked_count", F.array_join("blocked_stages", ",").alias("blocked_stages"),
        F.array_join("verifier_verdicts", ",").alias("verdicts"), F.array_join(claims, ",").alias("claims"), F.lit(",".join(shown.columns)).alias("fields"))


@query(f"""WITH {_F2}, cl AS (SELECT query_id, source_id, list({{'claim_id': claim_id, 'evidence_sha256': sha256(evidence), 'line': line}} ORDER BY ordinal) AS cs FROM eff WHERE verdict = 'SUPPORTED' GROUP BY ALL),
 r AS (SELECT query_id, list({{'blocked_count': blocked_count, 'blocked_stages': blocked_stages, 'source_id': source_id::VARCHAR, 'status': status,
  'verified_claims': CASE WHEN status = 'VERIFIED_REVIEW' THEN coalesce(cs, []) ELSE [] END, 'verifier_verdicts': verdicts}} ORDER BY rank) AS rs FROM res LEFT JOIN cl USING (query_id, source_id) GROUP BY query_id)
 SELECT query_id, sha256(to_json({{'candidate_results': rs, 'case_id': query_id::VARCHAR, 'final_docket_fingerprint': sha256('docket-' || query_id), 'identifier_index_fingerprint': sha256('index'),
  'overall_status': overall_status, 'partial': partial}})::VARCHAR) AS seal FROM r JOIN ov USING (query_id)""")
def result_seal(spark, sf):
    """Hash of every query's result, evidence by its hash, together with the hashes of its docket and of the index."""
    results, _, overall = Case(spark, sf).resolved()
    short = results.withColumn("verified_claims", F.transform("verified_claims", lambda c: F.struct(
        c["claim_id"].alias("claim_id"), F.sha2(c["evidence_exact_text"], 256).alias("evidence_sha256"), c["evidence_start_line"].alias("line"))))
    seals = results.select("query_id").distinct().select(
        "query_id", F.sha2(F.concat(F.lit("docket-"), "query_id"), 256).alias("final_docket_fingerprint"), F.sha2(F.lit("index"), 256).alias("identifier_index_fingerprint"))
    return review.result_seal(short, overall, seals)
