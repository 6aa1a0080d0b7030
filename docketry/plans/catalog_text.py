"""Driver queries over text: sources, spans, intake, token and identifier index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import scores, text
from docketry.functions.rows import inline_rows, posexplode_rows
from docketry.operators import chunking, index, intake
from docketry.plans import fragments as sql
from docketry.session import scratch, table, tasks_for
from docketry.sources import corpus, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn
    return register


# ---- stand-in inputs --------------------------------------------------------------


#: Session setting: parts to deal documents into where they come in fewer files than there are cores. Unset: as they are stored.
READ_PARTITIONS = "docketry.read.partitions"


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    rows = table(spark, sf, "documents", *columns)
    parts = spark.conf.get(READ_PARTITIONS, None)
    return rows.repartition(int(parts), "doc_id") if parts and "doc_id" in rows.columns else rows


def document_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a source tree: path, raw content, bytes."""
    return documents(spark, sf, "doc_id", "text", "lang", "source").select(
        "doc_id", F.expr(sql.PATH_SQL).alias("path"), F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )


def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as markup with one element per line and named elements, documents as plain text."""
    html = F.replace(F.replace("html", F.lit("><"), F.lit(">\n<")), F.lit("class="), F.lit("id="))
    pages = table(spark, sf, "pages", "page_id", "html").select(
        F.concat(F.lit("site/page"), F.col("page_id").cast("string"), F.lit(".xml")).alias("path"),
        F.lit("site").alias("component"), F.lit(".xml").alias("suffix"), F.sha2("html", 256).alias("sha256"),
        html.alias("text"),
    )
    docs = documents(spark, sf, "doc_id", "text").select(
        F.concat(F.lit("docs/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("docs").alias("component"), F.lit(".txt").alias("suffix"), F.sha2("text", 256).alias("sha256"), "text",
    )
    return pages.unionByName(docs)


def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "doc_id", "source", "text").withColumnRenamed("doc_id", "source_id")
    return index.tokenized(docs, index.span_text("source", "text"))


def line_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as identifier occurrences: part bought in an order, typed by return flag."""
    return table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").select(
        F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("identifier"),
        F.col("l_returnflag").alias("kind"), F.lit(index.SCOPE).alias("scope"),
    )


POSTINGS_DUCK = """postings AS (SELECT DISTINCT l_partkey AS identifier, l_returnflag AS kind, l_orderkey AS source_id FROM lineitem),
 entries AS (SELECT identifier, kind, count(*) AS df FROM postings GROUP BY ALL)"""
DT_DUCK = f"""dt AS (SELECT doc_id AS source_id, {sql.tokens("source || chr(10) || text")} AS tokens FROM documents)"""


# ---- sources ----------------------------------------------------------------------


@query(f"""WITH {sql.SOURCE_FILES_DUCK} SELECT path, component, suffix, sha256(text) AS sha256,
 strlen(text)::BIGINT AS bytes, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS text_sha256 FROM sources""")
def scan_text_filter(spark, sf):
    files = corpus.source_files(document_tree(spark, sf))
    return files.select("path", "component", "suffix", "sha256", "bytes", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
 SELECT page_id, {sql.COMPONENT_DUCK} AS host, CASE WHEN contains(path, '/') THEN
 split_part(regexp_replace(path, '^[^/]+/', ''), '/', 1) ELSE path END AS component FROM p""")
def path_component(spark, sf):
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf, "pages", "page_id", "url").select(
        "page_id", corpus.component(path).alias("host"),
        corpus.component(F.regexp_replace(path, "^[^/]+/", "")).alias("component"),
    )


@query(f"WITH {sql.FILES_DUCK} SELECT doc_id, path, suffix, type FROM files")
def classify_type(spark, sf):
    path, suffix = F.col("path"), F.col("suffix")
    return document_tree(spark, sf).withColumn("suffix", corpus.suffix(path)).select(
        "doc_id", "path", "suffix", corpus.artifact_type(path, suffix).alias("type")
    )


_PAGE_TEXT = "replace(replace(html, '><', '>' || chr(10) || '<'), 'class=', 'id=')"
_HEADING = r"^\s*(?:#{1,6}\s+|\\(?:page|section|subsection)\s+)(.+)$"
_XML = r"""^\s*<([A-Za-z_:][\w:.-]*)[^>]*(?:name|id)=[''"]([^''"]+)[''"]"""
_ANCHORS_DUCK = f"""l0 AS (SELECT 'site/page' || page_id || '.xml' AS path, {sql.lines(_PAGE_TEXT)} AS ls FROM pages
   UNION ALL SELECT 'docs/doc' || doc_id || '.txt', {sql.lines('text')} FROM documents),
 l1 AS (SELECT path, len(ls) AS n, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM l0),
 l2 AS (SELECT path, n, no, CASE WHEN regexp_matches(line, '{_HEADING}') THEN {sql.strip(f"regexp_extract(line, '{_HEADING}', 1)")}
   WHEN path LIKE '%.xml' AND regexp_matches(line, '{_XML}') THEN regexp_extract(line, '{_XML}', 1) || '-' || regexp_extract(line, '{_XML}', 2) END AS label FROM l1),
 anchors AS (SELECT path, n, no, label FROM l2 WHERE label IS NOT NULL AND no > 0
   UNION ALL SELECT path, len(ls), 0, 'document' FROM l0)"""


@query(f"""WITH {_ANCHORS_DUCK} SELECT path, no::INT AS line, label,
 coalesce(lead(no) OVER (PARTITION BY path ORDER BY no), n)::INT AS section_end FROM anchors""")
def line_anchors(spark, sf):
    rows = chunking.with_anchors(text_files(spark, sf))
    ends = F.zip_with(
        "anchors", F.slice("anchors", 2, F.size("anchors")),
        lambda a, b: F.struct(a["line"].alias("line"), a["label"].alias("label"),
                              F.coalesce(b["line"], F.size("lines")).alias("section_end")),
    )
    return inline_rows(rows, ends, "path")


# Greedy windows as a recursive walk: the next start depends on the previous stop.
_CHUNKS_DUCK = f"""{_ANCHORS_DUCK},
 secs AS (SELECT path, no AS s0, label, coalesce(lead(no) OVER (PARTITION BY path ORDER BY no), n) AS s1 FROM anchors),
 ln AS (SELECT s.path, s.s0, s.s1, s.label, l.no - s.s0 + 1 AS i, l.line FROM secs s JOIN l1 l ON l.path = s.path AND l.no >= s.s0 AND l.no < s.s1),
 live AS (SELECT path, s0 FROM ln GROUP BY ALL HAVING bool_or(length({sql.strip('line')}) > 0)),
 pre AS (SELECT path, s0, s1 - s0 AS m, label, i, sum(length(line) + 1) OVER w AS ct, sum(strlen(line) + 1) OVER w AS bt
   FROM ln SEMI JOIN live USING (path, s0) WINDOW w AS (PARTITION BY path, s0 ORDER BY i)),
 base AS (SELECT path, s0, m, label, i, ct, bt FROM pre UNION ALL SELECT DISTINCT path, s0, m, label, 0, 0, 0 FROM pre),
 nxt AS (SELECT a.path, a.s0, a.m, a.label, a.i AS a0, greatest(a.i + 1, max(b.i)) AS stop FROM base a JOIN base b
   ON a.path = b.path AND a.s0 = b.s0 AND b.i > a.i AND b.i <= a.i + 80 AND (b.i = a.i + 1 OR (b.ct - a.ct - 1 <= 4000 AND b.bt - a.bt - 1 <= 1800))
   GROUP BY a.path, a.s0, a.m, a.label, a.i),
 walk AS (SELECT path, s0, m, label, a0, stop, 1 AS part FROM nxt WHERE a0 = 0
   UNION ALL SELECT n.path, n.s0, n.m, n.label, n.a0, n.stop, w.part + 1 FROM walk w JOIN nxt n
   ON n.path = w.path AND n.s0 = w.s0 AND n.a0 = greatest(w.stop - 10, w.a0 + 1) WHERE w.stop < w.m),
 cut AS (SELECT w.path, w.label, w.part, w.s0 + w.a0 + 1 AS start_line, w.s0 + w.stop AS end_line,
   trim(array_to_string(l0.ls[w.s0 + w.a0 + 1:w.s0 + w.stop], chr(10)), chr(10)) AS content
   FROM walk w JOIN l0 ON l0.path = w.path),
 chunks AS (SELECT * FROM cut WHERE length({sql.strip('content')}) > 0)"""


@query(f"""WITH RECURSIVE {_CHUNKS_DUCK} SELECT path, label, part::INT AS part, start_line::INT AS start_line, end_line::INT AS end_line,
 sha256(content) AS content_sha256 FROM chunks""")
def chunk_lines(spark, sf):
    rows = chunking.chunks(chunking.sections(chunking.with_anchors(text_files(spark, sf))))
    return rows.select("path", "label", "part", "start_line", "end_line", F.sha2("content", 256).alias("content_sha256"))


_SAFE = "coalesce(nullif(substr(trim(regexp_replace(label, '[^A-Za-z0-9_.-]+', '-', 'g'), '-'), 1, 72), ''), 'document')"


@query(f"""WITH RECURSIVE {_CHUNKS_DUCK} SELECT 'CFS::' || split_part(path, '/', 1) || '::' || path || '::' || {_SAFE} || CASE WHEN part > 1 THEN '-p' || part ELSE '' END
 || '::L' || start_line || '-L' || end_line AS source_id, CASE WHEN path LIKE '%.xml' THEN 'interface' ELSE 'documentation' END AS type, split_part(path, '/', 1) || ': ' || label AS title,
 CASE WHEN label <> 'document' THEN label END AS symbol, sha256(content) AS content_sha256 FROM chunks""")
def span_ids(spark, sf):
    return chunking.spans(text_files(spark, sf)).select("source_id", "type", "title", "symbol", "content_sha256")


@query(f"""WITH RECURSIVE {_CHUNKS_DUCK} SELECT CASE WHEN path LIKE '%.xml' THEN 'interface' ELSE 'documentation' END AS type,
 count(*)::BIGINT AS spans FROM chunks GROUP BY 1""")
def corpus_type_counts(spark, sf):
    return chunking.type_counts(chunking.spans(text_files(spark, sf)))


@query("""SELECT 'pkg/LICENSE-' || doc_id AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 7 = 0""")
def license_inventory(spark, sf):
    """License files of a tree; those of version control and other names are left out."""
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("pkg/LICENSE-"), number)).when(
        F.col("doc_id") % 7 == 1, F.concat(F.lit("pkg/.git/LICENSE"), number)).otherwise(F.concat(F.lit("LICENSE/readme"), number))
    tree = documents(spark, sf, "doc_id", "text").select(name.alias("path"), F.col("text").cast("binary").alias("content"))
    return corpus.license_files(tree)


@query("""WITH r AS (SELECT o_orderkey AS position, o_orderdate AS k FROM orders),
 d AS (SELECT k FROM r GROUP BY k HAVING count(*) > 1)
 SELECT 'duplicate_id' AS violation, count(*)::BIGINT AS rows FROM d HAVING count(*) > 0
 UNION ALL SELECT 'not_sorted', count(*) FROM r JOIN r b ON r.position = b.position + 1 WHERE r.k < b.k HAVING count(*) > 0
 UNION ALL SELECT 'empty', 1 WHERE (SELECT count(*) FROM r) = 0""")
def load_check(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderdate").toDF("position", "source_id")
    return corpus.package_violations(rows)


@query(f"""WITH d AS (SELECT doc_id, {sql.lines('text')} AS ls FROM documents),
 m AS (SELECT l.doc_id AS source_id, quality AS start_line, quality + 1 + 2 * toxic AS end_line, ls FROM labels l LEFT JOIN d USING (doc_id))
 SELECT source_id, CASE WHEN ls IS NULL THEN 'missing_file' WHEN start_line < 1 OR end_line < start_line OR end_line > len(ls)
 THEN 'invalid_line_range' END AS violation, CASE WHEN ls IS NOT NULL AND start_line >= 1 AND end_line >= start_line AND end_line <= len(ls)
 THEN sha256(array_to_string(ls[start_line:end_line], chr(10))) END AS content_sha256 FROM m""")
def line_slices(spark, sf):
    manifest = table(spark, sf, "labels", "doc_id", "quality", "toxic").select(
        F.col("doc_id").alias("source_id"), F.col("doc_id").alias("path"), F.col("quality").alias("start_line"),
        (F.col("quality") + 1 + 2 * F.col("toxic")).alias("end_line"),
    )
    files = documents(spark, sf, "doc_id", "text").withColumnRenamed("doc_id", "path")
    return corpus.line_slices(manifest, files).select("source_id", "violation", F.sha2("content", 256).alias("content_sha256"))


@query(f"""WITH c AS (SELECT conv_id, turn, {sql.lines('text')} AS ls FROM conversations)
 SELECT conv_id AS stored_run_id, turn AS case_id, (i - 1)::INT AS ordinal, ls[i] AS source_id, length(ls[i])::INT AS score
 FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM c)""")
def explode_runs(spark, sf):
    candidate = F.transform(
        text.split_lines(F.col("text")), lambda l: F.struct(l.alias("source_id"), F.length(l).alias("score"))
    )
    runs = table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        F.col("conv_id").alias("run_id"), F.array(F.struct(F.col("turn").alias("case_id"), candidate.alias("candidates"))).alias("cases")
    )
    return corpus.run_rows(corpus.run_cases(runs), "candidates")


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS run_id, max(ts) AS published_at FROM events GROUP BY user_id""")
def latest_pointer(spark, sf):
    pointers = table(spark, sf, "events", "user_id", "event_id", "ts").toDF("user_id", "run_id", "published_at")
    return corpus.latest_pointer(pointers, "user_id")


@query("SELECT turn, role, sha256(text) AS text_sha256 FROM conversations WHERE conv_id = 7")
def case_lookup(spark, sf):
    cases = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").withColumnRenamed("conv_id", "case_id")
    return corpus.case_lookup(cases, 7).select("turn", "role", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN array_to_string(list_sort(json_keys(props)), ',') ELSE '' END AS unexpected
 FROM events""")
def event_allowlist(spark, sf):
    plain = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("run_id")))
    body = F.when(F.col("event_type").isin("error", "view"), F.col("props")).otherwise(plain)
    return table(spark, sf, "events", "event_id", "event_type", "user_id", "props").select(
        "event_id", F.array_join(sinks.unexpected_fields(body), ",").alias("unexpected")
    )


@query("SELECT count(*)::BIGINT AS objects, sum(strlen(text))::BIGINT AS bytes, NULL::VARCHAR AS violation FROM documents")
def inventory(spark, sf):
    objects = table(spark, sf, "documents", "text").select(F.octet_length("text").cast("bigint").alias("bytes"))
    return corpus.inventory(objects)


@query("""SELECT doc_id AS path, CASE WHEN toxic IS NULL THEN 'new' WHEN toxic = 1 THEN 'conflict' ELSE 'identical' END AS action
 FROM documents LEFT JOIN labels USING (doc_id)""")
def sync_plan(spark, sf):
    local = documents(spark, sf, "doc_id", "text").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    remote = table(spark, sf, "labels", "doc_id", "toxic").join(local, F.col("doc_id") == F.col("path")).select(
        "path", F.when(F.col("toxic") == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256")
    )
    return corpus.sync_plan(local, remote).select("path", "action")


# ---- intake -----------------------------------------------------------------------

_TYPES = ("requirement", "interface_change", "design_change", "unknown")


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as incoming artifacts: padded fields, repeated and blank identifiers."""
    kind = F.element_at(text.lit_array(_TYPES), (F.length("source") % 4 + 1).cast("int"))
    return documents(spark, sf, "doc_id", "text", "lang", "source").select(
        F.col("doc_id").alias("query_id"), kind.alias("artifact_type"),
        F.concat(F.lit("  "), F.substring("text", 1, 220), F.lit(" ")).alias("title"),
        F.when(F.col("lang") == "en", F.lit("   ")).otherwise(F.concat(F.col("lang"), F.lit("\t"))).alias("subsystem"),
        F.split(F.substring("text", 1, 90), " ").alias("identifiers"),
        F.concat(F.lit("\n "), "text", F.lit(" \n")).alias("text"),
    )


_INCOMING_DUCK = f"""raw AS (SELECT doc_id AS query_id, ['requirement', 'interface_change', 'design_change', 'unknown'][length(source) % 4 + 1] AS artifact_type,
 '  ' || substr(text, 1, 220) || ' ' AS title, CASE WHEN lang = 'en' THEN '   ' ELSE lang || chr(9) END AS subsystem,
 string_split(substr(text, 1, 90), ' ') AS ids, chr(10) || ' ' || text || ' ' || chr(10) AS text FROM documents),
 tr AS (SELECT *, list_filter(list_transform(ids, lambda v: {sql.strip('v')}), lambda v: length(v) > 0) AS t FROM raw),
 inc AS (SELECT query_id, artifact_type, nullif({sql.strip('title')}, '') AS title, nullif({sql.strip('subsystem')}, '') AS subsystem,
 list_filter(t, lambda v, i: list_position(t, v) = i) AS ids, {sql.strip('text')} AS text,
 list_filter([CASE WHEN artifact_type = 'unknown' THEN 'artifact_type' END, CASE WHEN length({sql.strip('text')}) = 0 THEN 'blank_text' END,
 CASE WHEN list_max(list_transform(t, lambda v: length(v))) > 120 THEN 'long_identifier' END, CASE WHEN length(subsystem) > 120 THEN 'long_subsystem' END,
 CASE WHEN length(text) > 20000 THEN 'long_text' END, CASE WHEN length(title) > 200 THEN 'long_title' END,
 CASE WHEN len(ids) > 20 THEN 'many_identifiers' END], lambda v: v IS NOT NULL) AS violations FROM tr)"""


@query(f"""WITH {_INCOMING_DUCK} SELECT query_id, title, subsystem, array_to_string(ids, '|') AS identifiers, sha256(text) AS text_sha256,
 array_to_string(violations, ',') AS violations FROM inc""")
def normalize_incoming(spark, sf):
    return intake.normalise_incoming(incoming(spark, sf)).select(
        "query_id", "title", "subsystem", F.array_join("identifiers", "|").alias("identifiers"),
        F.sha2("text", 256).alias("text_sha256"), F.array_join("violations", ",").alias("violations"),
    )


_QID_DUCK = f"""{_INCOMING_DUCK}, qi AS (SELECT *, list_concat(ids, list_filter({sql.words("concat_ws(chr(10), title, subsystem, text)")},
 lambda w: {sql.code_like('w')})) AS everything FROM inc),
 qx AS (SELECT *, list_filter(everything, lambda v, i: list_position(everything, v) = i) AS found FROM qi)"""


@query(f"""WITH {_QID_DUCK} SELECT query_id, (i - 1)::INT AS ordinal, found[i] AS identifier
 FROM (SELECT query_id, found, unnest(range(1, len(found) + 1)) AS i FROM qx)""")
def query_identifiers(spark, sf):
    queries = intake.process_queries(intake.normalise_incoming(incoming(spark, sf)))
    return posexplode_rows(queries, "extracted_identifiers", "ordinal", "identifier", "query_id")


@query(f"""WITH {_QID_DUCK}, j AS (SELECT query_id, found, concat_ws(chr(10), artifact_type, coalesce(title, ''), coalesce(subsystem, ''),
 array_to_string(ids, chr(10)), text, array_to_string(list_filter(found, lambda v: NOT list_contains(ids, v)), chr(10))) AS query_text FROM qx)
 SELECT query_id, sha256(to_json({{'extracted_identifiers': found, 'processor_version': '{intake.PROCESSOR_VERSION}', 'query_text': query_text}})::VARCHAR)
 AS query_fingerprint FROM j""")
def query_fingerprint(spark, sf):
    queries = intake.process_queries(intake.normalise_incoming(incoming(spark, sf)))
    return queries.select("query_id", "query_fingerprint")


@query(f"""WITH c AS (SELECT conv_id, turn, role, {sql.lines('text')} AS ls FROM conversations),
 d AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'REVIEW' WHEN 'user' THEN 'NO_REVIEW' ELSE 'UNSURE' END AS decision,
 CASE WHEN role = 'user' THEN []::VARCHAR[] ELSE ls END AS ls FROM c),
 v AS (SELECT conv_id, turn, unnest(list_filter([CASE WHEN decision <> 'REVIEW' AND len(ls) > 0 THEN 'claim_without_review' END,
 CASE WHEN len(list_filter(ls, lambda l: length(l) = 0 OR length(l) > 500)) > 0 THEN 'draft_limits' END,
 CASE WHEN decision = 'REVIEW' AND len(ls) = 0 THEN 'review_without_claim' END, CASE WHEN len(ls) > 3 THEN 'too_many_claims' END,
 CASE WHEN decision = 'UNSURE' THEN 'unknown_decision' END], lambda x: x IS NOT NULL)) AS violation FROM d)
 SELECT conv_id AS query_id, turn AS source_id, violation FROM v
 UNION ALL SELECT conv_id, NULL, 'too_many_request_claims' FROM d GROUP BY conv_id HAVING sum(len(ls)) > 20""")
def contract_check(spark, sf):
    draft = F.transform(text.split_lines(F.col("text")), lambda l, i: F.struct(
        F.lit("INTERFACE_IMPACT").alias("impact_type"), l.alias("impact_claim"), l.alias("evidence_exact_text"),
        (i + 1).alias("evidence_start_line"), (i + 1).alias("evidence_end_line")))
    decision = F.when(F.col("role") == "assistant", "REVIEW").when(F.col("role") == "user", "NO_REVIEW").otherwise("UNSURE")
    decisions = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("source_id"), decision.alias("decision"),
        F.when(F.col("role") != "user", draft).alias("claims"))
    return intake.decision_contract(decisions)


@query("""SELECT 'event_type' AS field, event_type AS value, count(*)::BIGINT AS rows FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY ALL
 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY ALL
 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL""")
def enum_check(spark, sf):
    events = intake.enum_violations(table(spark, sf, "events", "event_type"), {"event_type": ("click", "view")})
    orders = intake.enum_violations(
        table(spark, sf, "orders", "o_orderstatus", "o_orderpriority"),
        {"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT", "2-HIGH")})
    return events.unionByName(orders)


@query("""WITH s AS (SELECT d.doc_id, CASE WHEN quality = 0 THEN NULL WHEN toxic = 1 THEN 'changed' ELSE 'same' END AS c, coalesce(quality, 1) AS q, source, lang
 FROM documents d LEFT JOIN labels l USING (doc_id))
 SELECT doc_id AS source_id, unnest(list_filter([CASE WHEN c IS DISTINCT FROM 'same' THEN 'content_sha256' END, CASE WHEN q = 0 THEN 'line_range' END,
 CASE WHEN lang = 'fr' OR source = 'src9' THEN 'source_file_sha256' END], lambda x: x IS NOT NULL)) AS violation FROM s""")
def span_integrity(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "lang", "source")
    spans = docs.join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("source_id"), F.col("source").alias("path"), F.col("text").alias("content"),
        F.coalesce("quality", F.lit(1)).alias("start_line"), F.lit(1).alias("end_line"),
        F.when(F.col("quality") == 0, F.lit(None)).when(F.col("toxic") == 1, F.sha2("source", 256)).otherwise(F.sha2("text", 256)).alias("content_sha256"),
        F.when(F.col("lang") == "fr", F.sha2("lang", 256)).otherwise(F.sha2("source", 256)).alias("source_file_sha256"),
    )
    files = docs.select(F.col("source").alias("path")).distinct().filter("path <> 'src9'").withColumn("sha256", F.sha2("path", 256))
    return intake.span_integrity(spans, files)


# ---- token statistics -------------------------------------------------------------


@query(f"""WITH {DT_DUCK} SELECT source_id, len(tokens)::BIGINT AS tokens, sha256(array_to_string(tokens, ' ')) AS token_sha256 FROM dt""")
def tokenize(spark, sf):
    return document_tokens(spark, sf).select(
        "source_id", F.size("tokens").cast("bigint").alias("tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("token_sha256"))


@query(f"""WITH {DT_DUCK}, s AS (SELECT count(*) AS n, avg(len(tokens)) AS a FROM dt)
 SELECT source_id, len(tokens)::BIGINT AS length, n::BIGINT AS n, round_even(a, 6) AS avg_length FROM dt, s""")
def doc_lengths(spark, sf):
    tokens = document_tokens(spark, sf)
    stats = index.corpus_stats(tokens)
    return index.doc_lengths(tokens).select(
        "source_id", "length", stats.select("n").scalar().alias("n"),
        F.bround(stats.select("avg_length").scalar(), 6).alias("avg_length"))


@query(f"WITH {DT_DUCK} SELECT token, count(DISTINCT source_id)::BIGINT AS df FROM (SELECT source_id, unnest(tokens) AS token FROM dt) GROUP BY token")
def doc_freq(spark, sf):
    return index.doc_freq(document_tokens(spark, sf))


@query(f"WITH {DT_DUCK} SELECT source_id, token, count(*)::BIGINT AS tf FROM (SELECT source_id, unnest(tokens) AS token FROM dt) GROUP BY ALL")
def term_freq(spark, sf):
    return index.term_freq(document_tokens(spark, sf)).select("source_id", "token", "tf")


# ---- identifier index -------------------------------------------------------------

_KINDS_DUCK = "'" + "', '".join((*index.KEYWORDS, *index.GENERIC)) + "'"


def _kind_duck(w: str) -> str:
    return f"""CASE WHEN {w} IN ({_KINDS_DUCK}) THEN NULL WHEN upper({w}) LIKE '%\\_MID' ESCAPE '\\' THEN 'message_id'
 WHEN upper({w}) LIKE '%\\_CC' ESCAPE '\\' THEN 'command_code' WHEN contains(upper({w}), 'TBL') OR contains(upper({w}), 'TABLE') THEN 'table'
 WHEN {w} LIKE '%\\_t' ESCAPE '\\' THEN 'type' WHEN list_contains(calls, {w}) THEN 'function'
 WHEN contains({w}, '_') AND {w} = upper({w}) AND regexp_matches({w}, '[A-Z]') THEN 'macro'
 WHEN type IN ('interface', 'configuration') AND contains({w}, '_') THEN 'symbol'
 WHEN type = 'verification' AND (starts_with({w}, 'Test') OR starts_with({w}, 'UtAssert')) THEN 'test_target' END"""


@query(f"""WITH p AS (SELECT page_id AS source_id, ['interface', 'verification', 'design'][page_id % 3 + 1] AS type, 'Page_' || page_id || '_TBL' AS symbol, html,
 list_transform(list_filter(regexp_extract_all(html, '[\\p{{L}}\\p{{N}}_]+\\s*\\('), lambda c: regexp_full_match(c, '[A-Za-z_][A-Za-z0-9_]{{2,119}}\\s*\\(')),
 lambda c: regexp_extract(c, '^[A-Za-z0-9_]+')) AS calls,
 regexp_extract_all(html, '\\b(?:class|lang)=["'']([A-Za-z_][A-Za-z0-9_.:-]{{2,119}})["'']', 1) AS vals, {sql.words('html')} AS ws FROM pages),
 w AS (SELECT source_id, type, calls, unnest(ws) AS identifier FROM p),
 k AS (SELECT source_id, identifier, {_kind_duck('identifier')} AS kind FROM w
 UNION ALL SELECT source_id, symbol, coalesce({_kind_duck('symbol')}, 'symbol') FROM p UNION ALL SELECT source_id, unnest(vals), 'eds_xml' FROM p)
 SELECT DISTINCT source_id, identifier, kind, 'global' AS scope FROM k WHERE kind IS NOT NULL""")
def typed_identifiers(spark, sf):
    kinds = text.lit_array(("interface", "verification", "design"))
    spans = table(spark, sf, "pages", "page_id", "html").select(
        F.col("page_id").alias("source_id"), F.element_at(kinds, (F.col("page_id") % 3 + 1).cast("int")).alias("type"),
        F.concat(F.lit("Page_"), F.col("page_id").cast("string"), F.lit("_TBL")).alias("symbol"), F.col("html").alias("content"))
    return index.typed_identifiers(spans, ("class", "lang"))


@query(f"""WITH {POSTINGS_DUCK} SELECT identifier, kind, 'global' AS scope, source_id, df::BIGINT AS df FROM postings JOIN entries USING (identifier, kind)""")
def inverted_index(spark, sf):
    rows = index.postings(line_identifiers(spark, sf))
    return rows.join(index.entries(rows), index.ENTRY_KEY)


@query(f"WITH {POSTINGS_DUCK} SELECT identifier, kind, 'global' AS scope, df::BIGINT AS df FROM entries WHERE df BETWEEN 2 AND 10")
def eligible_entries(spark, sf):
    return index.eligible_entries(index.entries(index.postings(line_identifiers(spark, sf))), 2, 10)


@query(f"""WITH {POSTINGS_DUCK}, n AS (SELECT count(*) AS n FROM orders) SELECT identifier, kind, df::BIGINT AS df,
 round_even({sql.specificity('df', 'n')}, 8) AS specificity FROM entries, n""")
def specificity(spark, sf):
    n = table(spark, sf, "orders", "o_orderkey").agg(F.count(F.lit(1))).scalar()
    return index.entries(index.postings(line_identifiers(spark, sf))).select(
        "identifier", "kind", "df", F.bround(scores.specificity(F.col("df"), n), 8).alias("specificity"))


SEEDS_DUCK = f"""{POSTINGS_DUCK}, elig AS (SELECT identifier, kind, source_id, df FROM postings JOIN entries USING (identifier, kind) WHERE df BETWEEN 2 AND 50),
 rare AS (SELECT source_id, identifier, min(df) AS df FROM elig GROUP BY ALL),
 seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY df, identifier) AS seed_no FROM rare) WHERE seed_no <= 8)"""


@query(f"WITH {SEEDS_DUCK} SELECT source_id, identifier, df::BIGINT AS df, seed_no::INT AS seed_no FROM seeds")
def seed_topk(spark, sf):
    return index.seed_identifiers(index.identifier_links(index.eligible_postings(index.postings(line_identifiers(spark, sf)))))


@query(f"""WITH {POSTINGS_DUCK}, t AS (SELECT identifier, kind, df, source_id, row_number() OVER (ORDER BY identifier, kind, source_id) - 1 AS slot FROM postings JOIN entries USING (identifier, kind)),
 ix AS (SELECT identifier, kind, source_id, CASE WHEN identifier % 11 = 0 THEN df + 1 ELSE df END AS df, CASE WHEN (slot // 2) % 7 <> 0 THEN slot WHEN slot % 2 = 0 THEN slot + 1 ELSE slot - 1 END AS position FROM t),
 p AS (SELECT a.*, b.identifier AS bi, b.kind AS bk, b.source_id AS bs FROM ix a JOIN ix b ON a.position = b.position + 1)
 SELECT DISTINCT identifier, kind, 'global' AS scope, 'postings_not_sorted_unique' AS violation FROM p WHERE identifier = bi AND kind = bk AND source_id <= bs
 UNION ALL SELECT identifier, kind, 'global', 'df_mismatch' FROM ix GROUP BY ALL HAVING min(df) <> count(*)
 UNION ALL SELECT DISTINCT identifier, kind, 'global', 'unknown_source' FROM ix WHERE source_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
 UNION ALL SELECT DISTINCT identifier, kind, 'global', 'entries_not_ordered' FROM p WHERE (identifier, kind) < (bi, bk)""")
def index_audit(spark, sf):
    """Entries of any frequency, written and read back; some frequencies and places are then falsified."""
    path = scratch(spark, "index")
    lines = line_identifiers(spark, sf)
    parts = tasks_for(lines.count(), spark)
    sinks.write_index(index.index_table(index.postings(lines, parts)), path, *index.ENTRY_KEY, "source_id")
    stored = corpus.with_positions(spark.read.parquet(path))
    at = F.col("position")
    swapped = F.when(F.floor(at / 2) % 7 != 0, at).when(at % 2 == 0, at + 1).otherwise(at - 1)
    tampered = stored.withColumns({
        "df": F.when(F.col("identifier") % 11 == 0, F.col("df") + 1).otherwise(F.col("df")), "position": swapped})
    spans = table(spark, sf, "orders", "o_orderkey", "o_orderstatus").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("source_id"))
    return index.audit_index(tampered, spans, parts)
