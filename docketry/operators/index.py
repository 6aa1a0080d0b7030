"""Token statistics and the typed-identifier inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import scores, text
from docketry.functions.rows import explode_rows, inline_rows
from docketry.session import materialise

# C keywords, never identifiers.
KEYWORDS = (
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else",
    "enum", "extern", "float", "for", "goto", "if", "inline", "int", "long", "register",
    "restrict", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef",
    "union", "unsigned", "void", "volatile", "while",
)
# Words too generic to link spans.
GENERIC = (
    "NULL", "TRUE", "FALSE", "SUCCESS", "ERROR", "size_t", "int8_t", "int16_t", "int32_t",
    "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t",
)
MARKUP_ATTRIBUTES = ("name", "id", "type")
SCOPE = "global"


def span_text(title: str = "title", content: str = "content") -> Column:
    return F.concat(F.col(title), F.lit("\n"), F.col(content))


# ---- token statistics -------------------------------------------------------------


def tokenized(spans: DataFrame, body: Column) -> DataFrame:
    """(source_id, tokens): a narrow projection, no shuffle."""
    return spans.select("source_id", text.tokenize(body).alias("tokens"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("source_id", F.size("tokens").cast("bigint").alias("length"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: number of spans and their average token count (zero spans give 0)."""
    return tokens.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(F.size("tokens").cast("double")), F.lit(0.0)).alias("avg_length"),
    )


def doc_freq(tokens: DataFrame) -> DataFrame:
    """Spans per token. Partial aggregation absorbs tokens found in every span."""
    return (
        explode_rows(tokens, F.array_distinct("tokens"), "token")
        .groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    )


def term_freq(tokens: DataFrame) -> DataFrame:
    return (
        explode_rows(tokens, "tokens", "token", "source_id", F.size("tokens").alias("length"))
        .groupBy("source_id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))
    )


# ---- typed identifiers ------------------------------------------------------------


def _kind(token: Column, span_type: Column, calls: Column) -> Column:
    upper = F.upper(token)
    return (
        F.when(token.isin(*KEYWORDS, *GENERIC), F.lit(None).cast("string"))
        .when(upper.endswith("_MID"), "message_id")
        .when(upper.endswith("_CC"), "command_code")
        .when(upper.contains("TBL") | upper.contains("TABLE"), "table")
        .when(token.endswith("_t"), "type")
        .when(F.array_contains(calls, token), "function")
        .when(token.contains("_") & (token == upper) & token.rlike("[A-Z]"), "macro")
        .when(span_type.isin("interface", "configuration") & token.contains("_"), "symbol")
        .when(
            (span_type == "verification")
            & (token.startswith("Test") | token.startswith("UtAssert")),
            "test_target",
        )
    )


def typed_identifiers(
    spans: DataFrame, markup_attributes: tuple[str, ...] = MARKUP_ATTRIBUTES
) -> DataFrame:
    """Distinct (source_id, identifier, kind, scope) found in each span.

    ``spans`` needs source_id, type, symbol and content. Words, call names and markup
    values are taken inside the row and deduplicated there, so only distinct
    identifiers of a span are exploded and no shuffle is needed while source_id is
    unique.
    """
    call = text.WORD_BEFORE + "(" + text.IDENTIFIER + r")(?U:\s*)\("
    markup = (
        text.WORD_BEFORE + "(?:" + "|".join(markup_attributes)
        + r""")=["']([A-Za-z_][A-Za-z0-9_.:-]{2,119})["']"""
    )
    found = spans.select(
        "source_id", "type", "symbol",
        F.array_distinct(text.identifier_tokens(F.col("content"))).alias("words"),
        F.array_distinct(F.regexp_extract_all("content", F.lit(call), F.lit(1))).alias("calls"),
        F.array_distinct(F.regexp_extract_all("content", F.lit(markup), F.lit(1))).alias("values"),
    )

    def entry(identifier: Column, kind: Column) -> Column:
        return F.struct(identifier.alias("identifier"), kind.alias("kind"))

    words = F.filter(
        F.transform("words", lambda w: entry(w, _kind(w, F.col("type"), F.col("calls")))),
        lambda e: e["kind"].isNotNull(),
    )
    symbol = F.col("symbol")
    own = F.when(
        symbol.rlike(r"\A" + text.IDENTIFIER + r"\z") & ~symbol.isin(*KEYWORDS, *GENERIC),
        F.array(entry(symbol, F.coalesce(_kind(symbol, F.col("type"), F.col("calls")), F.lit("symbol")))),
    )
    marked = F.transform("values", lambda v: entry(v, F.lit("eds_xml")))
    every = F.array_distinct(
        F.concat(words, F.coalesce(own, F.slice(words, 1, 0)), marked)
    )
    return inline_rows(found, every, "source_id").withColumn("scope", F.lit(SCOPE))


# ---- inverted index ---------------------------------------------------------------

ENTRY_KEY = ["identifier", "kind", "scope"]


def postings(identifiers: DataFrame, parts: int | None = None) -> DataFrame:
    """Long-form inverted index: one row per entry and source.

    With ``parts`` rows are dealt to so many tasks first, so that no task groups more the larger the table is.
    """
    rows = identifiers.select(*ENTRY_KEY, "source_id")
    # Constant columns leave the grouping, so rows dealt by them too would be moved again.
    return (rows.repartition(parts, "identifier", "source_id") if parts else rows).distinct()


def entries(posting_rows: DataFrame) -> DataFrame:
    """Document frequency per entry; input must be the distinct postings."""
    return posting_rows.groupBy(*ENTRY_KEY).agg(F.count(F.lit(1)).alias("df"))


def eligible_entries(
    entry_rows: DataFrame, min_df: int = scores.MIN_DF, max_df: int = scores.MAX_DF
) -> DataFrame:
    return entry_rows.filter(F.col("df").between(min_df, max_df))


# Share of all postings above which an entry is dropped before the shuffle. The
# frequencies add up to the number of postings, so fewer than this many entries can
# exceed the share: the broadcast list is bounded whatever the data looks like.
HEAVY_ENTRIES = 10_000


def eligible_postings(
    posting_rows: DataFrame, min_df: int = scores.MIN_DF, max_df: int = scores.MAX_DF, repeated: DataFrame | None = None
) -> DataFrame:
    """Postings of the eligible entries with their document frequency.

    ``repeated`` are the same postings before repeats were removed, for callers who group the result anyway; it is returned instead.

    Entries far above the limit would put their whole posting list into one join
    partition only to be discarded there; they are filtered out map-side first. The
    entry counts are an index table of their own and are written once.
    """
    counted = materialise(entries(posting_rows), "entries")
    share = counted.agg(F.ceil(F.sum("df") / HEAVY_ENTRIES).alias("share")).scalar()
    heavy = counted.filter((F.col("df") > max_df) & (F.col("df") > share)).select(*ENTRY_KEY)
    rows = posting_rows if repeated is None else repeated
    light = rows.join(F.broadcast(heavy), ENTRY_KEY, "left_anti")
    return light.join(eligible_entries(counted, min_df, max_df), ENTRY_KEY)


def identifier_links(eligible_rows: DataFrame) -> DataFrame:
    """(source_id, identifier, df): one row per span and identifier at its rarest kind.

    Specificity falls strictly with document frequency, so the rarest kind carries the
    strongest link and every later step can join on unique rows.
    """
    return eligible_rows.groupBy("source_id", "identifier").agg(F.min("df").alias("df"))


def seed_identifiers(links: DataFrame, per_span: int = scores.SEEDS_PER_SPAN) -> DataFrame:
    """The most specific identifiers of each span: (source_id, identifier, df, seed_no)."""
    order = Window.partitionBy("source_id").orderBy(F.asc("df"), F.asc("identifier"))
    return links.withColumn("seed_no", F.row_number().over(order)).filter(F.col("seed_no") <= per_span)


def index_table(posting_rows: DataFrame) -> DataFrame:
    """Stored form of all entries: one row per entry and source with the entry's frequency.

    Long form keeps entries of any frequency; the eligible range is applied at look-up. Written
    with ``sinks.write_index`` by ENTRY_KEY and source, it is in order throughout.
    """
    rows = posting_rows.select(*ENTRY_KEY, "source_id")
    return rows.join(entries(rows), ENTRY_KEY)


def audit_index(index_rows: DataFrame, spans: DataFrame, parts: int | None = None) -> DataFrame:
    """Violations of a stored index: (identifier, kind, scope, violation), each entry once per kind.

    ``index_rows`` is the long form with the ``position`` of each row. Order is checked by joining each
    position with the next, frequencies by counting, so no list of a frequent entry is ever built. With ``parts`` joins run in so many tasks.
    """

    def dealt(rows: DataFrame, column: str) -> DataFrame:
        return rows.repartition(parts, column) if parts else rows

    key = F.struct(*ENTRY_KEY)
    before = index_rows.select(
        (F.col("position") + 1).alias("position"), key.alias("before"), F.col("source_id").alias("source_before")
    )
    pairs = dealt(index_rows.drop("df"), "position").join(dealt(before, "position"), "position")
    unsorted = pairs.filter((key == F.col("before")) & (F.col("source_id") <= F.col("source_before")))
    disorder = pairs.filter(key < F.col("before"))
    counted = index_rows.groupBy(*ENTRY_KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.min("df").alias("low"), F.max("df").alias("high"))
    wrong = counted.filter(~(F.col("low").eqNullSafe(F.col("rows")) & F.col("high").eqNullSafe(F.col("rows"))))
    unknown = dealt(index_rows.drop("df", "position"), "source_id").join(dealt(spans.select("source_id"), "source_id"), "source_id", "left_anti")

    def named(rows: DataFrame, violation: str) -> DataFrame:
        return rows.select(*ENTRY_KEY, F.lit(violation).alias("violation")).distinct()

    return (
        named(unsorted, "postings_not_sorted_unique").unionByName(named(wrong, "df_mismatch"))
        .unionByName(named(unknown, "unknown_source")).unionByName(named(disorder, "entries_not_ordered"))
    )
