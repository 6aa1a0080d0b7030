"""SQL text shared by the reference statements that check the Spark queries."""

from __future__ import annotations

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def lines(x: str) -> str:
    cut = f"regexp_replace({x}, '(?:{_BREAK})\\z', '')"
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split_regex({cut}, '{_BREAK}') END)"


def tokens(x: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[0-9]+'), lambda w: "
        "CASE WHEN regexp_matches(w, '[a-z0-9][A-Z]') THEN list_append(string_split(lower("
        r"regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' '), lower(w)) ELSE [lower(w)] END))"
    )


def words(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]{2,119}'))"
    )


def code_like(w: str) -> str:
    return (
        f"(contains({w}, '_') OR regexp_matches({w}, '[a-z0-9][A-Z]') OR "
        f"(regexp_matches({w}, '[0-9]') AND regexp_matches({w}, '[A-Za-z]')))"
    )


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"


def specificity(df: str, n: str) -> str:
    return (
        f"(CASE WHEN {df} < 2 OR {n} <= 1 OR ln(({n} + 1) / 3e0) <= 0 THEN 0e0 ELSE "
        f"greatest(0e0, least(1e0, ln(({n} + 1) / ({df} + 1e0)) / ln(({n} + 1) / 3e0))) END)"
    )


def safe_rate(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN NULL ELSE round_even(({a})::DOUBLE / ({b}), 6) END)"


def min_max(v: str, lo: str, hi: str) -> str:
    return (
        f"(CASE WHEN abs({hi} - {lo}) <= 1e-9 * greatest(abs({lo}), abs({hi})) THEN "
        f"(CASE WHEN {hi} > 0 THEN 1e0 ELSE 0e0 END) ELSE ({v} - {lo}) / ({hi} - {lo}) END)"
    )


# Paths given to documents: folders and suffixes that exercise every path rule.
FOLDER_SQL = (
    "CASE source WHEN 'src1' THEN 'apps/sample' WHEN 'src2' THEN 'libs/core/unit-test' "
    "WHEN 'src3' THEN 'Vendor/x' WHEN 'src4' THEN 'tools/gen/config' WHEN 'src5' THEN 'docs' "
    "WHEN 'src6' THEN 'fsw/inc' WHEN 'src7' THEN 'mission_inc' WHEN 'src8' THEN 'requirements' ELSE source END"
)
SUFFIX_SQL = "CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.c' WHEN 'de' THEN '.XML' ELSE '.html' END"
PATH_SQL = f"concat({FOLDER_SQL}, '/doc', CAST(doc_id AS STRING), {SUFFIX_SQL})"
PATH_DUCK = PATH_SQL.replace("AS STRING", "AS VARCHAR")
COMPONENT_DUCK = (
    "(CASE WHEN split_part(path, '/', 1) IN ('apps', 'libs', 'tools') AND contains(path, '/') "
    "THEN split_part(path, '/', 1) || '-' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END)"
)
TYPE_DUCK = """(CASE WHEN regexp_matches(lower(path), 'unit-test|unit_test|/tests/|/test/') THEN 'verification'
 WHEN contains(lower(path), 'requirement') OR contains(lower(regexp_extract(path, '[^/]+$')), 'req') THEN 'requirement'
 WHEN suffix IN ('.xml', '.eds') OR regexp_matches(lower(path), 'msgdef|interface|/inc/|topicid') THEN 'interface'
 WHEN regexp_matches(lower(path), '/config/|mission_inc|platform_inc|sample_defs') THEN 'configuration'
 WHEN suffix IN ('.md', '.txt') OR contains(lower(path), '/docs/') THEN 'documentation' ELSE 'design' END)"""
FILES_DUCK = f"""files AS (
 SELECT *, {COMPONENT_DUCK} AS component, {TYPE_DUCK} AS type FROM (
  SELECT doc_id, text, path, lower(regexp_extract(path, '\\.[^.]+$')) AS suffix
  FROM (SELECT doc_id, text, {PATH_DUCK} AS path FROM documents)))"""
SOURCE_FILES_DUCK = FILES_DUCK + f""", sources AS (
 SELECT * FROM files WHERE suffix IN ('.md', '.c', '.xml') AND NOT contains(lower(path), 'vendor/')
  AND length({strip('text')}) > 0)"""
