"""SQL statements of the periodic runs, the manifest and the Jaccard join."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def jaccard(shingle: int = 3, percent: int = 90) -> str:
    """Sets of n-grams, overlaps by joining them, components by closure over the links."""
    gram = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(shingle))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
d AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {shingle - 2}), lambda i: {gram}) END) AS grams FROM w),
s AS MATERIALIZED (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM d),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM o WHERE 100 * k >= {percent} * (nx + ny - k)),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x)
SELECT doc_id, any_value(len(grams))::BIGINT AS n_shingles, min(reached) AS component_id FROM r JOIN d USING (doc_id) GROUP BY doc_id"""


def _crc32(value: str) -> str:
    """Unsigned crc32 of a short ASCII text: eight shifts per byte."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    table = step
    for _ in range(7):
        table = f"list_transform([{table}], lambda c: {step})[1]"
    byte = f"list_transform([xor(c, b)], lambda c: {table})[1]"
    codes = f"list_transform(string_split({value}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"


def _levels(out: list[str], name: str, key: str, levels: int) -> str:
    """CTEs that hash runs of three, level by level, until one node of each tree is left; the name of the last."""
    last = f"{name}0"
    for k in range(1, levels + 1):
        out.append(f"{name}{k} AS MATERIALIZED (SELECT {key}, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (any_value(n) + 2) // 3 AS n FROM {last} WHERE n > 1 GROUP BY {key}, pos // 3"
                   f" UNION ALL SELECT {key}, pos, h, n FROM {last} WHERE n = 1)")
        last = f"{name}{k}"
    return last


def _paths(out: list[str], rows: str, name: str, key: str, node: str, levels: int, prefix: str) -> str:
    """CTEs that walk ``rows`` up the levels of ``name``: proof grows by the siblings, folded by hashing with them."""
    last = rows
    for k in range(levels):
        out.append(f"""{prefix}{k} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN m > 1 THEN {node} // 3 ELSE {node} END AS {node}, CASE WHEN m > 1 THEN (m + 2) // 3 ELSE m END AS m,
 CASE WHEN m > 1 THEN proof || coalesce(b, '') || coalesce(a, '') ELSE proof END AS proof, CASE WHEN m > 1 THEN sha256(coalesce(b, '') || folded || coalesce(a, '')) ELSE folded END AS folded) FROM {last} r
 LEFT JOIN LATERAL (SELECT string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < r.{node}) AS b, string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > r.{node}) AS a
 FROM {name}{k} t WHERE t.{key} = r.{key} AND t.pos // 3 = r.{node} // 3) ON true)""")
        last = f"{prefix}{k}"
    return last


def manifest(source_levels: int = 12, top_levels: int = 6) -> str:
    """Leaves, trees of sources, the tree of their roots; proofs and folded roots on the way up."""
    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    out = [
        f"""l AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS shown FROM documents)""",
        "g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM l GROUP BY source)",
        """p AS MATERIALIZED (SELECT l.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source)""",
        "s0 AS MATERIALIZED (SELECT tree, pos, leaf AS h, n FROM p)",
    ]
    tops = _levels(out, "s", "tree", source_levels)
    out.append(f"t0 AS MATERIALIZED (SELECT 0 AS whole, tree AS pos, h, (SELECT count(*) FROM g) AS n FROM {tops})")
    root = _levels(out, "t", "whole", top_levels)
    out.append("a0 AS (SELECT doc_id, leaf, tree, 0 AS whole, pos, tree AS top, n AS m, '' AS proof, shown AS folded FROM p)")
    inner = _paths(out, "a0", "s", "tree", "pos", source_levels, "b")
    out.append(f"c0 AS (SELECT * REPLACE ((SELECT count(*) FROM g) AS m) FROM {inner})")
    outer = _paths(out, "c0", "t", "whole", "top", top_levels, "e")
    ctes = ",\n".join(out)
    return f"""WITH {ctes}
SELECT doc_id, leaf, q.h AS subroot, (SELECT h FROM {root}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM {root}) AS verified
FROM {outer} f JOIN {tops} q ON q.tree = f.tree"""


def periodic() -> str:
    """Places a period apart that hold equal words, gathered into stretches; the smallest period of each stretch is its run."""
    return f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws, {_crc32('doc_id::VARCHAR')} AS h FROM documents),
m AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM t),
p AS MATERIALIZED (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM m),
w AS MATERIALIZED (SELECT doc_id, n, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM e) GROUP BY doc_id, q, stretch),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS q FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
f AS (SELECT doc_id, count(*) AS n_runs, first({{'s': start, 'l': length, 'q': q}} ORDER BY length / q DESC, start, q) AS best,
  string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.q AND w.i < r.start + r.length) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
 sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)"""
