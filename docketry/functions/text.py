"""Text expressions: lines, tokens, code-like identifiers, canonical hashes.

Everything here is a built-in Column expression and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line terminators Python recognises when splitting lines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Identifier shape shared by queries and spans (3..120 characters).
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,119}"
WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
WORD_AFTER = r"(?![\p{L}\p{N}_])"

def empty_strings() -> Column:
    return F.array().cast("array<string>")


def lit_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def canonical_sha(**fields: Column) -> Column:
    """sha256 of compact JSON with keys in alphabetical order.

    Null fields must be coalesced by the caller; JSON output drops them.
    """
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return sha256(F.to_json(F.struct(*ordered)))


def split_lines(col: Column) -> Column:
    """Lines without terminators; a final terminator opens no extra line."""
    trimmed = F.regexp_replace(col, f"(?:{LINE_BREAK})\\z", "")
    return F.when(F.length(col) == 0, empty_strings()).otherwise(F.split(trimmed, LINE_BREAK, -1))


def normalise_newlines(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def _camel_pieces(word: Column) -> Column:
    pieces = F.split(word, r"(?<=[a-z0-9])(?=[A-Z])", -1)
    return F.when(
        word.rlike(r"[a-z0-9][A-Z]"),
        F.transform(F.array_append(pieces, word), F.lower),
    ).otherwise(F.array(F.lower(word)))


def tokenize(col: Column) -> Column:
    """Lower-cased letter and digit runs, camel-split, joined form appended.

    Separators never occur inside a run, so they need no replacement; texts with no
    camel boundary take the cheap branch.
    """
    runs = F.regexp_extract_all(col, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
    return F.when(
        col.rlike("[a-z][A-Z]"), F.flatten(F.transform(runs, _camel_pieces))
    ).otherwise(F.transform(runs, F.lower))


def identifier_tokens(col: Column) -> Column:
    """All identifier-shaped words, in order, with Unicode-aware word edges."""
    pattern = WORD_BEFORE + IDENTIFIER + WORD_AFTER
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def is_code_like(token: Column) -> Column:
    return (
        token.contains("_")
        | token.rlike("[a-z0-9][A-Z]")
        | (token.rlike("[0-9]") & token.rlike("[A-Za-z]"))
    )


def query_identifiers(user_ids: Column, title: Column, subsystem: Column, text: Column) -> Column:
    """User identifiers first, then code-like words of the free text, no repeats."""
    raw = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(subsystem, F.lit("")), text)
    found = F.filter(identifier_tokens(raw), is_code_like)
    return F.array_distinct(F.concat(F.coalesce(user_ids, empty_strings()), found))


def count_newlines(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))
