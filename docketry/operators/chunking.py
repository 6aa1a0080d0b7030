"""From source files to line-addressed spans, all inside the file's own row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docketry.functions import text
from docketry.functions.rows import posexplode_rows
from docketry.sources.corpus import artifact_type

# Chunk limits.
MAX_LINES = 80
MAX_CHARS = 4_000
MAX_BYTES = 1_800
OVERLAP = 10
LABEL_LENGTH = 72
ID_PREFIX = "CFS"
# Line patterns that open a section.
HEADING = r"(?U)^\s*(?:#{1,6}\s+|\\(?:page|section|subsection)\s+)(.+)$"
XML_NAMED = r"""(?U)^\s*<([A-Za-z_:][\w:.-]*)[^>]*(?:name|id)=['"]([^'"]+)['"]"""
C_SYMBOL = (
    r"(?U)^\s*(?:static\s+)?(?:inline\s+)?[A-Za-z_][\w\s*]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:\{|$)"
)
XML_SUFFIXES = (".xml", ".eds")
C_SUFFIXES = (".c", ".cc", ".cpp", ".h", ".hh", ".hpp")
DOCUMENT = "document"


def line_label(line: Column, suffix: Column) -> Column:
    """Label of the section a line opens, or null."""
    return (
        F.when(line.rlike(HEADING), text.strip(F.regexp_extract(line, HEADING, 1)))
        .when(
            suffix.isin(*XML_SUFFIXES) & line.rlike(XML_NAMED),
            F.concat(F.regexp_extract(line, XML_NAMED, 1), F.lit("-"), F.regexp_extract(line, XML_NAMED, 2)),
        )
        .when(suffix.isin(*C_SUFFIXES) & line.rlike(C_SYMBOL), F.regexp_extract(line, C_SYMBOL, 1))
    )


def anchors(lines: Column, suffix: Column) -> Column:
    """Array of (line, label) in line order, opened by (0, 'document')."""
    first = F.array(F.struct(F.lit(0).alias("line"), F.lit(DOCUMENT).alias("label")))
    found = F.transform(
        lines, lambda l, i: F.struct(i.cast("int").alias("line"), line_label(l, suffix).alias("label"))
    )
    return F.concat(first, F.filter(found, lambda a: a["label"].isNotNull() & (a["line"] > 0)))


def with_anchors(files: DataFrame) -> DataFrame:
    """Add ``lines`` and ``anchors`` to path, suffix, text rows."""
    lined = files.withColumn("lines", text.split_lines(F.col("text"))).drop("text")
    return lined.withColumn("anchors", anchors(F.col("lines"), F.col("suffix")))


def sections(anchored: DataFrame) -> DataFrame:
    """One row per non-blank section with its own lines: start, end (exclusive), label."""
    following = F.slice("anchors", 2, F.size("anchors"))
    bounds = F.zip_with(
        "anchors", following,
        lambda a, b: F.struct(
            a["line"].alias("start"), F.coalesce(b["line"], F.size("lines")).alias("end"),
            a["label"].alias("label"),
        ),
    )
    keep = [c for c in anchored.columns if c not in ("lines", "anchors")]
    exploded = posexplode_rows(anchored, bounds, "section", "s", *keep, "lines")
    cut = F.slice("lines", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return exploded.select(*keep, "section", "s.*", cut.alias("lines")).filter(
        F.exists("lines", lambda l: F.length(text.strip(l)) > 0)
    )


def window_bounds(chars: Column, octets: Column) -> Column:
    """Greedy windows over the lines of one section, as (start, stop) offsets.

    Where a window starts depends on where the previous one ended, so this is the one
    step written in Python; it sees line sizes only, never text.
    """

    @pandas_udf("array<struct<start:int,stop:int>>")
    def kernel(char_sizes: pd.Series, byte_sizes: pd.Series) -> pd.Series:
        return pd.Series([
            _windows(np.asarray(c, dtype=np.int64), np.asarray(b, dtype=np.int64))
            for c, b in zip(char_sizes, byte_sizes)
        ])

    return kernel(chars, octets)


def _windows(chars: np.ndarray, octets: np.ndarray) -> list[dict[str, int]]:
    n = len(chars)
    # Size of lines[a:b] joined by line feeds is total[b] - total[a] - 1.
    char_total = np.concatenate([[0], np.cumsum(chars + 1)])
    byte_total = np.concatenate([[0], np.cumsum(octets + 1)])
    out, at = [], 0
    while at < n:
        fits = min(
            np.searchsorted(char_total, char_total[at] + MAX_CHARS + 1, side="right") - 1,
            np.searchsorted(byte_total, byte_total[at] + MAX_BYTES + 1, side="right") - 1,
            at + MAX_LINES, n,
        )
        stop = int(max(fits, at + 1))
        out.append({"start": at, "stop": stop})
        if stop >= n:
            break
        at = max(stop - OVERLAP, at + 1)
    return out


def chunks(section_rows: DataFrame) -> DataFrame:
    """Windows of each section with absolute line numbers (1-based, inclusive).

    Line feeds at the ends of the content are dropped; the line numbers keep counting
    the dropped lines. Blank windows vanish but still use up their part number.
    """
    windows = window_bounds(
        F.transform("lines", F.length), F.transform("lines", F.octet_length)
    )
    keep = [c for c in section_rows.columns if c not in ("lines", "start", "end")]
    cut = F.slice("lines", F.col("w.start") + 1, F.col("w.stop") - F.col("w.start"))
    return (
        posexplode_rows(section_rows.withColumn("windows", windows), "windows", "pos", "w", *keep, "start", "lines")
        .select(
            *keep, (F.col("pos") + 1).alias("part"),
            (F.col("start") + F.col("w.start") + 1).alias("start_line"),
            (F.col("start") + F.col("w.stop")).alias("end_line"),
            F.btrim(F.array_join(cut, "\n"), F.lit("\n")).alias("content"),
        )
        .filter(F.length(text.strip(F.col("content"))) > 0)
    )


def safe_label(label: Column) -> Column:
    trimmed = F.btrim(F.regexp_replace(label, "[^A-Za-z0-9_.-]+", "-"), F.lit("-"))
    short = F.substring(trimmed, 1, LABEL_LENGTH)
    return F.when(F.length(short) > 0, short).otherwise(DOCUMENT)


def span_id(component: Column, path: Column, label: Column, part: Column,
            start_line: Column, end_line: Column) -> Column:
    part_suffix = F.when(part > 1, F.concat(F.lit("-p"), part.cast("string"))).otherwise("")
    lines = F.concat(F.lit("L"), start_line.cast("string"), F.lit("-L"), end_line.cast("string"))
    return F.concat_ws(
        "::", F.lit(ID_PREFIX), component, path, F.concat(safe_label(label), part_suffix), lines
    )


def spans(files: DataFrame) -> DataFrame:
    """Span table of text files (path, component, suffix, sha256, text): no shuffle."""
    rows = chunks(sections(with_anchors(files)))
    label = F.col("label")
    return rows.select(
        span_id(F.col("component"), F.col("path"), label, F.col("part"),
                F.col("start_line"), F.col("end_line")).alias("source_id"),
        artifact_type(F.col("path"), F.col("suffix")).alias("type"),
        F.concat_ws(": ", "component", label).alias("title"),
        "path", "start_line", "end_line", "content", "component",
        F.when(label != DOCUMENT, label).alias("symbol"),
        F.col("sha256").alias("source_file_sha256"),
        F.sha2("content", 256).alias("content_sha256"),
    )


def type_counts(span_rows: DataFrame) -> DataFrame:
    return span_rows.groupBy("type").agg(F.count(F.lit(1)).alias("spans"))


def duplicate_ids(span_rows: DataFrame) -> DataFrame:
    return span_rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
