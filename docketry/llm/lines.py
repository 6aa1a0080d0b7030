"""Line dedup by site-relative frequency.

Pages are grouped by host; a line is boilerplate on a host if more than ``max_ratio`` of the host's pages
contain it. A line's frequency elsewhere does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import columns
from docketry.session import materialise

MAX_RATIO = 0.1
#: A line needs this many pages of a host; on a host of a few pages every line would be frequent.
MIN_PAGES = 5


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n")


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, bad): keys of the lines to drop on each host.

    Counts are summed before the shuffle, and keys rather than lines travel. A host's set holds at most
    (mean lines per page) / ``max_ratio`` keys, since each takes that share of the host's pages.
    """
    own = columns(pages, host=host, text=text)
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    line = own.select("host", F.explode_outer(F.array_distinct(_lines())).alias("line")).filter(F.trim("line") != "")
    counts = line.groupBy("host", _key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.filter(F.col("n") >= min_pages)
    bad = (
        frequent.join(totals.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
        .filter(F.col("n") / F.col("pages") > max_ratio)
        .groupBy("host").agg(F.collect_list("key").alias("bad"))
    )
    return materialise(bad, "boilerplate")


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Every row stays, in place of its old text it has the lines that are left, in order. Blank lines are
    never counted nor dropped; a line repeated within a page counts once for it. Null text stays null with
    0 lines; empty text is one blank line. Null hosts form one host. Repeated rows count as pages of
    their own. If all lines go, the text is empty. An empty table gives an empty one. Other columns are kept as they are.
    """
    bad = boilerplate(docs, host, text, max_ratio, min_pages)
    sites = bad.select(F.col("host").alias("_site"), F.col("bad").alias("_bad"))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    joined = held.join(sites, F.col(f"_row.`{host}`").eqNullSafe(F.col("_site")), "left")
    lines = F.split(F.col(f"_row.`{text}`"), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_bad"), _key(x)))
    joined = joined.select("_row", F.when(F.col("_bad").isNull(), lines).otherwise(kept).alias("_kept"))
    n_lines = F.when(F.col(f"_row.`{text}`").isNull(), 0).otherwise(F.size(lines))
    return joined.select(
        *[
            (F.array_join("_kept", "\n") if c == text else F.col(f"_row.`{c}`")).alias(c)
            for c in docs.columns if c not in ("n_lines", "n_dropped")
        ],
        n_lines.cast("long").alias("n_lines"),
        (n_lines - F.when(F.col("_kept").isNull(), 0).otherwise(F.size("_kept"))).cast("long").alias("n_dropped"),
    )
