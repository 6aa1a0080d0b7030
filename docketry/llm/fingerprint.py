"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the hash names a bin and a value, and a bin keeps its least value. Empty bins borrow from
bins that a fixed universal sequence names, tried in order until one is filled (optimal densification), so
the same bin borrows from the same place in every text. The low byte of each bin is stored, eight to a 64-bit word. The share of
equal bytes, corrected for bytes that agree by chance, estimates the share of common shingles.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import SPACE, columns, int_table, whole_text

SHINGLE = 5
BINS = 128
BITS = 8
TRIES = 8
#: Ranges of keys that are windowed one by one; a task takes several.
RANGES = 1024


def donors(bins: int = BINS) -> list[list[int]]:
    """For each bin the other bins in the order in which it borrows from them; fixed by rule."""
    out = []
    for b in range(bins):
        others = [x for x in range(bins) if x != b]
        random.Random(b).shuffle(others)
        out.append(others)
    return out


def densify(found: Column, bins: int = BINS) -> Column:
    """Array of ``bins`` values from one with nulls for empty bins; all zero if every bin is empty."""
    order = donors(bins)
    tried = [int_table([order[b][t] for b in range(bins)]) for t in range(TRIES)]
    rest = int_table([x for b in range(bins) for x in order[b][TRIES:]])
    width = bins - 1 - TRIES

    def fill(value: Column, b: Column) -> Column:
        further = F.transform(F.slice(rest, b * width + 1, F.lit(width)), lambda x: F.get(found, x.cast("int")))
        return F.coalesce(
            value, *[F.get(found, F.get(t, b).cast("int")) for t in tried],
            F.get(F.filter(further, lambda x: x.isNotNull()), F.lit(0)), F.lit(0).cast("bigint"),
        )

    return F.transform(found, fill)


def pack(values: Column, bins: int = BINS) -> Column:
    """Low bytes of the bins, eight to a word."""

    def word(w: Column) -> Column:
        parts = [
            F.shiftleft(F.get(values, w * 8 + i).bitwiseAND(F.lit(255).cast("bigint")), 8 * i) for i in range(8)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return F.transform(F.sequence(F.lit(0), F.lit(bins // 8 - 1)), word)


def hex_words(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated share of common shingles, 0 to 1, from two packed fingerprints."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for step in (4, 2, 1):  # any set bit of a byte reaches its lowest bit
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (1 - apart / bins - chance) / (1 - chance))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def packed_fingerprints(texts: DataFrame, keys: list[str], text: str = "text", bins: int = BINS, shingle: int = SHINGLE) -> DataFrame:
    """(keys, facts, words) of each row; ``keys`` must name a row, ``facts`` is an optional array of longs that travels along.

    If ``texts`` is already dealt out by some of ``keys``, no row moves: shingles are hashed, binned and reduced
    where the text is. A text of fewer words than a shingle is one shingle, a text without words has only
    zero bytes.
    """
    facts = F.col("facts") if "facts" in texts.columns else F.array().cast("array<bigint>")
    split = texts.select(*keys, facts.alias("facts"), words_of(F.col(text)).alias("_words"))
    # Places below 0 stand for facts, so that a row without words is not lost.
    spots = F.sequence(-F.greatest(F.size("facts"), F.lit(1)), F.size("_words") - F.least(F.size("_words"), F.lit(shingle)) + F.when(F.size("_words") > 0, 0).otherwise(-1))
    at = split.select(*keys, "facts", "_words", F.explode_outer(spots).alias("_i"))
    hashed = F.xxhash64(*[F.get(F.col("_words"), F.col("_i") + i) for i in range(shingle)])
    row = at.select(
        *keys, F.when(F.col("_i") < 0, F.col("_i")).otherwise(F.lit(0)).alias("_i"),
        F.when(F.col("_i") < 0, F.get("facts", -F.col("_i") - 1)).otherwise(hashed).alias("_h"),
    )
    binned = row.select(
        *keys, F.when(F.col("_i") < 0, F.col("_i")).otherwise(F.pmod(F.col("_h"), F.lit(bins)).cast("int")).alias("_bin"),
        F.when(F.col("_i") < 0, F.col("_h")).otherwise(F.shiftrightunsigned(F.col("_h"), 7)).alias("_value"),
    )
    least = binned.groupBy(*keys, "_bin").agg(F.min("_value").alias("_value"))
    entry = F.struct(F.col("_bin"), F.col("_value"))
    whole = least.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_bin") >= 0, entry))).alias("_bins"),
        F.sort_array(F.collect_list(F.when(F.col("_bin") < 0, F.struct(-F.col("_bin"), F.col("_value"))))).alias("_facts"),
    )
    found = whole.select(
        *keys, F.transform("_facts", lambda x: x["_value"]).alias("facts"),
        F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.element_at("_bins", b)).alias("_found"),
    )
    filled = found.select(*keys, "facts", densify(F.col("_found"), bins).alias("_filled"))
    return filled.select(*keys, "facts", pack(F.col("_filled"), bins).alias("words"))


def _sha_parts(sha: Column) -> list[Column]:
    return [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(4)]


def _ranges(own: DataFrame, ranges: int) -> tuple[Column, list]:
    """Range number of a key, counted down from the largest key, and the largest key of each range."""
    points = own.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100_000)).first()[0] or []
    bounds = int_table(sorted(set(points)))
    number = F.when(F.col("doc_id").isNull(), len(set(points)) + 1).otherwise(
        F.size(F.filter(bounds, lambda b: b > F.col("doc_id")))
    )
    heads = own.groupBy(number.alias("range")).agg(F.max("doc_id").alias("head")).orderBy("range").collect()
    return number, [(r["range"], r["head"]) for r in heads]


def compare_edited(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bins: int = BINS, shingle: int = SHINGLE, ranges: int = RANGES
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row.

    A text is compared with its edited form (the last third of its code points replaced by the first ones of the next
    document, by descending integer key) and with the next document; after the last comes the first. Rows that repeat a key
    follow each other by descending text; null keys come last. Null text is empty. A single document is its own next. Texts without
    words agree with each other only. An empty table gives an empty one.

    Keys are cut into ranges at quantiles and texts are shuffled once, by range. The first row of each range is copied to the
    end of the range before, so that every row finds its next within its own range. Only the ``ranges`` quantiles
    and largest keys reach the driver.
    """
    own = columns(docs, doc_id=key, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    number, heads = _ranges(own.select("doc_id"), ranges)
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    named = [h for h in before if h is not None]
    is_head = F.col("doc_id").isin(named) if named else F.lit(False)
    if None in before:
        is_head = F.coalesce(is_head, F.lit(True))
    is_head = F.coalesce(is_head, F.lit(False))
    # Ranges are numbered densely by their place among those that have rows.
    place = {r: i for i, (r, _) in enumerate(heads)}
    table = int_table([place.get(i, 0) for i in range(max(place, default=0) + 1)])
    count = max(len(heads), 1)
    located = own.select("doc_id", "text", F.get(table, number).cast("int").alias("at"))
    both = F.array(F.struct(F.col("at"), F.lit(False).alias("ghost")), F.struct(((F.col("at") + count - 1) % count).alias("at"), F.lit(True).alias("ghost")))
    single = F.array(F.struct(F.col("at"), F.lit(False).alias("ghost")))
    rows = located.select("doc_id", "text", F.explode(F.when(is_head, both).otherwise(single)).alias("spot")).select(
        F.col("spot.at").alias("range"), F.col("spot.ghost").alias("ghost"), "doc_id", "text"
    )
    order = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("text"))
    placed = rows.select(
        "range", "ghost", "doc_id", "text", F.row_number().over(order).alias("line"), F.lead("text").over(order).alias("next_text")
    )
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), third))
    texts = placed.select("range", "line", "ghost", "doc_id", "text", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    texts = texts.select("range", "line", "ghost", "doc_id", "text", "n_chars", "edited", F.sha2("edited", 256).alias("sha"))
    forms = F.array(
        F.struct(F.lit(0).alias("form"), F.col("text"), F.array("n_chars").alias("facts")),
        F.struct(F.lit(1).alias("form"), F.col("edited").alias("text"), F.array(*_sha_parts(F.col("sha"))).alias("facts")),
    )
    each = texts.select("range", "line", "ghost", "doc_id", F.explode(forms).alias("f")).select(
        "range", "line", "ghost", "doc_id", "f.form", "f.text", "f.facts"
    )
    prints = packed_fingerprints(each, ["range", "line", "ghost", "doc_id", "form"], "text", bins, shingle)
    first = F.struct("facts", "words")
    joined = prints.groupBy("range", "line", "ghost", "doc_id").agg(
        F.max(F.when(F.col("form") == 0, first)).alias("own"), F.max(F.when(F.col("form") == 1, first)).alias("changed")
    )
    by_line = Window.partitionBy("range").orderBy("line")
    beside = joined.select("*", F.lead("own.words").over(by_line).alias("next_words")).filter(~F.col("ghost"))
    return beside.select(
        "doc_id", F.get("own.facts", F.lit(0)).alias("n_chars"),
        F.array_join(F.transform("changed.facts", lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "").alias("edited_sha256"),
        hex_words(F.col("own.words")).alias("fingerprint"), hex_words(F.col("changed.words")).alias("edited_fingerprint"),
        likeness(F.col("own.words"), F.col("changed.words"), bins).alias("near_edited"),
        likeness(F.col("own.words"), F.coalesce("next_words", "own.words"), bins).alias("near_next"),
    )
