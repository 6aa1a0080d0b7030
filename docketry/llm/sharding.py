"""Shards along a Hilbert curve through quantised metadata.

Several metadata columns are quantised to ``bits`` bits each; rows are sorted by the index of their cell
on the Hilbert curve and the sequence is cut into runs of equal row counts. Neighbours on the curve are
neighbours in every dimension, so each shard covers a compact box and minimum and maximum of each
column prune files.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import columns, int_table, ordered, whole_text
from docketry.session import materialise

SHARDS = 40
BITS = 4


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Index of a cell on the curve (Skilling's transform: undo rotations, Gray code, interleave)."""
    x, n = list(point), len(point)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            if x[i] >> level & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            flip ^= (1 << level) - 1
    x = [v ^ flip for v in x]
    index = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | v >> level & 1
    return index


def curve(dims: int, bits: int) -> list[int]:
    """Hilbert index of every cell, cells counted row by row; 2 ** (dims * bits) entries whatever the data."""
    side = 1 << bits
    return [
        hilbert_index(tuple(cell // side ** (dims - 1 - i) % side for i in range(dims)), bits)
        for cell in range(side**dims)
    ]


def _splits(df: DataFrame, name: str, kind: str, bits: int) -> list:
    """At most 2 ** bits - 1 ascending split points of a column, from all its rows.

    Those of a text column cut its distinct values, ordered by bytes, into runs of equal length; only the split points reach the driver.
    """
    side = 1 << bits
    if kind == "string":
        values = materialise(df.select(name).where(F.col(name).isNotNull()).distinct(), "split-values")
        total = values.count()
        if not total:
            return []
        places = [total * i // side for i in range(1, side)]
        found = ordered(values, "split-order", name).filter(F.col("rank").isin(places)).collect()
        at = {r["rank"]: r[name] for r in found}
        return [at[p] for p in places]
    points = df.agg(F.percentile_approx(name, [i / side for i in range(1, side)], 10000)).first()[0]
    return points or []


def _code(name: str, splits: list) -> Column:
    """Number of split points at or below the value; null is 0, like the lowest values."""
    steps = [(F.col(name) >= F.lit(s)).cast("int") for s in dict.fromkeys(splits)]
    return F.coalesce(reduce(add, steps) if steps else F.lit(0), F.lit(0))


def shard_by_rows(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text",
    dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = BITS,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index, text_group), one row per row of ``docs``.

    Law ``rows``: shard row counts differ by one at most, in curve order; fewer rows than shards leave the
    last shards empty. Equal texts form a group that takes the least metadata of its members, so they lie
    next to each other and a group is divided only where a run must end. Null text: size 16, CRC of no
    bytes, all null texts one group apart from the empty text. Null metadata counts as lowest. Order within a cell is text group, then
    key, so repeated rows are interchangeable. Text metadata is compared by bytes. Only sizes, hashes and metadata are shuffled.
    """
    kinds = {d: "string" if dict(docs.dtypes)[d] == "string" else "number" for d in dims}
    own = columns(docs, doc_id=key, text=text, **{f"d{i}": d for i, d in enumerate(dims)})
    names = [f"d{i}" for i in range(len(dims))]
    base = materialise(
        own.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(whole_text().cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_group"), *names,
        ),
        "shard-base",
    )
    meta = F.struct(*names)
    groups = (
        base.groupBy("text_group").agg(F.min(meta).alias("least"), F.max(meta).alias("most"))
        .filter(~F.col("least").eqNullSafe(F.col("most"))).select("text_group", "least")
    )
    joined = base.join(groups, "text_group", "left")
    own_meta = [
        F.when(F.col("least").isNull(), F.col(n)).otherwise(F.col(f"least.{n}")).alias(n) for n in names
    ]
    cell = F.lit(0)
    for name, dim in zip(names, dims):
        cell = cell * (1 << bits) + _code(name, _splits(base, name, kinds[dim], bits))
    index = F.get(int_table(curve(len(dims), bits)), F.col("cell"))
    placed = materialise(
        joined.select("doc_id", "size", "text_crc32", "text_group", *own_meta)
        .select("doc_id", "size", "text_crc32", "text_group", cell.cast("int").alias("cell"))
        .select("doc_id", "size", "text_crc32", "text_group", index.alias("curve_index")),
        "shard-cells",
    )
    total = placed.count()
    ranked = ordered(placed, "shard-order", "curve_index", "text_group", "doc_id", "size")
    short, longer = total // shards, total % shards
    cut = longer * (short + 1)
    shard = F.expr(f"if(rank < {cut}, rank div {short + 1}, {longer} + (rank - {cut}) div {max(short, 1)})")
    slot = F.expr(f"if(rank < {cut}, rank % {short + 1}, (rank - {cut}) % {max(short, 1)})")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index", "text_group",
    )
