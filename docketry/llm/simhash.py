"""SimHash near-dedup with pivot distance tables.

Each text gets a 64-bit fingerprint by majority over its shingle hashes. The Hamming distances of every distinct
fingerprint to a set of reference fingerprints (pivots) are computed once. By the triangle inequality two
fingerprints that differ in at most t bits have pivot distances that differ by at most t; and if the bits are cut into
t + 1 blocks, they agree on a whole block, so all their pivot distances within that block are equal. Equal
distances within a block are the join key, the maximum difference of the whole distances discards candidates, and
the survivors are verified by their Hamming distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import columns, whole_text
from docketry.session import materialise

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PIVOTS = 12
#: Fingerprints of a cell that are compared with each other; larger cells are linked over shared neighbours instead.
CELL = 32
#: Hashes whose bits are counted at a time.
SLICE = 1 << 16


def text_fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text as a signed 64-bit number; 0 if it has no word."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends]]
    width = min(shingle, n)
    total = n - width + 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, total, SLICE):
        stop = min(at + SLICE, total)
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[at:stop], ends[at + width - 1 :])], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null text is empty."""
    own = columns(docs, doc_id=key, text=text).select("doc_id", whole_text().alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = [text_fingerprint(t, shingle) for t in batch.pop("text")]
            yield batch.assign(fp=np.array(fps, dtype=np.int64))

    return own.mapInPandas(run, f"doc_id {dict(own.dtypes)['doc_id']}, fp bigint")


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints, by rule."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}", SEED)).view(np.int64)) for i in range(count)]


def block_masks(blocks: int) -> list[int]:
    """Masks that cut the 64 bits into runs of nearly equal length."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(fp: Column, other: int, mask: int = -1) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(other)).bitwiseAND(F.lit(mask)))


def _cells(nodes: DataFrame, refs: list[int], blocks: int) -> DataFrame:
    """(fp, cell): one cell per block, named by the block and the pivot distances within it."""
    names = []
    for b, mask in enumerate(block_masks(blocks)):
        parts = [F.lit(b).cast("tinyint"), *[_distance(F.col("fp"), p, mask).cast("tinyint") for p in refs]]
        names.append(F.struct(*[x.alias(f"d{i}") for i, x in enumerate(parts)]))
    return nodes.select("fp", F.explode(F.array(*names)).alias("cell"))


def _neighbours(fp: Column, radius: int) -> Column:
    """All fingerprints within ``radius`` bits."""
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(
        F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>"), lambda m: fp.bitwiseXOR(m)
    )


def links(nodes: DataFrame, max_bits: int = MAX_BITS, pivot_count: int = PIVOTS, cell: int = CELL) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints that differ in at most ``max_bits`` (even) bits.

    Cells of up to ``cell`` fingerprints give every linked pair. In a larger cell two fingerprints
    are linked if both lie within ``max_bits`` / 2 bits of a common one; each such common neighbour links
    the few around it to their least, which joins exactly what the pairs would join without making them.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    refs = pivots(pivot_count)
    cells = _cells(nodes, refs, max_bits + 1)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    table = [_distance(F.col("fp"), p).cast("tinyint").alias(f"p{i}") for i, p in enumerate(refs)]
    shared = materialise(cells.join(sizes, "cell").select("cell", "n", "fp", *table), "pivot-table")

    small = shared.filter(F.col("n") <= cell)
    left, right = small.alias("l"), small.alias("r")
    near = [F.abs(F.col(f"l.p{i}") - F.col(f"r.p{i}")) <= max_bits for i in range(pivot_count)]
    candidates = left.join(right, (F.col("l.cell") == F.col("r.cell")) & (F.col("l.fp") < F.col("r.fp")))
    for condition in near:
        candidates = candidates.filter(condition)
    verified = candidates.filter(F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= max_bits)
    pairs = verified.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))

    crowded = shared.filter(F.col("n") > cell).select("fp").distinct()
    around = crowded.select("fp", F.explode(_neighbours(F.col("fp"), max_bits // 2)).alias("common"))
    # At most as many fingerprints lie around a common neighbour as it has neighbours.
    stars = around.groupBy("common").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    spokes = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.union(spokes).distinct()



def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an edge reaches, by alternating large and small stars.

    Every round is a few joins on nodes, written to the shared folder; rounds grow with the
    logarithm of the longest path. Only one checksum per round reaches the driver.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    def seal(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    mark = seal(current)
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        small = large.join(least(large), "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        current = materialise(small.filter("u > v").distinct(), "small-star")
        last, mark = mark, seal(current)
        if mark == last:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Fingerprints that differ in at most ``max_bits`` bits are linked, equal ones belong together;
    ``component_id`` is the least key reachable over links. Null text is empty; texts without a word have
    fingerprint 0 and are linked like others. Repeated rows get equal rows. A null key is kept and never a
    component's name unless the component has no other. An empty table gives an empty one. Copies are joined by their
    fingerprint before any pairing, so a large group of copies is one fingerprint. Shuffled are keys and fingerprints only.
    """
    stored = materialise(fingerprints(docs, shingle, key, text), "fingerprints")
    nodes = materialise(stored.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    member = components(links(nodes.select("fp"), max_bits))
    linked = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    linked = materialise(linked, "linked")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = linked.select("fp", "root").join(names, "root").select("fp", "component_id")
    return stored.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that a smaller key of their near-duplicate group stands for."""
    return keep_least(docs, lambda rows: near_duplicates(rows, key="_row", text=text), key, text)


def keep_least(
    docs: DataFrame, grouped: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of ``docs`` per group, the one with the least key; ``grouped`` gives (doc_id, component_id) of rows by their ``_row``.

    A row is its key and the hash of its text, so texts that share a key are grouped and kept each on its own; a key does not stand for texts
    of other groups. Rows equal in both are one. A key does not stand for rows without one either, but of those a group keeps only one as well.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_row", F.struct(docs[key].isNull().alias("missing"), docs[key].alias("key"), F.xxhash64(held).alias("hash")))
    counted = materialise(grouped(rows), "groups").groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("_rows"))
    keyed = counted.filter(~F.col("doc_id.missing") & (F.col("doc_id") == F.col("component_id")))
    nameless = counted.filter("doc_id.missing").groupBy("component_id").agg(F.min(F.struct("doc_id", "_rows")).alias("least"))
    by_row = keyed.select("doc_id", "_rows").unionByName(nameless.select("least.*")).toDF("_stands", "_rows")
    named = rows.join(by_row, F.col("_row").eqNullSafe(F.col("_stands")))
    once = named.filter(F.col("_rows") == 1).select(*docs.columns)
    order = Window.partitionBy("_row").orderBy(F.col(text).asc_nulls_first())
    again = named.filter(F.col("_rows") > 1).withColumn("_at", F.row_number().over(order)).filter("_at = 1")
    return once.unionByName(again.select(*docs.columns))
