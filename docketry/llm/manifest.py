"""Merkle manifest of a dataset, its trees kept in van Emde Boas order.

Each row is a leaf, each source a ternary hash tree over its leaves in the order of their ids, and the roots of
the sources are the leaves of one more such tree. A tree is cut into aligned subtrees (blocks) of ``HEIGHT`` levels; a block's nodes lie
in one byte string, recursively split at half height: first the upper half as a block of its own, then the lower
halves one after another. Where a node lies follows from its level and place alone, both when a block is built and when siblings
are read. The roots of the blocks are the leaves of the next tree up, until one block is left, so no task
ever holds more than one block, however many rows a source has.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import columns, ordered
from docketry.session import materialise

FAN = 3
#: Levels of hashing within a block, which has FAN ** HEIGHT leaves at most.
HEIGHT = 7
_PATH = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def cells(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, place: np.ndarray) -> np.ndarray:
    """Where the nodes at ``place`` of ``depth`` (0 is the root) lie in a tree of ``levels`` levels."""
    at = np.zeros_like(place)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = FAN ** (depth - upper)
        at = at + cells(upper) + (place // below) * cells(levels - upper)
        place, depth, levels = place % below, depth - upper, levels - upper
    return at


def rises(count: int) -> int:
    """Levels of hashing over ``count`` nodes until one is left."""
    steps = 0
    while count > 1:
        count, steps = -(-count // FAN), steps + 1
    return steps


def build_block(leaves: list[str], steps: int) -> bytes:
    """The digests of a block over ``leaves`` after ``steps`` levels of hashing, in van Emde Boas order."""
    store = bytearray(32 * cells(steps + 1))
    nodes = leaves
    for depth in range(steps, -1, -1):
        where = address(steps + 1, depth, np.arange(len(nodes))).tolist()
        for at, node in zip(where, nodes):
            store[32 * at : 32 * at + 32] = bytes.fromhex(node)
        nodes = [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
    return bytes(store)


def sibling_paths(store: bytes, count: int, steps: int, places: np.ndarray) -> list[list[tuple[str, str]]]:
    """For the leaf at each of ``places``, what stands before and after it and its ancestors in their runs."""
    paths: list[list[tuple[str, str]]] = [[] for _ in places]
    for depth in range(steps, 0, -1):
        where = address(steps + 1, depth, np.arange(count)).tolist()
        nodes = [store[32 * at : 32 * at + 32].hex() for at in where]
        for path, place in zip(paths, places.tolist()):
            first = place - place % FAN
            path.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + FAN])))
        places, count = places // FAN, -(-count // FAN)
    return paths


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN**height}"))


def _build(nodes: DataFrame, height: int, label: str) -> DataFrame:
    """(tree, n, block, count, steps, store, root) of ``nodes`` (tree, n, pos, node); n is the number of a tree's nodes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        tree, n, block = (int(group[c].iloc[0]) for c in ("tree", "n", "block"))
        # A tree of one block ends at its own root, other blocks all rise by the same number of levels.
        steps = rises(n) if n <= FAN**height else height
        store = build_block(group["node"].tolist(), steps)
        return pd.DataFrame([(tree, n, block, len(group), steps, store, store[:32].hex())], columns=fields)

    fields = ["tree", "n", "block", "count", "steps", "store", "root"]
    schema = "tree bigint, n bigint, block bigint, count int, steps int, store binary, root string"
    return materialise(_blocked(nodes, height).groupBy("tree", "block").applyInPandas(run, schema), label)


def _above(blocks: DataFrame, height: int, label: str) -> DataFrame:
    """(tree, block, above, top): what stands beside each block's root and its ancestors, and the tree's root.

    The roots of the blocks of a large tree are the nodes of the next tree up.
    """
    width = FAN**height
    small = blocks.filter(F.col("n") <= width).select(
        "tree", "block", F.array().cast(_PATH).alias("above"), F.col("root").alias("top")
    )
    large = blocks.filter(F.col("n") > width)
    if large.isEmpty():
        return small
    nodes = large.select("tree", F.ceil(F.col("n") / width).alias("n"), F.col("block").alias("pos"), F.col("root").alias("node"))
    climbed = climb(nodes, height, f"{label}-up")
    return small.unionByName(climbed.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "top"))


def climb(nodes: DataFrame, height: int = HEIGHT, label: str = "manifest") -> DataFrame:
    """(tree, pos, path, top) of ``nodes`` (tree, n, pos, node): the siblings up to each tree's root, and that root."""
    nodes = materialise(nodes, f"{label}-nodes")
    blocks = _build(nodes, height, f"{label}-blocks")
    held = blocks.join(_above(blocks, height, label), ["tree", "block"])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = right.iloc[0]
        places = left["pos"].to_numpy() - int(own["block"]) * FAN**height
        above = [(s["before"], s["after"]) for s in own["above"]]
        paths = sibling_paths(own["store"], int(own["count"]), int(own["steps"]), places)
        named = [[{"before": b, "after": a} for b, a in path + above] for path in paths]
        return pd.DataFrame({"tree": left["tree"], "pos": left["pos"], "path": named, "top": own["top"]})

    grouped = _blocked(nodes, height).groupBy("tree", "block").cogroup(held.groupBy("tree", "block"))
    return materialise(grouped.applyInPandas(run, f"tree bigint, pos bigint, path {_PATH}, top string"), f"{label}-paths")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row: its values one after another, each with its length, so that no two rows read alike."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs``.

    Rows with an even crc32 of their id are proved with the line feeds taken out of their text, so their proof fails if it had any;
    rows without an id are proved as they are. Null and empty values give different leaves. Null sources form one
    tree, null ids come first in it, rows that repeat an id are ordered by their leaf, equal rows have equal leaves in either order.
    An empty table gives an empty one. Texts of any length are hashed where they are read and never travel. A source
    with many rows is dealt out by range and block, so no task holds more than a block of it.
    """
    own = columns(docs, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = own.select("doc_id", "source", leaf(*values, F.col("text")).alias("leaf"), leaf(*values, shown).alias("shown"))
    placed = ordered(materialise(leaves, "manifest-leaves"), "manifest-order", "source", "doc_id", "leaf")
    placed = placed.select("doc_id", "source", "leaf", "shown", "rank")
    # A tree is named by the rank of its first leaf, which also orders the trees as their sources.
    sources = materialise(
        placed.groupBy("source").agg(F.min("rank").alias("tree"), F.count(F.lit(1)).alias("n")), "manifest-sources"
    )
    known = sources.withColumnRenamed("source", "_source")
    rows = placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        "tree", "n", (F.col("rank") - F.col("tree")).alias("pos"), F.col("leaf").alias("node"), "shown",
        F.col("doc_id").cast("string"),  # pandas would make whole numbers with nulls into fractions
    )
    rows = materialise(rows, "manifest-rows")
    blocks = _build(rows.select("tree", "n", "pos", "node"), height, "manifest-blocks")
    above = materialise(_above(blocks, height, "manifest"), "manifest-above")

    subroots = above.filter("block = 0").select(F.col("tree").alias("source_tree"), F.col("top").alias("node"))
    lined = ordered(materialise(subroots, "manifest-subroots"), "manifest-tops", "source_tree")
    one = F.lit(0).cast("long").alias("tree")
    lined = lined.select(one, F.lit(lined.count()).cast("long").alias("n"), F.col("rank").alias("pos"), "node", "source_tree")
    tops = climb(lined.drop("source_tree"), height, "manifest-top")
    ends = lined.select("pos", "source_tree").join(tops.drop("tree"), "pos").select(
        F.col("source_tree").alias("tree"), F.col("path").alias("beyond"), F.col("top").alias("root")
    )
    held = blocks.drop("root", "n").join(above.withColumnRenamed("top", "subroot"), ["tree", "block"]).join(ends, "tree")
    held = held.select("tree", "block", "count", "steps", "store", "subroot", "root", F.concat("above", "beyond").alias("above"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = right.iloc[0]
        places = left["pos"].to_numpy() - int(block["block"]) * FAN**height
        above = [(s["before"], s["after"]) for s in block["above"]]
        paths = sibling_paths(block["store"], int(block["count"]), int(block["steps"]), places)
        rest = "".join(b + a for b, a in above)
        folded = [fold(node, path + above) for node, path in zip(left["shown"], paths)]
        return pd.DataFrame({
            "doc_id": left["doc_id"], "leaf": left["node"], "subroot": block["subroot"], "root": block["root"],
            "proof_sha256": [digest("".join(b + a for b, a in path) + rest) for path in paths],
            "folded_root": folded, "verified": [f == block["root"] for f in folded],
        })

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    left = _blocked(rows, height).drop("n").groupBy("tree", "block")
    proved = left.cogroup(held.groupBy("tree", "block")).applyInPandas(run, schema)
    return proved.withColumn("doc_id", F.col("doc_id").cast(dict(own.dtypes)["doc_id"]))
