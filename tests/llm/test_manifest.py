"""The Merkle manifest against a plain tree, and its block layout."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from docketry.llm import manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(parts))


def climb(nodes, at):
    """Siblings of node ``at`` level by level, and the root."""
    path = []
    while len(nodes) > 1:
        first = at - at % 3
        path.append((nodes[first:at], nodes[at + 1 : first + 3]))
        nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], at // 3
    return path, nodes[0]


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    lists = {}
    for source, own in by_source.items():
        lists[source] = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    order = sorted(lists, key=lambda s: (s is not None, (s or "").encode()))
    subroots = [climb([leaf_of(r) for r in lists[s]], 0)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        leaves = [leaf_of(r) for r in lists[s]]
        beyond, root = climb(subroots, k)
        for i, row in enumerate(lists[s]):
            path, subroot = climb(leaves, i)
            node = leaves[i]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                node = leaf_of((*row[:4], row[4].replace("\n", "")))
            for before, after in path + beyond:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join("".join(b + a) for b, a in path + beyond))
            out.append((row[0], leaves[i], subroot, root, proof, node, node == root))
    return out


def rows_of(sizes, seed=3):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for i in range(n):
            text = rng.choice([None, "", "a\nb", "ü€ line", "x" * rng.randint(0, 50) + "\n"])
            rows.append((rng.randint(0, 10**18), source, rng.choice([None, "en", ""]), rng.choice([None, 0, 7]), text))
    rng.shuffle(rows)
    return rows


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_proofs_equal_a_plain_tree(spark, height):
    rows = rows_of({None: 4, "": 1, "a": 100, "b": 27, "ab": 28, "é": 3, "zz": 2, "c": 9, "d": 10, "e": 1, "f": 81})
    rows += [(5, "a", "en", 1, "again\n"), (5, "a", "en", 1, "again\n"), (5, "a", "en", 1, "other"), (None, "a", None, None, None),
             (None, "a", None, None, "no id\n"), (2**62 + 1, "a", "en", 3, "very long\n" * 200_000)]
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS tree", "2 AS leaf", "3 AS rank")
    got = [tuple(r) for r in manifest.manifest(docs, height).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    verified = {r[6] for r in got}
    assert verified == {True, False}


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], COLUMNS)
    (row,) = manifest.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf_of((1, None, None, None, None))
    assert row.verified and row.proof_sha256 == sha("")
    empty = manifest.manifest(docs.limit(0))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0


@pytest.mark.parametrize("levels", range(1, 9))
def test_layout_fills_every_cell_and_keeps_subtrees_together(levels):
    seen = np.concatenate([manifest.address(levels, d, np.arange(3**d)) for d in range(levels)])
    assert sorted(seen.tolist()) == list(range(manifest.cells(levels)))
    upper = levels // 2
    if levels > 1:
        for k in range(3**upper):
            below = [manifest.address(levels, upper + d, np.arange(k * 3**d, (k + 1) * 3**d)) for d in range(levels - upper)]
            flat = np.concatenate(below)
            assert flat.max() - flat.min() + 1 == len(flat) == manifest.cells(levels - upper)
