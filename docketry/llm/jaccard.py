"""Similar documents by the Jaccard similarity of their n-gram sets, joined over vertical fragments.

The n-grams of all texts stand in one global order, that of their hashes, which is cut into ``FRAGMENTS`` ranges; a set is cut
likewise. Overlaps are counted fragment by fragment and summed per pair. The first fragment decides for most sets: a
set that has a partner misses at most a certain number of its n-grams, so a set with more n-grams there that no other
set holds is out, by the count of its first fragment alone. What is left is ordered by frequency, rarest first; two similar
sets share one of their first n-grams, and those that share one, whose sizes, places and bit parities allow the similarity, have
their partial overlaps counted. Sets of one n-gram are first compared with one of them, then only those that
are not joined yet with each other, so a large group of near copies is not multiplied by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import columns, forget, passing, whole_text
from docketry.llm.simhash import SEED, components
from docketry.session import discard, mark, materialise, written

SHINGLE = 3
#: Least similarity as a fraction of whole numbers, so that comparisons are exact.
LEAST = (9, 10)
FRAGMENTS = 4
#: 64-bit words of a set's bit parities; equal n-grams cancel out, so parities differ in no more bits than sets in n-grams.
PARITY = 8
#: Words whose hashes a task remembers at most.
KNOWN = 100_000
#: Rounds in which the sets of an n-gram are compared with one of them only.
ROUNDS = 2

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_set(text: str, shingle: int, known: dict[bytes, int]) -> np.ndarray:
    """Hashes of the distinct n-grams of the lower-cased words, ascending; fewer words are one n-gram."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(words))
    total = len(words) - width + 1
    mixed = np.full(total, width, dtype=np.uint64)
    for i in range(width):
        mixed = _mixed(mixed * _STEP + h[i : i + total])
    return np.unique(mixed)


def edges_of(least: tuple[int, int]) -> list[int]:
    """Least hash of each fragment, and the end of the last.

    The first fragment is wide enough that most sets without a partner miss more of their n-grams there than they may miss in all.
    """
    p, q = least
    first = min(0.5, 1.5 * (q - p) / q + 0.05)
    rest = [first + (1 - first) * k / (FRAGMENTS - 1) for k in range(FRAGMENTS - 1)]
    return [0, *[int(x * 2**53) << 11 for x in rest], 1 << 64]


def parity(grams: np.ndarray) -> np.ndarray:
    bits = np.bincount((grams & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _slices(batch: pa.RecordBatch, rows: int = 250) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _signed(docs: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(doc_id, digest, tag, n, first): 128 bits that stand for the set, 64 of them, its size, its n-grams of the first fragment."""
    bound = np.uint64(edges_of(least)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in _slices(batch):
                if len(known) > KNOWN:
                    known.clear()
                sets = [gram_set(t, shingle, known) for t in part.column(1).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(digests, pa.binary()), pa.array(np.frombuffer(b"".join(digests), "<i8")[::2]),
                        pa.array([len(s) for s in sets], pa.int32()), _lists([s[: np.searchsorted(s, bound)] for s in sets]),
                    ],
                    ["doc_id", "digest", "tag", "n", "first"],
                )

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, digest binary, tag bigint, n int, first array<bigint>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(digest, n, parity, grams) of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known: dict[bytes, int] = {}
        for batch in batches:
            for part in _slices(batch):
                if len(known) > KNOWN:
                    known.clear()
                sets = [gram_set(t, shingle, known) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()), _lists([parity(s) for s in sets]), _lists(sets),
                    ],
                    ["digest", "n", "parity", "grams"],
                )

    return texts.mapInArrow(run, "digest binary, n int, parity array<bigint>, grams array<bigint>")


def _alone(stored: DataFrame) -> DataFrame:
    """(tag, alone): how many n-grams of the first fragment no other set holds. The least and greatest tag tell whether an n-gram has one set."""
    grams = stored.select("tag", F.explode("first").alias("gram"))
    held = grams.groupBy("gram").agg(F.min("tag").alias("tag"), F.max("tag").alias("other"))
    return held.filter("tag = other").groupBy("tag").agg(F.count(F.lit(1)).alias("alone"))


def _partners_possible(n: Column | str, alone: Column, least: tuple[int, int]) -> Column:
    p, q = least
    n = F.col(n) if isinstance(n, str) else n
    return q * (n - alone) >= p * n


def fits(least: tuple[int, int]) -> Column:
    """Whether sizes, places of the common n-gram and parities of ``l`` and ``r`` allow the similarity."""
    p, q = least
    nl, nr = F.col("l.n").cast("long"), F.col("r.n").cast("long")
    differ = reduce(add, [F.bit_count(F.col("l.parity")[i].bitwiseXOR(F.col("r.parity")[i])) for i in range(PARITY)])
    return (
        (q * F.least(nl, nr) >= p * F.greatest(nl, nr))
        & ((p + q) * F.least(nl - F.col("l.pos"), nr - F.col("r.pos")) >= p * (nl + nr))
        & ((q + p) * differ <= (q - p) * (nl + nr))
    )


def rare_first(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(gram, node, n, alone, pos, parity): the first n-grams of each set, rarest first, that two sets have among their first."""
    p, q = least
    grams = sets.select("node", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = grams.join(often, "gram").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("shared"))
    # n-grams of one set come first in the order; of n, the first n - ceil(n p / q) + 1 meet every partner.
    alone = F.col("n") - F.size("shared")
    own = sets.select("node", "n", "parity").join(shared, "node").filter(_partners_possible("n", alone, least))
    prefix = F.col("n") - F.ceil(F.col("n") * p / F.lit(q)).cast("int") + 1 - alone
    placed = own.select("node", "n", "parity", alone.alias("alone"), F.posexplode(F.slice("shared", 1, prefix)).alias("at", "entry"))
    rows = materialise(
        placed.select(F.col("entry.gram").alias("gram"), "node", "n", "alone", (F.col("alone") + F.col("at")).alias("pos"), "parity"),
        "jaccard-prefix",
    )
    common = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("gram")
    return materialise(rows.join(common, "gram"), "jaccard-cells")


def overlapping(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) that are similar: overlaps counted per fragment, summed per pair."""
    # Hashes are unsigned; as signed numbers the upper half comes first.
    edges = [e - (1 << 64) if e >> 63 else e for e in edges_of(least)]

    def part(lo: int, hi: int) -> Column:
        return F.filter("grams", lambda x: (x >= lo) & (x < hi) if lo < hi else (x >= lo) | (x < hi))

    parts = F.array(*[part(lo, hi) for lo, hi in zip(edges, edges[1:])])
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    cut = sets.join(wanted, "node", "left_semi").select("node", "n", F.posexplode(parts).alias("fragment", "part")).filter(F.size("part") > 0)
    cut = materialise(cut, "jaccard-fragments")
    left = pairs.join(cut.select(F.col("node").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("pa")), "a")
    right = cut.select(F.col("node").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("pb"))
    counted = left.join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("c"))
    total = counted.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
    p, q = least
    return total.filter(q * F.col("c") >= p * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def links(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(node, root) of the sets that are linked to others.

    In each round the sets of an n-gram that are not joined with one of them yet are compared with it; at last, all
    pairs of an n-gram that are not joined and may be similar.
    """
    cells = rare_first(sets, least)
    found: DataFrame | None = None
    member: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        if member is None:
            rooted = cells.withColumn("root", F.col("node"))
        else:
            rooted = cells.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = rooted.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
            rooted = materialise(rooted.join(apart.select("gram"), "gram"), "jaccard-apart")
        if turn < ROUNDS:
            # The set with the fewest n-grams of its own is most likely what the others are copies of.
            central = F.min(F.struct("alone", "root", "node", "n", "pos", "parity"))
            other = F.max(F.struct("root", (-F.col("alone")).alias("alone"), "node", "n", "pos", "parity"))
            pick = central if turn % 2 == 0 else other
            one = rooted.groupBy("gram").agg(pick.alias("one")).select("gram", "one.*")
            pairs = rooted.alias("l").join(
                one.alias("r"), (F.col("l.gram") == F.col("r.gram")) & (F.col("l.root") != F.col("r.root")) & fits(least)
            )
        else:
            pairs = rooted.alias("l").join(
                rooted.alias("r"), (F.col("l.gram") == F.col("r.gram")) & (F.col("l.root") < F.col("r.root")) & fits(least)
            )
        a, b = F.col("l.node"), F.col("r.node")
        pairs = materialise(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "jaccard-pairs")
        if pairs.isEmpty():
            if turn == ROUNDS and member is not None:
                return member
            continue
        more = materialise(overlapping(pairs, sets, least), "jaccard-links")
        found = more if found is None else found.union(more)
        member = materialise(components(found), "jaccard-members")
    return member if member is not None else sets.select("node", F.col("node").alias("root")).limit(0)


def similar(
    docs: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST, key: str = "doc_id", text: str = "text",
    blank_alone: bool = True,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Two rows are linked if the intersection of their sets of n-grams is at least ``least`` of the union; ``component_id`` is
    the least key reachable over links, the row's own included. Null text is empty; texts without a word have an empty set and, with ``blank_alone``, no
    link, else they belong together. Texts of fewer words than ``shingle`` are one n-gram. Equal sets are one set from the first
    grouping on, so repeated rows and large groups of copies are not paired. Rows of a null key take
    part; a null never names a component unless it has no other key. Texts of any length are taken whole. An empty table gives an empty one.
    """
    own = columns(docs, doc_id=key, text=text).select("doc_id", whole_text().alias("text"))
    start = mark()
    with passing(_signed(own, shingle, least), "jaccard-first") as stored:
        rows = materialise(stored.select("doc_id", "digest", "tag", "n"), "jaccard-rows")
        classes = rows.groupBy("digest").agg(*[F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("tag").alias("tag")])
        counted = classes.filter("n > 0").join(_alone(stored), "tag", "left")
        left = counted.filter(_partners_possible("n", F.coalesce("alone", F.lit(0)), least))
        left = materialise(left.select("digest", "least"), "jaccard-left")
    texts = own.join(left.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least"))).select("text")
    sets = _sets(texts, shingle).join(left.select("digest"), "digest", "left_semi")
    sets = sets.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n", "parity", "grams")])
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "jaccard-sets")
    member = links(sets, least)
    joined = sets.select("digest", "node").join(member, "node").select("digest", "root")
    named = materialise(joined.join(left, "digest"), "jaccard-named")
    names = named.groupBy("root").agg(F.min("least").alias("reached"))
    reached = named.join(names, "root").select("digest", "reached")
    done = [*written(start)]
    reached = materialise(reached, "jaccard-reached")
    discard(rows.sparkSession, [path for path in done if "/jaccard-rows-" not in path])
    whole = rows.groupBy("digest").agg(F.min("doc_id").alias("least")).join(reached, "digest", "left")
    whole = whole.select("digest", F.coalesce("reached", "least").alias("component_id"))
    alone = (F.col("n") == 0) & F.lit(blank_alone)
    out = rows.join(whole, "digest")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
