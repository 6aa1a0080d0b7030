"""Nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are scaled to unit length, so the largest cosine is the least distance, and rotated by a random orthogonal
matrix, so that a few coordinates estimate the whole distance. Lists are formed around centroids. Within each probed
list coordinates are read in column blocks; after each block a hypothesis test on the partial distance
abandons the candidates that are significantly farther than the k-th best so far. A query scans its nearest list first; what it finds
there bounds the other lists, and the bound falls while a list is scanned. Survivors get their exact cosine. A query whose lists
hold too few vectors scans all lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import materialise

K = 5
#: Vectors the centroids are fitted on at most: those with the least hash of their id.
FIT_SAMPLE = 20_000
MAX_LISTS = 1024
#: Vectors of the sample per list.
FIT_PER_LIST = 20
#: Share of true neighbours that the probed lists must hold, measured on this many vectors of the sample.
COVERAGE = 0.98
MEASURED = 256
#: Columns read at a time, and width of the test: larger is safer and slower.
BLOCK = 16
EPSILON = 2.1
#: Rows of a list between two updates of the bound.
ROWS = 1024
#: Vectors and queries that meet in one group at most.
GROUP_VECTORS = 8192
GROUP_QUERIES = 1024
SEED = 7


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    #: Lists a query probes.
    probes: int


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): finite vectors other than zero, of any length."""
    own = vectors.select(vectors[key].alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    return own.filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_list()).astype(np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit(
    vectors: DataFrame, k: int = K, coverage: float = COVERAGE, sample: int = FIT_SAMPLE, max_lists: int = MAX_LISTS, rounds: int = 10
) -> Index | None:
    """Rotation, centroids and number of probes from a bounded sample; None if there is no vector.

    The number of probes is the least for which the probed lists hold ``coverage`` of the true ``k`` nearest within
    the sample. Neighbours in the whole table are nearer than those in a sample of it, so they share a list more often. The number of
    lists grows with the root of the number of vectors up to ``max_lists``, and the sample with the lists.
    """
    total = vectors.count()
    if not total:
        return None
    lists = int(min(max_lists, max(1, round(np.sqrt(total) / 2))))
    sample = max(sample, lists * FIT_PER_LIST)
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    x = _unit(_matrix(picked["v"]))
    random = np.random.default_rng(SEED)
    rotation, _ = np.linalg.qr(random.standard_normal((x.shape[1], x.shape[1])))
    x = x @ rotation
    lists = min(lists, len(x))
    centroids = x[random.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centroids.T - (centroids**2).sum(axis=1) / 2, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=lists)[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    asked = x[:: max(1, len(x) // MEASURED)][:MEASURED]
    order = np.argsort(_closest(asked, centroids, lists), axis=1)  # place of each list among a query's probes
    near = np.argmax(x @ centroids.T - (centroids**2).sum(axis=1) / 2, axis=1)
    # The first one found is the query itself.
    true = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    if not true.size:
        return Index(rotation, centroids, lists)
    needed = np.sort(np.take_along_axis(order, near[true], axis=1), axis=None)
    return Index(rotation, centroids, int(needed[int(np.ceil(coverage * len(needed))) - 1]) + 1)


def _closest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    near = (centroids**2).sum(axis=1) - 2 * (x @ centroids.T)
    return np.argsort(near, axis=1, kind="stable")[:, :n]


def assign(vectors: DataFrame, index: Index) -> DataFrame:
    """``vectors`` with ``lists``: the lists a query probes, nearest first; a vector lies in the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _unit(_matrix(batch["v"])) @ index.rotation
                yield batch.assign(lists=list(_closest(x, index.centroids, index.probes).astype(np.int32)))

    schema = ", ".join(f"{n} {t}" for n, t in vectors.dtypes) + ", lists array<int>"
    return vectors.mapInPandas(run, schema)


def scan(
    queries: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, block: int = BLOCK, epsilon: float = EPSILON,
    bounds: np.ndarray | None = None, rows: int = ROWS,
) -> list[np.ndarray]:
    """For each rotated query the rows of ``x`` that may be among its ``k`` nearest; ``own`` marks rows to leave out.

    ``bounds`` are squared distances known to hold ``k`` vectors already. After every ``rows`` rows the bound falls to the k-th best so far.
    """
    n, dim = x.shape
    out = []
    for i, (query, left_out) in enumerate(zip(queries, own)):
        bound = np.inf if bounds is None else bounds[i]
        found, best = [], np.empty(0)
        candidates = np.flatnonzero(~left_out)
        for first in range(0, len(candidates), rows):
            alive = candidates[first : first + rows]
            if not np.isfinite(bound) and len(alive) >= k:
                some = alive[:: max(1, len(alive) // (4 * k))]
                bound = np.partition(((x[some] - query) ** 2).sum(axis=1), k - 1)[k - 1]
            partial = np.zeros(len(alive))
            for at in range(0, dim, block):
                part = x[alive, at : at + block] - query[at : at + block]
                partial += np.einsum("ij,ij->i", part, part)
                read = min(at + block, dim)
                # Under the hypothesis that a candidate is near, partial * dim / read rarely exceeds the bound so far.
                wide = 1.0 if read == dim else (1 + epsilon / np.sqrt(read)) ** 2
                keep = partial * (dim / read) <= bound * wide + 1e-9
                alive, partial = alive[keep], partial[keep]
            found.append(alive)
            best = np.concatenate((best, partial))
            if len(best) >= k:
                bound = min(bound, np.partition(best, k - 1)[k - 1])
        held = np.concatenate(found) if found else candidates
        out.append(held[best <= bound + 1e-9])
    return out


def cosine(query: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of original vectors, each row summed alike so that equal vectors get equal scores."""
    return (v * query).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((query * query).sum()))


def search(
    vectors: DataFrame, every: int = 50, k: int = K, coverage: float = COVERAGE, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest other vectors for each vector whose id is divisible by ``every``.

    Nearest first, ties to the smaller id. Null, zero and non-finite vectors and null ids take no part. Vectors of each
    length are searched as a table of their own, one after the other. Rows repeated in full count once. Of equal vectors only the ``k`` + 1 smallest ids can ever be
    returned, so only they are searched; every one of them may be a query. With fewer candidates all are returned. An empty table
    gives no rows.

    Lists larger than a group are divided by a hash of the id, and queries of a list likewise, so a group
    never holds more than about ``GROUP_VECTORS`` vectors and ``GROUP_QUERIES`` queries. The driver holds the sample for fitting,
    the centroids and one count per list.
    """
    fine = usable(vectors, key, vector)
    kind = dict(fine.dtypes)["vec_id"]
    dims = sorted(r["d"] for r in fine.select(F.size("v").alias("d")).distinct().collect())
    found = [_search(fine.filter(F.size("v") == d).dropDuplicates(["vec_id", "v"]), every, k, coverage) for d in dims]
    if not found:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if len(found) == 1:
        return found[0]
    # An id may come with vectors of several lengths.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every_one = reduce(DataFrame.union, found).drop("rank").withColumn("rank", F.row_number().over(best))
    return every_one.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(fine: DataFrame, every: int, k: int, coverage: float) -> DataFrame:
    """:func:`search` over usable vectors of one length, at least one."""
    index = fit(fine, k, coverage)
    kind = dict(fine.dtypes)["vec_id"]
    schema = f"query_id {kind}, vec_id {kind}, score double"
    lists = len(index.centroids)
    placed = materialise(assign(fine, index), "ann-lists")
    copies = Window.partitionBy("v").orderBy("vec_id")
    # Distinct by value: an id may come with several vectors, each counts.
    base = placed.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    base = materialise(base.select("vec_id", "v", F.get("lists", F.lit(0)).alias("list")), "ann-base")
    asked = placed.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "lists")
    asked = materialise(asked, "ann-queries")
    sizes = {r["list"]: r["n"] for r in base.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    nearest = asked.select("query_id", "q", F.get("lists", F.lit(0)).alias("list"), F.lit(float("inf")).alias("bound"))
    first = materialise(_meet(nearest, base, index, sizes, k, kind), "ann-first")
    # What the nearest list gave bounds the others, once it gave k.
    worst = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).filter(F.col("n") >= k)
    one = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("vectors"))
    known = worst.join(one, "query_id").select("query_id", F.when(F.col("vectors") == 1, 2 - 2 * F.col("worst")).alias("known"))
    others = asked.select("query_id", "q", F.explode(F.slice("lists", 2, max(1, lists))).alias("list")).join(known, "query_id", "left")
    others = others.select("query_id", "q", "list", F.coalesce("known", F.lit(float("inf"))).alias("bound"))
    found = materialise(first.unionByName(_meet(materialise(others, "ann-others"), base, index, sizes, k, kind)), "ann-found")
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).filter(F.col("n") >= k).select("query_id")
    short = materialise(asked.join(enough, "query_id", "left_anti"), "ann-short")
    if index.probes < lists and not short.isEmpty():
        every_list = F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))
        whole = short.select("query_id", "q", every_list.alias("list"), F.lit(float("inf")).alias("bound"))
        found = found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(_meet(whole, base, index, sizes, k, kind))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _meet(queries: DataFrame, base: DataFrame, index: Index, sizes: dict[int, int], k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` of each list for each of ``queries`` (query_id, q, list, bound)."""
    lists = len(index.centroids)
    asked = {r["list"]: r["n"] for r in queries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [-(-sizes.get(i, 0) // GROUP_VECTORS) for i in range(lists)]
    turns = [-(-asked.get(i, 0) // GROUP_QUERIES) for i in range(lists)]

    def table(values: list[int]):
        return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), F.col("list"))

    def salt(column: str, n):
        return F.pmod(F.xxhash64(column), F.greatest(n, F.lit(1))).cast("int")

    def spread(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1))

    left = queries.withColumn("turn", salt("query_id", table(turns))).withColumn("part", F.explode(spread(table(parts))))
    right = base.withColumn("part", salt("vec_id", table(parts))).withColumn("turn", F.explode(spread(table(turns))))

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v, ids = _matrix(asked["q"]), _matrix(held["v"]), held["vec_id"].to_numpy()
        own = asked["query_id"].to_numpy()[:, None] == ids[None, :]
        # Rounding may put the k-th vector itself a little beyond its own distance.
        bounds = asked["bound"].to_numpy() + 1e-9
        found = []
        for i, rows in enumerate(scan(_unit(q) @ index.rotation, _unit(v) @ index.rotation, own, k, bounds=bounds)):
            score = cosine(q[i], v[rows])
            best = np.lexsort((ids[rows], -score))[:k]
            found.append(pd.DataFrame({"query_id": asked["query_id"].iloc[i], "vec_id": ids[rows][best], "score": score[best]}))
        return pd.concat(found)

    group = ["list", "part", "turn"]
    return left.groupBy(group).cogroup(right.groupBy(group)).applyInPandas(meet, f"query_id {kind}, vec_id {kind}, score double")
