"""Nearest neighbours among vectors of several lengths."""

import numpy as np

from docketry.llm import ann


def test_each_length_is_searched(spark):
    rows = [(i, [1.0, i / 100]) for i in range(0, 500, 50)] + [(i, [1.0, i / 100, 2.0]) for i in range(1000, 1200, 50)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ranks = {q: sorted(r.rank for r in got if r.query_id == q) for q, _ in rows}
    assert all(ranks[q] == ([1, 2, 3, 4, 5] if len(v) == 2 else [1, 2, 3]) for q, v in rows)
    sizes = {i: len(v) for i, v in rows}
    assert all(sizes[r.query_id] == sizes[r.vec_id] for r in got)


def test_a_query_whose_lists_are_short_scans_all(spark):
    """Outliers lie alone in their lists; they still get five neighbours."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal([10, 0, 0, 0], 0.05)]) for i in range(1, 600)]
    rows += [(50 * i, [float(x) for x in 5 * np.eye(4)[1 + i % 3] * (-1) ** i + rng.normal(0, 1e-3, 4)]) for i in range(12, 18)]
    rows = [r for r in rows if r[0] % 50 or r[0] >= 600]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == {q for q, _ in rows if q % 50 == 0} and all(len(v) == 5 for v in got.values())


def test_the_bound_falls_and_loses_no_neighbour():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries, own = x[:20], np.zeros((20, 5000), dtype=bool)
    true = [set(np.argsort(((x - q) ** 2).sum(axis=1))[:5]) for q in queries]
    loose = ann.scan(queries, x, own, 5, epsilon=4.0)
    tight = ann.scan(queries, x, own, 5, epsilon=4.0, bounds=np.array([np.sort(((x - q) ** 2).sum(axis=1))[4] for q in queries]), rows=100)
    for t, a, b in zip(true, loose, tight):
        assert t <= set(a.tolist()) and t <= set(b.tolist()) and len(b) <= 6
