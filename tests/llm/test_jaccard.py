"""The n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from docketry.llm import jaccard
from tests.llm.test_table_operators import near_copies
from tests.llm.test_text_operators import table


def gram_set(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) > k else {tuple(words)} if words else set()


def brute(rows, k=3, least=(9, 10), blank_alone=True):
    p, q = least
    sets = [gram_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a and b and q * len(a & b) >= p * len(a | b)) or (not a and not b and not blank_alone):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), key if not sets[i] and blank_alone else min(group, default=None)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def group_of_near_copies(n, words=60, seed=1):
    """Copies of one text with a few words each changed or cut off, many but not all pairs similar."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(words)] = rng.choice(["new", "other", f"own{i}"])
        out.append(" ".join(copy[: words - rng.choice([0, 0, 0, 1, 3, 12])]))
    return out


HARD = [None, "", " \n", "one", "ONE", "two words", "two  words", "a b c", "a b c d", "a b c a b c a b c", "a b c a b c",
        "ünï cödé wörds ünï", "very long " * 30_000, "very long " * 29_990]


@pytest.mark.parametrize("shingle,least", [(3, (9, 10)), (5, (4, 5))])
def test_components_equal_brute_force(spark, shingle, least):
    passage = " ".join(f"shared{i}" for i in range(40))
    texts = [*near_copies(80, seed=7, changed=3), *group_of_near_copies(70), *HARD]
    texts += [f"{passage} " + " ".join(f"u{i}x{j}" for j in range(n)) for i, n in enumerate([0, 1, 2, 4, 5, 8, 9, 10, 30, 300])]
    rows = [*enumerate(texts), (None, texts[0]), (None, "only null keys here"), (3, texts[3]), (3, "another text of key three"), (2**62 + 1, texts[5])]
    docs = table(spark, rows).selectExpr("*", "1 AS digest", "2 AS n", "3 AS node", "4 AS least")
    assert got(jaccard.similar(docs, shingle, least)) == brute(rows, shingle, least)


def test_thresholds_are_met_exactly(spark):
    """Sets of 19 n-grams each that share 18 (18/20), and of 18 and 19 that share 17."""
    words = [f"w{i}" for i in range(21)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:20], "end"])), (3, " ".join(words[1:20])), (4, " ".join([*words[:19], "x"]))]
    assert got(jaccard.similar(table(spark, rows))) == brute(rows)
    assert {r[2] for r in brute(rows)} == {1, 4} or len({r[2] for r in brute(rows)}) > 1


def test_blank_texts_together_and_empty_table(spark):
    rows = [(5, ""), (4, None), (6, "some words"), (None, " ")]
    assert got(jaccard.similar(table(spark, rows), blank_alone=False)) == brute(rows, blank_alone=False)
    assert got(jaccard.similar(table(spark, rows).limit(0))) == []


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_rounds_change_nothing(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = list(enumerate([*group_of_near_copies(60, seed=4), *near_copies(20, seed=8, changed=2)]))
    assert got(jaccard.similar(table(spark, rows))) == brute(rows)


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 2000), dtype=np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)))
        differ = sum(int(x).bit_count() for x in (jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_fragments_cover_the_order():
    for least in ((9, 10), (4, 5), (1, 2)):
        edges = jaccard.edges_of(least)
        assert edges[0] == 0 and edges[-1] == 1 << 64 and edges == sorted(set(edges)) and len(edges) == jaccard.FRAGMENTS + 1
