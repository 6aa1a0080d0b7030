"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from docketry.llm import periodic
from tests.llm.test_text_operators import table


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q):
                found.setdefault((s, e + q - s), q)
            s = max(e, s) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(key, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return key, len(runs), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def sequences(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(120):
        alphabet = rng.choice([1, 2, 3, 5, 400])
        words = [rng.randrange(alphabet) for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 200]))]
        for _ in range(rng.randint(0, 4)):
            q = rng.randint(1, 12)
            unit = [rng.randrange(alphabet + 2) for _ in range(q)]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * 12)[: rng.randint(3 * q, 9 * q)]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    texts = sequences(seed)
    got = periodic.find_runs([np.array(t, dtype=np.int64) for t in texts])
    for text, runs in zip(texts, got):
        assert sorted(runs) == brute_runs(text), text


@pytest.mark.parametrize("alphabet", [1, 2, 50])
def test_extensions_equal_a_plain_count(alphabet):
    rng = np.random.default_rng(alphabet)
    text = np.append(np.tile(rng.integers(0, alphabet, 97), 9), rng.integers(0, alphabet, 300))
    text = np.append(text, text.max() + 1)
    grammar = periodic.Grammar(text)
    i = rng.integers(0, len(text) - 1, 400)
    j = i + rng.integers(1, len(text) - i)
    got = grammar.extend(i, j)
    for a, b, n in zip(i, j, got):
        want = 0
        while b + want < len(text) and text[a + want] == text[b + want]:
            want += 1
        assert n == want
    assert grammar.top < 120


def test_rows_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    names = ["rain", "Rain", "über", "x", "a b", " "]
    texts = [None, "", " \n\t", "word", "a a a a a a", "a a a a a", "The the The the The the The the"]
    texts += [" ".join(names[w % 6] + str(w // 6) for w in t).replace(" ", rng.choice([" ", "\n", " \x0b\x0c"])) for t in sequences(9)]
    texts += [" ".join(str(rng.randrange(30)) for _ in range(3000)), "same " * 2500]
    rows = [*enumerate(texts), (None, "b c b c b c b c"), (None, None), (7, "again again"), (7, "again again"), (2**62 + 1, "z " * 9)]
    docs = table(spark, rows).selectExpr("*", "1 AS mark", "'t' AS n_runs")
    got = sorted((tuple(r) for r in periodic.runs(docs, perturb=True).collect()), key=repr)
    assert got == sorted((brute_row(k, t) for k, t in rows), key=repr)
    assert sum(r[1] for r in got) > 100
    empty = periodic.runs(docs.limit(0), perturb=True)
    assert empty.count() == 0 and len(empty.columns) == 8


def test_a_very_long_text():
    words = np.concatenate([np.arange(60_000), np.tile(np.arange(700), 30), np.arange(90_000, 160_000)])
    (runs,) = periodic.find_runs([words])
    assert runs == [(60_000, 21_000, 700)]


def test_equal_words_of_neighbouring_texts_are_no_run():
    texts = [np.arange(9), np.arange(9), np.arange(8), np.array([*range(8), 3, 3, 3, 3, 3, 3])]
    assert periodic.find_runs(texts) == [[], [], [], [(8, 6, 1)]]
    assert periodic.find_runs(texts[:3]) == [[], [], []]


def test_small_chunks_change_nothing(spark, monkeypatch):
    texts = [" ".join(map(str, t)) for t in sequences(4)]
    want = [periodic.find_runs([np.array(t.split(), dtype=np.int64)])[0] for t in texts]
    monkeypatch.setattr(periodic, "ASKED", 3)
    assert periodic.find_runs([np.array(t.split(), dtype=np.int64) for t in texts]) == want
    monkeypatch.setattr(periodic, "CHUNK", 10)
    assert list(periodic._chunks([4, 4, 4, 30, 1, 0])) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(periodic._chunks([])) == []
