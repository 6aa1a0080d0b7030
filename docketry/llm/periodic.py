"""Periodic runs of words, found by recompression.

A run is a stretch of words that repeats with a smallest period q, at least ``max(6, 4 q)`` words long, which no neighbouring
word extends. For each q, words q apart are compared on a grid so close that every run holds a grid point (harmonic
sums of grid points over all q). The texts with candidates are turned into a run-length grammar: blocks of equal symbols and pairs of
symbols are replaced by new ones in turn, in a way that depends on the symbols alone, so that equal stretches
get equal symbols but near their ends. The longest common extension of two places climbs and descends the levels of the grammar; extended
to the right and, in the grammar of the reversed text, to the left, a candidate gives the exact run.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import columns, whole_text

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Neighbouring words compared at a grid point.
LOOK = 4
#: Words of texts that are searched together; a longer text is searched alone.
CHUNK = 1 << 19
#: Extensions asked for at a time.
ASKED = 1 << 18


class Grammar:
    """Levels of symbols over a sequence whose last symbol occurs nowhere else."""

    def __init__(self, text: np.ndarray, enough: int = 8):
        self.symbols, self.up, self.first, self.left = [text], [], [None], []
        self._fresh = int(text.max()) + 1
        while len(self.symbols[-1]) > enough:
            self._blocks()
            self._pairs()
        self.top = len(self.up)

    def _push(self, first: np.ndarray, symbols: np.ndarray, left: np.ndarray | None) -> None:
        size = np.diff(first, append=len(self.symbols[-1]))
        self.up.append(np.repeat(np.arange(len(first)), size))
        self.left.append(left)
        self.first.append(first)
        self.symbols.append(symbols)

    def _named(self, keys: np.ndarray) -> np.ndarray:
        names, which = np.unique(keys, return_inverse=True)
        self._fresh += len(names)
        return self._fresh - len(names) + which

    def _blocks(self) -> None:
        s = self.symbols[-1]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(first, append=len(s))
        symbols, many = s[first], size > 1
        symbols[many] = self._named(symbols[many] * (len(s) + 1) + size[many])
        self._push(first, symbols, np.repeat(first + size, size) - np.arange(len(s)))

    def _pairs(self) -> None:
        s = self.symbols[-1]
        mixed = (s.astype(np.uint64) + np.uint64(len(self.up))) * np.uint64(0x9E3779B97F4A7C15)
        side = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)
        head = np.zeros(len(s), dtype=bool)
        head[:-1] = (side[:-1] == 0) & (side[1:] == 1)
        first = np.flatnonzero(~np.concatenate(([False], head[:-1])))
        symbols, paired = s[first], head[first]
        symbols[paired] = self._named(s[first[paired]] * self._fresh + s[first[paired] + 1])
        self._push(first, symbols, None)

    def _same(self, level: int, a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the ``asked``, those on equal symbols, moved past them; and the others."""
        x, y = a[asked], b[asked]
        same = self.symbols[level][x] == self.symbols[level][y]
        on, x, y = asked[same], x[same], y[same]
        left = self.left[level] if level < self.top else None
        step = 1 if left is None else np.minimum(left[x], left[y])
        a[on], b[on] = x + step, y + step
        return on, asked[~same]

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` and from ``j`` on are equal, for each pair of places i < j."""
        a, b = i.copy(), j.copy()
        stuck: list[list[np.ndarray]] = [[] for _ in range(self.top + 1)]
        asked = np.arange(len(i))
        for level in range(self.top):
            up, first, risen = self.up[level], self.first[level + 1], []
            while len(asked):
                x, y = up[a[asked]], up[b[asked]]
                starts = (first[x] == a[asked]) & (first[y] == b[asked])
                rise = asked[starts]
                a[rise], b[rise] = x[starts], y[starts]
                risen.append(rise)
                asked, off = self._same(level, a, b, asked[~starts])
                stuck[level].append(off)
            asked = np.concatenate(risen) if risen else asked
        for level in range(self.top, -1, -1):
            asked = here = np.concatenate([asked, *stuck[level]])
            while len(here):
                here, _ = self._same(level, a, b, here)
            if level:
                a[asked], b[asked] = self.first[level][a[asked]], self.first[level][b[asked]]
        return a - i


def grid(period: int) -> tuple[int, int]:
    """Distance of grid points and words to compare at each, so that every run of ``period`` has a point."""
    look = max(2, min(period, LOOK))
    return max(LEAST_WORDS, LEAST_TIMES * period) - period - look + 1, look


def candidates(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of grid points whose words recur a period later.

    ``text`` holds texts, longest first, each before a symbol of its own; ``ends`` are those symbols' places.
    """
    sizes = np.diff(ends, prepend=-1) - 1
    places, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for q in range(1, int(sizes[0]) // LEAST_TIMES + 1):
        held = int(np.searchsorted(-sizes, -max(LEAST_WORDS, LEAST_TIMES * q), side="right"))
        if not held:
            break
        last = int(ends[held - 1])
        step, look = grid(q)
        at = np.flatnonzero(text[: last - q : step] == text[q:last:step]) * step
        for d in range(1, look):
            if not len(at):
                break
            at = at[at + d + q < last]
            at = at[text[at + d] == text[at + d + q]]
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), q))
    return np.concatenate(places), np.concatenate(periods)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each before a symbol of its own, and the places of those symbols."""
    fresh = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    parts = [x for k, t in enumerate(texts) for x in (t, np.array([fresh + k], dtype=np.int64))]
    return np.concatenate(parts), np.cumsum([len(t) + 1 for t in texts]) - 1


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of word numbers, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((k for k, t in enumerate(texts) if len(t) >= LEAST_WORDS), key=lambda k: -len(texts[k]))
    if not order:
        return out
    text, ends = _joined([texts[k] for k in order])
    at, period = candidates(text, ends)
    if not len(at):
        return out
    inside = np.searchsorted(ends, at)
    whole = at + period < ends[inside]  # words of two texts may be alike, too
    at, period, inside = at[whole], period[whole], inside[whole]
    if not len(at):
        return out
    # Only texts with candidates go into the grammar.
    some, which = np.unique(inside, return_inverse=True)
    starts = np.concatenate(([0], ends[:-1] + 1))
    own = [texts[order[k]] for k in some.tolist()]
    text, ends = _joined(own)
    at = at - starts[inside] + np.concatenate(([0], ends[:-1] + 1))[which]
    n = len(text)
    right = Grammar(text)
    left = Grammar(np.append(text[::-1], text.max() + 1))
    found = set()
    for k in range(0, len(at), ASKED):
        i, q = at[k : k + ASKED], period[k : k + ASKED]
        ahead, back = right.extend(i, i + q), left.extend(n - i - q, n - i)
        start, length = i - back, back + q + ahead
        fit = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * q)
        found.update(zip(start[fit].tolist(), length[fit].tolist(), q[fit].tolist()))
    # The same stretch also has the multiples of its smallest period.
    shortest: dict[tuple[int, int], int] = {}
    for start, length, q in found:
        shortest[start, length] = min(q, shortest.get((start, length), q))
    begin = np.concatenate(([0], ends[:-1] + 1))
    for (start, length), q in shortest.items():
        k = int(np.searchsorted(ends, start))
        out[order[some[k]]].append((int(start - begin[k]), length, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def make_periodic(words: list[bytes], mark: int) -> list[bytes]:
    """From word mark/10 % n on, the words repeat with a period of a third of the rest or less."""
    n, g = len(words), mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the run of the greatest exponent, and digests of all runs and of the words without repetitions."""
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = words
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in runs:
            change[s + q] += 1
            change[s + n] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *figures, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first = held = 0
    for k, n in enumerate(sizes):
        if k > first and held + n > CHUNK:
            yield first, k
            first, held = k, 0
        held += n
    if sizes:
        yield first, len(sizes)


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", perturb: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), one row per row of ``docs``.

    With ``perturb``, the words of rows whose id has a crc32 divisible by 10 are first made periodic (:func:`make_periodic`); null
    ids are left as they are. Null and blank texts have no word, no run and digests of nothing. Equal texts have equal
    runs. Texts of any length are searched whole, each within its task; an empty table gives an empty one.
    """
    own = columns(docs, doc_id=key, text=text)
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) if perturb else F.lit(None).cast("long")
    own = own.select("doc_id", whole_text().alias("text"), F.when(mark % 10 == 0, mark).alias("mark"))
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _chunks([n // 5 for n in pc.binary_length(batch.column(1)).to_pylist()]):
                part = batch.slice(first, last - first)
                lists, numbers, known = [], [], {}
                for text, mark in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = text.encode().split()  # on bytes: ASCII white space only
                    if mark is not None and words:
                        words = make_periodic(words, mark)
                    lists.append(words)
                    numbers.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64))
                rows = [summary(w, r) for w, r in zip(lists, find_runs(numbers))]
                columns_ = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns_], ["doc_id", *names])

    longs = ", ".join(f"{n} bigint" for n in names[:5])
    schema = f"doc_id {dict(own.dtypes)['doc_id']}, {longs}, runs_sha256 string, collapsed_sha256 string"
    return own.mapInArrow(run, schema)
