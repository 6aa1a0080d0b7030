"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Piece lengths are integers up to the capacity, so an instance is a histogram of at most ``capacity``
counts whatever the number of documents. The reduction and the best fit run on that histogram and
give patterns (lengths that share a sequence) with multiplicities; pieces then find their place by their
rank among pieces of their length, in parallel.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import columns, ordered, whole_text, worker_memory
from docketry.session import materialise

CAPACITY = 2048
SEPARATOR = 0
#: Chunks in each half of a worker's memory, and texts whose new chunks are encoded together: so many, or fewer from so many characters on.
MEMORY = 300_000
TOGETHER = 256
TOGETHER_CHARS = 1_000_000
MEMORY_CHARS = 64

#: Letters whose lower case is left to the library.
BEYOND = re.compile("[^\x00-\u024f]")
#: A comma or full stop that continues a run of other signs; the lower case of the dotted capital I ends with one.
JOINED = re.compile("[.,] (?<=(?:[^\\w ]|[_\u0130])[.,] )")
#: Chunks without a comma that the library encodes as one text, a comma between each two.
LISTED = 512

Pattern = tuple[tuple[int, ...], int]


class Lengths:
    """Multiset of lengths with the largest at or below a bound in logarithmic time."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int = 1) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]

    def at_most(self, bound: int, but: Counter | None = None) -> int | None:
        """Largest length of at most ``bound`` of which one is left after ``but`` is set aside."""
        i = bisect_right(self.sizes, bound) - 1
        while i >= 0 and but and self.counts[self.sizes[i]] <= but[self.sizes[i]]:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, k: int, but: int) -> list[int]:
        """The ``k`` least lengths left when one of length ``but`` is set aside."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(k - len(out), self.counts[size] - (size == but))
            if len(out) == k:
                break
        return out


def dominating(left: Lengths, capacity: int) -> tuple[int, ...] | None:
    """A set with the largest length that dominates every other set with it, if a small one does.

    - Nothing fits beside it: the set is the length alone.
    - One length fills the rest exactly, or no two lengths fit in the rest: it joins the largest that fits.
    - Two at most fit in the rest: the largest single one, if no pair can exceed it, else a pair
      whose lengths dominate those of all pairs.
    """
    big = left.sizes[-1]
    room = capacity - big
    first = left.at_most(room, Counter((big,)))
    if first is None:
        return (big,)
    least = left.smallest(3, big)
    if first == room or sum(least[:2]) > room or len(least) < 2:
        return (big, first)
    if sum(least) > room or len(least) < 3:
        # Pairs alone compete: the pair with the largest member dominates all if its other member is
        # the largest that any pair could have as its smaller one.
        second = left.at_most(room - first, Counter((big, first)))
        if second is None:
            pair = _best_pair(left, room, big)
            return (big, first) if pair and max(pair) <= first and sum(pair) <= first else None
        bound = left.at_most(room // 2, Counter((big,)))
        return (big, first, second) if bound is None or second >= bound else None
    return None


def _best_pair(left: Lengths, room: int, big: int) -> tuple[int, int] | None:
    """The pair with the largest sum within ``room``."""
    best: tuple[int, int] | None = None
    for size in left.sizes:
        if 2 * size > room:
            break
        other = left.at_most(room - size, Counter((big, size)))
        if other is not None and left.counts[size] > (size == big) and (best is None or size + other > sum(best)):
            best = (other, size)
    return best


def place(pattern: tuple[int, ...], left: Lengths) -> Pattern:
    """Take a set as often as its lengths allow.

    The choice stands as long as they last: removing other lengths only removes alternatives to it.
    """
    need = Counter(pattern)
    times = min(left.counts[s] // n for s, n in need.items())
    for size, n in need.items():
        left.take(size, n * times)
    return pattern, times


def _exact_pair(left: Lengths, room: int, aside: Counter) -> list[int] | None:
    """Two lengths that fill ``room`` exactly."""
    for i in range(bisect_right(left.sizes, room) - 1, -1, -1):
        size = left.sizes[i]
        other = room - size
        if other > size:
            return None
        if left.counts[size] > aside[size] and left.counts.get(other, 0) - aside[other] > (other == size):
            return [size, other]
    return None


def best_fit(left: Lengths, capacity: int) -> tuple[int, ...]:
    """The largest length with what fits the rest best: two lengths that fill it exactly, or else
    the largest that fits, again and again."""
    big = left.sizes[-1]
    room, chosen = capacity - big, [big]
    while room > 0:
        aside = Counter(chosen)
        one = left.at_most(room, aside)
        if one is None:
            break
        if one < room and (pair := _exact_pair(left, room, aside)):
            chosen += pair
            break
        chosen.append(one)
        room -= one
    return tuple(chosen)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns with multiplicities that place every length exactly once.

    While the largest length has a dominating set, that set is fixed for good; where it has none, best fit
    fills its sequence and the reduction goes on with what is left.
    """
    left = Lengths(counts)
    out: list[Pattern] = []
    while left.sizes:
        out.append(place(dominating(left, capacity) or best_fit(left, capacity), left))
    return out


class Slots:
    """Where the n-th piece of each length goes, as sorted arrays of runs."""

    def __init__(self, patterns: list[Pattern]):
        used: Counter = Counter()
        rows, sequence = [], 0
        for pattern, times in patterns:
            offset = 0
            for size, n in sorted(Counter(pattern).items(), reverse=True):
                rows.append((size << 40 | used[size], n, sequence, offset))
                used[size] += n * times
                offset += n * size
            sequence += times
        rows.sort()
        self.first, self.copies, self.sequence, self.offset = (
            np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ((), (), (), ()))
        )

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << 40 | rank
        run = np.searchsorted(self.first, key, side="right") - 1
        step = key - self.first[run]
        copies = self.copies[run]
        return self.sequence[run] + step // copies, self.offset[run] + step % copies * length


def together(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in order, in groups of at most ``TOGETHER`` that end once they hold ``TOGETHER_CHARS`` characters."""
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if len(group) == TOGETHER or chars >= TOGETHER_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


class Encoder:
    """Identifiers of whole texts as little-endian 32-bit bytes, by the library on chunks.

    No token of this kind of vocabulary holds white space, so a text falls into independent chunks at spaces and
    line ends, and a comma or full stop after a letter or digit and before a space is a token of its own. The vocabulary is in lower case;
    letters below U+0250 are lowered here, by the same table as the library's. Each distinct chunk is encoded
    once while it is remembered: chunks in use pass from an older to a newer half of the memory.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.comma = self._ids([","])[0]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not BEYOND.search(text):
            text = text.lower()
        text = text.replace("\n", " ") + " "
        if not JOINED.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def learn(self, wanted: set[str]) -> None:
        """Bring ``wanted`` into the newer half."""
        if len(self.new) > MEMORY:
            self.old, self.new = self.new, {}
        missing, plain = [], []
        for chunk in wanted.difference(self.new):
            known = self.old.get(chunk)
            if known is None:
                (missing if "," in chunk else plain).append(chunk)
            else:
                self.new[chunk] = known
        for at in range(0, len(plain), LISTED):
            listed = plain[at : at + LISTED]
            ids = np.frombuffer(self._ids([" , ".join(listed)])[0], dtype="<u4")
            commas = np.flatnonzero(ids == np.frombuffer(self.comma, dtype="<u4")[0])
            if len(commas) == len(listed) - 1:
                data, ends = ids.tobytes(), [*(4 * commas).tolist(), 4 * len(ids)]
                self.new.update(zip(listed, (data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends))))
            else:  # a sign that the library takes apart into a comma
                missing += listed
        self.new.update(zip(missing, self._ids(missing)))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", f.ids).tobytes() for f in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        for group in together(texts):
            split = [self.chunks(t) for t in group]
            wanted = set().union(*split)
            self.learn(wanted)
            known = self.new.__getitem__
            for chunks in split:
                yield b"".join(map(known, chunks))
            for chunk in wanted:
                if len(chunk) > MEMORY_CHARS:
                    del self.new[chunk]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's identifiers and the separator, cut at ``capacity``."""
    own = columns(docs, doc_id=key, text=text).select("doc_id", whole_text().alias("text"))
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_memory(f"encoder {path}", lambda: Encoder(path))
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode_all(batch["text"].to_list())):
                data = ids + end
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy()[row], "piece": np.array(piece, dtype=np.int32),
                "start": np.array(start, dtype=np.int64), "length": np.array(length, dtype=np.int64),
                "ids_crc32": np.array(crc, dtype=np.int64),
            })

    schema = f"doc_id {dict(own.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return own.mapInPandas(run, schema)


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null and empty texts are one piece with the separator only. Only texts longer than ``capacity`` are cut. Repeated rows are
    packed as often as they occur; ties in length are ordered by key and piece. An empty
    table gives no rows. Memory: the driver holds the histogram of lengths (``capacity`` counts at most) and the
    patterns; tasks hold the patterns and one batch of texts. Only piece rows are shuffled, once.
    """
    stored = materialise(pieces(docs, path, capacity, separator, key, text), "pieces")
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = Slots(pack_histogram(counts, capacity))
    starts = np.zeros(capacity + 2, dtype=np.int64)
    for size, n in counts.items():
        starts[size + 1] = n
    starts = np.cumsum(starts)
    ranked = ordered(stored, "piece-order", "length", "doc_id", "piece", "ids_crc32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["length"].to_numpy()
            sequence, offset = slots.find(length, batch.pop("rank").to_numpy() - starts[length])
            yield batch.assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"{n} {t}" for n, t in stored.dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.mapInPandas(run, schema)
