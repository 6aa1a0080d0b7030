"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a linked list of symbols. A heap holds every adjacent pair that has a merge rank; the lowest rank
is popped, the pair is merged and the pairs with its neighbours are pushed. The count of a word is
its initial symbols minus its merges; token identifiers are never made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import columns, whole_text

#: Fixed value: the split of byte-level vocabularies before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LIMIT = 512
#: Chunks whose count a task remembers; the memory is emptied when full.
MEMORY = 400_000
#: Longer chunks are counted anew each time.
MEMORY_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class ByteMerges:
    """Merge ranks of a byte-level vocabulary file, by pairs of bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {c: b for b, c in enumerate(byte_symbols())}
        plain = {}
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            for part in (left, right):
                if part not in plain:
                    plain[part] = bytes(back[c] for c in part)
            self.ranks[plain[left], plain[right]] = rank
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]


def merges(symbols: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> int:
    """How many merges a word undergoes."""
    n = len(symbols)
    if n < 2:
        return 0
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [
        (rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None
    ]
    heapq.heapify(heap)
    done = 0
    while heap:
        rank, i = heapq.heappop(heap)
        left = symbols[i]
        j = after[i]
        # An entry is stale once either symbol was merged: its pair has another rank by now.
        if left is None or j >= n or ranks.get((left, symbols[j])) != rank:
            continue
        symbols[i], symbols[j] = left + symbols[j], None
        k = after[i] = after[j]
        done += 1
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return done


class Counter:
    """Counts whole texts with one vocabulary; one instance serves all batches of a task."""

    def __init__(self, path: str):
        vocabulary = ByteMerges(path)
        self.ranks = vocabulary.ranks
        self.words = regex.compile(WORDS)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.bytes = [bytes([b]) for b in range(256)]
        self.memory: dict[str, int] = {}

    def word(self, word: str) -> int:
        data = word.encode()
        return len(data) - merges([self.bytes[b] for b in data], self.ranks)

    def chunk(self, chunk: str) -> int:
        count = self.memory.get(chunk)
        if count is None:
            count = sum(map(self.word, self.words.findall(chunk)))
            if len(chunk) <= MEMORY_CHARS:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[chunk] = count
        return count

    def plain(self, text: str) -> int:
        if "  " in text:
            return sum(map(self.chunk, self.words.findall(text)))
        # No token starts before and ends after a single space, so the text falls into chunks there.
        first, *rest = text.split(" ")
        known = self.memory.get
        total = self.chunk(first) if first else 0
        for part in rest:
            chunk = " " + part
            total += known(chunk) or self.chunk(chunk)
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def count_tokens(
    docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``; ``path`` is a vocabulary file on every executor.

    Null and empty texts have 0 bytes and 0 tokens. Strings of special tokens inside a text count as one token each,
    the library's default. Repeated rows are counted one by one; a null key stays null. A
    narrow pass; a task holds the vocabulary, a bounded memory of chunks and one batch of texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(path)
        for batch in batches:
            counts = [counter.count(t) for t in batch.pop("text")]
            yield batch.assign(n_tokens=pd.Series(counts, dtype="int64"))

    own = columns(docs, doc_id=key, text=text)
    key_type = dict(own.dtypes)["doc_id"]
    texts = own.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), whole_text().alias("text"))
    counted = texts.mapInPandas(run, f"doc_id {key_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
