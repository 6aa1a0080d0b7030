"""Toxicity scores from a learned lexicon, misspellings and context windows.

Terms that mark toxic texts are learned from labelled rows: whole words and word beginnings. The words form a trie;
its product with a Levenshtein automaton accepts every spelling within one edit and is made deterministic step by step, as
texts need it. Hits are summed over windows of neighbouring tokens, apart for those within quotation marks, and a
logistic model turns the window scores into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import columns, forget, whole_text

#: Labelled rows that the model is fitted on at most, those with the least hash of their id.
FIT_ROWS = 50_000
#: Terms of each kind at most, and the evidence (likelihood ratio, share of toxic rows) they need.
MAX_TERMS = 1000
MIN_EVIDENCE = 30.0
MIN_SHARE = 0.5
STEMS = range(4, 9)
#: Words at least this long may be misspelled; tokens counted to each side of a hit.
FUZZY_LENGTH = 5
WINDOW = 12
FEATURES = ("words", "stems", "misspelled", "quoted", "window", "distinct", "density")

TOKEN = re.compile(r"[^\W_](?:[\w*@$!]*[^\W_])?")
QUOTES = "\"“”„«»"
#: Terms a task counts before it passes them on.
FLUSH = 300_000
SLICE = 10_000


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


class Speller:
    """Deterministic product of a lexicon trie and a Levenshtein automaton, built as it is used.

    A state is a set of (trie node, edits); its successor by a character is computed once.
    """

    def __init__(self, words: dict[str, float], fuzzy_length: int = FUZZY_LENGTH):
        self.children: list[dict[str, int]] = [{}]
        self.edits: list[int] = [0]  # most edits that any word below a node allows
        self.ends: dict[int, str] = {}
        for word in words:
            allowed = int(len(word) >= fuzzy_length)
            node = 0
            self.edits[0] = max(self.edits[0], allowed)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], allowed)
            self.ends[node] = word
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.steps: list[dict[str, int]] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """With every lexicon character that may be missing from the text."""
        queue = list(nodes.items())
        while queue:
            node, e = queue.pop()
            if nodes[node] < e:
                continue
            for child in self.children[node].values():
                if e < self.edits[child] and nodes.get(child, 9) > e + 1:
                    nodes[child] = e + 1
                    queue.append((child, e + 1))
        return frozenset(nodes.items())

    def _state(self, members: frozenset) -> int:
        if members not in self.states:
            self.states[members] = len(self.members)
            self.members.append(members)
            self.steps.append({})
            found = [(e, self.ends[n]) for n, e in members if n in self.ends and e <= self.edits[n]]
            found = [f for f in found if f[0] == 0 or len(f[1]) >= FUZZY_LENGTH]
            self.accepts.append(min(found)[::-1] if found else None)
        return self.states[members]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.edits[node] and e < nodes.get(node, 9):
                nodes[node] = e

        for node, e in self.members[state]:
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
        target = self._state(self._closed(nodes)) if nodes else self.dead
        self.steps[state][c] = target
        return target

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest lexicon word and its distance."""
        state = self.start
        for c in word:
            following = self.steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if state == self.dead:
                return None
        return self.accepts[state]


class Scorer:
    """Features of whole texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.speller = Speller(lexicon.words)
        self.memory: dict[str, tuple[int, float, str] | None] = {}

    def hit(self, word: str) -> tuple[int, float, str] | None:
        """(kind, weight, term) of a token: 0 word, 1 beginning, 2 misspelled word."""
        found = self.speller.match(word)
        if found and found[1] == 0:
            return 0, self.lexicon.words[found[0]], found[0]
        for n in STEMS:
            if (weight := self.lexicon.stems.get(word[:n])) is not None:
                return 1, weight, word[:n]
        return (2, self.lexicon.words[found[0]], found[0]) if found else None

    def features(self, text: str) -> list[float]:
        words = tokens(text)
        known = set(words)
        if len(self.memory) > FLUSH:
            self.memory.clear()
        for word in known.difference(self.memory):
            self.memory[word] = self.hit(word)
        marked = {w: h for w in known if (h := self.memory[w])}
        sums = [0.0, 0.0, 0.0, 0.0]
        if not marked:
            return [*sums, 0.0, 0.0, 0.0]
        quoted = self._quoted(text)
        places, weights = [], []
        for i, word in enumerate(words):
            if word in marked:
                kind, weight, _ = marked[word]
                sums[3 if quoted[i] else kind] += weight
                if not quoted[i]:
                    places.append(i)
                    weights.append(weight / (1 + (kind == 2)))
        best = 0.0
        if places:
            at, total = np.array(places), np.concatenate([[0.0], np.cumsum(weights)])
            window = total[np.searchsorted(at, at + WINDOW, side="right")] - total[np.searchsorted(at, at - WINDOW)]
            best = float(window.max())
        return [
            *[float(np.log1p(s)) for s in sums], float(np.log1p(best)), float(np.log1p(len({h[2] for h in marked.values()}))),
            float(np.log1p(100 * len(places) / len(words))),
        ]

    @staticmethod
    def _quoted(text: str) -> list[bool]:
        """For each token whether an odd number of quotation marks precedes it in its line."""
        out = []
        for line in text.lower().split("\n"):
            marks = np.array([i for i, c in enumerate(line) if c in QUOTES]) if any(q in line for q in QUOTES) else None
            for m in TOKEN.finditer(line):
                before = 0 if marks is None else int(np.searchsorted(marks, m.start()))
                out.append(before % 2 == 1 and before < len(marks))
        return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(own: DataFrame, labels: DataFrame, rows: int) -> dict[int, int]:
    """Labels to learn from: distinct texts only, so that copies do not vote many times."""
    known = columns(labels, doc_id="doc_id", toxic="toxic").filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = own.select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id")
    distinct = texts.groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("r"))
    picked = distinct.select("r.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    return {r["doc_id"]: int(r["toxic"]) for r in picked}


def learn_lexicon(own: DataFrame, sample: dict[int, int], max_terms: int = MAX_TERMS) -> Lexicon:
    """Words and beginnings that occur in significantly more toxic than clean rows of the sample."""
    toxic = sum(v == 1 for v in sample.values())
    clean = len(sample) - toxic
    if not toxic or not clean:
        return Lexicon()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def passed() -> Iterator[pd.DataFrame]:
            terms = list(seen[0].keys() | seen[1].keys())
            for at in range(0, len(terms), SLICE):
                some = terms[at : at + SLICE]
                counts = {"t": [seen[1][x] for x in some], "c": [seen[0][x] for x in some]}
                yield pd.DataFrame({"term": pd.Series(some, dtype=object), **counts})
            for s in seen:
                s.clear()

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"]):
                label = sample.get(key)
                if label is not None:
                    words = {w for w in tokens(text) if len(w) > 2}
                    seen[label].update([*["=" + w for w in words], *{w[:n] for w in words if len(w) > 3 for n in STEMS}])
            if len(seen[0]) + len(seen[1]) > FLUSH:
                yield from passed()
        yield from passed()

    counts = own.mapInPandas(run, "term string, t bigint, c bigint").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    share = F.col("t") / (F.col("t") + F.col("c"))
    ratio = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5) * ((clean + 1) / (toxic + 1)))
    n = toxic + clean

    def part(x: Column, row: int, total: Column) -> Column:
        return F.when(x > 0, x * F.log(x * n / (row * total))).otherwise(0.0)

    t, c, both = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    gain = 2 * (part(t, toxic, both) + part(c, clean, both) + part(toxic - t, toxic, n - both) + part(clean - c, clean, n - both))
    strong = counts.filter((share >= MIN_SHARE) & (ratio > 0)).withColumn("gain", gain).withColumn("weight", ratio)
    strong = strong.filter(F.col("gain") >= MIN_EVIDENCE)

    def best(kind: Column) -> list:
        return strong.filter(kind).orderBy(F.desc("gain"), "term").limit(max_terms).collect()

    whole = F.col("term").startswith("=")
    stems: dict[str, float] = {}
    for r in sorted(best(~whole), key=lambda r: (len(r["term"]), r["term"])):
        # A longer beginning is kept only if it says more than the shorter one it starts with.
        shorter = max((stems[r["term"][:n]] for n in STEMS if r["term"][:n] in stems), default=0.0)
        if r["weight"] > shorter + 0.5:
            stems[r["term"]] = r["weight"]
    return Lexicon({r["term"][1:]: r["weight"] for r in best(whole)}, stems)


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    bias: float


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[list[float], float]:
    """Weights and bias by Newton's method with a quadratic penalty."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w[:-1]], float(w[-1])


def features_of(text: Column, lexicon: Lexicon) -> Column:
    """The features of each text as an array; texts are judged where they are, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        scorer = Scorer(lexicon)
        for batch in batches:
            yield pd.Series([scorer.features(t) for t in batch], dtype=object)

    return run(text)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0, and from no others.

    Labels that repeat an id count once, the larger one; of equal texts one counts. Without labels of both kinds the lexicon is
    empty and the probability is the share of toxic rows in the sample (0 if there is none). The driver holds the sample
    (``fit_rows`` ids with a few numbers each) and at most ``MAX_TERMS`` words and as many beginnings.
    """
    own = columns(docs, doc_id=key, text=text).select("doc_id", whole_text().alias("text"))
    sample = _sample(own, labels, fit_rows)
    share = sum(sample.values()) / len(sample) if sample else 0.0
    if not 0 < share < 1:
        return Model(Lexicon(), [0.0] * len(FEATURES), 40.0 if share else -40.0)
    lexicon = learn_lexicon(own, sample)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        scorer = Scorer(lexicon)
        for batch in batches:
            batch = batch[batch["doc_id"].isin(sample.keys())]
            rows = np.array([scorer.features(t) for t in batch["text"]], dtype=float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), **{n: rows[:, i] for i, n in enumerate(FEATURES)}})

    schema = f"doc_id {dict(own.dtypes)['doc_id']}, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = own.mapInPandas(chosen, schema).toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    truth = np.array([sample[i] for i in rows["doc_id"]], dtype=float)
    return Model(lexicon, *fit_logistic(rows[list(FEATURES)].to_numpy(), truth))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``_features`` and ``_score`` (probability of toxicity, 0 to 1). A narrow pass."""
    rows = docs.withColumn("_features", features_of(F.coalesce(docs[text], F.lit("")), model.lexicon))
    line = F.lit(model.bias)
    for i, w in enumerate(model.weights):
        line = line + F.get("_features", F.lit(i)) * w
    return rows.withColumn("_score", 1 / (1 + F.exp(-line)))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, features), one row per row of ``docs``; see :func:`fit` for what is learned.

    Null and empty texts have no hits and get the score of a text without any. Repeated rows get equal scores; a
    null key is kept and not held out. An empty table gives an empty one. Every text is scored whole, where it is;
    only keys, hashes and counts of terms are shuffled.
    """
    own = columns(docs, doc_id=key, text=text)
    rows = scored(own, fit(own, labels, fit_rows=fit_rows))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        *[F.get("_features", F.lit(i)).alias(name) for i, name in enumerate(FEATURES)],
    )


def reject(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are scored toxic, learned as in :func:`fit`."""
    rows = scored(docs, fit(docs, labels, key, text), text)
    return rows.filter(F.col("_score") < 0.5).select(*docs.columns)
