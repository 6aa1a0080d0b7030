"""Token counts, SentencePiece, packing, toxicity and line dedup against the libraries and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm import lattice, lines, packing, token_counts, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

SCRAPS = [
    "a", "b", " ", "  ", "\n", "\t", " \n", "\r\n", "'s", "<|endoftext|>", "<|startoftext|>", "é", "é", "́", "İ", "Σ", "1", "½",
    "!", "..", ", ", ". ", "_. ", ".. ", " ", "\u0085", "\x1c", "😀", "the", "ing", "\x00", "日本", "ß", "'LL", "İ. ", "▁", "aaaa", "<s>", "x" * 70,
]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(SCRAPS, k=rng.randint(0, 14))) for _ in range(n)]


def table(spark, rows, extra=True):
    """doc_id and text with columns whose names clash with those of the operators."""
    clash = ", word string, ids string, length string, rank string, score string, fp string, n string"
    return spark.createDataFrame([(i, t, *["z"] * 7) for i, t in rows], "doc_id long, text string" + clash)


HARD = [(1, None), (None, "a b c"), (2, ""), (3, " \n\t "), (4, "word " * 30000), (5, "tie"), (5, "tie"), (6, "tie")]


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    texts = odd_texts(400)
    rows = [*enumerate(texts), (None, "x y"), (900, None), (900, None)]
    got = token_counts.count_tokens(table(spark, rows), BYTE_BPE, limit=3).collect()
    want = sorted(
        (str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows
    )
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)
    assert token_counts.count_tokens(table(spark, rows).limit(0), BYTE_BPE).count() == 0


def test_merges_are_initial_symbols_minus_tokens():
    ranks = {(b"a", b"b"): 0, (b"ab", b"ab"): 1, (b"b", b"a"): 2}
    assert token_counts.merges([b"a", b"b"] * 4, ranks) == 6  # abab abab
    assert token_counts.merges([b"b", b"a"], ranks) == 1 and token_counts.merges([b"a"], ranks) == 0


def test_sentencepiece_round_trip_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts(300)
    rows = [*enumerate(texts), (None, "x y"), (900, None), (900, None)]
    encoded = lattice.encode(table(spark, rows), PIECES)
    got = encoded.collect()
    want = sorted((str(i), library.encode(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert all(r.n_pieces == len(r.ids) for r in got)
    back = {r.doc_id: r.text for r in lattice.decode(encoded, PIECES).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert lattice.encode(table(spark, rows).limit(0), PIECES).count() == 0


def test_viterbi_takes_the_best_of_all_segmentations(spark):
    rng = random.Random(5)
    pieces = {p: (i, -rng.uniform(1, 9)) for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bca", "aa"])}
    model = lattice.Model(pieces, list(pieces), [], 99, lattice.UNIGRAM, r"[\s\S]+")
    words = ["".join(rng.choices("abcx", k=rng.randint(1, 8))) for _ in range(60)]
    unknown = min(s for _, s in pieces.values()) - 10.0

    def best(word):
        if not word:
            return 0.0, []
        options = []
        for n in range(1, min(3, len(word)) + 1):
            known = pieces.get(word[:n])
            if known or n == 1:
                score, rest = best(word[n:])
                options.append((score + (known[1] if known else unknown), [known[0] if known else 99, *rest]))
        return max(options)

    vocabulary = spark.createDataFrame([(w,) for w in set(words)], "word string")
    got = {r.word: list(r.ids) for r in lattice.encode_words(vocabulary, model).collect()}
    assert got == {w: best(w)[1] for w in words}
    assert all(lattice.segment_ids(w, model) == got[w] for w in words)


def check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(WORD_BPE)
    want = defaultdict(Counter)
    for key, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[key][n, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = defaultdict(Counter)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_places_every_piece_once(spark):
    rows = [*enumerate(odd_texts(200)), *((i or 900, t) for i, t in HARD)]
    got = packing.pack(table(spark, rows), WORD_BPE, capacity=64).collect()
    used = check_packing(got, rows, 64)
    total = sum(r.length for r in got)
    assert used <= -(-total // 64) + 1
    assert packing.pack(table(spark, rows).limit(0), WORD_BPE).count() == 0


def test_dominance_never_costs_a_sequence():
    """Against the least number of sequences, found by trying all assignments."""

    def least(items, capacity, bins=()):
        if not items:
            return len(bins)
        first, rest = items[0], items[1:]
        best = 99
        for i, b in enumerate(bins):
            if b + first <= capacity and b not in bins[:i]:
                best = min(best, least(rest, capacity, (*bins[:i], b + first, *bins[i + 1 :])))
        return min(best, least(rest, capacity, (*bins, first)))

    rng = random.Random(1)
    extra = 0
    for _ in range(60):
        items = sorted((rng.randint(1, 12) for _ in range(8)), reverse=True)
        patterns = packing.pack_histogram(Counter(items), 12)
        placed = Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= 12
            for size in pattern:
                placed[size] += times
        assert placed == Counter(items)
        left = packing.Lengths(Counter(items))
        fixed = []
        while left.sizes and (p := packing.dominating(left, 12)):
            fixed.append(packing.place(p, left))
        rest = [s for s, n in left.counts.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + least(tuple(sorted(rest, reverse=True)), 12) == least(tuple(items), 12)
        extra += sum(t for _, t in patterns) - least(tuple(items), 12)
    assert extra <= 2


def test_line_dedup_by_share_of_the_host(spark):
    rows = [(i, "menu\nown %d\nmenu\n\n" % i, "big") for i in range(40)] + [(100 + i, "menu\nrare", "small") for i in range(3)]
    rows += [(i, "once %d\nshared\nx" % i if i < 204 else "once %d" % i, None) for i in range(200, 240)]
    rows += [(300, None, "big"), (301, "", None), (None, "menu", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_dropped", F.lit("clash")).withColumn("_bad", F.lit(1))
    got = lines.drop_boilerplate(docs)
    assert got.columns == ["doc_id", "text", "source", "_bad", "n_lines", "n_dropped"]
    out = {r.doc_id: r for r in got.collect()}
    assert len(out) == len(rows)
    assert out[0].text == "own 0\n\n" and (out[0].n_lines, out[0].n_dropped) == (5, 2)
    assert out[100].text == "menu\nrare"  # frequent elsewhere, on three pages here
    assert out[200].text == "once 200\nshared\nx"  # four pages of 41
    assert out[300].text is None and (out[300].n_lines, out[300].n_dropped) == (0, 0)
    assert out[301].text == "" and out[None].text == ""
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def abusive(spark):
    rng = random.Random(9)
    plain = ["river", "stone", "window", "bread", "garden", "letter", "winter", "silver", "market", "paper"]
    bad = ["grolbish", "snarvel", "plonket"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=30)
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(bad) if i % 2 else "vexo" + rng.choice(["ra", "lin", "tum", "ser"])
        rows.append((i, " ".join(words) + f" n{i}"))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_learns_words_stems_and_misspellings(spark, abusive):
    rows, labels = abusive
    probes = [
        (1001, "river stone qrolbish window xnarvel bread zplonket garden market"), (1002, "vexoquil river vexomar stone vexodin"),
        (1003, "river stone window bread"), (1004, None), (1005, ""), (None, "river"),
    ]
    docs = table(spark, rows + probes)
    truth = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, truth).collect()}
    assert len(got) == len(rows) + len(probes)
    for i, label in labels:
        assert got[i].predicted == label and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    assert got[1002].predicted == 1 and got[1001].misspelled > 0
    assert [got[i].predicted for i in (1003, 1004, 1005, None)] == [0, 0, 0, 0] and got[None].held_out is False
    # Labels of held-out rows change nothing.
    flipped = truth.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}
    assert toxicity.score(docs.limit(0), truth).count() == 0


def test_speller_accepts_exactly_one_edit():
    words = ["idiot", "moron", "scum"]
    speller = toxicity.Speller(dict.fromkeys(words, 1.0))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(4000):
        word = list(rng.choice(words))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "o", "1"])
        word = "".join(word)
        near = [(d, w) for w in words if (d := distance(word, w)) <= (1 if len(w) >= 5 else 0)]
        found = speller.match(word)
        assert (found is None) == (not near)
        assert not near or found[1] == min(near)[0]


def test_quoted_hits_count_apart():
    scorer = toxicity.Scorer(toxicity.Lexicon({"grolbish": 3.0}, {}))
    said, plain = scorer.features('he wrote "you grolbish" once'), scorer.features("he wrote you grolbish once")
    assert said[3] > 0 and said[0] == said[4] == 0 and plain[0] > 0 and plain[3] == 0
