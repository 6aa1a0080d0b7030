"""SentencePiece encoding and decoding over a relational lattice.

Distinct words are cut out of all texts and counted before anything is shuffled. The substrings of each word up to the
longest piece are exploded and joined to the piece table; the matches are the edges of the word's lattice. Edges
are grouped by word and folded with Spark's ``aggregate``: a unigram model takes the best path (Viterbi); a merge model
takes the best-scoring edge over two neighbouring segments, again and again, since the best path over merge
ranks is not what such a model means. The encoded words are then handed to the texts they occur in: a bounded number of the most
frequent ones to all tasks, the others to the groups of texts that contain them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import columns, int_table, whole_text
from docketry.session import materialise

SPACE = "▁"
#: Starts of substrings that are cut from one slice of a word.
SLICE = 64
#: Longer words are folded with a heap in Arrow batches, for the fold on arrays takes quadratic time.
LONG_WORD = 64
#: Encoded words that every task gets; the others travel to the groups of texts they occur in.
FREQUENT_WORDS = 100_000
#: Characters of text that are put together with the words they contain.
GROUP_CHARS = 4_000_000
UNIGRAM, MERGES = 1, 2
USER_DEFINED = 4


@dataclass(frozen=True)
class Model:
    """What encoding needs of a model file: pieces with scores, bytes, and how words are cut."""

    pieces: dict[str, tuple[int, float]]
    names: list[str]
    bytes: list[int]  # identifiers of the 256 byte pieces; empty without byte fallback
    unknown: int
    algorithm: int
    pattern: str

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


def load_model(path: str) -> Model:
    """Read a model file. Models that normalise texts or have user-defined pieces are refused."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    algorithm, normaliser = UNIGRAM, {}
    for number, value in _fields(library.serialized_model_proto()):
        if number == 2:
            algorithm = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            normaliser = dict(_fields(value))
        elif number == 1 and dict(_fields(value)).get(3, 1) == USER_DEFINED:
            raise ValueError("user-defined pieces")
    if algorithm not in (UNIGRAM, MERGES) or normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1):
        raise ValueError("only unigram and merge models without normalisation, with a dummy prefix")
    pieces, names, byte_ids = {}, [], {}
    for i in range(library.get_piece_size()):
        name = library.id_to_piece(i)
        names.append(name)
        if library.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
            pieces[name] = (i, float(library.get_score(i)))
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
        pattern = r"[\s\S]+"  # pieces reach over word limits: a text is one word
    else:
        pattern = f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
    return Model(
        pieces, names, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [], library.unk_id(), algorithm, pattern
    )


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, score) and a row for the empty string; as many rows as the model has pieces, whatever the data."""
    rows = [(p, i, s) for p, (i, s) in model.pieces.items()]
    return spark.createDataFrame([*rows, ("", -1, 0.0)], "piece string, id int, score double")


def normalised(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))).otherwise("")


def words(text: Column, model: Model) -> Column:
    return F.regexp_extract_all(normalised(text), F.lit(f"({model.pattern})"), 1)


def edges(vocabulary: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """``vocabulary`` with start, size, id and score: pieces found in each word, from 0. ``table`` is bounded by the model.

    Each word also has an edge of no size at 0, so that one without any piece is not lost.
    """
    keep = vocabulary.columns
    slices = vocabulary.select(
        *keep, F.length("word").alias("_n"), F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(SLICE))).alias("_from")
    ).select(*keep, "_n", "_from", F.expr(f"substring(word, _from + 1, {SLICE + longest - 1})").alias("_slice"))
    starts = slices.select(
        *keep, "_n", "_from", "_slice", F.explode(F.sequence(F.lit(0), F.least(F.lit(SLICE), F.col("_n") - F.col("_from")) - 1)).alias("_i")
    )
    sizes = starts.select(
        *keep, "_from", "_slice", "_i",
        F.explode(F.sequence(F.when(F.col("_from") + F.col("_i") == 0, 0).otherwise(1), F.least(F.lit(longest), F.col("_n") - F.col("_from") - F.col("_i")))).alias("size"),
    )
    spans = sizes.select(*keep, (F.col("_from") + F.col("_i")).alias("start"), "size", F.expr("substring(_slice, _i + 1, size)").alias("piece"))
    return spans.join(F.broadcast(table), "piece").select(*keep, "start", "size", "id", "score")


#: Edges are looked up by start * STRIDE + size; pieces are shorter.
STRIDE = 1024


def _by_place(found: Column) -> Column:
    """Edges as a map from place to score and id."""
    return F.map_from_entries(F.transform(
        found, lambda e: F.struct((e["start"] * STRIDE + e["size"]).alias("k"), F.struct(e["score"], e["id"]).alias("v"))))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _merged(by_place: Column, n: Column) -> Column:
    """Borders of the segments of a merge model.

    Of all neighbouring segments whose union is a piece, the union with the best score, the leftmost of equals, loses its
    inner border, until there is none. Each step needs one fold over the borders left.
    """

    def step(state: Column, _: Column) -> Column:
        borders = state["borders"]

        def union(mid: Column, i: Column) -> Column:
            left = F.get(borders, i)
            score = F.element_at(by_place, left * STRIDE + (F.get(borders, i + 2) - left))["score"]
            return F.struct(score.alias("score"), (-i).alias("i"), mid.alias("mid"))

        # A union that is no piece has no score and sorts below all others.
        best = F.array_max(F.transform(F.slice(borders, 2, F.greatest(F.size(borders) - 2, F.lit(0))), union))
        after = _bound(best, lambda b: F.when(b["score"].isNotNull(), F.struct(
            F.array_remove(borders, b["mid"]).alias("borders"), F.lit(False).alias("done"))))
        ended = F.struct(borders.alias("borders"), F.lit(True).alias("done"))
        return F.when(state["done"], state).otherwise(F.coalesce(after, ended))

    start = F.struct(F.sequence(F.lit(0), n).alias("borders"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step)["borders"]


def _best_path(by_place: Column, n: Column, longest: int, unknown_score: float) -> Column:
    """Borders of the best path of a unigram model; unknown characters cost ``unknown_score``, the longer last piece wins ties."""

    def step(state: Column, end: Column) -> Column:
        def arrive(size: Column) -> Column:
            start = end - size
            known = F.element_at(by_place, start * STRIDE + size)["score"]
            score = F.coalesce(known, F.when(size == 1, F.lit(unknown_score)))
            before = F.get(state, start)
            return F.struct(
                score.isNotNull().alias("ok"), (before["score"] + score).alias("score"), size.alias("size"),
                F.concat(before["path"], F.array(end)).alias("path"),
            )

        best = F.array_max(F.transform(F.sequence(F.lit(1), F.least(end, F.lit(longest))), arrive))
        return F.concat(state, F.array(_bound(best, lambda b: F.struct(b["score"].alias("score"), b["path"].alias("path")))))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path")))
    states = F.aggregate(F.sequence(F.lit(1), n), start, step)
    return F.get(states, n)["path"]


def _ids(by_place: Column, borders: Column, word: Column, model: Model) -> Column:
    """Identifiers of the segments; characters without a piece become bytes or the unknown piece."""
    byte_table = int_table(model.bytes or [model.unknown]).cast("array<int>")

    def one(left: Column, i: Column) -> Column:
        known = F.element_at(by_place, left * STRIDE + (F.get(borders, i + 1) - left))["id"]
        if model.bytes:
            digits = F.hex(F.encode(F.substring(word, left + 1, F.lit(1)), "utf-8"))
            other = F.transform(
                F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1),
                lambda b: F.get(byte_table, F.conv(F.substring(digits, b * 2 + 1, F.lit(2)), 16, 10).cast("int")),
            )
        else:
            other = F.array(F.lit(model.unknown))
        return _bound(known, lambda k: F.when(k.isNotNull(), F.array(k)).otherwise(other))

    return F.flatten(F.transform(F.slice(borders, F.lit(1), F.size(borders) - 1), one))


def segment(word: str, model: Model) -> list[tuple[int, int]]:
    """Segments (start, end) of one word; used for very long words, with the rules of the folds above."""
    n = len(word)
    longest = model.longest
    if model.algorithm == UNIGRAM:
        unknown = min((s for _, s in model.pieces.values()), default=0.0) - 10.0
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, n + 1):
            options = []
            for size in range(1, min(end, longest) + 1):
                known = model.pieces.get(word[end - size : end])
                if known or size == 1:
                    options.append((best[end - size][0] + (known[1] if known else unknown), size))
            best.append(max(options))
        out = []
        while n:
            out.append((n - best[n][1], n))
            n -= best[n][1]
        return out[::-1]
    import heapq

    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int]] = []

    def push(i: int) -> None:
        if i >= 0 and ends[i] < n and (known := model.pieces.get(word[i : ends[ends[i]]])):
            heapq.heappush(heap, (-known[1], i, ends[ends[i]]))

    for i in range(n):
        push(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        alive[ends[i]] = False
        ends[i] = end
        if end < n:
            before[end] = i
        push(i)
        push(before[i])
    return [(i, ends[i]) for i in range(n) if alive[i]]


def segment_ids(word: str, model: Model) -> list[int]:
    out: list[int] = []
    for a, b in segment(word, model):
        known = model.pieces.get(word[a:b])
        if known:
            out.append(known[0])
        else:
            out += [model.bytes[x] for x in word[a:b].encode()] if model.bytes else [model.unknown]
    return out


def encode_words(vocabulary: DataFrame, model: Model) -> DataFrame:
    """``vocabulary`` (distinct non-empty words, further columns) with ids.

    If ``vocabulary`` is dealt out by word, edges are grouped where they arise and no row moves.
    """
    keep = vocabulary.columns
    short = vocabulary.filter(F.length("word") <= LONG_WORD)
    found = edges(short, piece_table(vocabulary.sparkSession, model), model.longest)
    lattice = found.groupBy(*keep).agg(F.collect_list(F.struct("start", "size", "id", "score")).alias("_edges"))
    n = F.length("word")
    mapped = lattice.select(*keep, _by_place(F.col("_edges")).alias("_by_place"))
    if model.algorithm == MERGES:
        borders = _merged(F.col("_by_place"), n)
    else:
        unknown = min((s for _, s in model.pieces.values()), default=0.0) - 10.0
        borders = _best_path(F.col("_by_place"), n, model.longest, unknown)
    folded = mapped.select(*keep, "_by_place", borders.alias("_borders"))
    ids = folded.select(*keep, _ids(F.col("_by_place"), F.col("_borders"), F.col("word"), model).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=[np.array(segment_ids(w, model), dtype=np.int32) for w in batch["word"]])

    schema = ", ".join(f"{c} {t}" for c, t in vocabulary.dtypes) + ", ids array<int>"
    return ids.union(vocabulary.filter(F.length("word") > LONG_WORD).mapInPandas(run, schema))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids), one row per row of ``docs``: the identifiers the library gives for the whole text.

    Null and empty texts have none. Repeated rows are encoded one by one; a null key stays null. An empty table gives
    an empty one. Words are counted before the shuffle and each distinct word is encoded once. Texts are dealt into groups of about
    ``GROUP_CHARS`` characters by a hash of key and text length; a task holds one group's texts, its rarer words and the
    ``FREQUENT_WORDS`` most frequent ones (of at most ``LONG_WORD`` characters, which bounds their size).
    """
    spark = docs.sparkSession
    model = load_model(path)
    own = columns(docs, doc_id=key, text=text).select("doc_id", whole_text().alias("text"))
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_CHARS))
    vocabulary = own.select(F.explode(words(F.col("text"), model)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    encoded = materialise(encode_words(vocabulary, model), "encoded-words")
    top = encoded.filter(F.length("word") <= LONG_WORD).orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).select("word", "ids")
    frequent = {r["word"]: np.array(r["ids"], dtype="<i4").tobytes() for r in top.collect()}
    common = spark.createDataFrame([(w,) for w in frequent], "word string")
    shared = spark.sparkContext.broadcast(frequent)

    # Rows that repeat a key are spread by what else tells them apart.
    dealt = own.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).cast("int"))
    rare = dealt.select("grp", F.explode(words(F.col("text"), model)).alias("word")).join(F.broadcast(common), "word", "left_anti")
    held = rare.distinct().join(encoded.select("word", "ids"), "word").select(F.col("grp").alias("of"), "word", "ids")

    pattern = re.compile(model.pattern)
    kind = dict(own.dtypes)["doc_id"]

    def run(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        own_words = {w: i.astype("<i4").tobytes() for w, i in zip(known["word"], known["ids"])}
        common, rows = shared.value.get, []
        for text in texts.pop("text"):
            found = pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []
            rows.append(np.frombuffer(b"".join([common(w) or own_words[w] for w in found]), dtype="<i4"))
        return pd.DataFrame({"doc_id": texts["doc_id"], "n_pieces": [len(r) for r in rows], "ids": rows})

    by = dealt.groupBy("grp").cogroup(held.groupBy("of"))
    return by.applyInPandas(run, f"doc_id {kind}, n_pieces bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of identifiers; the exact inverse of :func:`encode`.

    Pieces are put together as bytes, so characters that were split into bytes are whole again; invalid sequences become U+FFFD.
    Control pieces are silent, an unknown piece reads as U+2047 between spaces. Null and empty arrays give empty text.
    """
    model = load_model(path)
    numbers = {i: f"{b:02X}" for b, i in enumerate(model.bytes)}
    known = {i for i, _ in model.pieces.values()}

    def digits(i: int, name: str) -> str:
        if i in numbers:
            return numbers[i]
        if i == model.unknown:
            return " ⁇ ".encode().hex().upper()
        return name.replace(SPACE, " ").encode().hex().upper() if i in known else ""

    table = F.split(F.lit(",".join(digits(i, n) for i, n in enumerate(model.names))), ",")
    own = columns(encoded, doc_id=key, ids=ids)
    # Looked up by place, not joined: the table is a constant as large as the vocabulary.
    joined = F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.get(table, i)), "")
    text = F.decode(F.unhex(joined), "utf-8")
    return own.select("doc_id", F.regexp_replace(text, "^ ", "").alias("text"))
