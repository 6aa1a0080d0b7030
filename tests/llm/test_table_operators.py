"""SimHash groups, fingerprints, neighbours, licences, shards and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import ann, fingerprint, licenses, sharding, simhash
from tests.llm.test_text_operators import check_packing, odd_texts, table

WORDS = ["rain", "Stone", "BIRD", "lake", "über", "moss", "fern", "owl", "sand", "kelp"]


def near_copies(n, seed=1, length=60, changed=1):
    """Groups of exact and near copies among unrelated texts."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(length)]
        out.append(" ".join(words))
        if rng.random() < 0.5:
            for _ in range(rng.randint(1, 4)):
                copy = list(words)
                for _ in range(rng.randint(0, changed)):
                    copy[rng.randrange(length)] = "edit%d" % rng.randint(0, 9)
                out.append("\n\t ".join(copy))
    return out


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, prints, max_bits=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, key in enumerate(keys):
        if key is not None:
            names[find(i)].append(key)
    return [min(names[find(i)], default=None) for i in range(len(prints))]


@pytest.mark.parametrize("cell", [32, 1])
def test_simhash_groups_equal_brute_force(spark, monkeypatch, cell):
    """With cells of one, all links go over common neighbours."""
    monkeypatch.setattr(simhash, "CELL", cell)
    texts = [*near_copies(60), None, "", " \n", "one", "one two", "one two three", "ONE two\x0bthree", "é É x\u0085y a b"]
    rows = [*enumerate(texts), (None, texts[0]), (7, texts[7])]
    prints = [brute_fingerprint(t) for _, t in rows]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    want = Counter((str(k), f"{p:016x}", str(c)) for (k, _), p, c in zip(rows, prints, brute_components([k for k, _ in rows], prints)))
    assert Counter((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_links_join_the_same_fingerprints_in_crowded_cells(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 300:
        p = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = Counter(Counter(brute_components(signed, prints)).values())
    for cell in (2, 8, 500):
        edges = simhash.links(nodes, cell=cell)
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in edges.collect())
        roots = simhash.components(edges).collect()
        sizes = Counter(Counter(r.root for r in roots).values())
        sizes[1] = len(prints) - len(roots)
        assert +sizes == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = simhash.components(edges).collect()
    assert len(roots) == 201 and {r.root for r in roots} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (2, "other words are here now"), (2, "other words are here now"), (None, "a b c d e"), (9, None), (8, "")]
    kept = simhash.one_per_group(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, None, 8])


def shingles(text, n=5):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text.lower()) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar_groups(keys, sets):
    """For each row the least key it reaches over sets of a Jaccard similarity of 0.8 or more; empty sets are alike."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, key in enumerate(keys):
        if key is not None:
            least[find(i)].append(key)
    return [min(least[find(i)], default=None) for i in range(len(keys))]


def test_fingerprints_estimate_common_shingles(spark):
    texts = [*near_copies(40, length=90, changed=8), None, "", "one two", "one two", "é" * 10, "x " * 3000]
    keys = [*range(len(texts) - 1), len(texts) - 2]  # the last key repeats
    rows = list(zip(keys, texts))
    got = fingerprint.compare_edited(table(spark, rows), ranges=16).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""), reverse=True)
    by_text = {}
    wrong = []
    for r in got:
        i = next(i for i, (k, t) in enumerate(order) if k == r.doc_id and r.edited_sha256 == expected(order, i)[1])
        text, _, edited, after = expected(order, i)
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        a, b, c = shingles(text), shingles(edited), shingles(after)
        if a and b:
            wrong.append(r.near_edited - len(a & b) / len(a | b))
        if a and c:
            wrong.append(r.near_next - len(a & c) / len(a | c))
    assert np.sqrt(np.mean(np.square(wrong))) < 0.05 and abs(np.mean(wrong)) < 0.02
    assert fingerprint.compare_edited(table(spark, rows).limit(0)).count() == 0
    single = fingerprint.compare_edited(table(spark, [(None, "a b c d e f")])).first()
    assert single.near_next == 1.0 and single.doc_id is None


def expected(order, i):
    text, after = order[i][1] or "", order[(i + 1) % len(order)][1] or ""
    third = len(text) // 3
    edited = text[: len(text) - third] + after[:third]
    return text, hashlib.sha256(edited.encode()).hexdigest(), edited, after


def test_densification_borrows_in_a_fixed_order(spark):
    found = [None] * 128
    for b in (3, 77, 90):
        found[b] = b + 1
    row = spark.createDataFrame([(found,), ([None] * 128,)], "f array<long>").select(fingerprint.densify(F.col("f")).alias("x")).collect()
    order = fingerprint.donors()
    want = [v or next(found[d] for d in order[b] if found[d]) for b, v in enumerate(found)]
    assert row[0].x == want and row[1].x == [0] * 128


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 24)).astype(np.float32)
    v[100:160] = v[50]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan"), *[1.0] * 23]), (5150, [float("inf"), *[1.0] * 23]), (5200, [1.0, 2.0]), (None, [1.0] * 24), (5250, [None, *[1.0] * 23])]
    frame = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>").withColumn("list", F.lit("x")).withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in ann.search(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    x = v.astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    hits = 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        score = x @ x[q] / (norm * norm[q])
        score[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(score, 12)))[:5]
        assert [r.rank for r in found] == [1, 2, 3, 4, 5]
        assert np.allclose([r.score for r in found], score[[r.vec_id for r in found]], rtol=0, atol=1e-12)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(best.tolist()))
    assert hits >= 0.9 * 5 * len(got)
    assert [r.vec_id for r in got[100]] == [50, 101, 102, 103, 104]
    few = ann.search(frame.filter("vec_id in (0, 7, 8)")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]
    assert ann.search(frame.limit(0)).count() == 0


def test_license_rules_follow_sentence_order(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    parts = [licenses.SENTENCES[x] + ".\n" for x in ("bsd_source", "bsd_binary", "bsd_names")]
    rows = [
        (1, "Text. Licensed under the Apache License, Version 2.0.\nMore."), (2, "released   UNDER the (MIT) license"),
        (3, bsd + "\n" + "".join(parts[:2])), (4, bsd + "\n" + "".join(parts)), (5, bsd + "\n" + parts[1] + parts[0]),
        (6, "Licensed under CC BY-NC 4.0. Some words. This work is licensed under the GNU General Public License, version 3."),
        (7, "not licensed under the Apache License, Version 2.0 at all"), (8, None), (9, ""), (None, "SPDX-License-Identifier: MIT"), (2, "released   UNDER the (MIT) license"),
    ]
    got = Counter((r.doc_id, r.n_known, r.licenses) for r in licenses.scan(table(spark, rows)).collect())
    assert got == Counter({
        (1, 1, "Apache-2.0"): 1, (2, 1, "MIT"): 2, (3, 3, "BSD-2-Clause"): 1, (4, 4, "BSD-3-Clause"): 1, (5, 3, ""): 1,
        (6, 2, "CC-BY-NC-4.0,GPL-3.0"): 1, (7, 0, ""): 1, (8, 0, ""): 1, (9, 0, ""): 1, (None, 1, "MIT"): 1,
    })
    assert licenses.scan(table(spark, rows).limit(0)).count() == 0


def test_the_curve_is_a_path_through_all_cells():
    for dims, bits in ((2, 3), (3, 3)):
        side = 1 << bits
        index = sharding.curve(dims, bits)
        assert sorted(index) == list(range(side**dims))
        cells = sorted(range(len(index)), key=index.__getitem__)
        points = [[c // side ** (dims - 1 - i) % side for i in range(dims)] for c in cells]
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


@pytest.mark.parametrize("n", [3, 40, 997])
def test_shards_are_even_runs_of_the_curve(spark, n):
    rng = random.Random(n)
    texts = odd_texts(n)
    rows = [(i if i % 50 else None, None if i % 31 == 7 else "copy" if i % 3 == 0 else texts[i], rng.choice(["en", "de", None]), rng.choice(["a", "b", "c"]), rng.choice([1, 50, 900, None])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("shard", F.lit("x")).withColumn("rank", F.lit(0))
    got = sharding.shard_by_rows(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r.shard for r in got)
    sizes = [counts[s] for s in range(40)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    placed = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in placed] == sorted(r.curve_index for r in got)
    # Equal texts follow each other: each group is one run.
    runs = [g for i, g in enumerate(r.text_group for r in placed) if i == 0 or placed[i - 1].text_group != g]
    assert len(runs) == len(set(runs))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_by_rows(docs.limit(0)).count() == 0


def test_split_points_come_from_all_strings(spark):
    """More distinct values than any sample: cut into runs of equal length in the order of their bytes."""
    names = [f"s{(i * 7919) % 9000:05d}" for i in range(9000)]
    docs = spark.createDataFrame([(n,) for n in [*names, *names[:50], None]], "name string")
    every = sorted(names)
    assert sharding._splits(docs, "name", "string", 4) == [every[9000 * i // 16] for i in range(1, 16)]
    assert sharding._splits(docs.limit(0), "name", "string", 4) == []


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(6)
    bad = ["grolbish", "snarvel", "plonket"]
    rows, labels, toxic = [], [], set()
    unique = near_copies(300, seed=8)[:300]
    for i, text in enumerate(unique):
        words = text.split()
        if i % 6 == 0:
            toxic.add(i)
            for b in bad:
                words[rng.randrange(len(words))] = b
        rows.append((i, "Home | About\n" + " ".join(words), "en", f"host{i % 3}", 0))
        labels.append((i, 1, int(i in toxic)))
    rows += [(1000 + i, rows[i][1], "en", rows[i][3], 0) for i in range(0, 60)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "host0", 0), (None, "lone words", "en", "host1", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "packing"]

    clean = by_name["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    kept = Counter(r.doc_id for r in clean.collect())
    assert kept == Counter(i for i, *_ in rows if i is None or i % 1000 not in toxic or i >= 2000)

    short = by_name["line dedup"](spark, clean, str(tmp_path))
    assert short.columns == docs.columns and not short.filter(F.contains("text", F.lit("Home"))).count()
    assert short.filter("n_chars <> length(text)").count() == 0 and Counter(r.doc_id for r in short.collect()) == kept

    left = short.select("doc_id", "text").collect()
    sets = [shingles(r.text or "") for r in left]
    one = by_name["near-dedup"](spark, short, str(tmp_path))
    assert one.columns == docs.columns
    groups = similar_groups([r.doc_id for r in left], sets)
    assert len(set(groups)) < len(left) - 40
    assert Counter(r.doc_id for r in one.collect()) == Counter(r.doc_id for r, g in zip(left, groups) if r.doc_id in (g, None))

    last = [(r.doc_id, r.text) for r in one.select("doc_id", "text").collect()]
    check_packing(by_name["packing"](spark, one, str(tmp_path)).collect(), last, 2048)
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), last, 2048)


def test_chunks_with_signs_are_encoded_together(monkeypatch):
    """Chunks that hold signs but no comma share one call with words, with the library's identifiers; long texts end a group."""
    import public_tokenizers

    from docketry.llm import packing

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    calls = []
    own = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: calls.append(texts) or own(texts))
    texts = ["don't e-mail@x.com he—said… (so)", "á ,x ， z　q\tw <unk> [CLS]", "http://a.b/c?d=1 ﬁne ½ \"no\""]
    got = list(encoder.encode_all(texts[:1] + texts[2:]))
    assert [len(c) for c in calls] == [1, 0]
    assert [list(memoryview(b).cast("I")) for b in got + list(encoder.encode_all(texts[1:2]))] == [
        encoder.library.encode(t, add_special_tokens=False).ids for t in (texts[0], texts[2], texts[1])]
    monkeypatch.setattr(packing, "TOGETHER_CHARS", 5)
    monkeypatch.setattr(packing, "TOGETHER", 3)
    assert list(packing.together(["aaaaaa", "b", "cc", "d", "e", "", "f"])) == [["aaaaaa"], ["b", "cc", "d"], ["e", "", "f"]]
