"""Groups of similar texts and the pipeline's near-dedup stage against a brute-force Jaccard count."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from docketry.llm import common, jaccard, overlap, simhash
from tests.llm.test_table_operators import near_copies, shingles
from tests.llm.test_text_operators import table


def similar(texts):
    """Pairs of rows of a five-word similarity of 0.8 or more; texts without a word are alike."""
    sets = [shingles(t or "") for t in texts]
    return [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
        if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b))
    ]


def kept_rows(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in similar(texts):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_the_stage_drops_every_similar_text(spark):
    texts = [*near_copies(120, seed=5, changed=3), None, "", " \n", "one", "ONE", "one two three four", "a b c d e", "a b c d f"]
    texts = [t and t.replace("ü", "u") for t in texts]
    docs = table(spark, list(enumerate(texts)))
    near = dict(corpus_pipeline.STAGES)["near-dedup"]
    got = near(spark, docs, "")
    assert got.columns == docs.columns
    left = {r.doc_id for r in got.collect()}
    assert left == kept_rows(texts) and len(left) < len(texts) - 60
    assert not similar([texts[i] for i in sorted(left)])
    assert near(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_large_groups_join_the_same_texts(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:at], "new%d" % at, *words[at + 1 :]]) for at in range(60)]
    texts += [" ".join(words), *near_copies(30, seed=2, changed=2), "lone words stay here now"]
    found = defaultdict(set)
    for r in overlap.near_duplicates(table(spark, list(enumerate(texts)))).collect():
        found[r.component_id].add(r.doc_id)
    assert set(found) == kept_rows(texts) and all(k == min(v) for k, v in found.items())
    assert sum(map(len, found.values())) == len(texts)


def test_null_and_repeated_keys(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (2, "other words are here now"), (2, "other words are here now"), (None, "a b c d e"), (9, None), (8, "")]
    kept = overlap.one_per_group(table(spark, rows))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, None, 8])


@pytest.mark.parametrize("one_per_group", [overlap.one_per_group, simhash.one_per_group])
def test_texts_that_share_a_key_are_kept_each(spark, one_per_group):
    """A key does not stand for texts of other groups, whatever rows repeat it."""
    rows = [(5, "first text of many words here"), (5, "quite another line without anything shared"), (3, "first text of many words here"),
            (7, "a third line that nobody repeats"), (7, "a third line that nobody repeats"), (7, "one more under the same number")]
    kept = one_per_group(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([rows[1], rows[2], rows[3], rows[5]])


@pytest.mark.parametrize("one_per_group", [overlap.one_per_group, simhash.one_per_group])
def test_rows_without_a_key_are_grouped_too(spark, one_per_group):
    """Of the rows of a group that have no key one stays, beside the one with the least key."""
    rows = [(None, "first text of many words here"), (None, "first text of many words here"), (None, "FIRST  text of many words here"), (None, ""), (None, None),
            (None, "quite another line without anything shared"), (4, "quite another line without anything shared"), (None, "a third line that nobody repeats")]
    kept = one_per_group(table(spark, rows)).collect()
    assert Counter((r.doc_id, (r.text or "").lower().replace("  ", " ")) for r in kept) == Counter([rows[0], (None, ""), rows[5], rows[6], rows[7]])


def test_workers_forget_what_other_operators_left():
    made = []
    for _ in range(2):
        common.worker_memory("probe", lambda: made.append(1) or len(made))
    assert made == [1]
    common.forget()
    common.forget()
    assert common.worker_memory("probe", lambda: made.append(1) or len(made)) == 2
    common.forget()
