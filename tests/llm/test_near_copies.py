"""Near copies of the pipeline against brute force over all pairs of texts."""

import random

import pytest

from wattloom.llm import near_copies, simhash
from .test_operators import ASCII, WORD


def brute_components(rows, least=0.8, k=5):
    def grams(text):
        w = WORD.findall((text or "").translate(ASCII))
        return frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)) if w else frozenset()

    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    between = 0
    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not all_ or both >= least * all_ - 1e-9:
                between += all_ > 0 and both < 0.9 * all_
                root[find(i)] = find(j)
    parts = {}
    for i in range(len(rows)):
        parts.setdefault(find(i), []).append(rows[i][0])
    ids = {p: min((x for x in m if x is not None), default=None) for p, m in parts.items()}
    return sorted(((r[0], ids[find(i)]) for i, r in enumerate(rows)), key=repr), between


def changed(rng, text, n):
    """The text with n words replaced."""
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_rows(rows):
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    out, at = [r[:2] for r in rows], 1000
    for size, edits in [(150, 3), (200, 3), (300, 5), (300, 6), (400, 8), (60, 1), (40, 1), (1200, 20), (7, 1)] * 8:
        base = fresh(size)
        out += [(at, base), (at + 1, changed(rng, base, edits))]
        at += 2
    # more than SMALL texts with one passage; near copies of three originals among them
    passage = fresh(60)
    for _ in range(90):
        out.append((at, passage + " " + fresh(18)))
        at += 1
    chain = fresh(220)
    for _ in range(90):
        out.append((at, chain))
        at, chain = at + 1, changed(rng, chain, 4)
    return out


def test_near_copies_are_whole(spark, near_rows, monkeypatch):
    frame = spark.createDataFrame(near_rows, "doc_id long, text string").repartition(3)
    want, between = brute_components(near_rows)
    assert between > 30
    got = near_copies.near_duplicates(frame).select("doc_id", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    monkeypatch.setattr(near_copies, "SMALL", 4)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    again = near_copies.near_duplicates(frame.coalesce(1)).select("doc_id", "component_id")
    assert sorted(map(tuple, again.collect()), key=repr) == want


def test_unrelated_texts_without_an_id_or_with_one_id_stay(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(50)) for _ in range(5)]
    rows = list(zip([None, None, 5, 5, 6], texts, ["a", "b", "c", "d", "e"], strict=True)) + [(6, texts[4], "e"), (7, texts[0], "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, group string")
    for found in (near_copies.near_duplicates(frame), simhash.near_duplicates(frame, shingle=5)):
        out = simhash.first_of_each(frame, found)
        assert out.columns == frame.columns
        assert sorted(map(tuple, out.collect()), key=repr) == sorted([(None, texts[1], "b"), *rows[2:5], (7, texts[0], "f")], key=repr)


def test_pipeline_drops_copies_at_four_fifths(spark):
    """Pairs with a Jaccard similarity of 0.8 to 0.9, which fingerprints within 4 bits mostly miss."""
    import corpus_pipeline

    rng, rows = random.Random(3), []
    for i in range(40):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
        rows += [(2 * i, base), (2 * i + 1, changed(rng, base, 5))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, frame, "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 80, 2))
    assert simhash.one_of_each(frame, shingle=5, bits=4).count() > 60


def test_near_copies_of_nothing(spark, none):
    assert near_copies.near_duplicates(none).count() == 0
