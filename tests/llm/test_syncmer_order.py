"""Likenesses of long texts: all anchors take part, and their order decides."""

import random

import pytest

from wattloom.llm import syncmers


def long_text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_a_short_passage_in_long_texts(spark):
    rng = random.Random(5)
    passage = long_text(rng, 60)
    a, b, c = (long_text(rng, 7000) + passage + long_text(rng, 7000) for _ in range(3))
    got = {r.doc_id: r for r in syncmers.compare_edited(spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")).collect()}
    for i, (x, y) in {1: (a, b), 2: (b, c), 3: (c, a)}.items():
        m, n = set(syncmers.marks(x).tolist()), set(syncmers.marks(y).tolist())
        assert len(m & n) > 40 and 0 < got[i].near_next <= len(m & n) / len(m | n) + 1e-3
        assert got[i].near_next == pytest.approx(len(m & n) / len(m | n), rel=0.2)


def test_order_decides():
    rng = random.Random(6)
    x, y = long_text(rng, 400), long_text(rng, 400)
    there, back = syncmers.marks(x + " " + y), syncmers.marks(y + " " + x)
    assert syncmers.likeness(there, there) == 1
    assert 0.3 < syncmers.likeness(there, back) < 0.4  # one of the halves


def test_in_order_against_all_pairs():
    rng = random.Random(7)
    for _ in range(50):
        a = rng.sample(range(40), 30)
        b = rng.sample(range(40), 30)
        best = [[0] * 31 for _ in range(31)]
        for i in range(30):
            for j in range(30):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert syncmers.in_order(syncmers.np.array(a, "uint64"), syncmers.np.array(b, "uint64")) == best[30][30]
