"""Every operator against brute force on small tables with all the odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from .conftest import DOCS, words
from wattloom.llm import ann, components, line_dedup, mixing, packing, simhash, suffix_dedup, suffix_tree, syncmers, token_files, tokenizing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 1 suffix tree
def test_suffix_tree_counts_and_probabilities(docs, rows):
    got = suffix_tree.score(docs, chunk=4000).collect()
    tokens = [(r[0], WORD.findall((r[1] or "").translate(ASCII)) + ["\n"]) for r in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in tokens if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((i if i is not None else -1, out(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    trained = [r for r in got if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def brute_scores(texts, depth, least, divergence, discount=0.75):
    """log10 probabilities by a tree that is kept in a dictionary, word by word; texts: (doc_id, words)."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    after = {}
    for i, t in texts:
        for k in range(len(t) if not out(i) else 0):
            for n in range(min(k, depth) + 1):
                after.setdefault(tuple(t[k - n : k]), Counter())[t[k]] += 1
    root = after.get((), Counter())
    total = sum(root.values())
    stays = {}

    def chance(word, context):
        if not context:
            return (root[word] + 1) / (total + len(root) + 1)
        p = chance(word, context[1:])
        c = after.get(context, Counter())
        n = sum(c.values())
        if context not in stays:
            logs = sum(m * round(math.log(chance(w, context[1:])) * 4096) / 4096 for w, m in c.items())
            stays[context] = n >= least and (sum(m * math.log(m) for m in c.values()) - logs) / n - math.log(n) >= divergence
        return max(c[word] - discount, 0) / n + discount * len(c) / n * p if stays[context] else p

    return sorted((i if i is not None else -1, round(sum(math.log10(chance(t[k], tuple(t[max(0, k - depth) : k]))) for k in range(len(t))), 6)) for i, t in texts), sum(stays.values())


@pytest.mark.parametrize("depth,least,divergence", [(1, 1, 0.0), (2, 2, 0.05), (3, 3, 0.4)])
def test_suffix_tree_scores(spark, docs, rows, monkeypatch, depth, least, divergence):
    rng = random.Random(depth)
    more = [(1000 + i, " ".join(rng.choice(["the", "a", "of", *"bcdefgh"]) for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(120)]
    frame = docs.unionByName(spark.createDataFrame(more, DOCS))
    want, kept = brute_scores([(r[0], WORD.findall((r[1] or "").translate(ASCII)) + ["\n"]) for r in rows + more], depth, least, divergence)
    assert kept > 50
    for hot in (suffix_tree.HOT, 0.02):  # the second: frequent contexts are dealt to several buckets
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        got = suffix_tree.score(frame, depth=depth, least=least, divergence=divergence, chunk=5000)
        assert sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 6)) for r in got.collect()) == want


def test_suffix_tree_does_not_depend_on_chunks(docs, none):
    a = sorted((r.doc_id or -1, round(r.score, 6)) for r in suffix_tree.score(docs, chunk=1000).collect())
    assert a == sorted((r.doc_id or -1, round(r.score, 6)) for r in suffix_tree.score(docs.coalesce(1), chunk=10**7).collect())
    assert suffix_tree.score(none).count() == 0


def test_suffix_tree_prefers_what_it_has_seen(spark):
    """All next words and the unknown one have probabilities that sum to 1: in a text of one word after 'a', for every word."""
    train = ["a b", "a b", "a c", "b a c", "a b c"] * 30
    base = [(7 * i, t) for i, t in enumerate(train * 3) if zlib.crc32(str(7 * i).encode()) % 7 != 2]
    ask = [i for i in range(100000, 100400) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    texts = ["a a", "a b", "a c", "a", "a zzz"]
    frame = spark.createDataFrame(base + list(zip(ask, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree.score(frame, least=1, divergence=0.0).collect()}
    one = {t: 10 ** got[i] for i, t in zip(ask, texts, strict=True)}
    first = one["a"]  # 'a', then the end; the others: 'a', a word, then the end
    assert first > 0 and one["a b"] > one["a zzz"]


def test_suffix_tree_exchanges_no_chunks(spark, docs):
    """What is exchanged at a level are questions and answers; the chunks (ids, words, hashes) stay in their buckets."""
    plan = suffix_tree.score(docs, chunk=4000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Bucketed: true" in plan
    assert "hashes" not in plan.split("Exchange", 1)[1]


# --- 2 packing
def test_packing(docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_pieces(packing.token_pieces(docs, path, 1, 256), 256, shard_pieces=40).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if r[0] is None else r[0], k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack_pieces(packing.token_pieces(none, path), 4096).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pack_is_tight(seed):
    lengths = np.random.default_rng(seed).integers(1, 4097, 2000) if seed else np.random.default_rng(9).lognormal(6.5, 1, 3000).clip(1, 4096).astype(int)
    where, offset = packing.pack(lengths, 4096)
    assert np.bincount(where, weights=lengths).max() <= 4096
    bound = max(-(-lengths.sum() // 4096), (lengths > 2048).sum())
    assert where.max() + 1 <= 1.03 * bound + 1


def test_tokens_are_exact(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = ["", " ", "a  b", "a\n\nb", " lead", "tail \n", "Hello, world. It's 12,5 o'clock.", "x*, y", "é́ ö", "Σας ΟΔΟΣ", "<|endoftext|> in", "a b", "tab\tbed", "end.", "a_. b", "\0x", "1. 2, 3.", "x" * 300 + " y", "a\u3000b c", "a\u2028b", "é\x85b", "a\x1cb c"]
    texts += ["".join(rng.choice("abcé .,\n'1*#_") for _ in range(80)) for _ in range(300)] + [words(rng, 50) + ", " + words(rng, 9) + ".\n" + words(rng, 3) for _ in range(50)]
    for name, keeps in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        for group in (1 << 21, 200):  # in groups of any size
            monkeypatch.setattr(tokenizing, "GROUP", group)
            assert [x.tolist() for x in tokenizing.encoder(public_tokenizers.path(name), keeps)(texts)] == want


def test_a_piece_is_looked_up_once_for_a_group_of_texts(monkeypatch):
    from tokenizers import Tokenizer

    texts, asked, numbers = ["one two one, two.", "", "two one\ntwo", "a  b"] * 30, [], tokenizing._Memory.numbers
    monkeypatch.setattr(tokenizing._Memory, "numbers", lambda self, pieces, n: asked.append(list(pieces)) or numbers(self, asked[-1], n))
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizing.encoder.cache_clear()
    got = [x.tolist() for x in tokenizing.encoder(path, True)(texts)]
    tokenizing.encoder.cache_clear()
    assert got == [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert asked and all(len(x) == len(set(x)) for x in asked)


# --- 3 line dedup
def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows, near=near):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    places = {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if norm(line):
                places.setdefault(norm(line), []).append((doc, k))
    firsts = {x: min(p) for x, p in places.items()}
    keep = {firsts[x] for x in firsts if not any(firsts[y] < firsts[x] and near(x, y) for y in firsts if y != x)}
    out = []
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for k, x in enumerate(lines) if not norm(x) or (doc, k) in keep]
        out.append((doc, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def test_line_dedup(spark, none):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd") for _ in range(n)) for n in (20, 21, 63, 64, 65, 66, 127, 128, 129, 300, 40, 40)]
    rows, lines = [], []
    for x in base:
        lines.append(x)
        for _ in range(12):
            k = rng.choice([0, len(x) - 1, len(x) // 2, rng.randrange(len(x)), min(64, len(x) - 1), min(63, len(x) - 1)])
            lines.append(rng.choice([x[:k] + x[k + 1 :], x[:k] + "z" + x[k:], x[:k] + "y" + x[k + 1 :], x + "w", x[1:], x.upper(), "  " + x.replace("a", "a", 1)]))
    rng.shuffle(lines)
    for i in range(0, len(lines), 3):
        rows.append((i, "\n".join([*lines[i : i + 3], "", "short", lines[0] if i % 9 == 0 else "x"])))
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "\n\n"), (10**6 + 3, "word  \t " * 9 + "\nword word word word word word word word word")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit(1)).withColumn("n_chars", F.lit(2)).repartition(3)
    got = line_dedup.dedup_lines(frame)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr) == brute_lines(rows)
    assert got.columns == ["doc_id", "text", "keep", "n_chars", "n_lines", "n_removed"]
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_takes_short_lines_and_other_bounds(spark, monkeypatch):
    """Lines of one to a few characters take part like any other, and the bound is a parameter."""
    rng = random.Random(6)
    rows = [(i, "\n".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 7, 9, 12, 13]))) for _ in range(4))) for i in range(40)]
    rows += [(100 + i, x[1].replace("a", "hb")) for i, x in enumerate(rows[:20])] + [(200, "same 15 letters\n\n \t"), (201, "same 15 letters"), (202, "Same 15  letters\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(line_dedup, "HOT", 3)
    for bound, apart in ((1, near), (2, lambda a, b: edits(a, b) <= 2), (3, lambda a, b: edits(a, b) <= 3)):
        got = line_dedup.dedup_lines(frame, bound=bound).collect()
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=repr) == brute_lines(rows, apart), bound


def test_lines_that_share_a_piece_with_few_make_no_variants(spark, monkeypatch):
    """Such lines are compared two by two; only those of a crowded piece make a row per character, and none is lost between the two."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    alone, crowd, asked = [word(30) for _ in range(20)], word(20), []
    lines = [*alone, *[x[:-1] + "z" for x in alone], *[crowd + word(20) for _ in range(30)]]
    lines += [lines[-1][:-3] + "z" + lines[-1][-2:], "\u00c9T\u00c9\tet  \u03a3\u03a3", "\u00e9t\u00e9 et \u03c3\u03c2"]
    rows = [(i, "\n".join(lines[i::7])) for i in range(7)]
    made = line_dedup._partners_of_one
    monkeypatch.setattr(line_dedup, "_partners_of_one", lambda texts, window: asked.append(texts.count()) or made(texts, window))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=repr) == brute_lines(rows)
    assert asked == [31] and sum(r.n_removed for r in got) >= 22


def test_line_dedup_odd_rows(docs, rows):
    got = line_dedup.dedup_lines(docs)
    assert got.count() == len(rows)
    assert got.where("doc_id is null and text is null").count() == 0
    assert got.where("doc_id = 64 and text is null and n_lines = 0").count() == 1
    assert got.where("doc_id = 60").select("n_removed").head()[0] > 0


# --- 4 suffix dedup
def brute_repeats(rows, width=50):
    rows = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in rows:
        for i in range(len(b) - width + 1):
            least[b[i : i + width]] = min(d, least.get(b[i : i + width], d))
    out = []
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < d:
                gone[i : i + width] = True
        edge = gone & ~np.append(False, gone[:-1]) if len(b) else gone
        out.append((None if d == 2**63 - 1 else d, len(b), int(gone.sum()), int(edge.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def repeats(frame, **how):
    return table(suffix_dedup.remove_repeats(frame, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)))


def test_suffix_dedup(spark, docs, rows, none):
    assert repeats(docs, chunk=3000) == brute_repeats([r[:2] for r in rows])
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_hot_passage(spark):
    """A passage in every document, from different places to different places, and long runs of one letter; limits of ranges fall inside."""
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = []
    for i in range(200):
        own = "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randint(0, 100)))
        rows.append((i // 2 * 2 if i % 50 == 0 else i, own + passage[rng.randint(0, 60) : rng.randint(50, 120)] + own[::-1] + ("a" * rng.randint(0, 130) if i % 3 == 0 else "")))
    rows += [(5002, "x" * 49), (5003, "x" * 50), (5004, "x" * 51), (5005, "é" * 40), (5006, "é" * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert repeats(frame, chunk=2000) == brute_repeats(rows)


def test_merge_of_runs():
    rng = random.Random(3)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        shared = [suffix_dedup._shared(np.array([list(x) for x in r], np.uint8).reshape(len(r), 12)).tolist() for r in runs]
        run, lengths = suffix_dedup.merge_runs(runs, shared, 12)
        at, out = [0] * k, []
        for r in run:
            out.append(runs[r][at[r]])
            at[r] += 1
        assert out == sorted(x for r in runs for x in r)
        assert lengths[1:] == suffix_dedup._shared(np.array([list(x) for x in out], np.uint8).reshape(len(out), 12)).tolist()[1:]


# --- 5 neighbours
def test_merge_reads_long_copies_at_once():
    read = []

    class Counted(bytes):
        def __getitem__(self, at):
            read.append(at)
            return super().__getitem__(at)

    rng = random.Random(7)
    text = bytes(rng.randrange(97, 100) for _ in range(75))
    runs = [[Counted(text)] for _ in range(8)] + [[]]
    assert suffix_dedup.merge_runs(runs, [[0]] * 8 + [[]], 75) == (list(range(8)), [0] + [75] * 7)
    assert len(read) <= 4 * 7  # by single bytes: 150 for each of the 7


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:420] = x[300]  # one very common vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1100, [0.0] * 8), (1200, [1.0] * 7 + [None]), (1300, [1.0] * 7 + [float("nan")]), (1400, [1.0] * 7 + [float("inf")]), (1500, [1.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = ann.search(frame, cells=4, block=50, trial=9).collect()
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(900) if i != q)[:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
        hits += len({i for _, i in want} & {r.vec_id for r in own})
    assert hits >= 0.9 * 90 and {r.query_id for r in got} == set(range(0, 900, 100))
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert ann.search(few).count() == 3


def test_neighbours_of_repeated_queries_and_odd_lengths(spark):
    """A query that is there twice asks once; different vectors under one id ask one by one; other lengths are compared among themselves."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6)).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    short = [(i, [float(v) for v in rng.normal(size=3)]) for i in (500, 501, 502, 503, 600)]
    other = (0, [float(v) for v in x[5] + 1])
    frame = spark.createDataFrame([*rows, rows[0], rows[0], rows[9], other, *short, short[0]], "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(frame, recall=1.0).collect()
    ask = lambda q: sorted((math.dist(q, v), i) for i, v in [*rows, rows[9]] if i != 0)[:10]
    want = [(0, k + 1, i, d) for q in (rows[0][1], other[1]) for k, (d, i) in enumerate(ask(q))]
    for q, v in (short[0], short[4]):
        near = sorted((math.dist(v, w), i) for i, w in [*short, short[0]] if i != q)
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    shown = lambda rows: sorted((q, k, i, round(d, 9)) for q, k, i, d in rows)
    assert shown((r.query_id, r.rank, r.vec_id, r.score) for r in got) == shown(want)


def test_candidates_of_a_query_do_not_grow_with_the_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    assert 12 * 10 <= ann.candidates(frame, cells=16, shards=3, recall=1.0).count() <= 12 * 3 * 10  # a list per shard, not per pair


def test_neighbours_of_nothing(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 6 mixing
def waterfill(sizes):
    weights, total = [(3, 1, 2)[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes)
    target, full = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(2 * sizes[k] for k in full)
        free = sum(w for k, w in enumerate(weights) if k not in full)
        target = [2 * s if k in full else rest * weights[k] / free for k, s in enumerate(sizes)]
        more = {k for k, s in enumerate(sizes) if target[k] > 2 * s}
        if not more:
            return target
        full |= more


def test_mixing(docs, rows, none):
    got = mixing.mix(docs, block_words=8).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = dict(zip(names, waterfill([sizes[s] for s in names]), strict=True))
    for s in names:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(8, 0.01 * want[s])
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(docs.repartition(7), block_words=8)
    assert sorted(r.taken for r in got) == sorted(r.taken for r in again.collect())
    assert mixing.mix(none).count() == 0


def test_mixed_documents(docs):
    taken = sum(r.taken for r in mixing.mix(docs, block_words=8).collect())
    out = mixing.mixed_documents(docs, block_words=8)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in out.collect()) == taken


def test_mixed_documents_keep_columns_of_any_name(docs):
    names = ["_size", "_order", "_times", "_no", "_at", "_shard", "_text", "_row", "_words", "_spans"]
    odd = docs.withColumns({c: F.concat_ws("-", F.lit(c), "doc_id") for c in names})
    out = mixing.mixed_documents(odd, block_words=8)
    assert out.columns == odd.columns
    assert sorted(map(tuple, out.select(docs.columns).collect()), key=repr) == sorted(map(tuple, mixing.mixed_documents(docs, block_words=8).collect()), key=repr)
    assert all(r[c] == (f"{c}-{r.doc_id}" if r.doc_id is not None else c) for r in out.collect() for c in names)


def test_sainte_lague(spark):
    rng = random.Random(8)
    for _ in range(5):
        votes, seats = [rng.randrange(1, 1000) for _ in range(9)], rng.randrange(0, 60)
        won = Counter()
        for _ in range(seats):
            won[max(range(9), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))] += 1
        frame = spark.createDataFrame([(1, k, float(v), seats) for k, v in enumerate(votes)], "g int, k int, v double, s long")
        assert {r.k: r.q for r in mixing.apportion(frame, ["g"], "k", "v", "s", "q").collect()} == {k: won[k] for k in range(9)}


# --- 7 simhash
def brute_fingerprint(text, n=4):
    import xxhash

    w = WORD.findall((text or "").translate(ASCII))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(spark, docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.fp & (2**64 - 1)) for r in got) == sorted((r[0] or -1, brute_fingerprint(r[1])) for r in rows)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_components(spark, rows):
    """component_id of real texts against all pairs, with changed copies among them, and null and repeated ids."""
    rng = random.Random(21)
    long = [words(rng, 900) for _ in range(6)]
    more = [(200 + 10 * i + k, t if k == 0 else t + " " + words(rng, k)) for i, t in enumerate(long) for k in range(4)]
    own = [(r[0], r[1]) for r in rows] + more
    fps = [brute_fingerprint(t) for _, t in own]
    root = list(range(len(own)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    linked = 0
    for i in range(len(own)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                linked += fps[i] != fps[j]
                root[find(i)] = find(j)
    assert linked > 3
    groups = {}
    for i in range(len(own)):
        groups.setdefault(find(i), []).append(own[i][0])
    want = [(own[i][0], min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(own))]
    for parts in (None, 3):
        got = simhash.near_duplicates(spark.createDataFrame(own, "doc_id long, text string").repartition(3), parts=parts)
        assert sorted(map(tuple, got.select("doc_id", "component_id").collect()), key=repr) == sorted(want, key=repr)
    assert [simhash.cheapest_parts(n, 4) for n in (10**5, 10**7, 10**11)] == [4, 3, 2]


def test_rows_of_fingerprints_grow_with_them(spark, monkeypatch):
    """Five times the fingerprints make five times the rows that meet in tasks, also where many share frequent values."""
    rng = random.Random(8)
    made, kind = [], type(spark.range(0))
    repartition = kind.repartition

    def counted(self, *by):
        if "key" in by:
            made.append(self.count())
        return repartition(self, *by)

    def rows_made(n, bits):
        fps = rng.sample(range(2**bits), n)
        frame = spark.createDataFrame([(f,) for f in fps], "fp long")
        made.clear()
        with monkeypatch.context() as m:
            m.setattr(kind, "repartition", counted)
            simhash.link_fingerprints(frame)
        return made[0]

    assert rows_made(100_000, 62) == 5 * rows_made(20_000, 62)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert rows_made(20_000, 32) <= 6 * rows_made(4000, 32)  # of 64 bits half are the same in all


@pytest.mark.parametrize("bits,parts", [(4, 3), (4, 2), (3, 3), (6, 4)])
def test_links_are_whole(spark, bits, parts):
    rng = random.Random(bits * 10 + parts)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = set(centres)
    for c in centres[:8]:
        x = c
        for _ in range(30):
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            x = rng.choice([x, c])
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.link_fingerprints(frame, bits, parts)).collect()}
    root = {f: f for f in signed}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                p, q = find(signed[i]), find(signed[j])
                root[max(p, q)] = min(p, q)
    assert {f: got.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_one_of_each(docs):
    out = simhash.one_of_each(docs, shingle=5)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and 3 in ids and 60 not in ids and ids.count(7) == 1


# --- 8 token files
def test_token_files(spark, docs, distinct_rows, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame(distinct_rows, DOCS).repartition(3)
    token_files.write_token_files(frame, str(tmp_path / "t"), path, samples=40, dictionary_size=2048, shard_docs=7)
    got = sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect())
    t, at, want = Tokenizer.from_file(path), 0, []
    for r in sorted(distinct_rows, key=lambda r: r[0]):
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], at, len(ids), ids.tobytes()))
        at += len(ids)
    assert got == want
    assert token_files.round_trip(none, path).count() == 0


def test_token_files_are_cut_by_bytes_and_read_by_document(spark, docs, rows, tmp_path, monkeypatch):
    """Point reads through the index, with null and repeated ids in shards of a few hundred bytes."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "RANGE", 5000)
    token_files.write_token_files(docs, str(tmp_path / "t"), path, samples=40, dictionary_size=2048, shard_bytes=600)
    shards = spark.read.parquet(str(tmp_path / "t/shards"))
    assert shards.count() > 12 and shards.where("docs > 1 and length(image) > 3000").count() == 0
    t = Tokenizer.from_file(path)
    want = sorted(((r[0], np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows), key=repr)
    whole = token_files.read_token_files(spark, str(tmp_path / "t")).collect()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in whole), key=repr) == want
    at = 0
    for r in sorted(whole, key=lambda r: r.start):
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    some = [7, 9, 62, 64, 66, 12345]
    got = token_files.read_documents(spark, str(tmp_path / "t"), some).collect()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == [x for x in want if x[0] in some]


# --- 9 toxicity
def test_toxicity(spark, none):
    rng = random.Random(7)
    bad = ["idiot", "scum", "loser", "trashy", "trashes", "trashen"]
    rows, labels = [], []
    for i in range(400):
        text = words(rng, 40)
        toxic = i % 5 == 0
        if toxic:
            text += " " + " ".join(rng.choice(bad) for _ in range(rng.randrange(1, 6))).title() + "!"
        rows.append((i, text if i != 33 else None))
        if i % 10 < 8:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (99999, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic_x", F.lit(1))
    known = spark.createDataFrame([(*x, int(x[0] is None or x[0] % 3 > 0)) for x in labels], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.scored(frame, known).collect()}
    rest = [i for i in range(400) if i % 10 >= 8]
    assert not any(got[i].toxic for i in rest)
    assert sum(got[i].toxic for i in range(0, 400, 5)) >= 78
    assert all(0 <= r.severity <= 2 for r in got.values()) and got[33].severity < toxicity.REJECT
    assert toxicity.scored(none, known).count() == 0
    clean = toxicity.scored(frame, known.where("toxic = 0"))
    assert clean.where("severity > 0").count() == 0


def test_severity_is_the_sum_of_the_chances(spark):
    """Against the formula, word by word, with weights and thresholds as given; grades come from the labels."""
    model = toxicity.Model({toxicity.word_features("awful")[0]: 2.0, toxicity.word_features("awful")[1]: 0.5, toxicity.word_features("kind")[0]: -3.0}, [1.0, 2.5])
    for text, x in (("Awful, awful thing", 2.5), ("kind words", -3.0), ("awfully kind", 0.5 - 3.0), ("", 0.0), (None, 0.0)):
        assert abs(model.severity(text) - sum(1 / (1 + math.exp(t - x)) for t in (1.0, 2.5))) < 1e-12
    docs = spark.createDataFrame([(i, "vile " * (i % 4 == 0) + f"w{i}") for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) as toxic", "int(doc_id % 8 > 0) as quality", "'x' as severity")
    model = toxicity.fit(docs, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1] and model.severity("vile") > 1 > toxicity.REJECT > model.severity("w1")
    assert len(toxicity.fit(docs, labels.drop("quality")).thresholds) == 1
    out = toxicity.scored(docs.withColumns({"toxic": F.lit("mine"), "severity": F.lit("mine")}), labels)
    assert dict(out.dtypes)["toxic"] == "boolean" and out.columns == ["doc_id", "text", "toxic", "severity"]


def test_ordered_grades():
    rng = np.random.default_rng(1)
    x = [(np.array([0, 1]), np.array([a, 1.0])) for a in rng.normal(size=800)]
    y = np.digitize([2 * v[0] + rng.logistic() for _, v in x], [0, 2, 4])
    w, t = toxicity._fit(x, y, 2, ridge=1e-6)
    assert (np.diff(t) > 0).all() and abs(w[0] - 2) < 0.5 and abs((t[1] - t[0]) - 2) < 0.5


# --- 10 syncmers
def brute_hash(x):
    """The hash of a substring, in whole numbers modulo 2^64."""
    h, top = 0, 2**64
    for c in x:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % top
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 % top
    return h ^ h >> 29


def brute_anchors(text, k=15, s=5):
    """Closed syncmers k-mer by k-mer."""
    found = []
    for i in range(len(text) - k + 1):
        inner = [brute_hash(text[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(text[i : i + k])
    return found


def brute_likeness(a, b):
    """Anchors matched in order by dynamic programming over the n-th occurrences."""

    def numbered(text):
        seen = Counter()
        out = []
        for x in brute_anchors(text):
            seen[x] += 1
            out.append((x, seen[x]))
        return out or [(text, 0)]

    if not a or not b:
        return float(a == b)
    x, y = numbered(a), numbered(b)
    where = {m: j for j, m in enumerate(y)}
    tails = []
    for j in (where[m] for m in x if m in where):
        at = next((i for i, t in enumerate(tails) if t >= j), len(tails))
        tails[at : at + 1] = [j]
    return len(tails) / (len(x) + len(y) - len(tails))


def brute_print(text):
    """All anchors' hashes in order; a text without any has one of its own."""
    found = brute_anchors(text)
    if text and not found:
        return hashlib.blake2b(text.encode(), digest_size=4).hexdigest()
    return "".join(f"{brute_hash(x) >> 32:08x}" for x in found)


def test_syncmers(spark, distinct_rows, docs, none):
    frame = spark.createDataFrame(distinct_rows, DOCS).repartition(5)
    got = sorted(syncmers.compare_edited(frame).collect(), key=lambda r: r.doc_id)
    ordered = sorted(distinct_rows, key=lambda r: r[0])
    for r, own, after in zip(got, ordered, [*ordered[1:], ordered[0]], strict=True):
        text, following = own[1] or "", after[1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (own[0], len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute_print(text), brute_print(edited))
        assert r.near_edited == syncmers.likeness(syncmers.marks_of(r.fingerprint), syncmers.marks_of(r.edited_fingerprint))
        assert abs(r.near_next - brute_likeness(text, following)) < 1e-12 and abs(r.near_edited - brute_likeness(text, edited)) < 1e-12
    odd = docs.unionByName(spark.createDataFrame([(None, f"no id {i} " + "abc " * i, "en", "s", 1) for i in range(40)] + [(7, f"same id {i} " + "xyz " * i, "en", "s", 1) for i in range(40)], DOCS))
    for per in (4000, 5):  # the second: the documents without an id, and those with id 7, have several ranges
        pairs = syncmers.successors(odd, lambda a, b: {"doc_id": a[0], "own": a[1], "next_id": b[0], "next": b[1]}, "doc_id long, own string, next_id long, next string", per=per).collect()
        texts = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h")).collect()
        ordered = [(r.doc_id, r.text) for r in sorted(texts, key=lambda r: (2**63 if r.doc_id is None else r.doc_id, r.h))]
        assert sorted(map(tuple, pairs), key=repr) == sorted(((*a, *b) for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True)), key=repr)
    assert syncmers.compare_edited(none).count() == 0
    one = syncmers.compare_edited(frame.where("doc_id = 3")).head()
    assert one.near_next == 1


def test_anchors_are_closed_syncmers():
    text = words(random.Random(6), 300)
    k, s = 15, 5
    places, hashes = syncmers.anchors(text, k, s)
    codes = np.array([ord(c) + 1 for c in text], np.uint64)
    inner = syncmers._hashes(codes, s)
    want = [i for i in range(len(text) - k + 1) if inner[i : i + k - s + 1].min() in (inner[i], inner[i + k - s])]
    assert places.tolist() == want
    shifted = syncmers.anchors("xyz " + text, k, s)[0]
    assert set(places + 4) <= set(shifted.tolist())  # what stands before moves no anchor


# --- the pipeline
def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        from wattloom.llm.common import write_table

        out = write_table(stage(spark, seen, sf), name)
        if k < 4:
            assert out.columns == docs.columns, name
        if name in ("toxicity", "simhash_dedup"):
            assert out.join(seen, ["doc_id", "text"], "left_anti").count() == 0
        seen = out
    assert seen.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def odd_documents(rows):
    return [(*r, f"u{i}", i) for i, r in enumerate(rows)], DOCS + ", _size string, rows long"


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "simhash_dedup", "mixing", "packing"])
def test_every_stage_with_odd_rows(spark, rows, tmp_path, name):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names, and no rows."""
    import corpus_pipeline

    data, schema = odd_documents([*rows, rows[3], rows[3], (None, None, None, None, None), (None, "another without an id " + " ".join(reversed(rows[8][1].split())), None, "src0", None)])
    spark.createDataFrame([(1, 0, 0), (3, 1, 1), (68, 1, 1), (None, 1, None), (5, None, 0)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.createDataFrame(data, schema).repartition(3)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, frame, str(tmp_path))
    got = out.collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {r[0] for r in data} and len({(r.doc_id, r.piece, r.ids_crc32, r.sequence_id, r.offset) for r in got}) == len(got)
    else:
        assert out.columns == frame.columns
        marks = Counter(r["_size"] for r in got)
        assert set(marks) <= {r[5] for r in data} and all(r.rows == int(r["_size"][1:]) for r in got)
        if name == "mixing":
            assert max(marks.values()) <= 3
        else:
            assert max(marks.values()) == 1
        if name == "line_dedup":
            assert sum(r.text is None for r in got) == sum(r[1] is None for r in data)
        if name == "simhash_dedup":  # documents that differ stay, whatever their ids
            assert sum((r.text or "").startswith(("no id here", "another without")) for r in got) == 2 and sum(r.text == rows[3][1] for r in got) == 1
    assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0


def test_limits_of_ranges_from_few_samples(spark):
    """Fewer samples than ranges: each limit comes once, and only anchors with several different limits are left uncut."""
    from wattloom.llm.chunks import pack_chunks

    rng = random.Random(12)
    frame = spark.createDataFrame([(i, words(rng, 200)) for i in range(60)], "doc_id long, text string").repartition(4)
    chunks = pack_chunks(frame, 2000)
    n, width, k = chunks.count(), 50, 25
    for most in (100_000, 5):
        limits = suffix_dedup._limits(chunks, n, 64, width, k, most=most)
        assert limits == sorted(set(limits)) and all(len(x) == 2 * width - k for x in limits)
        assert sum(x[k:] != bytes(width) for x in limits) <= 2


def test_lines_of_a_very_long_text(spark):
    """Some 60,000 lines of one document, a third of them copies; the time grows with the lines, not with their square."""
    rng = random.Random(31)
    lines = [f"line {rng.randrange(10**9)} of many {i}" if i % 3 else f"copy {i // 3 % 500} of a line" for i in range(60_000)]
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, lines[1] + "\nnew")], "doc_id long, text string")).orderBy("doc_id").collect()
    left, first = got[0].text.split("\n"), dict.fromkeys(lines)
    assert got[0].n_lines == 60_000 and got[1].text == "new"
    assert [x for x in left if x.startswith("line")] == [x for x in first if x.startswith("line")]
    assert "copy 0 of a line" in left and len(left) == len(set(left)) == got[0].n_lines - got[0].n_removed


def test_ten_thousand_documents_are_asked_for(spark, tmp_path):
    frame = spark.createDataFrame([(3 * i, f"text number {i} of some") for i in range(300)], "doc_id long, text string")
    token_files.write_token_files(frame, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), samples=20, dictionary_size=1024, shard_docs=9)
    for asked in (list(range(10_000)), [0, 3, 897, 4, -5], []):
        got = sorted(r.doc_id for r in token_files.read_documents(spark, str(tmp_path / "t"), asked).collect())
        assert got == sorted(x for x in set(asked) if x % 3 == 0 and 0 <= x < 900)
