"""The pipeline stage by stage against brute force, and the toxicity model against its definition and held-out labels."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from wattloom.llm import toxicity
from wattloom.llm.common import write_table
from .conftest import DOCS, words
from .test_near_copies import brute_components, changed
from .test_operators import WORD, brute_lines, waterfill

BAD = ["idiot", "scum", "loser", "trashy", "trashes", "trashen"]


def corpus(rng):
    """Documents in three sources: toxic ones, repeated and near lines, exact and near copies, a null and an empty text."""
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(words(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4)))
        toxic = i % 6 == 0
        text += (" " + " ".join(rng.choice(BAD) for _ in range(4))) if toxic else ""
        rows.append((i, text, "en", f"src{rng.choice([0, 0, 0, 1, 2])}", len(text)))
        labels.append((i, int(toxic), 1)) if i % 4 else None
    clean = [r for r in rows if r[0] % 6]
    for k in range(30):
        own = clean[k * 5]
        copy = own[1] if k % 3 == 0 else changed(rng, own[1].replace("\n", " ") + " " + words(rng, 260), 2) if k % 3 == 1 else own[1].split("\n")[0] + "\n" + words(rng, 40)
        rows.append((300 + k, copy, "en", "src1", len(copy)))
        if k % 3 == 1:
            near = changed(rng, copy, 3)
            rows.append((400 + k, near, "en", "src0", len(near)))
    rows += [(500, None, "en", "src2", None), (501, "", "en", "src2", 0)]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, labels = corpus(random.Random(11))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, stages = spark.createDataFrame(rows, DOCS).repartition(3), dict(corpus_pipeline.STAGES)
    step = lambda name, docs: write_table(stages[name](spark, docs, str(tmp_path)), name)

    model = toxicity.fit(frame, spark.read.parquet(str(tmp_path / "labels.parquet")))
    chances = lambda text: sum(1 / (1 + math.exp(t - math.fsum(model.weights.get(f, 0.0) for w in toxicity.different_words(text) for f in toxicity.word_features(w)))) for t in model.thresholds)
    clean = step("toxicity", frame)
    want = sorted((r[:2] for r in rows if chances(r[1]) < toxicity.REJECT), key=repr)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == want
    assert len({r[0] for r in rows} - {d for d, _ in want}) >= 38 and all(d % 6 == 0 for d in {r[0] for r in rows if r[0] < 240} - {d for d, _ in want})

    lines = step("line_dedup", clean)
    left = [(d, t) for d, t, _, removed in brute_lines(want) if not removed or WORD.search(t)]
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=repr) == sorted(left, key=repr) and len(left) < len(want)

    single = step("simhash_dedup", lines)
    groups, _ = brute_components(left)
    stay = sorted(((d, t) for (d, t), (_, c) in zip(sorted(left, key=repr), groups, strict=True) if d == c), key=repr)
    assert sorted(((r.doc_id, r.text) for r in single.collect()), key=repr) == stay and len(stay) < len(left)

    mixed = step("mixing", single)
    sizes, source = Counter(), {r[0]: r[3] for r in rows}
    for d, t in stay:
        sizes[source[d]] += len(WORD.findall(t or ""))
    target = dict(zip(sorted(sizes), waterfill([sizes[s] for s in sorted(sizes)]), strict=True))
    taken, whole = Counter(), {d: len(WORD.findall(t or "")) for d, t in stay}
    by_doc = Counter()
    for r in mixed.collect():
        taken[r.source] += (n := len(WORD.findall(r.text or "")))
        by_doc[r.doc_id] += n
    assert all(abs(taken[s] - target[s]) <= max(512, 0.02 * target[s]) for s in target) and all(n <= 2 * whole[d] for d, n in by_doc.items())

    packed = step("packing", mixed).collect()
    coder, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in mixed.collect():
        ids = np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces += [(r.doc_id, k, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == sorted(pieces)
    used = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096


def test_features_and_weights_against_the_definition(spark):
    """The features are those that the counts single out, and no step along a weight or threshold raises the likelihood by much."""
    rows, labels = corpus(random.Random(12))
    frame = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    text, known = {r[0]: r[1] for r in rows}, [(d, t) for d, t, _ in labels]
    has = {d: Counter(f for w in toxicity.different_words(text[d]) for f in toxicity.word_features(w)) for d, _ in known}
    n = {t: Counter(f for d, x in known if x == t for f in has[d]) for t in (0, 1)}
    total = Counter(t for _, t in known)
    want = set()
    for f, a in n[1].items():
        odds = math.log(((a + 0.5) / (total[1] + 1)) / ((n[0][f] + 0.5) / (total[0] + 1)))
        if a >= 5 and abs(odds) >= 3.0 and abs(odds) / math.sqrt(1 / (a + 0.5) + 1 / (n[0][f] + 0.5)) >= 3.5:
            want.add(f)
    assert set(model.weights) == want and len(want) >= 6 and len(model.thresholds) == 1

    def loss(weights, t):
        out = 0.0
        for d, toxic in known:
            p = 1 / (1 + math.exp(t - sum(weights[f] * has[d][f] for f in weights if f in has[d])))
            out += math.log(max(p if toxic else 1 - p, 1e-12))
        return out / len(known) - 2e-5 / 2 * sum(w * w for w in weights.values())

    best = loss(model.weights, model.thresholds[0])
    for f in list(want)[:6]:
        for step in (-0.3, 0.3):
            assert loss(model.weights | {f: model.weights[f] + step}, model.thresholds[0]) <= best + 1e-4
    assert all(loss(model.weights, model.thresholds[0] + step) <= best + 1e-4 for step in (-0.3, 0.3))


def test_held_out_labels(spark):
    """Fitted on half of the labels of the given tables, asked about the other half: most toxic documents are found, few clean ones rejected."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = toxicity.scored(docs.join(labels.where(~half), "doc_id", "left_semi"), labels.where("false"))
    assert found.where("toxic").count() == 0
    model = toxicity.fit(docs, labels.where(half))
    asked = docs.join(labels.where(~half).withColumnRenamed("toxic", "known"), "doc_id").withColumn("hit", toxicity.severity(model, F.col("text")) >= toxicity.REJECT)
    n = {r.known: (r.hits, r.n) for r in asked.groupBy("known").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n")).collect()}
    assert n[1][0] >= 0.7 * n[1][1] and n[0][0] <= 0.02 * n[0][1]
