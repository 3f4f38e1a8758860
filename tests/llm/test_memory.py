"""What a Python worker holds at once."""

import subprocess
import sys

import public_tokenizers
from wattloom.llm import packing
from wattloom.llm.common import BATCH, write_table

GROWTH = """
import random, re
import numpy, pyarrow
from wattloom.llm.tokenizing import encoder
def held(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
encode = encoder(PATH, False)
list(encode(["warm up"]))
before, rng = held("VmRSS"), random.Random(1)
texts = (" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(2000)) for _ in range(300))
print(sum(len(x) > 0 for x in encode(texts)), held("VmHWM") - before)
"""


def test_encoder_holds_little_of_words_that_come_once():
    done = subprocess.run([sys.executable, "-c", f"PATH = {public_tokenizers.path('word_bpe_49k.json')!r}\n{GROWTH}"], capture_output=True, text=True, check=True)
    texts, mb = map(int, done.stdout.split())
    assert texts == 300 and mb < 100


def test_batches_of_texts_are_small(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(BATCH)
    rows = spark.range(0, 5000, 1, 1)
    assert sorted(r.n for r in write_table(rows.mapInArrow(sizes, "n long"), "sizes", 400).collect())[-1] == 400
    assert spark.conf.get(BATCH) == before
    assert write_table(rows.mapInArrow(sizes, "n long"), "sizes").count() == 1


def test_packing_reads_texts_in_small_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "write_table", lambda df, name, batch=None: seen.append(batch) or write_table(df, name, batch))
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert packing.pack_pieces(pieces).count() == 2 and seen == [packing.TEXTS]
