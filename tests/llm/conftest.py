import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(1 + rng.randrange(size) % 5)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, ties and repeated rows."""
    rng = random.Random(4)
    out = []
    for i in range(60):
        lines = [words(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))]
        out.append((i, "\n".join(lines), "en", f"src{i % 3}", None))
    long = words(rng, 6000)
    out += [(60, out[3][1], "en", "src0", None), (61, out[5][1] + " more", "en", None, None), (62, long, "en", "src1", None), (63, long[:9000] + words(rng, 50), "en", "src1", None)]
    out += [(64, None, None, None, None), (65, "", "en", "src2", 0), (66, " \n\t ", "en", "src2", 4), (67, "a", "en", "src2", 1), (68, "Idiot, STUPID! " + words(rng, 20), "en", "src0", None)]
    out += [(None, "no id here " + words(rng, 12), "en", "src0", None), (7, out[7][1], "en", "src1", None), (9, "another text with the id of one before " + words(rng, 30), "en", "src0", None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def distinct_rows(rows):
    """The same with ids that are unique, for what identifies documents by them."""
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out
