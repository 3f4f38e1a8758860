"""Conversation repair, quality rules and source divergence against brute force, and against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.llm import conversation_repair as R
from wattloom.llm import quality_rules as Q
from wattloom.llm import source_divergence as D
from wattloom.llm import sql
from wattloom.llm.queries import OP13_SQL

LEGAL = re.compile(r"(s?(ua)+)?\Z")
TALK = "conv_id long, turn long, role string, text string, text_2 string"


def all_edits(rows):
    """(cost, audit) by trying everything with up to two inserts in a row."""
    best = None

    def go(i, cost, audit, roles, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if LEGAL.match(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
        else:
            initial, forced, truncated = rows[i]
            go(i + 1, cost + 3, audit + "D", roles, 0)
            if not forced:
                go(i + 1, cost + truncated, audit + "K", roles + (initial or "?"), 0)
                for r in "ua":
                    go(i + 1, cost + 2 + truncated, audit + "R", roles + r, 0)
        if inserts < 2:
            for r in "ua":
                go(i, cost + 2, audit + "I", roles + r, inserts + 1)

    go(0, 0, "", "", 0)
    return best


def some_rows(rng, most):
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), (f := rng.random() < 0.25), not f and rng.random() < 0.3) for _ in range(rng.randrange(most))]


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 3, 1])
def test_cheapest_edits_against_all_edits(prime):
    """In one piece and in segments; a prime of 1 or 3 makes hashes collide, so that the verification decides."""
    rng = random.Random(prime)
    for _ in range(150):
        rows = some_rows(rng, 6)
        want = all_edits(rows)
        heads = R.Heads(R.Trail(prime), {0: (0, 0)})
        heads.segment(R.cheapest(rows, (0,), prime))
        assert heads.best() == want
        heads, i = R.Heads(R.Trail(prime), {0: (0, 0)}), 0
        while i < len(rows):
            k = rng.randrange(1, 4)
            heads.segment(R.cheapest(rows[i : i + k], (0, 1, 2, 3), prime))
            i += k
        assert (heads.best() if rows else (0, "")) == want


def plain_edits(rows):
    """The same for longer ones, with whole strings in place of linked nodes."""
    at = {0: (0, "")}

    def better(out, state, new):
        out[state] = min(out.get(state, new), new)

    def inserted(out):
        for froms, to in (((0, 1, 3), 2), ((2,), 3)):
            for f in froms:
                if f in out:
                    better(out, to, (out[f][0] + 2, out[f][1] + "I"))
        return out

    at = inserted(at)
    for initial, forced, truncated in rows:
        out = {}
        for s, (cost, audit) in at.items():
            better(out, s, (cost + 3, audit + "D"))
            if not forced:
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, initial))
                if to is not None:
                    better(out, to, (cost + truncated, audit + "K"))
                better(out, 3 if s == 2 else 2, (cost + 2 + truncated, audit + "R"))
        at = inserted(out)
    return min(at[s] for s in (0, 3) if s in at)


def audit_of(rows, damage):
    """What the query promises, from its definition."""
    out = {}
    for conv in {r[0] for r in rows}:
        talk = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else -1
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            talk += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
        talk.sort()
        kinds, seen = [], set()
        for _, _, role, text in talk:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        n = Counter(kinds)
        cost, audit = plain_edits([(t[2][:1], k in ("blank", "duplicate"), k == "truncated") for t, k in zip(talk, kinds, strict=True)])
        made, at, roles = [], 0, ""
        for edit in audit:
            role = "user" if roles[-1:] in ("", "s", "a") else "assistant"
            if edit == "I":
                made.append(f"{role}:")
            else:
                if edit in "KR":
                    role = talk[at][2] if edit == "K" else role
                    made.append(f"{role}:{talk[at][3]}")
                at += 1
            roles += role[0] if edit != "D" else ""
        assert LEGAL.match(roles) and at == len(talk)
        turns = {t[1] for t in talk if t[0]}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    texts = ["Hello.", "Hello", "Why?", " \n", "", "Go on!  ", "é.", None]
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(9)):
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}{rng.choice('.!?  ')}"))
    rows += [(500, None if k % 7 == 0 else k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"c{k}."])) for k in range(700)]  # one long conversation
    rows += [(501, 3, "user", "Same.")] * 90 + [(501, 4, "user", "Same.")] * 9 + [(None, None, None, None), (None, 2, "user", "x" * 5000 + ".")] + [(502, k % 3, "user", "One and the same.") for k in range(40)]
    return rows


@pytest.mark.parametrize(("most_rows", "most_chars"), [(R.ROWS, R.CHARS), (3, 40)])
def test_conversations_against_brute_force(spark, talks, most_rows, most_chars):
    given = spark.createDataFrame([(*r, "extra") for r in talks], TALK).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in R.audits(R.damaged(given), given, most_rows, most_chars).collect()}
    assert got == audit_of(talks, damage=True)
    plain = {r[0]: r for r in R.audits(given, None, most_rows, most_chars).collect()}
    assert {k: tuple(r)[1:] for k, r in plain.items()} == audit_of(talks, damage=False)
    made = {}
    for r in R.repaired(given, most_rows, most_chars).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert len(made[r.conv_id]) == r.place + 1
    assert all(hashlib.sha256("\n".join(made.get(k, [])).encode()).hexdigest() == r.repaired_sha256 for k, r in plain.items())


def shown(con, sql, names):
    found = con.execute(sql)
    at = [[c[0] for c in found.description].index(n) for n in names]
    return sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=repr)


def test_conversations_against_sql(spark, talks, tmp_path):
    given = spark.createDataFrame([(*r, "extra") for r in talks], TALK)
    given.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet'")
    found = R.audits(R.damaged(given), given)
    assert sorted(map(tuple, found.collect()), key=repr) == shown(con, sql.CONVERSATIONS, found.columns)


def test_no_conversations(spark):
    none = spark.createDataFrame([], TALK)
    assert R.audits(none).count() == 0 and R.repaired(none).count() == 0
    gone = spark.createDataFrame([(7,), (None,)], "conv_id long")
    assert sorted(map(str, (tuple(r) for r in R.audits(none, gone).collect()))) == sorted(str((k, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for k in (7, None))


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(hit)


def test_counts_against_brute_force(spark, docs, rows):
    rng = random.Random(8)
    odd = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 4, 5, 6, 9, 40, 300)] + ["x y z w v q\x1c #é<>|\n\n a \na\n a ", " ".join(["w"] * 30000), "é" * 9 + "\n" + "a b c d e\r\n" * 3]
    frame = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    want = sorted(((r[0], *counts_of(r[1])) for r in [*rows, *((1000 + i, t) for i, t in enumerate(odd))]), key=str)
    got = sorted(((r.doc_id, *(r[c] for c in Q.COUNTS)) for r in Q.measured(frame).collect()), key=str)
    assert got == want


def exact(k, n, p):
    return sum(Fraction(math.comb(n, i)) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_bounds_are_the_exact_ones():
    for k, n, p in ((0, 100, Fraction(1, 50)), (3, 500, Fraction(1, 100)), (40, 60, Fraction(1, 2)), (7, 7, Fraction(1, 3)), (900, 1000, Fraction(19, 20))):
        assert abs(Q.at_most(k, n, float(p)) - float(exact(k, n, p))) < 1e-9
    bound = Q.upper_bound(3, 500, 0.01)
    assert abs(float(exact(3, 500, Fraction(bound))) - 0.01) < 1e-5
    assert Q.certified(0, 300, 0.02, 0.01) and not Q.certified(0, 200, 0.02, 0.01) and not Q.certified(0, 0, 0.02, 0.5)
    assert Q.of_use(30, 100, 0.02, 0.01) and not Q.of_use(2, 100, 0.02, 0.01) and not Q.of_use(0, 0, 0.02, 0.01)


def ladder_by_hand(part, limit, delta, steps, enough):
    """The cutoff by fractions, for lists of (value, fit, good)."""
    low = sorted(v for v, fit, good in part if fit and not good)
    if not low:
        return None
    ladder = sorted({low[math.ceil(j * len(low) / steps) - 1] for j in range(1, steps + 1)} - {0}, reverse=True)
    good, bad = [v for v, fit, g in part if not fit and g], [v for v, fit, g in part if not fit and not g]
    fine = []
    for c in ladder:
        k = sum(v >= c for v in good)
        if not good or exact(k, len(good), limit) > delta:
            break
        b = sum(v >= c for v in bad)
        if bad and b and 1 - exact(b - 1, len(bad), limit) <= delta:
            fine.append(c)
    return next((c for c in fine if sum(v >= c for v in low) >= enough * sum(v >= fine[-1] for v in low)), None)


def test_cutoffs_against_fractions():
    rng, found = random.Random(3), 0
    for _ in range(40):
        shift, n = rng.choice([0, 20, 200]), rng.choice([5, 120, 400])
        part = [((0 if rng.random() < 0.7 else rng.randrange(50)) if good else rng.randrange(60) + shift, rng.random() < 0.25, good) for good in [rng.random() < 0.8 for _ in range(n)]]
        frame = pd.DataFrame([(*k, c) for k, c in Counter(part).items()], columns=["value", "fit", "good", "n"])
        got = Q.choose(frame, 0.05, 0.01, 16, 0.95)
        assert (got[0] if got else None) == ladder_by_hand(part, Fraction(5, 100), Fraction(1, 100), 16, Fraction(95, 100))
        found += got is not None
    assert 5 < found < 40


def test_verdicts_of_strata(spark, tmp_path):
    """Symbols mark low quality in one language, nothing does in the other, and the third has too few labels."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(4000):
        lang = "xy"[i % 2] if i > 60 else "z"
        good = rng.random() < 0.8
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("##" if not good and lang != "y" and k % 3 == 0 else "") for k in range(rng.randrange(12, 30)))
        docs.append((i, text, None if lang == "z" else lang, i))
        labels += [(i, int(good)), (None, 1), (i, None)] if i % 10 else []
    docs += [(9000, None, "x", 0), (9001, "too few words", "x", 0), (9002, " ".join(["again and again"] * 9), "y", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.judge(frame.drop("kept"), marks, limit=0.04).collect()}
    assert len(got) == len(docs) and not any(got[i].kept for i in (9000, 9001, 9002)) and got[9000].base_failed
    for i, text, lang, _ in docs[:-3]:
        assert got[i].kept == (not (lang == "x" and "#" in text)), (i, got[i])
    con = duckdb.connect()
    for name, rows in (("documents", frame), ("labels", marks)):
        rows.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    asked = sorted((tuple(r[c] for c in columns) for r in Q.judge(frame.drop("kept"), marks).collect()), key=repr)
    assert asked == shown(con, sql.QUALITY, columns)
    alone = Q.judge(frame, marks.where("false")).collect()
    assert sum(not r.kept for r in alone) == 3
    assert Q.judge(frame.where("false"), marks).count() == 0


@pytest.mark.parametrize(("least", "words", "chunk"), [(10, 32, 64), (2, 1, 2), (1, 1, 1)])
def test_divergence_against_sql(spark, tmp_path, docs, rows, least, words, chunk):
    rng = random.Random(least)
    vocabulary = ["the", "The", "ÉTÉ", "été", "x1y", "a-b", "ß", "日本", "q"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    more = [(2000 + i, " ".join(rng.choice(vocabulary[: rng.choice([9, 40, 200])]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "S3", None, "s10"]), None) for i in range(150)]
    more += [(9000, "12 34", "de", "only", 0), (9001, None, "de", "two", 0), (9002, "the " * 3000, "en", "hot", 0)]
    frame = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("value", F.lit("clash"))
    path = str(tmp_path / "documents.parquet")
    frame.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    found = con.execute(OP13_SQL.replace(">= 10", f">= {least}"))
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in D.divergences(frame, least=least, words=words, chunk=chunk).collect())
    assert got == want and {r[0] for r in got} >= {"en", "fr", "", "de"}


def test_divergence_of_nothing(spark, none):
    assert D.divergences(none).count() == 0
