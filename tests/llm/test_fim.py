import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from attestra.llm import fim


def brute(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, schema="doc_id long, text string"):
    out = fim.transform(spark.createDataFrame(rows, schema)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
    return out


def test_rank_and_select_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "\n", "\n", "é", "\x8a", "\x0b", "\U0001f600", "Ċ", "ਊ", "\x00", "ÿ"]) for _ in range(rng.randint(0, 70))).encode()
        data = np.frombuffer(text, np.uint8)
        words = fim.words_of(data)
        for marks, hit in ((fim.line_ends(words), lambda b: b == 10), (fim.continuations(words), lambda b: 128 <= b < 192)):
            where = [i for i, b in enumerate(text) if hit(b)]
            m = fim.Marks(marks)
            assert m.rank(np.arange(len(text) + 1)).tolist() == [sum(w < i for w in where) for i in range(len(text) + 1)]
            assert m.select(np.arange(1, len(where) + 1)).tolist() == where


def test_texts_by_brute_force(spark):
    rng = random.Random(9)
    pieces = ["word ", "\n", "\n\n", "é", "\U0001f600", "<", "P>", "<S", "<P", ">", "\r\n", "\x85", " ", "\t"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 9, 60, 400])))) for i in range(400)]
    out = check(spark, rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "no end"), (None, "a\nb\nc\nd"), (7, "x\n" * 300_000), (8, "é" * 400_000), (9, "has <M> inside\nx\n"), (10, "a\nb"), (10, "a\nb"), (-3, "one\ntwo\nthree\n")]
    check(spark, rows)
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_other_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "x", 5)], "doc_id long, text string, output string, N int")
    out = fim.transform(df)
    assert sorted(c.lower() for c in out.columns) == ["doc_id", "form", "middle_chars", "n", "output", "prefix_chars", "text"]
    r = out.first()
    assert (r.n, r.form, r.output) == (3, *brute(1, "a\nb\nc")[1::3])
    assert fim.transform(df, keep=["doc_id"]).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_rates(spark):
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    n = {r.form: r["count"] for r in fim.transform(df, rate=60, spm=25).groupBy("form").count().collect()}
    assert 700 < n["plain"] < 900 and 230 < n["spm"] < 370 and n["psm"] > 800
