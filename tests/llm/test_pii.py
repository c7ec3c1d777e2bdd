import hashlib
import random
import re
import time

from attestra.llm import pii, queries


def brute(text):
    """The base kinds straight from their definition."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_by_brute_force():
    rng = random.Random(4)
    parts = ["a@b.c", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "4539 1488 0343 6467", "4539148803436467", "+1 (23) 456-7890", " ", "-", "x", "é", "1", "+", "@", ".", "1.2.3.4.5.6"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [s[:3] for s in pii.spans_of(text) if s[1] < 4] == brute(text), text


def test_long_runs_in_linear_time():
    """A megabyte of letters, digits, dots or signs ends soon; the same runs, shorter, agree with brute force."""
    for n in (200, 1_000_000):
        runs = ["a" * n + " x@y.z", "a" * n + "@b.c", "1" * n + " 1.1.1.1", "a@" * (n // 2), "@a" * (n // 2) + ".b", "+1" + "(" * n, "1 " * (n // 2), "A" * n]
        for text in runs:
            start = time.process_time()
            found = [s[:3] for s in pii.spans_of(text) if s[1] < 4]
            assert time.process_time() - start < 5, text[:20]
            if n == 200:
                assert found == brute(text), text[:20]


def test_matches_that_touch():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.-_ 12%+") for _ in range(rng.randint(0, 24)))
        assert [s[:3] for s in pii.spans_of(text) if s[1] < 4] == brute(text), text


def test_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    kinds = lambda t: [pii.KINDS[s[1]] for s in pii.spans_of(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("sample serial GB82WEST12345698765432") == []
    assert "imei" in kinds("device imei 49-015420-323751-8 ok") and "imei" not in kinds("number 49-015420-323751-8 ok")


def test_mask_and_edges(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4", 1), (2, None, 1), (3, "", 1), (3, "", 1)], "doc_id long, text string, pii int")
    assert [r.text for r in pii.mask(df).collect()] == ["mail [EMAIL] or [IP]", None, "", ""]
    assert [len(r.pii) for r in pii.find_spans(df).collect()] == [2, 0, 0, 0]
    assert pii.find_spans(df.limit(0)).count() == 0 and pii.mask(df).columns == df.columns


def test_mask_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "own", "x"), (None, None, None, None)], "doc_id long, text string, pii string, spans string")
    assert [tuple(r) for r in pii.mask(df).collect()] == [(1, "[EMAIL]", "own", "x"), (None, None, None, None)]


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        joined = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
