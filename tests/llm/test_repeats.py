import random
import re

import numpy as np
import pytest

from attestra.llm import repeats


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute(rows, n=13):
    first, out = {}, []
    for doc, text in rows:
        ws = words_of(text)
        for i in range(len(ws) - n + 1 if doc is not None else 0):
            key = tuple(ws[i : i + n])
            first[key] = min(doc, first.get(key, doc))
    for doc, text in rows:
        ws = words_of(text)
        gone = {i + k for i in range(len(ws) - n + 1) if doc is not None and first[tuple(ws[i : i + n])] < doc for k in range(n)}
        cut = []
        for p in sorted(gone):
            if cut and cut[-1][1] == p:
                cut[-1][1] = p + 1
            else:
                cut.append([p, p + 1])
        out.append((doc, len(ws), len(gone), [tuple(c) for c in cut], " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = repeats.remove_repeats(df, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, [tuple(c) for c in r.removed], r.kept_text) for r in out), key=str)


def corpus(seed, docs=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "A", "a", "\x1cx", "nb\xa0sp", "\U0001f600"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 40, 70]))] for _ in range(6)]
    rows = []
    for doc in rng.sample(range(-20, 1000), docs):
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 12, 13, 60, 150]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(ws))
            ws[at:at] = rng.choice(passages)
        rows.append((doc, rng.choice([" ", "\n", " \t", "\x0b"]).join(ws)))
    return rows


def test_rolled_by_brute_force():
    words = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    base = int(repeats.BASE)
    for n in range(1, 20):
        want = [sum(int(w) * pow(base, n - 1 - k, 1 << 64) for k, w in enumerate(words[i : i + n])) % (1 << 64) for i in range(len(words) - n + 1)]
        assert repeats.rolled(words, n).tolist() == want


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_by_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_small_flushes_and_parts(spark):
    """Every flush and range gives the same result; a passage in all documents meets once a flush."""
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = corpus(3) + [(2_000 + i, f"{shared} own{i} {rng.random()}") for i in range(60)]
    want = brute(rows)
    assert got(spark, rows, part_bytes=500) == want == got(spark, rows, part_bytes=900, flush=1)
    assert got(spark, rows, window=4) == brute(rows, 4)


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, passage), (5, passage), (5, passage), (5, "other " + passage), (None, passage), (None, passage + " more"),
        (6, passage + " " + passage), (0, " ".join(["again"] * 40)), (9, " ".join(f"u{i}" for i in range(60_000)) + " " + passage), (8, " ".join(f"p{i}" for i in range(12))), (7, "x" * 3_000_000 + " " + passage),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(None, None)]) == brute([(None, None)])


def test_columns_of_other_names(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(1, passage, "a", 5, "x"), (2, passage, None, None, "y")], "doc_id long, text string, kind string, N_words int, _id string")
    out = repeats.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "kind", "_id", "n_words", "n_removed", "removed", "kept_text"]
    assert sorted((r.doc_id, r.kind, r["_id"], r.n_removed, r.kept_text) for r in out.collect()) == [(1, "a", "x", 0, passage), (2, None, "y", 20, "")]
