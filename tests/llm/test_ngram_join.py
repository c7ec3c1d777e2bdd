import random
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
import pytest

from attestra.llm import ngram_join as nj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = [w for w in nj_split((text or "").translate(LOWER)) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def nj_split(text):
    import re

    return re.split("[\x20\x09-\x0d]+", text)


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "A", "a"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, doc = [], 0
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 40, 120]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((doc, rng.choice([" ", "\n", " \t"]).join(words)))
            doc += 1
    return [*rows, (doc, None), (doc + 1, ""), (doc + 2, " \n"), (doc + 3, "One two"), (doc + 4, "one TWO"), (doc + 5, " ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(nj, "GROUP", 4)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join_components(df).collect()}
    assert got == brute(rows)


def test_pairs_by_brute_force(spark):
    rows = corpus(5)
    sets = {i: shingles(t) for i, t in rows}
    pairs, members = nj.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    rep = {r.doc_id: r.rep for r in members.collect()}
    first = {}
    for i, s in sorted(sets.items()):
        if s:
            first.setdefault(frozenset(s), i)
    assert rep == {i: first[frozenset(s)] for i, s in sets.items() if s}
    reps = sorted(first.values())
    want = [(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(want) > 20 and sorted((r.x, r.y) for r in pairs.collect()) == want


def test_common_shingles_go_by_parts(spark, monkeypatch):
    """Every shingle in parts, dealt by class: the same components."""
    monkeypatch.setattr(nj, "SPREAD", 1)
    monkeypatch.setattr(nj, "COMMON_PARTS", 3)
    monkeypatch.setattr(nj, "SHINGLES_A_COUNTER", 1)
    rows = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_sketch_counts(spark, monkeypatch):
    """Ranks are the counts of all shingles with the same leading bits, over several sendings of a task."""
    monkeypatch.setattr(nj, "FLUSH_SHINGLES", 300)
    texts = [f"a b c d e {i % 7} f g h i j" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = sum(len(shingles(t)) for t in texts)
    made = nj.sketch(nj.profile(docs), total)
    each = nj.np.concatenate([nj.shingle_sets(pa.array([t]))[1] for t in texts])
    counts = nj.np.bincount((each >> made.shift).astype(int), minlength=len(made.ranks))
    assert (made.ranks == nj.np.round(8 * nj.np.log2(counts + 1.0)).astype(int)).all()
    once = nj.shingle_sets(pa.array([texts[0]]))[1][:1]
    assert nj.packed_counts(nj.np.repeat(once, 600))[2] == [b"\xff", b"\xff", b"Z"]


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-9], "x"])), (3, "y" * 2_000_000), (4, "y" * 2_000_000 + " "), (5, "z")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (149_996, 1), 2: (149_988, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5)}


def test_only_the_result_is_left(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    out = nj.join_components(spark.createDataFrame(corpus(4), "doc_id long, text string"))
    assert [p.name.rsplit("-", 1)[0] for p in shared.iterdir() if p.name not in before] == ["ngram-join-result"] and out.count() > 0


def test_edges(spark):
    schema = "doc_id long, text string"
    assert nj.join_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    out = sorted([tuple(r) for r in nj.join_components(spark.createDataFrame(rows, schema)).collect()], key=str)
    assert out == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2)], key=str)


def test_hashes_do_not_depend_on_batches_or_segments(monkeypatch):
    texts = ["Alpha beta  gamma delta epsilon zeta", "x" * 5_000 + " y z " * 400, None, "", "b"]
    whole = nj.shingle_sets(pa.array(texts))
    sliced = nj.shingle_sets(pa.array(["pad", *texts])[1:])
    monkeypatch.setattr(nj, "SEGMENT", 64)
    cut = nj.shingle_sets(pa.array(texts))
    for other in (sliced, cut):
        assert (whole[0] == other[0]).all() and (whole[1] == other[1]).all()


def test_filters_never_lose_a_link():
    rng = random.Random(9)
    seen = defaultdict(int)
    for _ in range(3_000):
        a = nj.np.unique(nj.np.array([rng.getrandbits(64) for _ in range(rng.randint(1, 60))], nj.np.uint64))
        keep = rng.random()
        b = nj.np.unique(nj.np.array([v for v in a.tolist() if rng.random() < 0.5 + keep / 2] + [rng.getrandbits(64) for _ in range(rng.randint(0, 6))], nj.np.uint64))
        both = len(nj.np.intersect1d(a, b))
        want = len(b) > 0 and 100 * both >= 80 * (len(a) + len(b) - both)
        assert nj.linked(a, b) == want
        seen[want] += 1
    assert min(seen[True], seen[False]) > 100


def test_repeated_picks_leave_pairs_to_the_last_round(spark, monkeypatch):
    """Star rounds that pick the longer classes both times: the second one is empty, and the others still meet."""
    rng = random.Random(3)
    rows = []
    for length in (40, 150):
        words = [f"v{rng.randrange(10_000)}" for _ in range(length)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:-1], "changed"]))]
    picked = nj.star_pairs
    monkeypatch.setattr(nj, "star_pairs", lambda entries, seed: picked(entries.where("n > 100"), 0))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows) and found[1][1] == 0 and found[3][1] == 2
