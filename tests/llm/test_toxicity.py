import math
import random
import zlib

import pytest

from attestra.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_by_brute_force():
    rng = random.Random(6)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 8))): rng.random() + 1 for _ in range(40)}
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(3_000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        near = [(distance(word, t), -w) for t, w in terms.items() if distance(word, t) <= (1 if len(t) >= 5 else 0)]
        want = min(near, default=None)
        got = automaton.find(word)
        assert (got is None) == (want is None)
        if want:
            assert (got[1], -got[0]) == want


def inside(text):
    words = toxicity.words_of(text)
    return [w.decode() for w, q in zip(words, toxicity.quoted_words(words), strict=True) if q]


def test_quotation():
    assert inside('he said that "you utter fool" was not kind') == ['"you', "utter", 'fool"']
    assert inside('"foo bar" you idiot and then he "left"') == ['"foo', 'bar"', '"left"']
    assert inside("er rief \u201edu idiot\u201c und \u00ab sale type \u00bb, don't (you fool)") == ["\u201edu", "idiot\u201c", "\u00ab", "sale", "type", "\u00bb,"]
    assert inside('an "open mark ' + "x " * toxicity.QUOTE_WORDS + 'closed" late') == []
    assert inside('"a \u201cb c" d') == ['"a', "\u201cb", 'c"'] and inside('"' * 5_000 + " x " + '"' * 5_000) == ['"' * 5_000, "x", '"' * 5_000]
    words = toxicity.words_of("they called him a fool and you are a fool now")
    assert toxicity.context(words, 4, bytes(11)) == toxicity.REPORTED and toxicity.context(words, 10, bytes(11)) == 0


def test_words_are_cut_alike_for_fit_and_score():
    """Blanks of Unicode that are none of the six stay in a word for both."""
    text = "A\u00a0fool\u3000here \x1cthen\x0bnow \u0130"
    words = [w.decode() for w in toxicity.words_of(text)]
    assert words == ["a\u00a0fool\u3000here", "\x1cthen", "now", "i\u0307"]
    assert {t for t in toxicity.terms_in(text) if not t.endswith("*")} == {toxicity.bare(w.encode()) for w in words}


def test_long_words_and_texts(spark):
    """A word of any length is a term as itself, with its misspellings; a long text with one hit is searched to its end."""
    long = "badword" * 200
    scorer = toxicity.Scorer(toxicity.Model((("blorgig", 5.0), (long, 3.0), ("badw*", 2.5)), (), (-4.0, 1.0, 1.0, 1.0, 0.0, 1.0)))
    slip = long[:700] + "x" + long[701:]
    assert scorer[long.encode()] == (3.0, 0) and scorer.automaton._walk(slip) == (3.0, 1) and scorer[b"x" * 2_000_000] is None
    assert scorer[slip.encode()] == (2.5, 0), "a beginning is nearer than a misspelled term"
    assert {long, "badw*", "badwo*", "badwor*"} == set(toxicity.terms_in(long))
    text = "word " * 300_000
    assert scorer.score(text + "blorgig") > scorer.score(text)
    assert scorer.score("you blorgig") > scorer.score('they said "you blorgig"')


def test_learns_long_words(spark):
    long = "zq" * 40
    rows, labels = table(400, random.Random(3))
    docs = spark.createDataFrame([(i, t + (f" {long}" if i % 5 == 0 else "")) for i, t in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert long in dict(model.terms) and toxicity.Scorer(model).automaton._walk(long[:50] + long[51:]) == (dict(model.terms)[long], 1)


def plain_hit(word, terms, exceptions):
    """(weight, edits) of a word, by comparing it with every term."""
    if word in exceptions:
        return None
    near = [(e, -w) for t, w in terms.items() if not t.endswith("*") and abs(len(t) - len(word)) < 2 and (e := distance(word, t)) <= (len(t) >= toxicity.FUZZY_FROM)]
    best = min(near, default=None)
    if best and not best[0]:
        return -best[1], 0
    stems = [(len(t), w) for t, w in terms.items() if t.endswith("*") and word.startswith(t[:-1])]
    return (max(stems)[1], 0) if stems else best and (-best[1], best[0])


def test_scores_by_brute_force(spark, sf_dir):
    """Every score of the query, with each word held against each term; which words are quoted has its own test."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model, known = toxicity.fit(docs, labels), {}
    terms, exceptions = dict(model.terms), set(model.exceptions)
    want = {}
    for doc, text in docs.select("doc_id", "text").collect():
        words = [w.decode() for w in (text or "").lower().encode().split()]
        inside = toxicity.quoted_words([w.encode() for w in words])
        direct = fuzzy = quoted = heaviest = n = 0.0
        for i, raw in enumerate(words):
            word = raw.strip(toxicity.EDGES)
            if word not in known:
                known[word] = plain_hit(word, terms, exceptions)
            if known[word] is None:
                continue
            weight, edits = known[word]
            before = {w.strip(toxicity.EDGES) for w in words[max(0, i - 8) : i]}
            told = 1.0 if inside[i] else 0.75 if before & toxicity.REPORTING else 0.0
            quoted += told
            fuzzy += (1 - told) * (edits > 0)
            direct += weight * (1 - told) * (edits == 0)
            n += (1 - told) * (edits == 0)
            heaviest = max(heaviest, weight * (1 - told) * (edits == 0))
        values = [1, math.log1p(direct), heaviest, math.log1p(fuzzy), math.log1p(quoted), math.log1p(100 * (n + fuzzy) / max(len(words), 1))]
        want[doc] = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(values, model.beta, strict=True))))))
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[d].score - want[d]) < 1e-9 for d in want)


@pytest.mark.parametrize(("sf", "recall", "precision"), [("sf0.01", 0.5, 0.7), ("sf0.1", 0.9, 0.9)])
def test_query_on_held_out_labels(spark, sf, recall, precision):
    """With the 37 toxic rows that sf0.01 has to learn from, words of rare languages are not learned."""
    folder = f"/root/testdata/{sf}"
    docs, out = spark.read.parquet(f"{folder}/documents.parquet").count(), queries.op10_toxicity(spark, folder).collect()
    assert len(out) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(toxic[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in toxic]
    both = sum(a & b for a, b in held)
    assert both >= recall * sum(a for a, _ in held) and both >= precision * sum(b for _, b in held)


def test_repeated_ids_are_one_row_of_the_fit(spark):
    rows, labels = table(300, random.Random(2))
    docs = spark.createDataFrame([*rows, *[(0, f"again {i} blorgig") for i in range(500)]], "doc_id long, text string")
    once = spark.createDataFrame([(i, min(t, "again 0 blorgig") if i == 0 else t) for i, t in rows], docs.schema)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = toxicity.fit(docs, marks), toxicity.fit(once, marks)
    assert (a.terms, a.exceptions, a.beta) == (b.terms, b.exceptions, b.beta)


def table(n, rng):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"word{rng.randrange(300)}" for _ in range(60)]
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["blorgig", "snargle", "snargl", "frumpus"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_and_holds_out(spark):
    rows, labels = table(800, random.Random(8))
    docs = spark.createDataFrame([*rows, (9_000, None), (9_001, ""), (9_001, ""), (None, "x")], "doc_id long, text string").withColumn("score", toxicity.F.lit("s"))
    marks = spark.createDataFrame([*labels, (9_000, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    out = {r.doc_id: r for r in toxicity.score(docs, model).withColumn("held", ~toxicity.in_fit(toxicity.F.col("doc_id"))).collect() if r.doc_id is not None}
    truth = dict(labels)
    held = [i for i in truth if out[i].held]
    assert 100 < len(held) < 300
    assert sum(out[i].predicted == truth[i] for i in held) >= 0.98 * len(held)
    assert out[9_000].score == out[9_001].score and 0 <= out[9_000].score < 0.3
    assert toxicity.score(docs.limit(0), model).count() == 0
    slip = spark.createDataFrame([(1, " ".join(["word1"] * 20 + ["snarggle", "frumpsu", "blorgg"]))], "doc_id long, text string")
    assert toxicity.score(slip, model).first().score > out[9_001].score


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in toxicity.score(docs, model).collect())
