"""Toxicity from a lexicon that tolerates misspelling, and from what stands around each hit.

Fitting takes a bounded sample of labelled rows (MAX_FIT_ROWS ids, those with the
smallest hashes, one text each). A lexicon holds words far likelier in toxic than in
clean rows, and beginnings of words that are (a term `abcd*`). A logistic model on a handful of
features is fitted on one half of the sample with the lexicon of the other half, and used with the
lexicon of the whole sample. Scoring walks each word through the product of the lexicon's trie and
a Levenshtein automaton of distance 1, made deterministic as words need it, so a
word costs a table step a character and ends where no term is near.

A hit's context scores it between abuse (0) and quotation (1): QUOTED if it stands between
quotation marks that pair up within QUOTE_WORDS words, else REPORTED if a reporting word stands among the
CONTEXT_WORDS words before it. Its weight counts as abuse by what is left of 1.

Defined results: a null or empty text has no hit and gets the score of such
texts; texts and words of any length are learned from and scored whole; rows without a label, with a null label or a null text are not fitted on; of
rows that repeat an id the least text is, with the largest label; without any toxic or clean row to fit on,
the lexicon is empty and every score is the share of toxic rows; of terms equally near the heaviest counts, and
terms equally near and heavy count alike; an empty table gives no row; repeated rows score alike; columns named
like an added one are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import Workspace, add_with_arrow, bounded_batches, claim, without

#: The bound on what is learned from; nothing else of the fit grows beyond it.
MAX_FIT_ROWS = 16_000
MIN_DF, MIN_WEIGHT, FUZZY_FROM = 4, 2.0, 5
#: Beginnings of words, of these lengths, are terms too: they hold for every word that starts so.
STEMS = (4, 5, 6)
CONTEXT_WORDS, QUOTE_WORDS = 8, 64
QUOTED, REPORTED = 1.0, 0.75
#: Words that are remembered with their hit: so many, of so many bytes each at most; others are looked up each time.
MEMO_ENTRIES, MEMO_BYTES = 150_000, 48
THRESHOLD = 0.3
#: Words that report what another says.
REPORTING = frozenset("said says called quoted wrote term word phrase insult slur dit sagte dijo".split())
#: Quotation marks that open, and those that close each.
CLOSES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’"}
MARKS = "".join(dict.fromkeys("".join(CLOSES) + "".join(CLOSES.values())))
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‚…"
_marks = re.compile(f"[{MARKS}]")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8, cut at the six ASCII blanks: for fitting and for scoring."""
    return text.lower().encode("utf-8", "replace").split() if text else []


def bare(word: bytes) -> str:
    return word.decode().strip(EDGES)


def terms_in(text: str | None) -> list[str]:
    """What a text holds that may be a term: its words without the marks around them, and their beginnings."""
    words = {bare(w) for w in set(words_of(text))} - {""}
    return sorted(words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k})


class LexiconAutomaton:
    """Accepts words within one edit of a term (terms shorter than FUZZY_FROM: the term alone)."""

    def __init__(self, weights: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.end: list[tuple[float, bool] | None] = [None]
        self.stem: dict[int, float] = {}
        for term, weight in weights.items():
            node, stem = 0, term.endswith("*")
            term = term.removesuffix("*")
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(None)
                node = self.children[node][c]
            if stem:
                self.stem[node] = weight
            else:
                self.end[node] = (weight, len(term) >= FUZZY_FROM)
        self.ids: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[float, int] | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        """With the trie steps that skip a character of the term."""
        more = {(child, 1) for node, e in items if e == 0 for child in self.children[node].values()}
        exact = {node for node, e in items if e == 0}
        return frozenset(x for x in items | more if x[1] == 0 or x[0] not in exact)

    def _state(self, members: frozenset) -> int:
        if members not in self.ids:
            self.ids[members] = len(self.members)
            self.members.append(members)
            self.steps.append({})
            best = None
            for node, e in members:
                if (end := self.end[node]) and (e == 0 or end[1]) and (best is None or (e, -end[0]) < (best[1], -best[0])):
                    best = (end[0], e)
            self.accepts.append(best)
        return self.ids[members]

    def _step(self, state: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, e in self.members[state]:
            below = self.children[node]
            if c in below:
                items.add((below[c], e))
            if e == 0:
                items.add((node, 1))
                items.update((child, 1) for child in below.values())
        self.steps[state][c] = to = self._state(self._closed(items))
        return to

    def find(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the closest term, the heaviest of equally close ones; None if none is near."""
        node, known = 0, None
        for c in word:
            node = self.children[node].get(c, -1)
            if node < 0:
                break
            known = self.stem.get(node, known)
        near = self._walk(word)
        return near if near and not near[1] or known is None else (known, 0)

    def _walk(self, word: str) -> tuple[float, int] | None:
        state, steps, dead = self.start, self.steps, self.dead
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == dead:
                return None
        return self.accepts[state]


def quotations(words: list[bytes]) -> list[tuple[int, int]]:
    """First and last word of every pair of quotation marks: marks before a word open, marks behind it close the latest
    open one that they fit; a mark on its own closes if it can. One that stays open for QUOTE_WORDS words opens nothing."""
    open_: list[tuple[str, int]] = []
    out = []

    def close(mark: str, i: int) -> bool:
        for k in range(len(open_) - 1, -1, -1):
            if mark in CLOSES[open_[k][0]]:
                out.append((open_[k][1], i))
                del open_[k:]
                return True
        return False

    for i, raw in enumerate(words):
        word = raw.decode()
        if not _marks.search(word):
            continue
        while open_ and i - open_[0][1] > QUOTE_WORDS:
            open_.pop(0)
        body = word.strip(EDGES)
        lead, rest = word.partition(body)[::2] if body else (word, "")
        for mark in dict.fromkeys(lead):
            if mark in MARKS and not (not body and close(mark, i)) and mark in CLOSES:
                open_.append((mark, i))
        for mark in dict.fromkeys(rest):
            if mark in MARKS:
                close(mark, i)
    return out


class Scorer(dict):
    """Lower-cased raw word -> its hit or None; remembers MEMO_ENTRIES of them at most."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.automaton = model, LexiconAutomaton(dict(model.terms))
        self.fine = frozenset(model.exceptions)

    def __missing__(self, raw: bytes):
        word = bare(raw)
        hit = None if word in self.fine else self.automaton.find(word)
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[raw] = hit
        return hit

    def features(self, text: str | None) -> list[float]:
        words = words_of(text)
        hits = [(i, hit) for i, hit in enumerate(map(self.__getitem__, words)) if hit is not None]
        direct = fuzzy = quoted = heaviest = n_direct = 0.0
        if hits:
            inside = quoted_words(words) if _marks.search(text) else bytes(len(words))
            for i, (weight, edits) in hits:
                told = context(words, i, inside)
                quoted += told
                if edits:
                    fuzzy += 1 - told
                else:
                    direct += weight * (1 - told)
                    n_direct += 1 - told
                    heaviest = max(heaviest, weight * (1 - told))
        share = 100 * (n_direct + fuzzy) / max(len(words), 1)
        return [1.0, math.log1p(direct), heaviest, math.log1p(fuzzy), math.log1p(quoted), math.log1p(share)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.features(text), self.model.beta, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def quoted_words(words: list[bytes]) -> bytearray:
    """1 for each word inside a quotation."""
    steps = [0] * (len(words) + 1)
    for a, b in quotations(words):
        steps[a] += 1
        steps[b + 1] -= 1
    return bytearray(depth > 0 for depth in accumulate(steps[:-1]))


def context(words: list[bytes], i: int, inside: bytes) -> float:
    """How far the word at i is quoted or reported, 0 to 1."""
    if inside[i]:
        return QUOTED
    return REPORTED if any(bare(w) in REPORTING for w in words[max(0, i - CONTEXT_WORDS) : i]) else 0.0


class Model:
    """terms: (word, weight) pairs; exceptions: near words that clean rows use; beta: of the logistic model."""

    def __init__(self, terms: tuple, exceptions: tuple, beta: tuple):
        self.terms, self.exceptions, self.beta = terms, exceptions, beta


@lru_cache(maxsize=2)
def scorer_of(terms: tuple, exceptions: tuple, beta: tuple) -> Scorer:
    return Scorer(Model(terms, exceptions, beta))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's steps on the penalised likelihood; a handful of columns."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(beta)) * len(y) / 100, x.T @ (y - p) - ridge * beta * len(y) / 100)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def in_fit(doc_id: Column) -> Column:
    """Rows that may be learned from: the others are held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the labelled rows that in_fit() lets through, MAX_FIT_ROWS ids at most."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & in_fit(F.col(key)))
    known = known.groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    known = known.withColumn("_h", F.xxhash64(F.col("_k"), F.lit(11))).orderBy("_h", "_k").limit(MAX_FIT_ROWS)
    # MAX_FIT_ROWS bounds the broadcast side, and the ids that the rest is grouped by.
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(known), "_k").where(F.col("_t").isNotNull())
    rows = rows.groupBy("_k", "_y", (F.pmod(F.col("_h"), F.lit(2)) == 0).alias("_first")).agg(F.min("_t").alias("_t"))
    bounded_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "toxicity-fit")
    try:
        return _fitted(space.written(rows, "sample"), space)
    finally:
        space.close()


def _fitted(sample: DataFrame, space: Workspace) -> Model:
    sums = lambda y, first: F.coalesce(F.sum(F.when(F.col("_first") == first, y)), F.lit(0))
    toxic, clean = F.col("_y"), 1 - F.col("_y")
    tallies = [sums(toxic, True).alias("t1"), sums(clean, True).alias("c1"), (sums(toxic, True) + sums(toxic, False)).alias("t"), (sums(clean, True) + sums(clean, False)).alias("c")]
    n = sample.agg(*tallies).first()
    share = min(max(n["t"] / (n["t"] + n["c"]) if n["t"] + n["c"] else 0.0, 1e-3), 1 - 1e-3)
    constant = (math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0, 0.0)
    if not n["t"] or not n["c"]:
        return Model((), (), constant)
    names = ("t1", "c1", "t", "c")
    each = sample.select("_y", "_first", "_t").mapInArrow(_tallied, "_w string, t1 long, c1 long, t long, c long")
    counts = space.written(each.groupBy("_w").agg(*[F.sum(c).alias(c) for c in names]), "counts")
    half = Model(*_lexicon(counts, "t1", "c1", n["t1"], n["c1"]), constant)
    other = add_with_arrow(sample.where(~F.col("_first")), [T.StructField("f", T.ArrayType(T.DoubleType()))], _features(half), ["_y"])
    rows = other.select("_y", "f").collect()  # one short row an id, MAX_FIT_ROWS at most
    fits = len({r["_y"] for r in rows}) > 1
    beta = tuple(map(float, logistic(np.array([r["f"] for r in rows]), np.array([float(r["_y"]) for r in rows])))) if fits else constant
    return Model(*_lexicon(counts, "t", "c", n["t"], n["c"]), beta)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts of the first half, and of all, a term is found; a row a term of each batch."""
    claim("toxicity", scorer_of.cache_clear)
    for batch in batches:
        tallies: list[Counter] = [Counter() for _ in range(4)]
        for y, first, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            terms = terms_in(t)
            tallies[2 if y else 3].update(terms)
            if first:
                tallies[0 if y else 1].update(terms)
        words = list(dict.fromkeys([*tallies[2], *tallies[3]]))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([n[w] for w in words], pa.int64()) for n in tallies]], names=["_w", "t1", "c1", "t", "c"])


def _lexicon(counts: DataFrame, t: str, c: str, n_toxic: int, n_clean: int) -> tuple[tuple, tuple]:
    """(term, weight) pairs, and the words of clean rows that look like a misspelled term but are not one."""
    if not n_toxic or not n_clean:
        return (), ()
    weight = F.log((F.col(t) + 0.5) / (n_toxic + 1)) - F.log((F.col(c) + 0.5) / (n_clean + 1))
    weighed = counts.withColumn("weight", weight)
    heavy = weighed.where((F.col(t) >= MIN_DF) & (F.col("weight") >= MIN_WEIGHT))
    terms = tuple(sorted((r["_w"], round(r["weight"], 6)) for r in heavy.select("_w", "weight").collect()))
    return terms, near_words(weighed.where((F.col(c) > 0) & (F.col("weight") < MIN_WEIGHT) & ~F.col("_w").endswith("*")), terms)


def near_words(words: DataFrame, terms: tuple) -> tuple:
    """Those of the words that the automaton would take for a misspelled term."""

    def make():
        automaton = LexiconAutomaton(dict(terms))

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([(hit := automaton.find(w.as_py())) is not None and hit[1] == 1 for w in batch.column(0)], pa.bool_())]

        return step

    near = add_with_arrow(words.select("_w"), [T.StructField("near", T.BooleanType())], make)
    return tuple(sorted(r["_w"] for r in near.where("near").collect()))


def _features(model: Model):
    parts = (model.terms, model.exceptions, model.beta)

    def make():
        claim("toxicity", scorer_of.cache_clear)
        scorer = scorer_of(*parts)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index("_t"))
            return [pa.array([scorer.features(t.as_py()) for t in texts], pa.list_(pa.float64()))]

        return step

    return make


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add each whole text's score, 0 to 1, and whether it reaches THRESHOLD as `predicted`."""
    parts = (model.terms, model.exceptions, model.beta)

    def make():
        claim("toxicity", scorer_of.cache_clear)
        scorer = scorer_of(*parts)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([scorer.score(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))], pa.float64())]

        return step

    scored = add_with_arrow(without(df, "predicted"), [T.StructField(out, T.DoubleType())], make, keep)
    return scored.withColumn("predicted", (F.col(out) >= THRESHOLD).cast("int"))
