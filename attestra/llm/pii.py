r"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Kinds, in the order in which spans that start together are listed:
email, ip, card, phone (the base kinds, kept on the pattern and its checks
alone), then iban and imei (patterns of the method, kept when their checksum
holds and their score reaches MIN_SCORE). Matches are leftmost and do not overlap within a
kind; one that fails its check is dropped, and the search goes on behind it.
Offsets are code points, the end exclusive.

Score of a span: what its kind starts with, plus CONTEXT_GAIN if a context word
of the kind stands within CONTEXT_CHARS characters before or after it, minus
CONTEXT_LOSS if a word that speaks against it does. Base spans keep whatever the
score is; it is reported for them too.

Defined results: a null or empty text has no span; texts of any length are
searched whole, each character a bounded number of times; repeated rows give the same spans; spans
that start together are listed by kind; an empty table gives no row; columns named like an added
one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestra.llm.common import add_with_arrow, claim

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "imei")
ORDER = {k: i for i, k in enumerate(KINDS)}
START = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.7, "iban": 0.7, "imei": 0.4}
MIN_SCORE, CONTEXT_CHARS, CONTEXT_GAIN, CONTEXT_LOSS = 0.5, 40, 0.25, 0.3

FOR = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "imei": ("imei", "device", "handset"),
}
AGAINST = {
    "email": (),
    "ip": ("version", "release"),
    "card": ("isbn", "serial", "order no"),
    "phone": ("isbn", "serial", "order no"),
    "iban": ("sample", "serial"),
    "imei": ("isbn", "order no"),
}

PATTERN = {
    # A match can't end inside a run of digits, so one that starts there could have started at the run's first digit.
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "imei": re.compile(r"(?<![0-9-])[0-9]{2}-[0-9]{6}-[0-9]{6}-[0-9](?![0-9-])"),
}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_not_digit = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    """The check of payment cards: every second digit from the right doubled, digits summed, a multiple of ten."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: first four characters moved behind, letters as 10..35, remainder 1 by 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of LOCAL characters, `@` and a domain of two labels or more, found from each `@` outwards.

    No LOCAL character is an `@`, so the run before one is walked once; it starts behind the match before.
    """
    behind, at = 0, text.find("@")
    while at >= 0:
        if at > behind and text[at - 1] in LOCAL and (domain := _domain.match(text, at + 1)):
            start, step = at, 64
            while start > behind:
                low = max(behind, start - step)
                run = len(text[low:start].rstrip(LOCAL))
                start = low + run
                if run:
                    break
                step *= 2
            yield start, domain.end()
            behind = domain.end()
        at = text.find("@", max(at + 1, behind))


def candidates(kind: str, text: str) -> Iterator[tuple[int, int]]:
    return emails(text) if kind == "email" else (m.span() for m in PATTERN[kind].finditer(text))


def confirmed(kind: str, found: str) -> bool:
    digits = _not_digit.sub("", found)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "iban":
        return 15 <= len(found.replace(" ", "")) <= 34 and mod97(found.replace(" ", ""))
    return kind != "imei" or luhn(digits)


def score(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS) : start]}\n{text[end : end + CONTEXT_CHARS]}".lower()
    gain = CONTEXT_GAIN * any(w in near for w in FOR[kind])
    loss = CONTEXT_LOSS * any(w in near for w in AGAINST[kind])
    return round(min(1.0, max(0.0, START[kind] + gain - loss)), 2)


def spans_of(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, order of the kind, end, score) of every span, sorted."""
    if not text:
        return []
    has = {"ip": "." in text, "phone": "+" in text, "imei": "-" in text}
    out = []
    for kind in KINDS:
        if not has.get(kind, True):
            continue
        for start, end in candidates(kind, text):
            if (kind != "card" or end - start >= 14) and confirmed(kind, text[start:end]):
                points = score(kind, text, start, end)
                if kind in BASE or points >= MIN_SCORE:
                    out.append((start, ORDER[kind], end, points))
    return sorted(out)


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def find_spans(df: DataFrame, text: str = "text", out: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """Add the spans as array<struct<kind, start, end, score>>, by start and kind."""

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text))
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in spans_of(t.as_py())] for t in texts]
            return [pa.array(rows, kind)]

        return step

    return add_with_arrow(df, [T.StructField(out, T.ArrayType(SPAN))], make, keep)


def masked(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """text with each span replaced by its kind in brackets; of spans that overlap, the one that starts first counts."""
    parts, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = end
        else:
            at = max(at, end)
    return "".join([*parts, text[at:]])


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span in the text by its kind; null stays null and a text without spans is unchanged."""

    def make():
        claim("pii")

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for t in batch.column(batch.schema.get_field_index(text)):
                t = t.as_py()
                spans = spans_of(t)
                out.append(masked(t, spans) if spans else t)
            return [pa.array(out, pa.string())]

        return step

    order = df.columns
    return add_with_arrow(df, [T.StructField(text, T.StringType())], make).select(*[f"`{c}`" for c in order])
