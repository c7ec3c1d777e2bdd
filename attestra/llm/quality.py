r"""Line-first quality rules.

Each line of a text is tried against three families of rules; lines that fail
are removed, and a document that loses too large a part of its word characters,
or fails the base rules, is rejected.

* navigation: three or more `|`, `»` or `›` separators in the line;
* boilerplate: a stock phrase (cookie, sign-in, share and licence notices, in
  English, German, French and Spanish) in a line of at most MAX_NOTICE_WORDS words, or
  symbols (`#*$%&|<>`) that number over a tenth of the line's word characters;
* punctuation: at least NEEDS_STOP words without a sentence end (`.`, `!`, `?`,
  `…`, `。`, perhaps followed by quotes or brackets, before white space or the
  end), or over a fifth of the words ending in `!!` or `??`.

A line without a word is dropped without loss. Words are runs of characters
other than space and U+0009..U+000D; a line ends at \n.

Defined results: a null or empty text has no words, so it fails the base rules
and its cleaned text is empty; a text of one long line is one line; repeated
rows get the same verdict; of equal lines the first is no duplicate; an empty table gives no row; columns
named like an added one are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestra.llm.common import add_with_arrow

#: Base rules: fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Line rules.
MIN_SEPARATORS, MAX_NOTICE_WORDS, NEEDS_STOP, MAX_SYMBOL_PERCENT, MAX_SHOUT_PERCENT = 3, 30, 12, 10, 20
#: A document may lose so many percent of its word characters at most.
MAX_LOSS_PERCENT = 50

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|"
    r"enable javascript|javascript is (disabled|required)|sign in to|log in to|subscribe to our|share on (facebook|twitter)|"
    r"click here|lorem ipsum|skip to (main )?content|back to top|powered by|^copyright |^licensed under |^released under |"
    r"^this work is licensed|alle rechte vorbehalten|datenschutzerklärung|cookie-einstellungen|nach oben springen|"
    r"tous droits réservés|politique de confidentialité|accepter (tous )?les cookies|retour en haut|"
    r"todos los derechos reservados|política de privacidad|aceptar (todas )?las cookies|volver arriba)"
)
SENTENCE_END = r"[.!?…。][\"'”’»)\]]*([ \x09-\x0D]|$)"

_boilerplate, _end = re.compile(BOILERPLATE), re.compile(SENTENCE_END)
_symbols, _blanks = SYMBOLS.encode(), b" \t\n\x0b\x0c\r"
#: Odd multipliers that set the places of a window apart.
_places = (np.arange(WINDOW, dtype=np.uint64) * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)


def line_fails(line: str, raw: bytes, words: list[bytes], chars: int) -> bool:
    """Whether a line, raw in UTF-8, with these words of chars characters in all, is to be removed."""
    if line.count("|") + line.count("»") + line.count("›") >= MIN_SEPARATORS:
        return True
    if len(words) <= MAX_NOTICE_WORDS and _boilerplate.search(line):
        return True
    if 100 * (len(raw) - len(raw.translate(None, _symbols))) > MAX_SYMBOL_PERCENT * chars:
        return True
    if (b"!!" in raw or b"??" in raw) and 100 * sum(w.endswith((b"!!", b"??")) for w in words) > MAX_SHOUT_PERCENT * len(words):
        return True
    return len(words) >= NEEDS_STOP and not _end.search(line)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = each[:n] * _places[0]
    for k in range(1, WINDOW):
        sums += each[k : n + k] * _places[k]
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():  # equal windows have equal sums, so none repeats
        return 0
    windows = list(zip(*[words[k:] for k in range(WINDOW)], strict=False))
    counts, covered, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + WINDOW - max(i, covered)
            covered = i + WINDOW
    return total


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, cleaned text."""
    text = text or ""
    n_words = word_chars = dup_lines = lost = symbols = 0
    seen: set[str] = set()
    all_words: list[bytes] = []
    good: list[str] = []
    for line in text.split("\n"):
        raw = line.encode("utf-8", "surrogatepass")
        words = raw.split()  # at the six ASCII blanks
        if not words:
            continue
        if line in seen:
            dup_lines += 1
        seen.add(line)
        chars = len(line) - len(raw) + len(raw.translate(None, _blanks))
        symbols += len(raw) - len(raw.translate(None, _symbols))
        n_words += len(words)
        word_chars += chars
        all_words += words
        if line_fails(line, raw, words, chars):
            lost += chars
        else:
            good.append(line)
    repeat = repeated_words(all_words)
    failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words
    kept = not failed and 100 * lost <= MAX_LOSS_PERCENT * word_chars
    return n_words, word_chars, symbols, dup_lines, repeat, failed, lost, kept, "\n".join(good)


FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("lost_chars", T.LongType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("cleaned", T.StringType()),
]


def clean_lines(df: DataFrame, text: str = "text", keep: list[str] | None = None, cleaned: bool = True) -> DataFrame:
    """Add the measures, the verdict and the cleaned text (left out unless cleaned)."""
    fields = FIELDS if cleaned else FIELDS[:-1]

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [judge(t.as_py())[: len(fields)] for t in batch.column(batch.schema.get_field_index(text))]
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            kinds = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}
            return [pa.array(list(c), kinds[f.dataType]) for c, f in zip(columns, fields, strict=True)]

        return step

    return add_with_arrow(df, fields, make, keep)
