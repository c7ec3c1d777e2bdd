r"""Fill-in-the-middle transformation: texts cut at unit ends, the parts moved behind sentinels.

A unit is a line with its `\n`, or what is left behind the last one. Where units end is looked up in the UTF-8 bytes
eight at a time: a batch of texts is one array of 64-bit words; byte arithmetic marks every `\n` of a word, a population
count a word and their running sum rank the marks, a binary search in the sums finds the word that holds the k-th mark, and prefix
counts within that word its byte. Code points are counted by the same sums over the bytes that continue one.

Which cut is made follows from the id alone, so a lost task makes the same one again. `restored` gives the text back.

Defined results: a null text is empty, and an empty text stays plain; so does one that holds a sentinel; a text without `\n`
is one unit; a null id is an empty string behind the seed; rows that repeat an id are cut at the same numbers;
a column named like an added one is replaced, others are carried over; an empty table gives no rows. A text is a row
and has to fit one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import add_with_arrow, without

SEED, RATE_PERCENT, SPM_PERCENT = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"

ONES, LOW7, HIGH = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
ENDS = np.uint64(ord("\n")) * ONES


def words_of(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, filled up with zeros."""
    out = np.zeros(len(data) // 8 + 1, "<u8")
    out.view(np.uint8)[: len(data)] = data
    return out


def line_ends(words: np.ndarray) -> np.ndarray:
    r"""The high bit of every byte that is `\n`: those that are zero once it is taken out. No carry leaves a byte."""
    x = words ^ ENDS
    return ~(((x & LOW7) + LOW7) | x | LOW7)


def continuations(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte 10xxxxxx, which continues a code point."""
    return words & ~(words << np.uint64(1)) & HIGH


class Marks:
    """Rank and select over the marked bytes (high bits) of a string."""

    def __init__(self, marks: np.ndarray):
        self.marks, self.upto = marks, np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.upto[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th mark, from 1."""
        word = np.searchsorted(self.upto, k, "left") - 1
        # How many marks each byte of the word has up to itself; those with fewer than asked for lie before the one.
        counts = (self.marks[word] >> np.uint64(7)) * ONES
        asked = (k - self.upto[word]).astype(np.uint64) * ONES
        enough = ((counts | HIGH) - asked) & HIGH
        return word * 8 + 8 - np.bitwise_count(enough)


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, first cut, second cut, code points of prefix, of middle) of the texts data[starts:ends]; h: two numbers a text."""
    words = words_of(data)
    lines, inner = Marks(line_ends(words)), Marks(continuations(words))
    before = lines.rank(starts)
    whole = lines.rank(ends) - before
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(starts), np.uint8)
    units = whole + ((ends > starts) & (last != ord("\n")))
    taken = np.sort(h % (units[:, None] + 1).astype(np.uint64), axis=1).astype(np.int64)

    def at(n: np.ndarray) -> np.ndarray:
        out = np.where(n > 0, ends, starts)
        inside = (n > 0) & (n <= whole)
        out[inside] = lines.select(before[inside] + n[inside]) + 1
        return out

    a, b = at(taken[:, 0]), at(taken[:, 1])
    points = lambda x, y: y - x - (inner.rank(y) - inner.rank(x))
    return units, a, b, points(starts, a), points(a, b)


def draws(key: Column, seed: int = SEED) -> Column:
    """Four 32-bit numbers of each id: the groups of eight digits at the head of the sha256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = SEED, rate: int = RATE_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """docs (columns keep, all by default) with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output.

    rate: percent of texts that are cut; spm: percent of those whose suffix comes first.
    """
    kept = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__fim_text"), draws(F.col(f"`{key}`"), seed).alias("__fim_draws"))

    def make():
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index("__fim_text"))
            n = len(texts)
            bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            bounds -= bounds[0]
            h = batch.column(batch.schema.get_field_index("__fim_draws")).flatten().to_numpy().reshape(-1, 4).astype(np.uint64)
            units, a, b, before, middle = cuts(data, bounds[:-1], bounds[1:], h[:, :2])
            marked = pc.match_substring_regex(texts, SENTINEL).to_numpy(zero_copy_only=False)
            plain = (bounds[:-1] == bounds[1:]) | marked | (h[:, 2] % 100 >= rate)
            first = h[:, 3] % 100 < spm
            raw, out = data.tobytes(), []
            for i, (start, x, y, end) in enumerate(zip(bounds[:-1].tolist(), a.tolist(), b.tolist(), bounds[1:].tolist(), strict=True)):
                if plain[i]:
                    out.append(raw[start:end])
                elif first[i]:
                    out.append(b"".join((s, raw[y:end], p, raw[start:x], m, raw[x:y])))
                else:
                    out.append(b"".join((p, raw[start:x], s, raw[y:end], m, raw[x:y])))
            form = np.where(plain, "plain", np.where(first, "spm", "psm"))
            return [
                pa.array(units, pa.int64()),
                pa.array(form.tolist(), pa.string()),
                pa.array(before, pa.int64(), mask=plain),
                pa.array(middle, pa.int64(), mask=plain),
                pa.array(out, pa.binary()).cast(pa.string()),
            ]

        return step

    return without(add_with_arrow(rows, FIELDS, make), "__fim_text", "__fim_draws")


def restored(output: Column, form: Column) -> Column:
    """The text back from output and form: a text that holds a sentinel is plain, so the three found are the ones put in."""
    parts = F.split(output, SENTINEL, -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
