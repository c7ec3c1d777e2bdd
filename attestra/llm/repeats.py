"""Removal of repeated passages: Rabin-Karp hashes of every window of so many words, counted in Spark, merged into intervals.

A word goes if a window that covers it has the words of a window that starts in a document with a smaller id. Windows are judged
on the input, not on what is left.

1. Each task hashes the windows of its texts and sorts a flush of them: of a window that several of its documents have, only the one with
   the smallest id is sent on by its hash; the others are decided. So a passage that a third of all documents share
   arrives once a flush, not once a document.
2. Windows meet by ranges of their hashes. All documents of a window but the one with the smallest id are told about it.
3. What documents are told meets their texts, dealt by id. Told windows are found by their hashes, and the words that they cover merge
   into maximal intervals.

Windows travel as packed arrays, a row for each flush and range: the ids of a row and how many windows of each follow
one another, bytes of like place side by side, so that Spark's own compression has runs to find.

Hashes are 64-bit polynomials over hashed words, put through a bijection: two different windows meet with a chance of 2**-64, about
once in all pairs of four thousand million windows.

Defined results: a null text and one with fewer words than a window lose nothing; a window that repeats within its document
only is kept; rows that share an id are one document: they don't remove from one another, and the same windows go in each;
a row without an id loses nothing, and nothing is removed on its account; ids are whole numbers; a column named like an added one is
replaced, others are carried over; an empty table gives no rows. Texts are hashed whole, one a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attestra.llm.common import Workspace, bounded_batches
from attestra.llm.ngram_join import mix, word_hashes

WINDOW = 13
#: Bytes of text whose windows meet in one task, and whose texts do at the end.
PART_BYTES = 32 << 20
#: Windows that a task sorts at once before it sends them on.
FLUSH = 2_000_000
BASE = np.uint64(0xD6E8FEB86659FD93)
_values = np.random.default_rng(20_250_113).integers(1, 1 << 63, 256, dtype=np.uint64)
#: What a block says: these documents have these windows (by hash range), or must remove them (by document).
HAVE, GONE, TEXT = 0, 1, 2
BLOCK = "part int, kind int, ids binary, counts binary, hashes binary"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """The polynomial in BASE of every n words in a row, put together from spans of 1, 2, 4 and so on."""
    out, have, span, size, up = None, 0, words, 1, np.array([BASE])
    while True:
        if n & size:
            if out is None:
                out = span
            else:
                m = max(0, len(words) - have - size + 1)
                out = out[:m] * up + span[have : have + m]
            have += size
        if have == n:
            return out
        span = span[:-size] * up + span[size:]
        size, up = 2 * size, up * up


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, data) of a string column; null is empty."""
    column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return bounds - bounds[0], np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]


def windows(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position in the text) of every window of the column's texts, in order."""
    bounds, data = column_bytes(column)
    doc, words = word_hashes(data, bounds[:-1], bounds[1:], _values)
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
    owner = doc[: len(whole)][whole]
    first = np.searchsorted(doc, owner)
    return mix(rolled(words, n)[whole]), owner, np.flatnonzero(whole) - first


def planes(values: np.ndarray, kind: str) -> bytes:
    """The values' bytes, all first ones, then all second ones."""
    return values.astype(kind).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def place(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of each document, as text_place has it."""
    some, at = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(str(i).encode()) % parts for i in some.tolist()], np.int64)[at] if len(ids) else np.empty(0, np.int64)


def blocks(kind: int, part: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Rows of BLOCK, one for each part; within a part, windows of one id that lie side by side share its entry."""
    order = np.argsort(part, kind="stable")
    part, ids, hashes = part[order], ids[order], hashes[order]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (ids[1:] != ids[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(heads, append=len(part))
    cuts = np.flatnonzero(np.diff(part[heads].astype(np.int64), prepend=-1))
    rows: list[list] = [[], [], [], []]
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(heads)][: len(cuts)], strict=True):
        low, high = int(heads[a]), int(heads[b - 1] + counts[b - 1])
        for out, value in zip(rows, (int(part[low]), planes(ids[heads[a:b]], "<i8"), planes(counts[a:b], "<u4"), hashes[low:high].tobytes()), strict=True):
            out.append(value)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[0], pa.int32()), pa.array(np.full(len(rows[0]), kind), pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=[c.split()[0] for c in BLOCK.split(", ")]
    )


def least_owners(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: one entry of each hash, with its smallest id; and all entries whose id is larger than that."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    heads, own = np.flatnonzero(new), ids[order]
    least = np.repeat(np.minimum.reduceat(own, heads), np.diff(heads, append=len(h))) if len(h) else own
    larger = own > least
    # The first entry of a run that isn't larger: runs of one are their own.
    number = np.cumsum(new) - 1
    at = np.flatnonzero(~larger)
    first = at[np.diff(number[at], prepend=-1) > 0] if len(at) else at
    one, more = np.zeros(len(h), bool), np.zeros(len(h), bool)
    one[order[first]] = True
    more[order] = larger
    return one, more


def told(docs: DataFrame, parts: int, n: int, flush_at: int = FLUSH) -> DataFrame:
    """BLOCK rows, by document, of the windows that each has to remove. docs: _id and _text."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, ids = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            one, more = least_owners(hashes, ids)
            span = (hashes[one] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            yield blocks(HAVE, span.astype(np.min_scalar_type(parts)), ids[one], hashes[one])
            yield blocks(GONE, place(ids[more], parts), ids[more], hashes[more])

        for batch in batches:
            hashes, owner, _ = windows(batch.column(1), n)
            waiting.append((hashes, batch.column(0).to_numpy()[owner]))
            if sum(len(h) for h, _ in waiting) >= flush_at:
                yield from flush()
        if waiting:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes = [], []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            yield batch.filter(pa.array(kind == GONE))
            for row in batch.filter(pa.array(kind == HAVE)).select([2, 3, 4]).to_pylist():
                ids.append(np.repeat(unplaned(row["ids"], "<i8"), unplaned(row["counts"], "<u4")))
                hashes.append(np.frombuffer(row["hashes"], "<u8"))
        if ids:
            owner, window = np.concatenate(ids), np.concatenate(hashes)
            ids.clear(), hashes.clear()
            _, more = least_owners(window, owner)
            owner, window = owner[more], window[more]
            order = np.argsort(owner, kind="stable")
            yield blocks(GONE, place(owner[order], parts), owner[order], window[order])

    return docs.mapInArrow(send, BLOCK).repartitionById(parts, F.col("part")).mapInArrow(meet, BLOCK)


def intervals(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal half-open runs of true values."""
    steps = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))


ADDED = "n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, window: int = WINDOW, part_bytes: int = PART_BYTES, flush: int = FLUSH) -> DataFrame:
    """docs (columns keep, all by default) with n_words, n_removed, removed (positions of words, from 0, ends exclusive) and kept_text, the
    words that stay joined by one space."""
    spark = docs.sparkSession
    bounded_batches(spark)
    added = T.StructType.fromDDL(ADDED)
    names = {f.name.lower() for f in added.fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    own = {c: f"_own{i}" for i, c in enumerate(kept)}
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // part_bytes))
    space = Workspace(spark, "repeats")
    # What was shuffled for this table has no further use; Spark may drop it once the table is there.
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        gone = space.written(told(rows.select("_id", "_text").where("_id IS NOT NULL"), parts, window, flush), "told")
    finally:
        spark.conf.set(CLEANUP, before)
    there = (F.crc32(F.coalesce(F.col("_id").cast("string"), F.col("_text"), F.lit(""))) % parts).cast("int")
    both = gone.unionByName(rows.withColumns({"part": there, "kind": F.lit(TEXT)}), allowMissingColumns=True)
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("kind")
    schema = T.StructType([*[rows.schema[a] for a in own.values()], *added.fields])
    removed_type = to_arrow_type(added["removed"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        known: dict[int, np.ndarray] | None = None
        for batch in batches:
            field = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            kind = field("kind").to_numpy()
            for row in batch.filter(pa.array(kind == GONE)).select(["ids", "counts", "hashes"]).to_pylist():
                ids.append(np.repeat(unplaned(row["ids"], "<i8"), unplaned(row["counts"], "<u4")))
                hashes.append(np.frombuffer(row["hashes"], "<u8"))
            batch = batch.filter(pa.array(kind == TEXT))
            if not len(batch):
                continue
            field = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            if known is None:
                known = {}
                if ids:
                    owner, window_hash = np.concatenate(ids), np.concatenate(hashes)
                    order = np.lexsort((window_hash, owner))
                    owner, window_hash = owner[order], window_hash[order]
                    heads = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
                    known = dict(zip(owner[heads].tolist(), np.split(window_hash, heads[1:]), strict=True))
                    ids.clear(), hashes.clear()
            bounds, data = column_bytes(field("_text"))
            raw, doc_ids = data.tobytes(), field("_id").to_pylist()
            found, owner, at = windows(field("_text"), window)
            edges = np.searchsorted(owner, np.arange(len(batch) + 1))
            n_words, n_removed, removed, texts = [], [], [], []
            for i, doc in enumerate(doc_ids):
                words = raw[bounds[i] : bounds[i + 1]].split()
                cut, asked = [], known.get(doc)
                if asked is not None and edges[i] < edges[i + 1]:
                    mine = found[edges[i] : edges[i + 1]]
                    hit = at[edges[i] : edges[i + 1]][asked[np.minimum(np.searchsorted(asked, mine), len(asked) - 1)] == mine]
                    steps = np.zeros(len(words) + 1, np.int32)
                    np.add.at(steps, hit, 1)
                    np.add.at(steps, hit + window, -1)
                    cut = intervals(np.cumsum(steps[:-1]) > 0)
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in cut))
                removed.append([{"start": a, "end": b} for a, b in cut])
                left, last = [], 0
                for a, b in cut:
                    left += words[last:a]
                    last = b
                texts.append(b" ".join([*left, *words[last:]]))
            yield pa.RecordBatch.from_arrays(
                [*[field(a) for a in own.values()], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, removed_type), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names
            )

    out = dealt.mapInArrow(run, schema).withColumnsRenamed({a: c for c, a in own.items()})
    return space.finish(out)
