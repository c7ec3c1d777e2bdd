"""Jaccard self-join on word n-grams: rare-first prefixes, length, positional and suffix filters, components.

Texts with equal shingle sets are one class. Shingles are ordered by how often
the corpus has them (a counting sketch over all texts, which grows with them up to 2**MOST_BITS counters) and then by hash; two
classes that are similar enough share a shingle among the first few of each, the
prefixes. Prefix entries meet by shingle; entries that no other class shares go at once.
What is left is joined in rounds, so that a large group of near copies never
emits all its pairs:

1. each class with two classes of each shingle it shares, picked by a hash of shingle and
   class, so that a group's shingles pick many of its members; this is done STARS times,
   each time only for shingles whose classes are in different components by now;
2. classes of one shingle that are still in different components.

In any round a pair passes the length filter, the positional filter (at its
first common shingle) once each, and is then verified once on the whole sets behind a suffix
filter. A pair that round 2 skips lies inside one component, so components are
those of all links. Any order of shingles gives right results; the sketch only
decides how few candidates there are.

Defined results: null texts and texts without words have no shingles and are components of
their own; a text of fewer than five words is one shingle, all of it; rows that share
an id are one document, linked; a row without an id has a null component; an empty table
gives no rows; texts of any length are cut into shingles whole; sets of equal size and shingles of equal rank need no
order of their own, as hashes decide; columns other than id and text are ignored. Shingles are 64-bit
hashes; classes are 64-bit sums of them together with the size of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import Workspace, bounded_batches, claim, written

#: Words of a shingle. Two sets link when 9 * overlap >= 4 * (sum of their sizes): a Jaccard similarity of 0.8 or more.
N = 5
#: The sketch has a counter for every SHINGLES_A_COUNTER shingles of the corpus, 2**MOST_BITS at most; tasks send counts at that
#: finest resolution, by blocks of 2**BLOCK_BITS counters, and they are added up at the one the corpus needs.
MOST_BITS, BLOCK_BITS, SHINGLES_A_COUNTER = 26, 16, 16
#: Rounds of stars before the classes that are left meet one another.
STARS = 2
#: A shingle gets so many parts as there are SPREAD entries in what the sketch counts above its mean; joins by shingle go by parts.
SPREAD, MOST_PARTS = 1_024, 4_096
#: Entries of a shingle with so many parts are dealt by class as well before they meet: some other class shares it for sure.
COMMON_PARTS = 48
BUCKET_ENTRIES, FLUSH_ENTRIES, SEEN_CLASSES, FLUSH_SHINGLES = 200_000, 200_000, 200_000, 1_000_000
#: Entries of one shingle up to which each is held against the others at once.
LOOK = 48
#: A set's outline: how many of its shingles lie in each of so many equal parts of the hash range.
PARTS = 128
#: Classes of one shingle that meet in one task at most; a larger group is cut into blocks, and blocks meet pairwise.
GROUP = 2_048
SEGMENT = 256 << 10
#: Ids that may be broadcast; beyond them the texts are joined by shuffling.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20_240_607)
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_byte[65:91] = _byte[97:123]  # A-Z as a-z
_blank = np.zeros(256, bool)
_blank[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_places = _rng.integers(1, 1 << 63, N, dtype=np.uint64) | np.uint64(1)
ENTRY = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        if len(up) < n:
            ps = np.full((2, n), [[_P], [_P_INV]], np.uint64)
            ps[:, 0] = 1
            up, down = np.cumprod(ps, axis=1, dtype=np.uint64)
            if n <= 2 * SEGMENT:  # those of a longer word are not kept
                self.up, self.down = up, down
        return up[:n], down[:n]


_powers = _Powers()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _byte) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every word of UTF-8 texts that lie at data[starts[i]:ends[i]]. values: a number for each byte."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    blank = _blank[data]
    opens, closes = np.empty(len(data), bool), np.empty(len(data), bool)
    opens[0] = closes[-1] = True
    opens[1:], closes[:-1] = blank[:-1], blank[1:]
    some = starts < ends
    opens[starts[some]] = True
    closes[ends[some] - 1] = True
    first, last = np.flatnonzero(opens & ~blank), np.flatnonzero(closes & ~blank) + 1
    hashes = np.empty(len(first), np.uint64)
    a = 0
    while a < len(first):  # in segments, so that a long text needs no long powers; a word is never cut
        base = int(first[a])
        b = max(int(np.searchsorted(last, base + SEGMENT, "right")), a + 1)
        part = data[base : last[b - 1]]
        up, down = _powers.to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[:-1], out=sums[1:])
        s, e = first[a:b] - base, last[a:b] - base
        hashes[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return np.searchsorted(ends, first, "right"), hashes


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values): the sorted distinct shingles of text i are values[bounds[i]:bounds[i + 1]]."""
    column = column.fill_null("")
    n = len(column)
    raw = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[raw[0] : raw[-1]]
    raw -= raw[0]
    doc, word = word_hashes(data, raw[:-1], raw[1:])
    words = np.bincount(doc, minlength=n)
    if len(word) >= N:
        m = len(word) - N + 1
        h = word[:m] * _places[0]
        for k in range(1, N):
            h += word[k : m + k] * _places[k]
        whole = doc[:m] == doc[N - 1 :]
        h, owner = mix(h[whole]), doc[:m][whole]
    else:
        h, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < N))
    if len(short):
        at = np.searchsorted(doc, short)
        each = [mix(np.array([(word[a : a + c] * _places[:c]).sum() + np.uint64(c)], np.uint64))[0] for a, c in zip(at, words[short], strict=True)]
        h, owner = np.append(h, np.array(each, np.uint64)), np.append(owner, short)
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    edges = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner[new], minlength=n), out=bounds[1:])
    return bounds, h[new]


def class_keys(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A key of each set that does not depend on order."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def outlines(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """The outline of each set, as bytes (255 stands for more)."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    part = (values >> np.uint64(57)).astype(np.int64)
    table = np.bincount(owner * PARTS + part, minlength=(len(bounds) - 1) * PARTS).reshape(-1, PARTS)
    return pa.array([row.tobytes() for row in table.clip(0, 255).astype(np.uint8)], pa.binary())


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def packed_counts(values: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    """Block, positions in it and their counts of the counters that the shingles fall on; counts above 255 take several rows."""
    counter, count = np.unique((values >> np.uint64(64 - MOST_BITS)).astype(np.uint32), return_counts=True)
    blocks, at, many = [], [], []
    while len(counter):
        cuts = np.flatnonzero(np.diff((counter >> np.uint32(BLOCK_BITS)).astype(np.int64), prepend=-1, append=-2))
        place, some = (counter & np.uint32((1 << BLOCK_BITS) - 1)).astype("<u2"), np.minimum(count, 255).astype(np.uint8)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            blocks.append(int(counter[a] >> np.uint32(BLOCK_BITS)))
            at.append(place[a:b].tobytes())
            many.append(some[a:b].tobytes())
        counter, count = counter[count > 255], count[count > 255] - 255
    return blocks, at, many


def profile(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, cls, outline), and what its task adds to the sketch (block, places, counts)."""
    names = ["doc_id", "n", "cls", "outline", "block", "places", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def batch_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join")
        waiting, held = [], 0

        def sent() -> pa.RecordBatch:
            blocks, places, counts = packed_counts(np.concatenate(waiting))
            return batch_of(block=blocks, places=places, counts=counts)

        for batch in batches:
            bounds, values = shingle_sets(_text(batch))
            waiting.append(values)
            held += len(values)
            yield batch_of(doc_id=batch.column(batch.schema.get_field_index("doc_id")), n=np.diff(bounds), cls=class_keys(bounds, values), outline=outlines(bounds, values))
            if held > FLUSH_SHINGLES:
                yield sent()
                waiting, held = [], 0
        if held:
            yield sent()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls long, outline binary, block int, places binary, counts binary")


class Sketch:
    """How common shingles are, in eighths of a power of two by their leading bits, and the parts that each such rank gets."""

    def __init__(self, ranks: np.ndarray, load: float):
        self.ranks, self.shift = ranks, np.uint64(65 - len(ranks).bit_length())
        above = np.exp2(np.arange(256) / 8) - 1 - load
        self.parts = np.clip(np.ceil(above / SPREAD), 1, MOST_PARTS).astype(np.int32)

    def rank(self, shingles: np.ndarray) -> np.ndarray:
        return self.ranks[shingles >> self.shift]


def sketch(profiled: DataFrame, total: int) -> Sketch:
    """The sketch of all shingles, total in number: a byte a counter, 2**MOST_BITS at most."""
    bits = min(MOST_BITS, max(MOST_BITS - BLOCK_BITS, (total // SHINGLES_A_COUNTER).bit_length()))
    fold, width = MOST_BITS - bits, 1 << (BLOCK_BITS - (MOST_BITS - bits))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = np.bincount(np.frombuffer(places, "<u2") >> fold, weights=np.frombuffer(counts, np.uint8), minlength=width)
                sums[block] = sums[block] + part if block in sums else part
        ranks = [np.round(8 * np.log2(s + 1.0)).clip(0, 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["block", "ranks"])

    blocks = profiled.where("block IS NOT NULL").select("block", "places", "counts")
    n = min(1 << (MOST_BITS - BLOCK_BITS), int(profiled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros(1 << bits, np.uint8)
    for row in blocks.repartitionById(n, F.col("block") % n).mapInArrow(add, "block int, ranks binary").collect():
        out[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["ranks"], np.uint8)
    return Sketch(out, total / len(out))


def prefix_entries(docs: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """Packed prefix entries by bucket of their shingle. A task sends a class once only. shared: the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join")
        known, seen = shared.value, set()
        waiting: list[np.ndarray] = []
        held = 0

        def send():
            entries = np.concatenate(waiting)
            common = known.parts[known.rank(entries["token"])] >= COMMON_PARTS
            dealt = np.where(common, mix(entries["token"] + entries["cls"].view(np.uint64)), entries["token"])
            bucket = (mix(dealt) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
            rows = [entries[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(rows, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            bounds, values = shingle_sets(_text(batch))
            keys = class_keys(bounds, values)
            how = known.rank(values)
            for i, cls in enumerate(keys.tolist()):
                a, b = bounds[i], bounds[i + 1]
                n = int(b - a)
                if not n or cls in seen:
                    continue
                if len(seen) < SEEN_CLASSES:
                    seen.add(cls)
                p = n - (4 * n + 4) // 5 + 1
                part = np.empty(p, ENTRY)
                part["token"] = values[a:b][np.argsort(how[a:b], kind="stable")[:p]]
                part["cls"], part["n"], part["pos"] = cls, n, np.arange(p)
                waiting.append(part)
                held += p
                if held >= FLUSH_ENTRIES:
                    yield send()
                    waiting, held = [], 0
        if waiting:
            yield send()

    return docs.select("text").mapInArrow(run, "bucket int, entries binary")


def shared_entries(packed: DataFrame, buckets: int, shared: Broadcast) -> DataFrame:
    """token, cls, n, pos of the entries whose shingle another class shares within the length and positional filters, the
    number of parts of the shingle and the part of the entry."""

    def distinct(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        e = np.frombuffer(b"".join(rows), ENTRY)
        e = e[np.lexsort((e["cls"], e["token"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["cls"][1:] != e["cls"][:-1])
        e = e[new]
        cuts = np.flatnonzero(np.concatenate(([True], e["token"][1:] != e["token"][:-1], [True])))
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        parts = shared.value.parts[shared.value.rank(e["token"])]
        alive = (parts >= COMMON_PARTS) | (size > LOOK)
        # Within a group that is small enough, an entry stays if some other passes the filters with it.
        for d in range(1, LOOK):
            a = np.flatnonzero(e["token"][d:] == e["token"][:-d])
            if not len(a):
                break
            b = a + d
            nx, ny = e["n"][a].astype(np.int64), e["n"][b].astype(np.int64)
            need = 4 * (nx + ny)
            good = (5 * nx >= 4 * ny) & (5 * ny >= 4 * nx) & (9 * (nx - e["pos"][a]) >= need) & (9 * (ny - e["pos"][b]) >= need)
            alive[a[good]] = True
            alive[b[good]] = True
        return e[alive], parts[alive]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join")

        def out(rows):
            e, parts = distinct(rows)
            own = (mix(e["cls"].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
            columns = [e["token"].astype(np.int64), e["cls"], e["n"], e["pos"], parts, own]
            for a in range(0, len(e), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[a : a + 100_000])) for c in columns], names=["token", "cls", "n", "pos", "parts", "part"])

        at, parts = None, []
        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at and parts:
                    yield from out(parts)
                    parts = []
                at = bucket
                parts.append(entries)
        if parts:
            yield from out(parts)

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "token long, cls long, n int, pos int, parts int, part int")


def may_meet() -> Column:
    """The length and positional filters of x and y that share the shingle at positions i and j.

    A pair that links passes at its first common shingle, so it is enough to let such meetings through.
    """
    length = (5 * F.col("nx") >= 4 * F.col("ny")) & (5 * F.col("ny") >= 4 * F.col("nx"))
    need = 4 * (F.col("nx") + F.col("ny"))
    return length & (9 * (F.col("nx") - F.col("i")) >= need) & (9 * (F.col("ny") - F.col("j")) >= need)


def filtered_pairs(met: DataFrame) -> DataFrame:
    """x, y once each from x, y, nx, ny, i, j, past the filters."""
    return met.where(may_meet()).select("x", "y").distinct()


def by_parts(entries: DataFrame, of_tokens: DataFrame, how: str = "inner") -> DataFrame:
    """entries joined with a row a shingle (token and parts), which goes to each part of a common shingle."""
    spread = of_tokens.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return entries.join(spread, ["token", "part"], how)


def star_pairs(entries: DataFrame, seed: int) -> DataFrame:
    """Pairs of each class with the two classes of its shingle that a hash picks, if their components differ. entries: also comp."""
    pick = F.struct(F.xxhash64("token", "cls", F.lit(seed)).alias("h"), "cls", "n", "pos", "comp")
    ends = entries.groupBy("token").agg(F.min(pick).alias("low"), F.max(pick).alias("high"), F.max("parts").alias("parts"))
    met = by_parts(entries.drop("parts"), ends).withColumn("other", F.explode(F.array("low", "high"))).where("cls <> other.cls AND comp <> other.comp")
    x_first = F.col("cls") < F.col("other.cls")
    side = lambda a, b: F.when(x_first, F.col(a)).otherwise(F.col(b))
    columns = [("x", "cls", "other.cls"), ("y", "other.cls", "cls"), ("nx", "n", "other.n"), ("ny", "other.n", "n"), ("i", "pos", "other.pos"), ("j", "other.pos", "pos")]
    return filtered_pairs(met.select(*[side(a, b).alias(c) for c, a, b in columns]))


def open_entries(entries: DataFrame, links: DataFrame, space: Workspace) -> DataFrame:
    """entries with the components of the links so far, of shingles whose classes lie in more than one."""
    found = components(links, space)
    placed = entries.drop("comp").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    still = placed.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max("parts").alias("parts")).where("a <> b").select("token", "parts")
    out = space.written(by_parts(placed, still, "left_semi"), "open")
    space.dropped(found)
    return out


def cross_pairs(placed: DataFrame, outlined: DataFrame) -> DataFrame:
    """Pairs of one shingle in different components. outlined: cls, outline.

    The classes of a shingle meet in Arrow tasks, which hand on what passes the length, positional and suffix filters;
    the latter holds the outlines against each other: two sets share at most the sum of the smaller counts.
    """
    sizes = placed.groupBy("token").agg(F.count("*").alias("m"), F.max("parts").alias("parts"))
    rows = by_parts(placed.drop("parts"), sizes).join(outlined, "cls")
    # Blocks of a large group: a row goes to the block pairs that its own block is in.
    blocks = F.ceil(F.col("m") / (GROUP // 2)).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "cls", "n", "pos", "comp", "outline")
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meeting = rows.repartition(n, "token", "a", "b").sortWithinPartitions("token", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join")
        at, held = None, []
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != at and held:
                        yield from meet(at, held)
                        held = []
                    at = keys[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield from meet(at, held)

    def meet(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        own, cls, n, pos, comp = (table.column(c).to_numpy() for c in ("own", "cls", "n", "pos", "comp"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        shape = np.frombuffer(b"".join(table.column("outline").to_pylist()), np.uint8).reshape(-1, PARTS)
        for i in range(len(cls) - 1):
            rest = slice(i + 1, None)
            need = 4 * (n[i] + n[rest])
            fine = (comp[rest] != comp[i]) & (5 * n[i] >= 4 * n[rest]) & (5 * n[rest] >= 4 * n[i]) & (9 * (n[i] - pos[i]) >= need) & (9 * (n[rest] - pos[rest]) >= need)
            if key[1] != key[2]:
                fine &= own[rest] != own[i]
            j = np.flatnonzero(fine)
            if len(j):
                share = np.minimum(shape[i], shape[i + 1 + j])
                full = (share == 255).any(axis=1)
                j = j[full | (9 * share.sum(axis=1, dtype=np.int64) >= need[j])]
            if len(j):
                other, mine = cls[i + 1 + j], np.full(len(j), cls[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other))], names=["x", "y"])

    return meeting.mapInArrow(run, "x long, y long").distinct()


def may_overlap(a: np.ndarray, b: np.ndarray, need: int, depth: int = 2) -> bool:
    """The suffix filter: sets split at b's median can't share more than the smaller of each two parts."""
    parts = [(a, b)]
    for _ in range(depth):
        split = []
        for p, q in parts:
            if len(p) and len(q):
                k = len(q) // 2
                at = int(np.searchsorted(p, q[k]))
                split += [(p[:at], q[:k]), (p[at:], q[k:])]
        parts = split
        if sum(min(len(p), len(q)) for p, q in parts) < need:
            return False
    return True


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    need = -(-4 * (len(a) + len(b)) // 9)
    if min(len(a), len(b)) < need or not may_overlap(a, b, need):
        return False
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, space: Workspace) -> DataFrame:
    """The pairs that link, as a table. pairs: x, y of classes, once each; classes: cls, rep."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct().join(classes.select("cls", "rep"), "cls")
    wanted = space.written(wanted.select("cls", F.col("rep").alias("doc_id")), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.select("doc_id", "text").join(ids, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, values = shingle_sets(_text(batch))
            keys = class_keys(bounds, values)
            cls = batch.column(batch.schema.get_field_index("cls")).to_numpy()
            rows = [i for i in range(len(keys)) if keys[i] == cls[i]]  # a row that repeats the id may hold another text
            yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in rows], pa.binary())], names=["cls", "values"])

    found = space.written(texts.mapInArrow(sets, "cls long, values binary"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, vx, vy = (batch.column(i).to_pylist() for i in range(4))
            good = [i for i in range(len(x)) if linked(np.frombuffer(vx[i], np.uint64), np.frombuffer(vy[i], np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.int64()), pa.array([y[i] for i in good], pa.int64())], names=["x", "y"])

    one = found.dropDuplicates(["cls"])
    both = pairs.join(one.select(F.col("cls").alias("x"), F.col("values").alias("vx")), "x").join(one.select(F.col("cls").alias("y"), F.col("values").alias("vy")), "y")
    links = space.written(both.select("x", "y", "vx", "vy").mapInArrow(check, "x long, y long"), "links")
    space.dropped(wanted, found)
    return links


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """node, comp (the least node reachable) for every node of the edges x, y: alternating large and small stars."""
    at = space.written(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, at = at, space.written(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        space.dropped(before)
        now = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now["n"]:
            break
        state = now
    found = at.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    out = space.written(found, "components")
    space.dropped(at)
    return out


def prepared(docs: DataFrame, key: str, text: str, space: Workspace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs, rows, classes, entries): doc_id and text; doc_id, n and cls of each row; cls, n, rep and outline of each class with an id;
    prefix entries that another class shares."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    profiled = space.written(profile(docs), "profile")
    rows = profiled.where("block IS NULL").select("doc_id", "n", "cls", "outline")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.min("outline").alias("outline"))
    classes = space.written(classes, "classes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(sketch(profiled, total))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 5 // BUCKET_ENTRIES))
    some = docs.where("doc_id IS NOT NULL")
    entries = space.written(shared_entries(prefix_entries(some, shared, buckets), buckets, shared), "entries")
    kept = space.written(rows.drop("outline"), "rows")
    space.dropped(profiled)
    return some, kept, classes, entries


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    space = Workspace(docs.sparkSession, "ngram-join")
    some, rows, classes, entries = prepared(docs, key, text, space)
    links, done = None, None
    placed = entries.withColumn("comp", F.col("cls"))
    for turn in range(STARS + 1):
        pairs = star_pairs(placed, turn) if turn < STARS else cross_pairs(placed, classes.select("cls", "outline"))
        pairs = space.written(pairs.join(done, ["x", "y"], "left_anti") if done is not None else pairs, "pairs")
        if pairs.isEmpty() and links is not None:
            if placed.isEmpty():
                break
            continue  # the picks of a round may repeat; pairs that have not met are left to cross_pairs
        new = verified(some, classes, pairs, space)
        links = new if links is None else links.unionByName(new)
        done = pairs if done is None else done.unionByName(pairs)
        if turn < STARS:
            before, placed = placed, open_entries(entries, links, space)
            space.dropped(before)
    reps = classes.select(F.col("cls"), F.col("rep"))
    edges = links.join(reps.select(F.col("cls").alias("x"), F.col("rep").alias("rx")), "x").join(reps.select(F.col("cls").alias("y"), F.col("rep").alias("ry")), "y")
    # Rows that share an id link their classes.
    own = rows.where("n > 0").join(classes.drop("outline"), ["cls", "n"]).select(F.col("doc_id"), "cls", "n", "rep")
    again = own.where("doc_id <> rep").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    found = components(edges.select(F.col("rx").alias("x"), F.col("ry").alias("y")).unionByName(again), space)
    placed = rows.join(classes.drop("outline"), ["cls", "n"], "left").withColumn("node", F.coalesce("rep", "doc_id"))
    placed = placed.join(found, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node"))
    return space.finish(placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")))


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(x, y of each pair of representatives that links, least first; doc_id and rep of each row with shingles and an id).

    All links between different sets, those inside a component too: as many rows as there are such links.
    """
    space = Workspace(docs.sparkSession, "ngram-pairs")
    some, rows, classes, entries = prepared(docs, key, text, space)
    pairs = space.written(cross_pairs(entries.withColumn("comp", F.col("cls")), classes.select("cls", "outline")), "pairs")
    links = verified(some, classes, pairs, space)
    reps = classes.select("cls", "rep")
    named = links.join(reps.select(F.col("cls").alias("x"), F.col("rep").alias("a")), "x").join(reps.select(F.col("cls").alias("y"), F.col("rep").alias("b")), "y")
    members = written(rows.where("n > 0 AND doc_id IS NOT NULL").join(classes.drop("outline"), ["cls", "n"]).select("doc_id", "rep"), "ngram-members")
    return space.finish(named.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))), members
