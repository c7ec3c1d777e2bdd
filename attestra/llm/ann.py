"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged.

Vectors that are equal are one node (its smallest ids stand for the group when
results are spread out again). Nodes are dealt to shards by a hash of their id, a shard to a partition. Each shard is
built by one task into flat arrays, stored in chunks of its nodes: their ids, their vectors, and for each level their neighbour
lists as one integer matrix padded with -1. Nodes are inserted, and queries answered, a block at a time: the block's searches
go down the upper levels together and keep the best EF_BUILD or EF_SEARCH nodes each on the lowest one. Every query visits every
shard; a shard's queries are cut into blocks of tasks, each of which has the shard's arrays.

Nearness is the inner product in double precision. Graphs are built on vectors
extended by one component, sqrt(1 - squared norm), which makes
the order by distance the order by inner product; what a search keeps is scored on the original vectors. A shard only has nodes whose
norms lie within a factor of four, scaled by a power of two to norms below one, and queries are scaled to norm one; so single
precision tells a shard's nodes apart whatever the norms of others are, and neither very large nor very small vectors leave its range.

Defined results: vectors that are null or zero, or hold null or non-finite
components, take no part, neither do rows without an id or with a number of
components other than the commonest (of equally common ones the smallest); a query that takes no part has no rows; ties go to the
smaller id, in any shard; if there are fewer than k candidates, all are returned; rows that repeat an id with
equal vectors count once; columns other than id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import Workspace, bounded_batches

#: A shard has so many nodes or bytes of vectors at most; with EF_SEARCH, recall falls with its size (README).
SHARD_ROWS, SHARD_BYTES, MIN_SHARDS = 16_000, 32 << 20, 4
#: Links of a node on upper levels and on the lowest; a list grows by SPARE before it is chosen anew.
M, M0, SPARE = 16, 32, 16
EF_BUILD, EF_SEARCH = 80, 128
#: Nodes inserted or queries answered together, neighbours looked for within such a block, queries of a task, nodes of a stored chunk.
BLOCK, WITHIN, TASK_QUERIES, CHUNK = 256, 16, 16_384, 4_096
INDEX = "shard int, part int, n long, entry int, power int, ids binary, vectors binary, levels array<binary>"


def usable(vector: Column) -> Column:
    """Whether the vector takes part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def norm(vector: Column) -> Column:
    """The norm of an array of doubles, by way of its largest component, so that no square leaves the range."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return most * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(x / most, 2)))


def power(vector: Column) -> Column:
    """The power of two that brings a vector's norm below one, in steps of two; bounds are no powers of two, as norms often are one."""
    return (2 * F.floor((F.log2(norm(vector)) + 0.5) / 2) + 2).cast("int")


def extended(vectors: np.ndarray, power: int) -> np.ndarray:
    """Vectors scaled down by the power of two, with the component that brings each to norm one, in single precision."""
    x = np.ldexp(vectors, -power)
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
    return np.column_stack((x, rest)).astype(np.float32)


def directions(vectors: np.ndarray) -> np.ndarray:
    """Queries scaled to norm one, with a zero for the extra component."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.column_stack((x, np.zeros(len(x)))).astype(np.float32)


class Graph:
    """A hierarchical navigable small world over the rows of a matrix, worked on by blocks of rows."""

    def __init__(self, points: np.ndarray, levels: list[np.ndarray] | None = None, entry: int = -1, seed: int = 7):
        self.x, self.n = np.ascontiguousarray(points, np.float32), len(points)
        self.squares = np.einsum("ij,ij->i", self.x, self.x)
        self.entry, self.top = entry, -1
        if levels is not None:
            self.levels, self.top = levels, len(levels) - 1
            return
        self.heights = np.minimum((-np.log(np.random.default_rng(seed).random(self.n) + 1e-12) / np.log(M)).astype(int), 8)
        self.levels = [np.full((self.n, (M if k else M0) + SPARE), -1, np.int32) for k in range(int(self.heights.max(initial=0)) + 1)]
        self.degree = [np.zeros(self.n, np.int32) for _ in self.levels]

    def beam(self, q: np.ndarray, start: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest nodes that a search from start meets for each row of q, and their distances (less the query's own
        square), nearest first; padded with -1 and infinity."""
        links, rows = self.levels[level], np.arange(len(q))
        met = np.zeros((len(q), self.n), bool)
        met[rows, start] = True
        ids = np.full((len(q), ef), -1, np.int32)
        near = np.full((len(q), ef), np.inf, np.float32)
        done = np.ones((len(q), ef), bool)
        ids[:, 0], done[:, 0] = start, False
        near[:, 0] = self.squares[start] - 2 * np.einsum("ij,ij->i", self.x[start], q)
        active = rows
        while True:
            waiting = np.where(done[active], np.inf, near[active])
            pick = waiting.argmin(axis=1)
            some = np.isfinite(waiting[np.arange(len(active)), pick])
            active, pick = active[some], pick[some]
            if not len(active):
                break
            done[active, pick] = True
            found = links[ids[active, pick]]
            r, c = np.nonzero((found >= 0) & ~met[active[:, None], found])
            to, own = found[r, c], active[r]
            met[own, to] = True
            d = np.full(found.shape, np.inf, np.float32)
            d[r, c] = self.squares[to] - 2 * np.einsum("ij,ij->i", self.x[to], q[own])
            better = (d < near[active].max(axis=1)[:, None]).any(axis=1)
            changed = active[better]
            if len(changed):
                all_d = np.concatenate((near[changed], d[better]), axis=1)
                best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
                near[changed] = np.take_along_axis(all_d, best, axis=1)
                ids[changed] = np.take_along_axis(np.concatenate((ids[changed], found[better]), axis=1), best, axis=1)
                done[changed] = np.take_along_axis(np.concatenate((done[changed], np.zeros_like(found[better], bool)), axis=1), best, axis=1)
                ids[~np.isfinite(near)] = -1
                done[~np.isfinite(near)] = True
        order = np.argsort(near, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1)

    def diverse(self, found: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
        """Of each row's nodes, nearest first at true distances d: those nearer to the row than to any kept, filled up with the nearest."""
        x, sq = self.x[found], self.squares[found]
        between = sq[:, :, None] + sq[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
        kept, valid, n = np.zeros(found.shape, bool), np.isfinite(d), np.zeros(len(found), np.int64)
        for i in range(found.shape[1]):
            hidden = ((between[:, i, :] <= d[:, i, None]) & kept).any(axis=1)
            kept[:, i] = valid[:, i] & ~hidden & (n < most)
            n += kept[:, i]
        place = np.arange(found.shape[1]) + found.shape[1] * (~kept + 2 * ~valid)
        first = np.argsort(place, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(valid, first, axis=1), np.take_along_axis(found, first, axis=1), -1)

    def _nearest_first(self, of: np.ndarray, found: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """found (rows of candidates for the nodes `of`, -1 for none) by true distance, the nearest `most` of them."""
        x = self.x[found]
        d = self.squares[of][:, None] + self.squares[found] - 2 * np.einsum("ijk,ik->ij", x, self.x[of])
        d[found < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(found, order, axis=1), np.take_along_axis(d, order, axis=1)

    def _link(self, level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Set the lists of new nodes and add them to those of the chosen ones; a list that is full is chosen anew."""
        links, degree = self.levels[level], self.degree[level]
        links[nodes, : chosen.shape[1]], degree[nodes] = chosen, (chosen >= 0).sum(axis=1)
        to, source = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        new = (to >= 0) & ~(links[to] == source[:, None]).any(axis=1)
        order = np.argsort(to[new], kind="stable")
        to, source = to[new][order], source[new][order]
        owner, first, count = np.unique(to, return_index=True, return_counts=True)
        place = degree[to] + np.arange(len(to)) - np.repeat(first, count)
        room = np.repeat(degree[owner] + count <= links.shape[1], count)
        links[to[room], place[room]] = source[room]
        degree[owner] += np.where(degree[owner] + count <= links.shape[1], count, 0)
        full = ~np.isin(owner, to[room])
        width, most = links.shape[1], links.shape[1] - SPARE
        for a in range(0, full.sum(), BLOCK):
            mine, start, n = owner[full][a : a + BLOCK], first[full][a : a + BLOCK], count[full][a : a + BLOCK]
            more = np.full((len(mine), n.max()), -1, np.int32)
            more[np.arange(n.max()) < n[:, None]] = source[np.concatenate([np.arange(s, s + k) for s, k in zip(start, n, strict=True)])]
            found, d = self._nearest_first(mine, np.concatenate((links[mine], more), axis=1), 2 * width)
            again = self.diverse(found, d, most)
            links[mine, :most], links[mine, most:], degree[mine] = again, -1, (again >= 0).sum(axis=1)

    def build(self) -> Graph:
        a = 0
        while a < self.n:
            b = min(self.n, a + min(BLOCK, max(a, 16)))
            nodes = np.arange(a, b)
            at, q = np.full(b - a, self.entry), self.x[a:b]
            for level in range(max(self.top, int(self.heights[a:b].max())), -1, -1):
                mine = self.heights[a:b] >= level
                if level <= self.top:
                    if (~mine).any():
                        at[~mine] = self.beam(q[~mine], at[~mine], level, 1)[0][:, 0]
                    far = self.beam(q[mine], at[mine], level, EF_BUILD)[0] if mine.any() else np.empty((0, EF_BUILD), np.int32)
                    at[mine] = far[:, 0]
                else:
                    far = np.empty((mine.sum(), 0), np.int32)
                own = nodes[mine]
                if len(own):
                    among = np.full((len(own), len(own)), -1, np.int32)
                    among[:] = own
                    np.fill_diagonal(among, -1)
                    close = self._nearest_first(own, among, WITHIN)[0]
                    found, d = self._nearest_first(own, np.concatenate((far, close), axis=1), EF_BUILD)
                    self._link(level, own, self.diverse(found, d, M))
            if self.heights[a:b].max() > self.top:
                self.top, self.entry = int(self.heights[a:b].max()), a + int(self.heights[a:b].argmax())
            a = b
        return self

    def search(self, q: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """The ef nodes that a search keeps for each row of q, -1 for none."""
        at = np.full(len(q), self.entry)
        for level in range(self.top, 0, -1):
            at = self.beam(q, at, level, 1)[0][:, 0]
        return self.beam(q, at, 0, ef)[0]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build_index(nodes: DataFrame, shards: int, dims: int) -> DataFrame:
    """The chunks of each shard. nodes: shard, power (one for all nodes of a shard), _node long, _v array<double> of dims components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, shard = [], [], None
        for batch in batches:
            if len(batch):
                shard, power = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
                ids.append(batch.column(2).to_numpy())
                vectors.append(matrix(batch.column(3), dims))
        if shard is None:
            return
        ids, vectors = np.concatenate(ids), np.concatenate(vectors)
        # Insertion in a hashed order, so that runs of near vectors are not inserted together, whatever order rows came in.
        order = np.argsort(ids, kind="stable")[np.random.default_rng(3).permutation(len(ids))]
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        graph = Graph(extended(vectors, power)).build()
        for part, a in enumerate(range(0, len(ids), CHUNK)):
            cut = slice(a, a + CHUNK)
            row = [[shard], [part], [len(ids)], [graph.entry], [power], [ids[cut].tobytes()], [vectors[cut].tobytes()], [[x[cut].tobytes() for x in graph.levels]]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    return nodes.select("shard", "power", "_node", "_v").repartitionById(shards, F.col("shard")).mapInArrow(run, INDEX)


def search_index(index: DataFrame, queries: DataFrame, shards: int, tasks: int, k: int, dims: int) -> DataFrame:
    """query_id, _node and score: the k + 1 best nodes of each shard for every query (_q long, _v). tasks: blocks that a shard's queries
    are cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, graph, waiting_q, waiting_v = [], None, [], []

        def answers() -> pa.RecordBatch:
            q, v = np.concatenate(waiting_q), np.concatenate(waiting_v)
            out: list[tuple] = []
            for a in range(0, len(q), BLOCK):
                part = v[a : a + BLOCK]
                kept = graph.search(directions(part))
                scores = np.einsum("ijk,ik->ij", points[kept], part)
                scores[kept < 0] = -np.inf
                node = ids[kept]
                best = np.lexsort((node, -scores), axis=1)[:, : k + 1]
                valid = np.take_along_axis(kept, best, axis=1) >= 0
                out.append((np.repeat(q[a : a + BLOCK], valid.sum(axis=1)), np.take_along_axis(node, best, axis=1)[valid], np.take_along_axis(scores, best, axis=1)[valid]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "_node", "score"])

        for batch in batches:
            kind = batch.column(1).to_numpy()
            stored, asked = batch.filter(pa.array(kind == 0)), batch.filter(pa.array(kind == 1))
            chunks += stored.select([3, 4, 5, 6, 7, 8]).to_pylist()
            if len(asked) and chunks:
                if graph is None:
                    ids = np.frombuffer(b"".join(c["ids"] for c in chunks), np.int64)
                    points = np.frombuffer(b"".join(c["vectors"] for c in chunks), np.float64).reshape(-1, dims)
                    levels = [np.frombuffer(b"".join(c["levels"][i] for c in chunks), np.int32).reshape(len(ids), -1) for i in range(len(chunks[0]["levels"]))]
                    graph = Graph(extended(points, chunks[0]["power"]), levels, chunks[0]["entry"])
                    chunks = [None]
                waiting_q.append(asked.column(9).to_numpy())
                waiting_v.append(matrix(asked.column(10), dims))
                if sum(map(len, waiting_q)) >= BLOCK:
                    yield answers()
                    waiting_q, waiting_v = [], []
        if waiting_q:
            yield answers()

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    each = index.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    stored = each.select((F.col("shard") * tasks + F.col("_t")).alias("unit"), F.lit(0).alias("kind"), "part", "n", "entry", "power", "ids", "vectors", "levels", none("long", "_q"), none("array<double>", "_v"))
    there = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    unit = F.col("shard") * tasks + F.pmod(F.xxhash64("_q"), F.lit(tasks)).cast("int")
    missing = [none(t, c) for t, c in (("int", "part"), ("long", "n"), ("int", "entry"), ("int", "power"), ("binary", "ids"), ("binary", "vectors"), ("array<binary>", "levels"))]
    asked = there.select(unit.alias("unit"), F.lit(1).alias("kind"), *missing, "_q", "_v")
    both = stored.unionByName(asked).repartitionById(shards * tasks, F.col("unit")).sortWithinPartitions("kind", "part")
    return both.mapInArrow(run, "query_id long, _node long, score double")


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest rows found, itself left out."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), is_query.alias("_is_query"))
    rows = rows.where(F.col("_id").isNotNull() & usable(F.col("_v")))
    totals = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n"), F.count_if("_is_query").alias("q")).orderBy(F.desc("n"), "d").first()
    if totals is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, space = totals["d"], Workspace(spark, "ann")
    most = max(1_000, min(SHARD_ROWS, SHARD_BYTES // (8 * dims)))
    shards = shards or max(MIN_SHARDS, -(-totals["n"] // most))
    rows = rows.where(F.size("_v") == dims).withColumn("power", power(F.col("_v")))
    # Doubles have some 1,100 ranges of norms; each gets shards of its own.
    ranges = {r["power"]: r["n"] for r in rows.groupBy("power").agg(F.count("*").alias("n")).collect()}
    own = {p: max(1, -(-n // most), shards * n // totals["n"]) for p, n in ranges.items()}
    start = dict(zip(sorted(own), np.cumsum([0, *[own[p] for p in sorted(own)]]).tolist(), strict=False))
    shards = sum(own.values())
    place = F.create_map(*[F.lit(v) for p in own for v in (p, start[p])])[F.col("power")], F.create_map(*[F.lit(v) for p, n in own.items() for v in (p, n)])[F.col("power")]
    tasks = max(1, -(-totals["q"] // TASK_QUERIES), -(-spark.sparkContext.defaultParallelism // shards))
    # Equal vectors: one node; hashing first keeps the grouping key short.
    print_ = F.sha1(F.array_join(F.col("_v").cast("array<string>"), ","))
    rows = space.written(rows.withColumn("_same", print_).dropDuplicates(["_id", "_same"]), "vectors")
    first = rows.groupBy("_same").agg(F.min_by(F.struct("_id", "_v", "power"), "_id").alias("r")).select(F.col("r._id").alias("_node"), F.col("r._v").alias("_v"), "r.power")
    dealt = first.withColumn("shard", (place[0] + F.pmod(F.xxhash64("_node"), place[1])).cast("int"))
    index = space.written(build_index(dealt, shards, dims), "graphs")
    queries = rows.where("_is_query").select(F.col("_id").alias("_q"), "_v")
    found = search_index(index, queries, shards, tasks, k, dims)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "_node")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    # The k + 1 smallest ids of each group of equal vectors are all that a result can hold.
    members = rows.join(rows.groupBy("_same").agg(F.min("_id").alias("_node")), "_same")
    order = Window.partitionBy("_node").orderBy("_id")
    members = members.select("_node", "_id").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")
    spread = found.join(members, "_node").where(F.col("_id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    ranked = spread.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return space.finish(ranked.select("query_id", "rank", F.col("_id").alias("vec_id"), "score"))


def exact(batches: Iterator[pd.DataFrame], candidates: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """Brute force on small inputs; to measure recall in tests."""
    points = np.stack(candidates["v"].to_numpy()).astype(np.float64)
    ids = candidates["id"].to_numpy()
    for batch in batches:
        out = []
        for q, v in zip(batch["id"], batch["v"], strict=True):
            scores = points @ np.asarray(v, np.float64)
            order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
            out += [(q, r, int(ids[i]), float(scores[i])) for r, i in enumerate(order, 1)]
        yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
