import numpy as np
from pyspark.sql import functions as F

from attestra.llm import ann, queries


def brute(ids, points, q, k):
    scores = points @ points[q]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def test_recall_of_the_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, points = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in queries.op7_ann(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queried = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(got) == {int(ids[i]) for i in queried}
    hits = 0
    for i in queried:
        own = sorted(got[int(ids[i])])
        assert [r for r, _, _ in own] == list(range(1, 21))
        hits += len({v for _, v, _ in own} & {v for v, _ in brute(ids, points, i, 20)})
    assert hits >= 0.95 * 20 * len(queried)


def test_graph_finds_near_copies():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(800, 16)), rng.normal(size=(800, 16))])
    graph = ann.Graph(points).build()
    asked = np.arange(0, 1_600, 40)
    hits = 0
    for i, found in zip(asked, graph.search(points[asked].astype(np.float32)), strict=True):
        d = ((points - points[i]) ** 2).sum(1)
        hits += len(set(found[:10].tolist()) & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 400


def test_lists_are_bounded_and_have_no_node_twice():
    rng = np.random.default_rng(2)
    graph = ann.Graph(np.vstack([rng.normal(size=(900, 8)), 3 + 0.001 * rng.normal(size=(400, 8))])).build()
    for level, links in enumerate(graph.levels):
        assert links.shape == (1_300, (ann.M if level else ann.M0) + ann.SPARE)
        for node, row in enumerate(links):
            own = row[row >= 0].tolist()
            assert len(own) == len(set(own)) and node not in own and (row[len(own) :] == -1).all()
            assert all(graph.heights[m] >= level for m in own) and (graph.heights[node] >= level or not own)


def test_recall_over_shards_of_thousands(spark):
    """Plain and clustered vectors in shards of 3,000 nodes, far more than a search keeps."""
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(4_000, 24)), np.repeat(rng.normal(size=(40, 24)), 50, axis=0) + 0.05 * rng.normal(size=(2_000, 24))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, shards=2).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[i] & {v for v, _ in brute(np.arange(6_000), points, i, 20)}) for i in range(0, 6_000, 100))
    assert hits >= 0.95 * 20 * 60


def test_ties_across_shards(spark):
    """Vectors on a line of equal inner products in eight shards: the smallest ids win."""
    rows = [(i, [1.0, float(i + 1)]) for i in range(200)] + [(1_000, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") == 1_000, k=200, shards=8).orderBy("rank").collect()
    assert [r.vec_id for r in out] == list(range(200)) and {r.score for r in out} == {1.0}


def test_ties_copies_and_unfit_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.5, 0.5]), (101, [0.0, 0.0]), (102, None), (103, [float("nan"), 1.0]), (104, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 0.0]), (105, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    out = ann.nearest(df, F.col("vec_id").isin(3, 100, 101), k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(3, 0), (3, 1), (3, 2), (3, 4), (3, 5), (100, 0), (100, 1), (100, 2), (100, 3), (100, 4)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 1).count() == 0
    few = ann.nearest(df.where("vec_id IN (1, 2, 100)"), F.col("vec_id") == 1, k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(2, 1.0), (100, 0.5)]


def test_recall_whatever_the_norms(spark):
    """One vector of 10,000 times the others' norm, all at 1e25 or 1e-25, norms spread over many powers: full results, recall as ever."""
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(3_000, 24))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    one = unit.copy()
    one[17] *= 10_000
    for points in (one, unit * 1e25, unit * 1e-25, unit * np.exp(rng.normal(0, 3, (3_000, 1)))):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 60 == 0).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert all(len(got[i]) == 20 for i in range(0, 3_000, 60))
        hits = sum(len(set(got[i]) & {v for v, _ in brute(np.arange(3_000), points, i, 20)}) for i in range(0, 3_000, 60))
        assert hits >= 0.95 * 20 * 50


def test_norms_at_the_ends_of_doubles(spark):
    rows = [(i, [s * c, s]) for i, (s, c) in enumerate((s, c) for s in (1e-300, 1e-160, 1.0, 1e160, 1e300) for c in (0.5, 1.0, 2.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") == 7, k=20).orderBy("rank").collect()
    want = sorted(((-(v[0] * rows[7][1][0] + v[1] * rows[7][1][1]), i) for i, v in rows if i != 7))
    assert [(r.vec_id, r.score) for r in out] == [(i, -s) for s, i in want]
