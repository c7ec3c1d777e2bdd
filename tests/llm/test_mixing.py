import math

import duckdb
from pyspark.sql import functions as F

from attestra.llm import mixing, queries
from tests.compare import check


def brute(u, rate):
    k, p, below = 0, math.exp(-rate), math.exp(-rate)
    while u >= below:
        k += 1
        p *= rate / k
        below += p
    return k


def test_inversion(spark):
    rows = [(i / 97, rate) for i in range(97) for rate in (0.01, 0.5, 1.0, 3.7, 20.0)]
    df = spark.createDataFrame(rows, "u double, rate double")
    first, most = F.lit(0).cast("long"), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 16).cast("long")
    below = mixing.cumulative(F.col("rate"), first, most, F.exp(-F.col("rate")))
    for r in df.withColumn("k", mixing.poisson_count(F.col("u"), first, below)).collect():
        assert r.k == brute(r.u, r.rate)


def test_targets(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 30 == 1, "small").otherwise(None).alias("source"), F.lit(1).alias("copy"))
    out = mixing.replicate(df, weights={"big": 1.0, "small": 3.0}, total=20_000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"big", "small"} and abs(n["big"] - 5_000) < 300 and abs(n["small"] - 15_000) < 500
    again = mixing.replicate(df.repartition(7), weights={"big": 1.0, "small": 3.0}, total=20_000)
    assert out.select("doc_id", "copy", "mix_key").exceptAll(again.select("doc_id", "copy", "mix_key")).count() == 0


def test_beyond_the_broadcast(spark, monkeypatch):
    df = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 11).cast("string").alias("source"))
    small = mixing.replicate(df)
    monkeypatch.setattr(mixing, "BROADCAST_TERMS", 0)
    large = mixing.replicate(df)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan and "strategy=broadcast" in small._jdf.queryExecution().optimizedPlan().toString()
    assert small.count() == large.count() and small.exceptAll(large).count() == 0


def test_global_order(spark):
    """Equal ranges of the key, sorted within: one order over all partitions."""
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    keys = [r.mix_key for r in mixing.shuffled(mixing.replicate(df)).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys) > 1_000


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (2, "a"), (2, "a")], "doc_id long, source string")
    rows = mixing.replicate(df, total=200).collect()
    twice = [r.copy for r in rows if r.doc_id == 2]
    assert twice and all(twice.count(c) == 2 for c in twice)
    assert {r.source for r in rows} == {None, "a"}
    assert mixing.replicate(df.limit(0)).count() == 0
    ordered = mixing.shuffled(mixing.replicate(df, total=200)).collect()
    assert len(ordered) == len(rows)


def test_small_source_beside_large(spark, tmp_path):
    """One-row sources, a null one among them, beside one of 60,000 rows: rates near 240, as in SQL."""
    source = F.when(F.col("id") == 7, "lone").when(F.col("id") == 8, "other").when(F.col("id") > 8, "hot")
    docs = spark.range(7, 60_009).select(F.col("id").alias("doc_id"), source.alias("source")).unionByName(spark.sql("SELECT 1L AS doc_id, CAST(NULL AS STRING) AS source"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.rates(docs).agg(F.max("rate")).first()[0] > 200
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    check("op8_mixing", queries.QUERIES["op8_mixing"], queries.OP8_SQL, spark, con, str(tmp_path))


def quantile(u, rate):
    """How many k have a cumulative probability of at most u, in log space."""
    k, below = 0, math.exp(-rate)
    while u >= below:
        k += 1
        below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_rates_beyond_the_least_double(spark):
    """Rates around and above 745, where exp(-rate) is 0, and more copies than a block holds."""
    for total in (699 * 5, 760 * 5, 13_000 * 5):
        df = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
        u = {r.doc_id: r.u for r in df.select("doc_id", mixing.uniform(str(mixing.SEED), F.col("doc_id")).alias("u")).collect()}
        out = mixing.replicate(df, weights={"a": 1.0}, total=total).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("last"))
        rows = {r.doc_id: r for r in out.collect()}
        for i in range(5):
            assert rows[i].n == rows[i].d == rows[i].last + 1 == quantile(u[i], total / 5)
