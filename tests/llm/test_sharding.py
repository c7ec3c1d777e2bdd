import collections

import pytest

from attestra.llm import queries, sharding


def brute(shards, size):
    """Turn by turn, from full preference lists."""
    crc = sharding.zlib.crc32
    prefs = [[(crc(f"offset:{s}".encode()) % size + k * (crc(f"step:{s}".encode()) % (size - 1) + 1)) % size for k in range(size)] for s in shards]
    table = [None] * size
    while None in table:
        for i, p in enumerate(prefs):
            free = [s for s in p if table[s] is None]
            if free:
                table[free[0]] = i
    return table


def test_table_by_brute_force():
    shards = [f"s{i}" for i in range(7)]
    assert sharding.fill_table(shards, 101) == brute(shards, 101)


def test_shares_weights_and_moves():
    shards = [f"s{i}" for i in range(20)]
    table = sharding.fill_table(shards, 10_007)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(shards[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 19)
    assert moved < 0.15 * 10_007
    weighted = collections.Counter(sharding.fill_table(["a", "b"], 10_007, {"a": 3}))
    assert 2.9 < weighted[0] / weighted[1] < 3.1
    for bad in ([], ["a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 100)


def test_assignment(spark):
    df = spark.createDataFrame([(i, "x") for i in range(5_000)] + [(None, "y"), (7, "z"), (7, "z")], "doc_id long, shard string")
    names = [f"s{i}" for i in range(8)]
    out = sharding.assign_shards(df, "doc_id", names)
    rows = out.collect()
    table = sharding.fill_table(names)
    assert len(rows) == 5_003 and all(table[r.slot] == r.shard for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert sharding.assign_shards(df.limit(0), "doc_id", names).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_written_shards(spark, tmp_path):
    df = sharding.assign_shards(spark.range(1_000).withColumnRenamed("id", "doc_id"), "doc_id", ["a", "b", "c"])
    sharding.write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1_000


def test_query_by_brute_force(spark, sf_dir):
    """Every document of the table, each at the slot of its hash in the table filled turn by turn."""
    table = sharding.fill_table(queries.SHARD_NAMES)
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    out = queries.op5_sharding(spark, sf_dir)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == ids and all(table[r.slot] == r.shard for r in rows)
    slots = {r.doc_id: r.slot for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").transform(lambda d: sharding.assign_shards(d, "doc_id", queries.SHARD_NAMES)).collect()}
    assert slots == {r.doc_id: r.slot for r in rows}
