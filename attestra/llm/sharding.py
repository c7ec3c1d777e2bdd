"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table whose size is a
prime: it starts at an offset and goes on by a step, both hashed from its name, so
the order is a permutation. Shards take turns claiming their next free slot
until none is left; so their shares differ by one slot at most (by their weights
if they have any), and a shard that leaves moves few of the others' slots. The
table is broadcast (TABLE_SIZE rows: its size never depends on the data), and a row's
place is one lookup at hash(key) mod TABLE_SIZE.

Defined results: a null key hashes to a slot like any other value; rows with equal
keys meet in one shard; an empty table gives no row; a column named like an
added one is replaced; fewer than one shard or a size that is not prime is refused.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import without

TABLE_SIZE = 65_537
N_SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The shard number of every slot. A shard of weight w claims w slots at each of its turns (1 by default)."""
    if not shards or not is_prime(size) or len(shards) > size:
        raise ValueError("at least one shard, and a prime table size no smaller than their number, are needed")
    starts = [zlib.crc32(f"offset:{s}".encode()) % size for s in shards]
    steps = [zlib.crc32(f"step:{s}".encode()) % (size - 1) + 1 for s in shards]
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    table, tried, left = [-1] * size, [0] * len(shards), size
    while True:
        for i, turn in enumerate(turns):
            for _ in range(turn):
                while table[slot := (starts[i] + tried[i] * steps[i]) % size] >= 0:
                    tried[i] += 1
                table[slot] = i
                left -= 1
                if not left:
                    return table


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """slot, shard: one row a slot, from one literal."""
    filled = ",".join(map(str, fill_table(shards, size, weights)))
    numbers = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "shard"))
    return numbers.select("slot", F.col("shard").cast("int").alias("shard"))


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """Add `slot` and `shard` (the shard's number in shards)."""
    df = without(df, "slot", "shard")
    slot = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(size)).cast("int")
    return df.withColumn("slot", slot).join(F.broadcast(lookup_table(df.sparkSession, shards, size, weights)), "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Write one folder a shard; a hot shard is spread over tasks by adaptive rebalancing."""
    df.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
