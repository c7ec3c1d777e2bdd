"""Mixing sources to target weights by Poisson replication.

A source of n rows that is to have the share w of a mix of size m gets the mean
repetition rate m * w / n. Each row inverts the Poisson distribution of that mean at
a uniform number hashed from the seed and its id: it is emitted as many times as the
cumulative distribution stays at or below that number. Copies are then shuffled globally by a
hash of seed, id and copy. Nothing depends on partitions, order or attempts, so a
task that runs again gives the same rows.

Without given weights a source's share is proportional to its size to the power ALPHA.

Defined results: a null source is a source of its own; a null id hashes like the
text `null`; rows that repeat an id are drawn alike and lie side by side in the global order; a source without a
given weight gets no row; an empty table gives no row; texts are carried along whole; columns named like an added one are replaced.
Every rate is drawn: above PLAIN_RATE, where exp(-rate) nears the least double, the terms start
LEFT_OUT standard deviations and 16 below the mean instead of at 0, scaled by their sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import without, written

ALPHA, SEED, PLAIN_RATE, LEFT_OUT, BLOCK = 0.5, 17, 700.0, 12, 10_000
#: Probabilities of all sources that may be broadcast; beyond them the rows are joined by shuffling, where adaptive execution splits hot sources.
BROADCAST_TERMS = 4_000_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(rate: Column, first: Column, most: Column, p: Column) -> Column:
    """The cumulative probabilities of `first` to `most` - 1 as an array, added up from p, the probability of `first`."""
    start = F.struct(p.alias("p"), p.alias("below"), F.array(p).alias("all"))

    def step(s: Column, i: Column) -> Column:
        p = s.p * rate / i
        return F.struct(p.alias("p"), (s.below + p).alias("below"), F.array_append(s.all, s.below + p).alias("all"))

    return F.aggregate(F.sequence(first + 1, most - 1), start, step, lambda s: s.all)


def poisson_count(u: Column, first: Column, below: Column) -> Column:
    """How many k from 0 on have a cumulative probability of at most u, u of 52 bits, given those from `first` on."""
    # What lies below `first` is less than the least u above 0.
    return F.when(u > 0, first + F.size(F.filter(below, lambda x: x <= u))).otherwise(F.lit(0)).cast("long")


def terms(rate: Column, first: Column, most: Column) -> Column:
    """The sum of the terms of the Poisson distribution from `first` to `most`, as multiples of the first one."""
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("whole"))

    def step(s: Column, i: Column) -> Column:
        p = s.p * rate / i
        return F.struct(p.alias("p"), (s.whole + p).alias("whole"))

    return F.aggregate(F.sequence(first + 1, most), start, step, lambda s: s.whole)


def rates(df: DataFrame, source: str = "source", weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """_source, rate, the first term to add and the cumulative probabilities from it on: one row a source, from counts over all rows."""
    sizes = df.groupBy(F.col(f"`{source}`").alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        shares = sizes.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(ALPHA)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        shares = sizes.withColumn("_w", F.coalesce(given[F.col("_source")], F.lit(0.0)))
    whole = shares.agg(F.sum("_w").alias("_ws"), F.sum("_n").alias("_ns"))
    size = F.lit(float(total)) if total is not None else F.col("_ns").cast("double")
    # whole is one row.
    rated = shares.join(F.broadcast(whole), F.col("_n") <= F.col("_ns"))
    rate = size * F.col("_w") / F.col("_ws") / F.col("_n")
    rated = rated.select("_source", rate.alias("rate"))
    far = LEFT_OUT * F.sqrt("rate") + 16
    plain = F.col("rate") <= PLAIN_RATE
    rated = rated.withColumns({"_first": F.when(plain, F.lit(0)).otherwise(F.floor(F.col("rate") - far)).cast("long"), "_most": F.ceil(F.col("rate") + far).cast("long")})
    rated = rated.withColumn("_p", F.when(plain, F.exp(-F.col("rate"))).otherwise(1 / terms(F.col("rate"), F.col("_first"), F.col("_most"))))
    return rated.select("_source", "rate", "_first", cumulative(F.col("rate"), F.col("_first"), F.col("_most"), F.col("_p")).alias("_below"))


def replicate(df: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """df's rows as often as drawn, with `copy` (from 0), `rate` and `mix_key`, the key of the global shuffle.

    Rows are drawn where they are read: the counted rates come to them.
    """
    df = without(df, "copy", "rate", "mix_key")
    rated = written(rates(df, source, weights, total), "rates")
    n_terms = rated.agg(F.sum(F.size("_below"))).first()[0] or 0
    rated = F.broadcast(rated) if n_terms <= BROADCAST_TERMS else rated
    drawn = df.withColumn("_u", uniform(str(seed), F.col(f"`{key}`"))).join(rated, F.col(f"`{source}`").eqNullSafe(F.col("_source")))
    copies = drawn.withColumn("_count", poisson_count(F.col("_u"), F.col("_first"), F.col("_below"))).where("_count > 0")
    # In blocks: no array of copies grows with a rate.
    copies = copies.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_count - 1) div {BLOCK}"))))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("_block") * BLOCK, F.least("_count", (F.col("_block") + 1) * BLOCK) - 1)))
    return copies.withColumn("mix_key", uniform(str(seed), "mix", F.col(f"`{key}`"), F.col("copy"))).drop("_source", "_first", "_below", "_u", "_count", "_block")


def shuffled(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The global order: ranges of mix_key, sorted within. The key is uniform in [0, 1), so equal ranges need no sampling."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionById(n, F.floor(F.col("mix_key") * n).cast("int")).sortWithinPartitions("mix_key", key, "copy")
