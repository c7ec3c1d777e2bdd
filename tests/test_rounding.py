"""Halves in display texts, gray and scores, each against its SQL on rows that bring them about."""

from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestra.functions import geometry, scores
from attestra.plans import queries
from tests.compare import check, duck


@pytest.fixture
def with_tables(tmp_path, sf_dir):
    """A folder of the given tables in which some are replaced."""

    def make(**tables: pd.DataFrame) -> str:
        for f in Path(sf_dir).iterdir():
            if f.stem not in tables:
                (tmp_path / f.name).symlink_to(f)
        for name, frame in tables.items():
            frame.to_parquet(tmp_path / f"{name}.parquet", index=False)
        return str(tmp_path)

    return make


def agrees(name, spark, sf_dir):
    check(name, queries.QUERIES[name], queries.ORACLES[name], spark, duck(sf_dir), sf_dir)


def test_gray_of_exact_halves_goes_up(spark, sf_dir, with_tables):
    rows = spark.range(256).crossJoin(spark.range(0, 256, 5).withColumnRenamed("id", "g")).select(F.col("id").alias("b"), "g", ((F.col("id") * 7 + F.col("g")) % 256).alias("r"))
    got = rows.select("b", "g", "r", geometry.gray(F.col("b"), F.col("g"), F.col("r")).alias("v")).collect()
    assert all(x.v == (114 * x.b + 587 * x.g + 299 * x.r + 500) // 1000 for x in got)
    part = pd.read_parquet(f"{sf_dir}/part.parquet").head(1)
    part = pd.concat([part.assign(p_partkey=k, p_size=s) for k in range(70) for s in range(1, 51)])
    agrees("c5_c8_cells", spark, with_tables(part=part.astype({"p_size": "int32"})))


def test_sizes_of_exact_halves_go_up(spark, sf_dir, with_tables):
    events = pd.read_parquet(f"{sf_dir}/events.parquet").head(1)
    ids = [131_072 * k + d for k in (1, 3, 5, 13, 21) for d in (-1, 0, 1)] + [64 * k for k in range(1, 40)]
    data = with_tables(events=pd.concat([events.assign(event_id=i) for i in ids]))
    agrees("i13_i14_display", spark, data)
    got = queries.i13_i14_display(spark, data).where("event_id = 131072").first()
    assert got.bytes == "1.3 MB"


def test_overall_risk_of_halves_goes_up(spark, sf_dir, with_tables):
    customer = pd.read_parquet(f"{sf_dir}/customer.parquet").head(1)
    # Hundreds are halves of a tenth: 100 times 0.0015 is 0.15.
    data = with_tables(customer=pd.concat([customer.assign(c_custkey=10_000_000 + i, c_acctbal=i * 100.0) for i in range(1, 140)]))
    agrees("g3_g6_overall", spark, data)
    got = queries.g3_g6_overall(spark, data).select(F.round((F.col("c_custkey") - 10_000_000) * 100).cast("long").alias("cents"), "risk").collect()
    assert all(round(r.risk * 10) == min(200, (r.cents * 15 + 500) // 1000) for r in got)
    most = spark.range(1).select(scores.overall_risk(F.lit(4.35), F.lit(1), F.lit(0.0)).alias("v")).first()
    assert most.v == 4.4
