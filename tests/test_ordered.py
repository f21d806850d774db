import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetlake.functions import ordered as O


def test_row_numbers_are_dense_per_key(spark):
    df = spark.range(5000).withColumn("key", F.when(F.col("id") < 3500, "hot").otherwise("cold"))
    out = O.hashed_row_number(df, ["key"], F.md5(F.col("id").cast("string")), "n", total="size")
    rows = out.collect()
    for key, size in (("hot", 3500), ("cold", 1500)):
        numbers = sorted(r.n for r in rows if r.key == key)
        assert numbers == list(range(1, size + 1))
        assert {r["size"] for r in rows if r.key == key} == {size}


def test_at_most_keeps_the_lowest_digests(spark):
    df = spark.range(5000)
    digest = F.md5(F.col("id").cast("string"))
    every = O.hashed_row_number(df, [], digest, "n").filter("n <= 700")
    some = O.hashed_row_number(df, [], digest, "n", at_most=700)
    assert {r.id for r in every.collect()} == {r.id for r in some.collect()}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 8, 5000, 200_000, 200_001, 400_000])
def test_exact_quantiles(spark, size):
    rng = np.random.default_rng(size)
    values = np.round(rng.normal(size=size), 2 if size <= 5000 else 9)
    values[: size // 3] = 0.0  # a third of all values is the same
    frame = pd.DataFrame({"k": "a", "v": values})
    df = spark.createDataFrame(frame, "k string, v double").repartition(8)
    probabilities = [0.05, 0.25, 0.5, 0.75]
    got = {
        r.probability: r.quantile
        for r in O.exact_quantiles(df, "k", "v", probabilities).collect()
    }
    for p in probabilities:
        assert got[p] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)
