import random

import numpy as np
from pyspark.sql import functions as F

from askgrid.plans.skew import attach_per_key, exact_percentiles, number_within
from conftest import rows


def skewed(n=3000, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i, rng.randrange(10**6))
            for i in range(n)]


def test_number_within_equals_plain_ranking(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k string, id long, v long").repartition(7)
    got = rows(number_within(df, ["k"], "v", "n", tie=["id"], bits=4), "k", "id", "n")
    want, seen = [], {}
    for k, i, v in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, i, seen[k]))
    assert got == sorted(want, key=repr)


def test_number_within_with_equal_order_values(spark):
    df = spark.createDataFrame([("a", i, 5) for i in range(50)], "k string, id long, v long")
    got = rows(number_within(df, ["k"], "v", "n", tie=["id"]), "id", "n")
    assert got == sorted([(i, i + 1) for i in range(50)], key=repr)


def test_attach_per_key_salts_hot_keys_and_keeps_every_row(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k string, id long, v long")
    facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    for limit in (10, 10**9):
        out = attach_per_key(df, facts, ["k"], "n", hot_rows=limit, salts=5)
        tops = {}
        for k, _, v in data:
            tops[k] = max(tops.get(k, 0), v)
        assert rows(out, "id", "top") == sorted([(i, tops[k]) for k, i, _ in data], key=repr)
        assert out.columns == ["k", "id", "v", "top"]


def test_hot_key_lands_in_several_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id"))
    facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = attach_per_key(df, facts, ["k"], "n", hot_rows=10, salts=16)
        parts = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 2 and max(r["count"] for r in parts) < 4000


def test_exact_percentiles_match_numpy(spark):
    rng = random.Random(5)
    data = [(f"g{rng.randrange(3)}", round(rng.gauss(0, 10), 2)) for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, v double")
    out = exact_percentiles(df, ["g"], "v", [0.5, 0.95, 0.0, 1.0], ["a", "b", "lo", "hi"])
    for r in out.collect():
        values = [v for g, v in data if g == r["g"]]
        want = np.percentile(values, [50, 95, 0, 100])
        assert np.allclose([r["a"], r["b"], r["lo"], r["hi"]], want)


def test_exact_percentiles_of_one_value_and_nulls(spark):
    df = spark.createDataFrame([(4.0,), (None,)], "v double")
    assert rows(exact_percentiles(df, [], "v", [0.5, 0.95], ["a", "b"])) == [(4.0, 4.0)]
    four = spark.createDataFrame([(float(i),) for i in range(4)], "v double")
    assert abs(exact_percentiles(four, [], "v", [0.95], ["p"]).first()["p"] - 2.85) < 1e-9
