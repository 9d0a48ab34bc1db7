import random

from pyspark.sql import functions as F

from quillon.llm.common import block_pairs, components, drop_clashing, number_rows, settle

from .conftest import components as brute


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute(ids, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_numbers_are_gapless(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)))
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = number_rows(df, "k", ["id"], counts, "r", chunk_rows=30).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 500


def test_settled_tables_and_clashes(spark):
    df = spark.createDataFrame([(1, "a")], "Ids long, x string")
    assert settle(df).collect() == df.collect() and drop_clashing(df, ["ids"]).columns == ["x"]


def test_pairs_of_blocks(spark):
    touch = [(0, b) for b in range(40)] * 3 + [(1, 3), (1, 50), (2, 60)]
    got = sorted(map(tuple, block_pairs(spark.createDataFrame(touch, "g long, block long"), ["g"]).collect()))
    assert got == sorted({(a, b) for a in range(40) for b in range(a, 40)} | {(3, 50), (50, 50), (60, 60)})
