"""Connected components against a union of sets."""

import random

from pyspark.sql import functions as F

from pagewright.llm import components


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    return {x: root(x) for x in up}


def test_components_of_stars_chains_and_random_links(spark):
    rng = random.Random(5)
    star = [(0, k) for k in range(1, 3000)]
    late = [(9000, k) for k in range(5000, 6000)]  # a hub that is the largest of its neighbours
    chain = [(k, k + 1) for k in range(10_000, 10_060)]
    loose = [(rng.randrange(20_000, 20_400), rng.randrange(20_000, 20_400)) for _ in range(250)]
    edges = star + late + chain + loose + [(7, 7), (1, 0), (0, 1), (None, 3), (4, None)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = components.connected_components(df).collect()
    assert len(got) == len({r.id for r in got}) and {r.id: r.component for r in got} == brute(edges)
    assert components.connected_components(df.where("a < 0")).count() == 0


def test_hub_is_dealt_to_parts(spark):
    df = spark.createDataFrame([(0, k) for k in range(1, 5001)] + [(5, 9)], "u long, v long")
    got = components.smallest(df)
    assert got.count() == 5001 and got.where("m <> case when u = 0 then 1 else 9 end").count() == 0
    sizes = [r["count"] for r in got.where(F.col("u") == 0).groupBy("part").count().collect()]
    assert len(sizes) == components.SALTS and max(sizes) < 2 * 5000 / components.SALTS
