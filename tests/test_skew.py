"""Hot keys: joins that don't gather them, and components around hubs."""

import random

from pyspark.sql import functions as F

from graphloom.plans import components, skew
from graphloom.plans.lineage import cut


def test_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "COOL", 5)
    rng = random.Random(2)
    keys = [0] * 60 + [1] * 20 + [rng.randrange(2, 30) for _ in range(40)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    table = cut(rows.groupBy("k").agg(F.min("i").alias("least"), F.count(F.lit(1)).alias("n")).where("k <> 7"))
    found = sorted(map(tuple, skew.join_counted(rows, table, "k", "n").select("k", "i", "least").collect()))
    assert found == sorted((k, i, keys.index(k)) for i, k in enumerate(keys) if k != 7)


def test_components_around_hubs(spark, monkeypatch):
    monkeypatch.setattr(skew, "COOL", 5)
    monkeypatch.setattr(components, "AT_ONCE", 0)
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 60)] + [(200, k) for k in range(100, 160)] + [(k, k + 1) for k in range(300, 330)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    parent = list(range(501))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components.star_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == want
