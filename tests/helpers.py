"""Small helpers of the tests."""

import random

from graphloom.graph import PropertyGraph


def graph(spark, edges, vertices=(), directed=False, multi=False):
    return PropertyGraph.from_rows(spark, edges, list(vertices), directed, multi)


def pairs(text):
    """Edges written as 'a-b c-d' or with weights as 'a-b:2'."""
    out = []
    for item in text.split():
        ends, _, w = item.partition(":")
        s, t = ends.split("-")
        out.append((s, t, int(w)) if w else (s, t))
    return out


def table(df, key="id", value=None):
    value = value or next(c for c in df.columns if c != key)
    return {r[key]: r[value] for r in df.collect()}


def column(df, name="id"):
    return [r[name] for r in df.collect()]


def random_edges(seed, n, m, weights=True):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return [(a, b, rng.randint(1, 9)) for a, b in rows] if weights else rows
