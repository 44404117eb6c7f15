"""The queries over whole derived graphs against brute force."""

from collections import defaultdict

import __spark_entry__ as entry
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines():
    t = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey"])
    return sorted(zip(*(c.to_pylist() for c in t.columns)))


@pytest.fixture(scope="module")
def near(lines):
    parts, near = defaultdict(set), defaultdict(set)
    for order, _, part in lines:
        parts[order].add(part)
    for members in parts.values():
        for p in members:
            if len(members) > 1:
                near[p] |= members - {p}
    return near


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def components(near):
    out = {}
    for v in sorted(near):
        todo = [v] if v not in out else []
        while todo:
            u = todo.pop()
            if u not in out:
                out[u] = v
                todo += near[u]
    return out


def test_components(spark, near):
    expected = components(near)
    assert {r.id: r.component for r in run(spark, "n1_connected_components_whole")} == expected
    assert {r[0]: r[1] for r in run(spark, "h5_hyper_components_whole")} == expected
    assert run(spark, "x2_prim_whole")[0].edges == len(near) - len(set(expected.values()))


def test_clustering(spark, near):
    links = {v: sum(len(near[v] & near[u]) for u in near[v]) / 2 for v in near}
    expected = {v: links[v] / (len(near[v]) * (len(near[v]) - 1) / 2) if len(near[v]) > 1 else 0 for v in near}
    assert {r.id: r.coefficient for r in run(spark, "s9_clustering_whole")} == pytest.approx(expected, abs=1e-7)
    assert sorted(r.degree for r in run(spark, "s2_degree_sequence_whole")) == sorted(map(len, near.values()))


def test_cycle_is_of_the_whole_graph(spark, lines, monkeypatch):
    from graphloom import queries

    seen = []
    monkeypatch.setattr(queries.traversal, "find_cycle", lambda g: seen.append(g.edges.count()))
    run(spark, "t5_find_cycle")
    steps = {(a[2], b[2]) for a, b in zip(lines, lines[1:]) if a[0] == b[0] and a[2] != b[2]}
    assert seen == [len(steps)]
