"""Embedding near-duplicates against all pairs in double precision."""

import math

import numpy as np
import pytest

from graphloom.llm import embeddings


def brute(rows, cosine=0.98):
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    for i in range(n):
        for j in range(i):
            (_, u, a), (_, v, b) = rows[i], rows[j]
            if a is None or a != b or not usable(u) or not usable(v) or len(u) != len(v):
                continue
            x, y = np.array(u, float) / max(map(abs, u)), np.array(v, float) / max(map(abs, v))
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, *_) in enumerate(rows):
        c = least.get(find(i))
        out.append((d, links[i], c, d is not None and d == c))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [2048, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = []
    for k in range(400):
        v = rng.normal(size=64)
        if k % 3 == 0:
            v = np.ones(64) + rng.normal(size=64) * rng.choice([0.1, 0.14, 0.2])
        rows.append((k, v.astype(np.float32).tolist(), int(k % 2)))
    odd = [(None, rows[0][1], 0), (500, None, 0), (501, [0.0] * 64, 0), (502, [float("nan")] * 64, 0), (503, [math.inf, *[1.0] * 63], 0), (504, [None, *[1.0] * 63], 0),
           (505, rows[0][1], None), (506, rows[0][1][:32], 0), (507, [], 0), (3, rows[3][1], 1), (508, [1e30] * 64, 0), (509, [1e-30] * 64, 0)]
    rows += odd
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rid int").repartition(5)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = sorted(map(str, map(tuple, embeddings.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())))
    assert got == brute(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_estimates_hold_within_their_bounds():
    """The estimate is unbiased and its bound holds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    x[150:] = x[:150] + 0.3 * rng.normal(size=(150, 64))
    u = embeddings.unit(x)
    packed, factor, spread = embeddings.codes(u)
    code, turned = embeddings.signs(list(map(bytes, packed)), 64), u @ embeddings.rotations(64)
    assert code.shape == (300, 128) and packed.shape == (300, 16)
    assert (code * turned).sum(axis=1) == pytest.approx(factor, abs=1e-5)
    estimate = (turned[:150] @ code[150:].T) / factor[None, 150:]
    true = u[:150] @ u[150:].T
    bound = embeddings.SIGMAS * spread[150:] / factor[150:] / math.sqrt(63)
    assert (np.abs(estimate - true) <= bound[None, :]).all()
    assert abs((estimate - true).mean()) < 0.005


def test_tables_meet():
    bits, count = embeddings.tables_for(1_000_000, 0.98, 1e-7)
    p = math.acos(0.98) / math.pi
    assert (1 - (1 - p) ** bits) ** count <= 1e-7 and bits == 12


def at_cosine(n, dim, cosine, seed):
    """Pairs of unit vectors at the cosine."""
    rng = np.random.default_rng(seed)
    x, y = (embeddings.unit(rng.normal(size=(n, dim))) for _ in range(2))
    y = embeddings.unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    return x, cosine * x + math.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("vectors", [2_000, 1_000_000])
def test_pairs_at_the_threshold_meet(vectors):
    """Tables of one label so large are independent, and few codes are apart."""
    bits, count = embeddings.tables_for(vectors, 0.98, 0.5e-7)
    x, y = at_cosine(200_000, 64, 0.98, 11)
    for a in range(0, len(x), 20_000):
        u, v = x[a : a + 20_000], y[a : a + 20_000]
        assert (embeddings.table_keys(u, bits, count) == embeddings.table_keys(v, bits, count)).any(axis=1).all()
        apart = np.bitwise_count(embeddings.codes(u)[0] ^ embeddings.codes(v)[0]).sum(axis=1)
        assert (apart <= embeddings.radius_for(128, 0.98, 0.25e-7)).all()


def test_radius_bounds_the_tail():
    p, r = math.acos(0.98) / math.pi, embeddings.radius_for(128, 0.98, 0.25e-7)
    tails = [sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(q + 1, 129)) for q in (r, r - 1)]
    assert tails[0] <= 0.25e-7 < tails[1]


def test_recall_and_pruning_on_chained_clusters():
    """Clusters at cosines from 0.9 on, which chain candidates: no link is lost, and most pairs are not recomputed."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 64))
    x = np.concatenate([c + s * rng.normal(size=(60, 64)) for c in centres for s in (0.1, 0.3)])
    packed, factor, spread = embeddings.codes(embeddings.unit(x))
    code, rows = embeddings.signs(list(map(bytes, packed)), 64), np.arange(len(x))
    got = {(int(a), int(b)) for u, v in embeddings.verified_pairs(x, code, factor, spread, rows, rows, 0.98, True) for a, b in zip(u, v)}
    u = embeddings.unit(x)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.98, 1)))}
    assert len(want) > 500 and got == want
