"""SimHash: fingerprints, the pigeonring filter and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from llm_helpers import prose

from graphloom.llm import common, simhash
from graphloom.plans import components


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in text.encode().split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A b\x0bC d\x0ce", "é É a B\xa0c d e", prose(1, 200)])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius,chain,parts", [(4, 2, 2), (4, 3, 3), (4, 4, 5), (4, 5, 6), (4, 5, 8), (2, 2, 2), (6, 3, 4)])
def test_every_close_pair_meets_and_links(radius, chain, parts):
    keys = simhash.key_masks(radius, chain, parts)
    rng = random.Random(radius)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, radius)):
            b ^= 1 << bit
        met = [k for k, (_, m) in enumerate(keys) if a & m == b & m]
        linked = False
        for k in met:
            cols = {
                "k": np.array([k, k]), "key": np.array([0, 0]), "bi": np.zeros(2, int), "bj": np.zeros(2, int),
                "fp": np.array([a, b], dtype=np.uint64).view(np.int64),
            }
            linked |= bool(simhash.link_runs(cols, keys, radius))
        assert linked


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((str(d), f"{f:016x}", str(ids.get(find(i)))) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def found(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(simhash.near_duplicates(odd_docs)) == brute(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_rows_without_an_id_link(spark, monkeypatch):
    """A class whose rows have no id stands between two others, and has their component; a lone one has none."""
    points = {0x0: [1], 0xF: [None, None], 0xFF: [2], 0xFFFF0000: [None], 0xFFFFF000: [None, 5], 1 << 60: [7, None]}
    docs = spark.createDataFrame([(d, fp) for fp, ids in points.items() for d in ids], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: docs)
    got = sorted((r.fingerprint, str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([
        (f"{0:016x}", "1", 1), (f"{15:016x}", "None", 1), (f"{15:016x}", "None", 1), (f"{255:016x}", "2", 1), (f"{0xFFFF0000:016x}", "None", 5),
        (f"{0xFFFFF000:016x}", "None", 5), (f"{0xFFFFF000:016x}", "5", 5), (f"{1 << 60:016x}", "7", 1), (f"{1 << 60:016x}", "None", 1),
    ])


@pytest.mark.parametrize("sent", [0, 1000])
def test_every_pair_of_a_hot_key_meets(spark, monkeypatch, sent):
    """By a broadcast of the hot keys, and by salts where they are too many for one."""
    monkeypatch.setattr(common, "SENT_KEYS", sent)
    rows = [(1, k) for k in range(50)] + [(2, k) for k in range(50, 70)] + [(3, k) for k in range(70, 73)]
    dealt = common.split_hot(spark.createDataFrame(rows, "k int, x int"), ["k"], "x", 8).collect()
    tasks, blocks = {}, {}
    for r in dealt:
        tasks.setdefault((r.k, r.bi, r.bj), []).append(r.x)
        blocks[r.x] = r.own
    for k, n in ((1, 50), (2, 20), (3, 3)):
        own = [x for key, x in rows if key == k]
        met = {(a, b) for key, xs in tasks.items() if key[0] == k for a in xs for b in xs if {blocks[a], blocks[b]} == {key[1], key[2]} or blocks[a] == blocks[b]}
        assert met >= {(a, b) for a in own for b in own} and len(own) == n
    assert max(map(len, tasks.values())) < 50


def test_near_copies_in_split_keys(spark, monkeypatch):
    """A group of near copies larger than a block, and components in rounds."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(components, "AT_ONCE", 0)
    rng, base = random.Random(2), prose(50, 400).split()
    rows = [(k, prose(k, 60)) for k in range(20)]
    for k in range(20, 90):
        words = list(base)
        words[rng.randrange(400)] = f"w{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(simhash.near_duplicates(docs)) == brute(rows)


def test_keep_one(odd_docs):
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(odd_docs).collect()]
    ids = [d for d, _ in kept if d is not None]
    assert sorted(ids) == sorted({int(c) for d, _, c in brute([(r.doc_id, r.text) for r in odd_docs.collect()]) if d != "None" and d == c})
    assert sum(d is None for d, _ in kept) == 2
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns


def test_sorted_runs_join_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [2, 2], [], [2, 3], [4])]
    runs = [c["k"].tolist() for c, _ in common.sorted_runs(iter(batches), ["k"])]
    assert sum(runs, []) == [1, 1, 2, 2, 2, 2, 3, 4]
    assert [r for r in runs if 2 in r and r.count(2) == 4]
