"""Decontamination against a search of every window."""

import random

import numpy as np
import pytest
from llm_helpers import prose

from graphloom.llm import decontamination as dec

ITEMS = [(k, prose(1000 + k, n)) for k, n in enumerate([3, 5, 16, 24, 24, 40, 58])] + [(90, ""), (91, "..."), (92, None)]


def brute(text):
    words, out = dec.words_of(text), {}
    for i, t in ITEMS:
        item = dec.words_of(t)
        if not item or not words:
            continue
        index = dec.BenchmarkIndex([(i, t)], 5, 0.8, 64)
        best = (0.0, 0)
        for p in range(max(1, len(words) - len(item) + 1)):
            s = dec.similarity(index.multiset(words[p : p + len(item)]), index.counts[i])
            if s > best[0]:
                best = (s, p)
        if best[0] >= 0.8:
            out[i] = best
    return out


def cases():
    rng, out = random.Random(4), []
    for k in range(60):
        words = (rng.choice(ITEMS[:7])[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "other"
        if k % 5 == 0:
            words = words[: int(len(words) * rng.uniform(0.8, 1))] or words
        around = prose(k, 70).split()
        at = rng.randrange(70)
        out.append(" ".join(around[:at] + words + around[at:]) if k % 4 else " ".join(words).upper())
    return out


def test_matches_equal_a_search_of_every_window():
    index = dec.BenchmarkIndex([(i, t) for i, t in ITEMS if t is not None], 5, 0.8, dec.RADIUS)
    texts = cases()
    assert [index.matches(t) for t in texts] == [brute(t) for t in texts]
    assert sum(bool(brute(t)) for t in texts) > 20


def test_index_finds_all_within_its_radius():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    index = dec.SizeIndex(list(range(40)), items, 24)
    probes = items[rng.integers(0, 40, 300)].copy()
    for k in range(300):
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    window, item = index.lookup(probes)
    expected = {(w, i) for w in range(300) for i in range(40) if int(probes[w] ^ items[i]).bit_count() <= 24}
    assert set(zip(window.tolist(), item.tolist())) == expected


@pytest.mark.parametrize("size, entries", [(1500, 1 << 20), (3, 1 << 20), (3, 10)])
def test_frames(spark, odd_docs, no_docs, monkeypatch, size, entries):
    """In slices of the benchmark too, sifted or not."""
    monkeypatch.setattr(dec, "SLICE_ITEMS", size)
    monkeypatch.setattr(dec, "SIEVE_ENTRIES", entries)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(cases(), 100)), "doc_id long, text string"))
    rows = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in dec.contaminated(docs, benchmark).collect()}
    expected = {(r.doc_id, i): m for r in docs.collect() for i, m in brute(r.text).items()}
    assert rows == expected
    kept = dec.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if not brute(r.text))
    assert dec.contaminated(no_docs, benchmark).count() == 0
    assert dec.contaminated(docs, benchmark.limit(0)).count() == 0
    assert dec.remove_contaminated(odd_docs, benchmark.limit(0)).count() == odd_docs.count()


def test_a_sieve_admits_all_that_a_slice_matches():
    items = [(i, t) for i, t in ITEMS if t]
    sieve = dec.Sieve([t for _, t in items], 5, 0.8)
    slices = [dec.BenchmarkIndex(items[k : k + 2], 5, 0.8, dec.RADIUS) for k in range(0, len(items), 2)]
    for t in cases():
        assert sieve.admits(t) or not any(x.matches(t) for x in slices)
    assert not any(sieve.admits(t) for t in ["", None, prose(7, 300)])


def test_many_slices_read_the_documents_once(spark, tmp_path, monkeypatch):
    """Five slices: the documents are scanned by the sieve alone."""
    monkeypatch.setattr(dec, "SLICE_ITEMS", 2)
    texts = [prose(4000 + k, 30) for k in range(10)]
    benchmark = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(k, t) for k, t in enumerate(texts[:3])] + [(k, prose(5000 + k, 50)) for k in range(10, 60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    found = dec.contaminated(spark.read.parquet(str(tmp_path / "docs")), benchmark)
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("size", [1500, 2])
def test_every_text_of_the_benchmark_counts(spark, monkeypatch, size):
    """Texts that share an id, and texts without one, in one slice and over several."""
    monkeypatch.setattr(dec, "SLICE_ITEMS", size)
    texts = [prose(2000 + k, 20) for k in range(8)]
    ids = [1, 1, 1, None, None, None, 2, 2]
    benchmark = spark.createDataFrame(list(zip(ids, texts)), "item_id long, text string")
    near = " ".join([*texts[0].split()[:-1], "other"])
    rows = [(k, f"{prose(3000 + k, 10)} {t}") for k, t in enumerate(texts)]
    rows += [(20, f"{near} {texts[1]}"), (21, texts[3]), (21, texts[3]), (None, texts[6]), (22, prose(9, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = [(k, i, 1.0, 10) for k, i in enumerate(ids)] + [(20, 1, 1.0, 20), (21, None, 1.0, 0), (21, None, 1.0, 0), (None, 2, 1.0, 0)]
    assert sorted(map(str, map(tuple, dec.contaminated(docs, benchmark).collect()))) == sorted(map(str, expected))
    assert [r.doc_id for r in dec.remove_contaminated(docs, benchmark).collect()] == [22]
