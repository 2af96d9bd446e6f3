import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from duelframe.llm import lexical as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    asked = {}
    for item, text in items:
        if item is not None:
            asked[item] = min(asked.get(item, text), text, key=lambda x: (x is None, x or ""))
    for item, text in asked.items():
        found = []
        for i, c in counts:
            if c:
                m = 75 + 25 * c.total() * n_docs // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
                found += [(-s, i is None, i)] * (s > 0)
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def invented(r, n):
    return " ".join(r.choice("abcdefgh") * r.choice([1, 1, 2]) if r.random() < 0.7 else f"w{r.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    r = random.Random(4)
    docs = [(i, invented(r, r.choice([1, 5, 40, 200]))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [docs[5]] * 3 + [(None, docs[3][1]), (None, None), (900, None), (901, ""), (902, " -- \x00\x7f"), (903, "Éa éA ÉA_b3c d"), (904, invented(r, 30_000))]
    items = [(i, invented(r, r.randint(1, 30))) for i in range(25)] + [(30, docs[3][1]), (31, None), (32, ""), (33, "nowhere"), (34, "É éa ÉA"), (35, "a A a a a"), (None, "a"), (36, "b w1"), (36, "a w2")]
    return docs, items


def test_equals_brute_force(spark, tables):
    docs, items = tables
    x = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "text").selectExpr("*", "1 AS n", "2 AS score", "3 AS item_id", "4 AS rank")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = L.rank(x, q, 7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 7)


def test_rounds_of_items(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(L, "ITEMS", 4)
    got = L.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 3)


def test_blocks_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(L, "BLOCK_DOCS", 5)
    monkeypatch.setattr(L, "BLOCK_POSTINGS", 9)
    rows = [(i if i % 4 else None, 3, list(range(i % 4)), [1] * (i % 4)) for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 3], strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], list("abcd")) for a in range(0, 40, 3)]
    blocks = list(L._blocks(iter(batches)))
    assert all(len(b[0]) <= 5 and len(b[3]) <= 9 or len(b[0]) <= 3 for b in blocks)
    assert [t for b in blocks for t in b[3].tolist()] == [t for r in rows for t in r[2]] and sum(len(b[0]) for b in blocks) == 30


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.rank(docs, items).collect() == [] and L.rank(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []


@pytest.mark.parametrize("width", [1, 4, 512])
def test_blocks_one_after_another_equal_a_full_ranking(width):
    r = np.random.default_rng(width)
    for trial in range(30):
        vocabulary, k = 12, 5
        weight = r.integers(0, 50, vocabulary)
        best, every = (np.empty(0, np.int64), np.empty(0, np.int64)), []
        own = np.flatnonzero(r.random(vocabulary) < 0.6)
        for _ in range(3):
            held = r.random((40, vocabulary)) < r.random(vocabulary) / (1 + trial % 3)
            held[:, 0] |= ~held.any(1)
            tf, ids, middle = r.integers(1, 4, held.shape), r.permutation(400)[:40], r.integers(75, 90, 40)
            d, t = np.nonzero(held)
            treaps = L.Treaps(ids, held.sum(1), t, tf[d, t], middle, vocabulary)
            best = treaps.search(own, weight[own], k, best, width)
            impact = np.where(held, 10**9 * tf // (1000 * tf + 12 * middle[:, None]), 0)
            every += [(-int(s), int(i)) for s, i in zip((impact[:, own] * weight[own]).sum(1), ids, strict=True) if s > 0]
        assert [(-s, i) for s, i in zip(*map(np.ndarray.tolist, best), strict=True)] == sorted(every)[:k]


def test_a_treap_is_sorted_and_heaped():
    r = np.random.default_rng(0)
    n = 200
    treaps = L.Treaps(r.permutation(n), np.full(n, 2), np.tile([0, 1], n), r.integers(1, 9, 2 * n), r.integers(75, 99, n), 2)
    for root, (a, b) in zip(treaps.root, ((0, n), (n, 2 * n)), strict=True):
        seen, path, at = [], [], root
        while path or at >= 0:
            while at >= 0:
                path.append(at)
                at = treaps.left[at]
            at = path.pop()
            seen.append(at)
            assert all(c < 0 or treaps.impact[c] <= treaps.impact[at] for c in (treaps.left[at], treaps.right[at]))
            at = treaps.right[at]
        assert seen == list(range(a, b))


def test_few_documents_are_touched_when_bounds_tell(monkeypatch):
    """A passage held by few documents: most subtrees are pruned unseen."""
    r = np.random.default_rng(1)
    n, vocabulary = 20_000, 40
    held = r.random((n, vocabulary)) < np.r_[np.full(30, 0.001), np.full(10, 0.5)]
    held[:25, :] = True
    held[:, -1] = True
    d, t = np.nonzero(held)
    treaps = L.Treaps(np.arange(n), held.sum(1), t, np.ones(len(t), np.int64), np.full(n, 100), vocabulary)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * held.sum(0) + 1))).astype(np.int64)
    scored = []
    monkeypatch.setattr(treaps, "impacts", lambda own, docs, f=treaps.impacts: scored.append(len(docs)) or f(own, docs))
    scores, ids = treaps.search(np.arange(vocabulary), weight, 20, (np.empty(0, np.int64), np.empty(0, np.int64)), 64)
    assert set(ids.tolist()) <= set(range(25)) and sum(scored) < n / 10
