from collections import Counter

import numpy as np
import pytest
from duelframe.llm import line_dedup as L


def brute(rows, least, min_chars=1):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(fold)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    seen = Counter(k for _, ls in split for k in {key(x) for x in ls})
    gone = lambda x: len(key(x)) >= min_chars and seen[key(x)] >= least
    return sorted(((d, "\n".join(x for x in ls if not gone(x)), len(ls), sum(map(gone, ls))) for d, ls in split), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


@pytest.mark.parametrize("least", [2, 3, 10])
def test_equals_brute_force_both_ways(odd, rows, least):
    index = L.LineIndex.build(odd, least)
    want = brute([r[:2] for r in rows], least)
    assert got(index.dedup(odd)) == want
    assert got(index._by_table(odd)) == want


def test_min_chars(odd, rows):
    assert got(L.dedup_lines(odd, 2, 6)) == brute([r[:2] for r in rows], 2, 6)


def test_clashing_columns_and_empty(clashing, rows, nothing):
    out = L.dedup_lines(clashing, 3)
    assert out.columns == [*clashing.columns, "n_lines", "n_dropped"]
    assert got(out) == brute([r[:2] for r in rows], 3)
    assert L.dedup_lines(nothing).collect() == []


def test_deletion_reverses_insertion(spark, odd, rows):
    docs = spark.createDataFrame([(i, f"common {i % 3}\nown {i}") for i in range(40)], "doc_id long, text string")
    both = docs.unionByName(odd.select("doc_id", "text"))
    index = L.LineIndex.empty(spark, shards=3, min_docs=2).insert(docs).insert(odd)
    assert got(index.dedup(both)) == got(L.dedup_lines(both, 2))
    back = index.delete(docs)
    assert got(back.dedup(odd)) == brute([r[:2] for r in rows], 2)
    assert {bytes(r.key): r.refs for r in back.refs.collect()} == {bytes(r.key): r.refs for r in L.LineIndex.build(odd, 2).refs.collect()}


def test_an_index_grows_by_insertion(spark, odd, rows, monkeypatch):
    monkeypatch.setattr(L, "KEYS_PER_SHARD", 10)
    docs = spark.createDataFrame([(i, f"common {i % 3}\nown {i}") for i in range(60)], "doc_id long, text string")
    index = L.LineIndex.empty(spark, min_docs=2).insert(docs).insert(odd)
    assert index.shards > 5 and index.filters.count() > 5
    both = docs.unionByName(odd.select("doc_id", "text"))
    assert got(index.dedup(both)) == got(L.dedup_lines(both, 2)) and got(index.delete(docs).dedup(odd)) == brute([r[:2] for r in rows], 2)


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, (3000, 2)).astype(np.uint64)
    f = L.CuckooFilter.built(keys[:2000])
    assert f.contains(keys[:2000]).all() and f.contains(keys[2000:]).mean() < 0.01
    assert all(f.delete(k) for k in keys[:1000]) and f.contains(keys[1000:2000]).all() and f.contains(keys[:1000]).mean() < 0.01
    again = L.CuckooFilter.loads(f.dumps())
    assert (again.table == f.table).all() and not L.CuckooFilter(1).delete(keys[0])
    full = L.CuckooFilter(1)
    assert [full.insert(keys[0]) for _ in range(5)] == [True] * 4 + [False]
