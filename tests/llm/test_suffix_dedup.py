import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from duelframe.llm import suffix_dedup as S


def brute(rows, n):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def planted(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefé \n") for _ in range(n))
    passages = [word(n) for n in (390, 401, 450, 900)]
    rows = [(0, None), (1, ""), (2, "a" * 399), (3, "b" * 400), (4, "c" * 401), (5, "For " * 500), (6, "For " * 300 + "x" + "For " * 200), (None, "z" * 900), (None, "z" * 900)]
    for i in range(40):
        rows.append((10 + i, "".join(r.choice([word(r.randint(1, 300)), r.choice(passages), r.choice(passages)[5:], r.choice(passages)[:-3]]) for _ in range(r.randint(1, 6)))))
    return [*rows, rows[20], (999, rows[25][1])]


@pytest.mark.parametrize("most", [4096, 2])
def test_equals_brute_force_by_arrays_and_by_counts(spark, most):
    rows = planted(most)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS anchor", "2 AS id", "3 AS start").repartition(4)
    assert got(S.dedup_substrings(docs, 400, most)) == brute(rows, 400)


def covered(rows, n):
    """Runs of bytes that strings of n bytes repeat, by brute force."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    return sorted(((d, S.merged([(i, i + n) for i in range(len(b) - n + 1) if seen[b[i : i + n]] > 1])) for (d, _), b in zip(rows, data, strict=True)), key=str)


@pytest.mark.parametrize("most", [8192, 2])
def test_passages_equal_brute_force(spark, most):
    rows = planted(5) + [(2000 + i, f"own text {i} " * i + "p" * 100 + "q" * 160 + str(i)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, [tuple(x) for x in r.passages]) for r in S.dedup_substrings(docs, 400, most).collect()), key=str)
    assert got == covered(rows, 256)


def test_groups_hold_all_occurrences(spark):
    rows = [r for r in planted(9) if r[0] is not None and r[0] != rows_twice(planted(9))]
    text = {d: (t or "").encode() for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = {}
    for r in S.repeat_groups(docs).collect():
        groups.setdefault((r.group, r.length), set()).add((r.doc_id, r.start))
    held = {}
    for (_, n), places in groups.items():
        d, at = min(places)
        own = text[d][at : at + n]
        assert 256 <= n <= 400 and len(places) > 1
        assert places == {(e, i) for e, b in text.items() for i in range(len(b) - n + 1) if b[i : i + n] == own}
        for e, i in places:
            held.setdefault(e, []).append((i, i + n))
    # Together they cover what strings of 256 bytes repeat.
    assert sorted(((d, S.merged(held.get(d, []))) for d in text), key=str) == covered(rows, 256)


def rows_twice(rows):
    """The id of the row that is there twice."""
    return next(d for d, n in Counter(d for d, _ in rows if d is not None).items() if n > 1)


def test_other_rows(odd, rows, nothing):
    assert got(S.dedup_substrings(odd, 400)) == brute([r[:2] for r in rows], 400)
    assert S.dedup_substrings(nothing).collect() == []


def test_maximal_repeats_have_all_occurrences():
    r = random.Random(2)
    for _ in range(30):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 5))]
        found = {}
        starts = np.cumsum([0, *map(len, texts)])
        for t, text in enumerate(texts):
            for i in range(len(text)):
                for j in range(i + 3, len(text) + 1):
                    found.setdefault(text[i:j], []).append((t, i))
        want = set()
        for s, where in found.items():
            left = {(texts[t][i - 1] if i else (t, i)) for t, i in where}
            right = {(texts[t][i + len(s)] if i + len(s) < len(texts[t]) else (t, "end")) for t, i in where}
            if len(where) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(sorted(int(starts[t]) + i for t, i in where))))
        assert {(x.length, tuple(sorted(x.places.tolist()))) for x in S.maximal_repeats(texts, 3)} == want


def test_sliding_minimum_and_rolling_hash():
    r = np.random.default_rng(1)
    v = r.integers(0, 1000, 157).astype(np.uint64)
    assert S.sliding_min(v, 10).tolist() == [int(v[i : i + 10].min()) for i in range(148)]
    data = r.integers(0, 3, 500).astype(np.uint8)
    h = S.Rolling(data).grams(5)
    assert all((h[i] == h[j]) == (data[i : i + 5] == data[j : j + 5]).all() for i in range(0, 496, 7) for j in range(0, 496, 5))


def test_long_texts_are_cut_into_overlapping_parts():
    offsets = np.array([0, 10, 10, 95, 100])
    parts = [(a.tolist(), b.tolist(), n.tolist()) for a, b, n in S._parts(offsets, 8, 30)]
    assert parts == [([0, 10], [10, 10], [0, 1]), ([10], [47], [2]), ([40], [77], [2]), ([70], [95], [2]), ([95], [100], [3])]


def test_only_the_ranges_of_the_result_stay_stored(spark):
    from pathlib import Path

    from duelframe.llm import common

    held = lambda: {p.name for p in Path(common.checkpoints(spark).removeprefix("file:")).iterdir()}
    before = held()
    found = S.dedup_substrings(spark.createDataFrame(planted(3)[:30], "doc_id long, text string"), 400)
    assert found.count() == 30 and len(held() - before) == 1
    common.drop(found)
    assert held() == before
