import re
from collections import Counter

import pytest
from duelframe.llm import mixing as M
from pyspark.sql import functions as F


def water(sizes, weights, share, most):
    total, capped = sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        level = (share * total - sum(most * sizes[i] for i in capped)) / max(1, sum(weights[i] for i in rest))
        new = {i for i in rest if level * weights[i] > most * sizes[i]}
        if not new:
            return [most * s if i in capped else level * weights[i] for i, s in enumerate(sizes)]
        capped |= new


def test_targets_and_words_taken(odd, clashing, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for r in rows:
        per[r[3]] += size(r[1])
    sources = sorted((s for s in per if s is not None)) + [None]
    goals = dict(zip(sources, water([per[s] for s in sources], [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5, 2), strict=True))
    out = M.mix(odd).collect()
    assert sorted((tuple(r)[:4] for r in out), key=str) == sorted(((r[0], r[3], size(r[1]), per[r[3]]) for r in rows), key=str)
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(goals[r.source]) and 0 <= r.taken <= 2 * r["size"]
        assert all(0 <= p <= 1 for p in r.positions) and len(r.positions) == -(-r.taken // r["size"] if r["size"] else 0)
    assert all(abs(taken[s] - goals[s]) <= 0.5 for s in sources)
    key = lambda rs: sorted(map(str, rs))
    assert key(out) == key(M.mix(odd.repartition(5)).collect()) == key(M.mix(clashing).collect())


def test_inverse_of_the_schedule(spark):
    for knots in ([(0.0, 1.0), (1.0, 1.0)], [(0.0, 2.0), (0.5, 1.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 3.0)]):
        col = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in knots))
        got = [r.x for r in spark.range(21).select(M.invert(col, F.col("id") / 20).alias("x")).collect()]
        area = lambda x: sum((min(x, b) - a) * (w + (v - w) * (min(x, b) - a) / (b - a) / 2) for (a, w), (b, v) in zip(knots, knots[1:], strict=False) if x > a)  # noqa: E731, B023
        assert [area(x) / area(1.0) for x in got] == pytest.approx([i / 20 for i in range(21)], abs=1e-9)


def test_order_and_empty(odd, nothing):
    docs = odd.where("doc_id >= 20 AND doc_id < 50").dropDuplicates(["doc_id"])
    mixed = M.mix(docs)
    read = M.training_order(mixed, docs)
    words = read.select(F.sum(M.word_count())).first()[0]
    assert words == mixed.agg(F.sum("taken")).first()[0] and read.columns == docs.columns
    assert M.mix(nothing).collect() == [] and M.training_order(M.mix(nothing), nothing).collect() == []


def test_sources_are_ranked_in_code_point_order(spark):
    names = [None, "é", "z", "A", "a", "", "\U0001f600", "｡"]
    got = M.ranked(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(4)).collect()
    assert [r.source for r in sorted(got, key=lambda r: r["rank"])] == ["", "A", "a", "z", "é", "｡", "\U0001f600", None]


def test_rows_without_or_with_repeated_ids_have_their_own_readings(spark, odd):
    nulls = [(None, f"text{i} " * (i + 3), "en", f"s{i % 3}", 1) for i in range(30)]
    docs = odd.unionByName(spark.createDataFrame(nulls, odd.schema)).cache()
    mixed = M.mix(docs)
    want = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect() if r.n}
    got = {r.source: r.n for r in M.training_order(mixed, docs).groupBy("source").agg(F.sum(M.word_count()).alias("n")).collect()}
    assert got == want


def test_training_order_with_clashing_columns(clashing, odd):
    extra = clashing.withColumns({c: F.lit("own") for c in ("size", "taken", "positions", "target", "source_size", "k", "position", "words")})
    mixed = M.mix(extra)
    read = M.training_order(mixed, extra)
    assert read.columns == extra.columns and {r[0] for r in read.select("taken").distinct().collect()} == {"own"}
    assert read.count() == M.training_order(M.mix(odd), odd).count()


@pytest.mark.parametrize("rows_a_slice", [1, 4])
def test_hot_ids_have_slices_of_their_own(spark, odd, rows_a_slice, monkeypatch):
    hot = [(None, "a b c " * (i % 4), "en", f"s{i % 2}", 1) for i in range(80)] + [(7, "x y", "en", "s0", 1)] * 30 + [(9, f"w {i}", "en", None, 1) for i in range(20)]
    docs = odd.unionByName(spark.createDataFrame(hot, odd.schema)).cache()
    key = lambda df: sorted((str(r.doc_id), str(r.source), r["size"], r.source_size, round(r.target, 6), r.taken, [round(p, 9) for p in r.positions]) for r in df.collect())
    want = key(M.mix(docs))
    monkeypatch.setattr(M, "SLICE_ROWS", rows_a_slice)
    assert key(M.mix(docs)) == want


def test_a_cut_reading_keeps_its_white_space(spark):
    df = spark.createDataFrame([("  a\n\n\tb c  \n d ", 3), ("x", 0), ("é f  g", 1)], "text string, n int")
    assert [r[0] for r in df.select(M._first_words(F.col("n"))).collect()] == ["  a\n\n\tb c", "", "é f"]


def test_schedules_decide_how_much_is_read_and_when(spark):
    """Targets are the integrals of the weights over time, and each interval holds its part of them."""
    schedules = [[(0.0, 4.0), (0.5, 0.0), (1.0, 0.0)], [(0.0, 1.0), (1.0, 3.0)], [(0.0, 0.0), (1.0, 0.0)]]
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 7 AS INT)) AS text", "concat('s', id % 3) AS source").cache()
    mixed = M.mix(docs, (3, 1, 2), 0.6, 2.0, schedules).cache()
    size = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(M.word_count())).collect()}
    goals = water([size[f"s{i}"] for i in range(3)], [3 * 1.0, 1 * 2.0, 0.0], 0.6, 2)
    assert {r.source: r.target for r in mixed.select("source", "target").distinct().collect()} == {f"s{i}": pytest.approx(g) for i, g in enumerate(goals)}
    got = {(r.source, r.interval): r.words for r in M.curriculum(mixed, 4).collect()}
    area = lambda knots, x: sum((min(x, b) - a) * (w + (v - w) * (min(x, b) - a) / (b - a) / 2) for (a, w), (b, v) in zip(knots, knots[1:], strict=False) if x > a)
    for i in range(2):
        for k in range(4):
            want = goals[i] * (area(schedules[i], (k + 1) / 4) - area(schedules[i], k / 4)) / area(schedules[i], 1.0)
            assert abs(got.get((f"s{i}", k), 0) - want) <= 7
    assert not any(s == "s2" for s, _ in got)
