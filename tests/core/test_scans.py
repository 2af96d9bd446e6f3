"""Scans over ranges: one key that holds nearly all rows, ties, nulls and empty tables."""

import random

import numpy as np
import pytest
from duelframe.functions import numeric, student
from duelframe.operators import asof, events, grading, scan, standings
from pyspark.sql import functions as F


def hot(r, n):
    """Nearly all rows of one key, within one day, many at the same microsecond."""
    return [("hot" if r.random() < 0.95 else r.choice(["a", "b", None]), r.randrange(n // 3), r.randrange(50)) for _ in range(n)]


def test_ranks_and_quantiles_of_a_hot_key(spark):
    rows = [(k, v, x if x else None) for k, v, x in hot(random.Random(1), 2000)]
    df = spark.createDataFrame(rows, "k string, v long, x int").repartition(7)
    ranked = scan.ranked(df, ["k"], ["v", "x"], "place").collect()
    for key in ("hot", "a", "b", None):
        own = sorted((r for r in ranked if r.k == key), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        order = [(r.v, r.x is not None, r.x or 0) for r in own]
        assert order == sorted(order)
    found = {r.k: (r.low, r.mid, r.top) for r in scan.rank_quantiles(df, ["k"], "x", {"low": 0.0, "mid": 0.5, "top": 1.0}).collect()}
    for key in ("hot", "a", "b", None):
        own = sorted(x for k, _, x in rows if k == key and x is not None)
        assert found[key] == tuple(numeric.rank_quantile(own, s) for s in (0.0, 0.5, 1.0))
    assert scan.rank_quantiles(df.where("x IS NULL"), ["k"], "x", {"low": 0.5}).collect() == [] and scan.ranked(df.limit(0), ["k"], ["v"]).collect() == []


def test_a_hot_key_is_dealt_evenly(spark):
    df = spark.range(20_000).selectExpr("'hot' AS k", "id AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in scan.in_ranges(df, ["k"], ["v"]).groupBy(scan.RANGE).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_as_of_within_one_day_of_a_hot_key(spark):
    r = random.Random(2)
    prices = [(k, t, p, i) for i, (k, t, p) in enumerate(hot(r, 900))]
    asked = [(i, k, t) for i, (k, t, _) in enumerate(hot(r, 700))] + [(9000, "none", 5)]
    stamp = lambda df: df.withColumn("t", F.timestamp_micros(F.lit(1_767_225_600_000_000) + F.col("t")))
    m, s = stamp(spark.createDataFrame(asked, "id long, k string, t long")).repartition(5), stamp(spark.createDataFrame(prices, "k string, t long, p int, i long")).repartition(3)
    got = {x.id: (x.close, x.flagged) for x in asof.as_of(m, s, ["k"], "t", "t", "i", [F.col("p"), F.col("i")], [F.col("i")]).collect()}
    assert len(got) == len(asked)
    for i, k, t in asked:
        own = [x for x in prices if x[0] == k and k is not None]
        before = [x for x in own if x[1] < t]
        want = (max(before, key=lambda x: (x[1], x[2], x[3]))[3], False) if before else (min(own, key=lambda x: (x[1], x[3]))[3], True) if own else (None, None)
        assert got[i] == want, (i, k, t)


def test_trailing_sums_equal_the_matches_of_each_window(spark):
    r = random.Random(3)
    stamp = lambda: f"20{r.randint(22, 25)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:00"
    m = spark.createDataFrame([(i, r.randrange(6), r.randrange(6), r.choice(["s", "a", None, "x"]), stamp()) for i in range(600)], "match_id long, team1_id long, team2_id long, tier string, t string").withColumn("start_ts", F.col("t").cast("timestamp"))
    ev = spark.createDataFrame([(e, b) for e, b in enumerate(["2024-03-31 00:00:00", "2024-02-29 13:30:00", "2024-01-01 00:00:00", "2024-01-15 07:00:00", "2025-12-01 23:59:59", "2022-02-02 02:02:02"])], "tournament_id long, b string").select("tournament_id", F.col("b").cast("timestamp").alias("boundary"))
    for months in (0, 1, 6, 24):
        window = events.window_matches(ev, m, months)
        want = {r.event_id: (r.n, r.first, r.last) for r in window.groupBy("event_id").agg(F.count("*").alias("n"), F.min("match_id").alias("first"), F.max("start_ts").alias("last")).collect()}
        got = {r.event_id: (r.n, r.first, r.last) for r in events.trailing(ev, m, months, [], {"n": (F.count("*"), F.sum), "first": (F.min("match_id"), F.min), "last": (F.max("start_ts"), F.max)}).collect()}
        assert got == want, months
    rows = lambda df: sorted((r.event_id, r.team, r.n, r.last_start, r.modal_tier, sorted(r.tiers.items())) for r in df.collect())
    assert rows(events.team_windows(ev, m, 6)) == rows(events.team_statistics(events.window_matches(ev, m, 6)))


def test_t_columns_equal_the_driver(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 7, 10, 29, 30, 101, 400)], "df int")
    for p in (0.025, 0.5, 0.9, 0.975, 0.999):
        known = spark.createDataFrame(df.select("df", student.t_quantile(p, "df").alias("t")).collect())
        for r in known.select("df", "t", student.t_inside("t", "df").alias("inside")).collect():
            assert r.t == pytest.approx(numeric.t_quantile(p, r.df), rel=1e-9, abs=1e-9) and r.inside == pytest.approx(2 * p - 1, abs=1e-9)
    assert df.select(student.t_quantile(0.9, F.lit(0))).first()[0] is None
    with pytest.raises(ValueError):
        student.t_quantile(1.0, "df")


def test_family_columns_equal_the_driver(spark):
    r = np.random.default_rng(4)
    rows = [(f, e, None if e == 3 else float(d)) for f, (mean, n) in enumerate([(-0.01, 30), (0.02, 30), (0.0, 30), (-0.01, 5), (-0.0011, 30), (-0.01, 1)]) for e, d in enumerate(r.normal(mean, 0.002, n))]
    df = spark.createDataFrame(rows, "family long, event_id long, mean_delta_brier double")
    found = {x.family: x for x in grading.verdicts(grading.paired_families(df, ["family"]), 0.002, 10).collect()}
    for f in range(5):
        own = [d for g, _, d in rows if g == f and d is not None]
        want = grading.paired_events(own)
        got = found[f]
        assert (got.n_events, got.mean, got.se, got.t_crit, got.ci_low, got.ci_high) == pytest.approx((want["n_events"], want["mean"], want["se"], want["t_crit"], *want["ci"]))
        assert got.verdict == grading.verdict(want, 0.002, 10)
    assert found[5].verdict == "BLOCKED" and found[5].se is None and {x.verdict for x in found.values()} == {"DEV-SCREENED", "REJECT", "INCONCLUSIVE", "BLOCKED"}
    more = spark.createDataFrame(list(found.values())).withColumns({"group": F.lit("g"), "variant": F.col("family").cast("string")})
    assert [(x.group, x.variant) for x in grading.nominees(more, ["group"], "variant").collect()] == [("g", "0")]
    held = grading.verdicts(grading.paired_families(df.where("family = 0"), ["family"]), 0.002, 10, objective_ok=False, split="holdout").first()
    assert held.verdict == "INCONCLUSIVE"


def test_standings(spark):
    m = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "b", "c"), (1, "b", "c"), (2, "x", "y")], "event long, winner string, loser string")
    table = standings.placed(standings.records(m, ["event"]), ["event"], "team")
    assert {(r.event, r.team): (r.wins, r.losses, r.buchholz, r.group_place, r.final_place) for r in table.collect()} == {
        (1, "a"): (2, 0, 1 - 3, 1, 1), (1, "b"): (2, 1, 2 - 3 - 3, 1, 2), (1, "c"): (0, 3, 2 + 1 + 1, 1, 3), (2, "x"): (1, 0, -1, 1, 1), (2, "y"): (0, 1, 1, 1, 2),
    }
