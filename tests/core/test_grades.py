import random

import pytest
from duelframe.operators import asof, events, grading
from duelframe.plans import gates
from pyspark.sql import functions as F

ALIASES = {"alpha": "A", "bravo": "B"}
SNAP = "ordinal long, ts string, slug string, outcomes array<string>, prices array<double>, volume double"


def snaps(spark, rows):
    return spark.createDataFrame([(i, ts, f"s{i}", o, p, v) for i, (ts, o, p, v) in enumerate(rows)], SNAP)


def close(spark, rows, start="2026-06-01T12:00:00+00:00", **more):
    m = spark.createDataFrame([(0, "A", "B", start)], "match_key long, a string, b string, start string")
    r = asof.closing_prices(m, snaps(spark, rows), ALIASES, **more).first()
    return (r.p_a, r.flagged, r.slug)


AB, BA = [" Alpha", "BRAVO "], ["bravo", "alpha"]


def test_closing_prices(spark):
    two = [("2026-06-01T10:00:00+00:00", AB, [0.7, 0.3], 5000.0), ("2026-06-01T13:30:00+02:00", AB, [0.74, 0.26], 5000.0), ("2026-06-01T13:00:00+00:00", AB, [0.9, 0.1], 5000.0)]
    assert close(spark, two) == (0.74, False, "s1")
    assert close(spark, [(two[0][0], BA, [0.4, 0.6], 2000.0)]) == (0.6, False, "s0")
    assert close(spark, [(two[2][0], AB, [0.8, 0.2], 2000.0), ("2026-06-01T14:00:00+00:00", AB, [0.9, 0.1], 2000.0)]) == (0.8, True, "s0")
    assert close(spark, [(two[0][0], AB, [0.8, 0.2], 10.0)]) == (None, False, None)
    assert close(spark, [two[0], (two[1][0], AB, [0.8, 0.2], None)]) == (0.7, False, "s0")
    assert close(spark, [(two[0][0], AB, [0.8, 0.2], 10.0), (two[0][0], AB, [0.6, 0.4], 10.0)], least_volume=None) == (0.8, False, "s0")
    assert close(spark, [(two[0][0], AB, [0.6, 0.4], 2e3), (two[0][0], AB, [0.5, 0.5], 2e3)]) == (0.5, False, "s1")
    assert close(spark, [(two[0][0], ["alpha", "zulu"], [0.8, 0.2], 2e3), (two[0][0], ["alpha"], [1.0], 2e3)]) == (None, False, None)


@pytest.fixture(params=[1, 9])
def ranges(spark, request):
    """So many ranges of rows, none joined with another."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_as_of_equals_brute_force(spark, ranges):
    """Ties, keys without snapshots, a hot key, values before all matches and in earlier ranges."""
    r = random.Random(7)
    at = lambda: f"2026-{r.randint(1, 3):02d}-{r.randint(1, 5):02d} {r.randint(0, 2):02d}:00:00"
    m = [(i, r.choice("aaaabcd"), at()) for i in range(150)] + [(900, "lonely", at()), (901, None, at())]
    s = [(i, r.choice("aaaaaab"), at(), float(i)) for i in range(200)] + [(999, "c", "2026-02-28 00:00:00", 1.5), (998, "d", "2025-01-01 00:00:00", None)]
    want = {}
    for i, k, start in m:
        own = [x for x in s if x[1] == k]
        pre, first = [x for x in own if x[2] < start], min(own, key=lambda x: (x[2], x[0]), default=None)
        last = max(pre, key=lambda x: (x[2], -x[0]), default=None)
        want[i] = ((last or first)[3], last is None) if own else (None, None)
    md = spark.createDataFrame(m, "id long, k string, start string").withColumn("start", F.col("start").cast("timestamp"))
    sd = spark.createDataFrame(s, "n long, k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    got = asof.as_of(md, sd, ["k"], "start", "t", "v", [-F.col("n")], [F.col("n")])
    assert {x.id: (x.close, x.flagged) for x in got.collect()} == want and got.count() == len(m)


def test_manifests(spark):
    full = {"reconstruction_mode": "backfill_reconstructed", "code_dirty": "false", "code_sha": "a", "ratings_sha": "b", "anchors_sha": "c"}
    cases = [(full, True), ({**full, "anchors_sha": "unknown"}, False), ({**full, "x_sha": "pending-w"}, False), ({**full, "code_dirty": "true"}, False), ({k: v for k, v in full.items() if k != "code_dirty"}, False), ({**full, "reconstruction_mode": "other"}, False), (None, False), ({"reconstruction_mode": "immutable_forecast", "code_dirty": "false", "code_sha": "a"}, True), ({**full, "ratings_sha": ""}, False)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i long, p map<string,string>")
    assert {r.i: r.m for r in df.select("i", grading.manifested("p").alias("m")).collect()} == {i: ok for i, (_, ok) in enumerate(cases)}


def test_grades_and_summary(spark):
    p = {"reconstruction_mode": "immutable_forecast", "code_dirty": "false", "code_sha": "a"}
    rows = [("A", "A", 0.7, 0.6, False, p), ("A", "B", 0.7, 0.6, True, p), ("A", "A", 0.7, None, None, p), ("A", "A", 0.8, 0.5, False, None)]
    g = grading.grade_matches(spark.createDataFrame(rows, "a string, winner string, model_prob double, close_prob double, close_flagged boolean, provenance map<string,string>"))
    got = g.collect()
    assert [r.adoption_eligible for r in got] == [True, False, False, False] and got[0].delta_brier == pytest.approx(0.16 - 0.09) and got[2].log_market is None
    s = grading.summarize(g).first()
    assert (s.n, s.eligible_n, s.excluded_flagged_n, s.excluded_unmanifested_n) == (1, 1, 1, 1) and s.model_brier == pytest.approx(0.09)
    assert grading.summarize(g, include_flagged=True, require_manifest=False).first().n == 3
    t = grading.grade_teams(spark.createDataFrame([(3, 0, 0.5, 0.3, 0.1), (3, 2, 0.5, 0.3, 0.1), (0, 3, 0.5, 0.3, 0.1)], "wins int, losses int, p30 double, padv double, p03 double")).collect()
    assert [(r.p30_brier, round(r.padv_brier, 4), round(r.p03_brier, 4)) for r in t] == [(0.25, 0.09, 0.01), (0.25, 0.49, 0.01), (0.25, 0.09, 0.81)]


def test_walk_forward_and_summaries(spark):
    m = spark.createDataFrame([(1, 10, "a", "b", "a"), (1, 11, "a", "c", "c"), (1, 12, "a", "b", "z"), (2, 13, "a", "b", "b")], "event_id long, match_id long, team1_id string, team2_id string, winner_team_id string")
    rate = lambda x: spark.createDataFrame([(e, t, r) for e in (1, 2) for t, r in x.items()], "event_id long, team string, rating double")
    seen = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (1, "c", 2), (2, "a", 9), (2, "b", 9)], "event_id long, team string, n long")
    graded, skipped = grading.walk_forward(m, rate({"a": 1100.0, "b": 1000.0, "c": 1000.0}), rate({"a": 1000.0, "b": 1000.0, "c": 1000.0}), seen)
    assert {r.match_id: r.reason for r in skipped.collect()} == {11: "below_min_obs:c", 12: "winner_not_a_side:z"}
    g = {r.match_id: r for r in graded.collect()}
    assert set(g) == {10, 13} and g[10].brier_inc == 0.25 and g[10].delta_brier < 0 < g[13].delta_brier
    s = {r.event_id: r for r in grading.event_summaries(graded, skipped).collect()}
    assert (s[1].n_graded, s[1].n_skipped, s[1].excluded) == (1, 2, True) and s[2].coverage == 1.0 and not s[2].excluded


def test_verdicts():
    stats = lambda lo, hi, n=20: {"n_events": n, "mean": (lo + hi) / 2, "ci": [lo, hi]}
    v = lambda s, **k: grading.verdict(s, 0.002, 10, **k)
    assert v(stats(-0.01, -0.001)) == "DEV-SCREENED" and v(stats(-0.01, -0.001), split="holdout") == "ADOPTED" and v(stats(-0.01, -0.001), objective_ok=False) == "INCONCLUSIVE"
    assert v(stats(0.001, 0.01)) == "REJECT" and v(stats(-0.01, 0.01)) == "INCONCLUSIVE" and v(stats(-0.002, -0.001)) == "INCONCLUSIVE" and v(stats(-0.1, -0.05, 9)) == "BLOCKED"
    s = [{"sweep_family": "f", "verdict": x, "stats": {"mean": m}} for x, m in (("DEV-SCREENED", -1), ("DEV-SCREENED", -2), ("REJECT", -3))]
    assert grading.nominee(s)["stats"]["mean"] == -2 and grading.nominee([]) is None
    with pytest.raises(ValueError):
        grading.nominee([*s, {"sweep_family": "g", "verdict": "REJECT", "stats": {"mean": 0}}])
    with pytest.raises(ValueError):
        grading.paired_events([0.1])


def test_self_test_can_fail():
    good = gates.self_test(20260705)
    assert good["ok"] and good["stats"]["clone"]["mean"] == 0
    assert not gates.self_test(20260705, weights=(-0.5, 0.5))["ok"]


def test_gates():
    base = {"model": {"sigma": 50}, "name": "inc"}
    good = {"model": {"sigma": 60}, "name": "cand", "knob_id": "sigma", "expected_diff_paths": ["model.sigma"]}
    meta = {"reconciled": "true", "audit_ok": "true", "audit_version": "v", "audit_input_counts": '{"reference_n": 1, "csv_n": 2}'}
    assert gates.passed([(gates.one_knob, good, base), (gates.audited, meta), (gates.registered_against, good, base), (gates.objective_known, "REJECT", False)]) == []
    bad = [(gates.one_knob, {**base, "knob_id": "x"}, base), (gates.one_knob, {**good, "expected_diff_paths": []}, base), (gates.one_knob, {**good, "knob_id": None}, base), (gates.registered_against, {**good, "screens_against": {"sha": "0"}}, base), (gates.nominated, None, good, base, {}), (gates.nominated, "/nowhere", good, base, {}), (gates.objective_known, "ADOPTED", False)]
    bad += [(gates.audited, {**meta, **x}) for x in ({"reconciled": "false"}, {"audit_ok": None}, {"audit_version": ""}, {"audit_input_counts": None}, {"audit_input_counts": "x"}, {"audit_input_counts": '{"reference_n": 0, "csv_n": 2}'})]
    assert len(gates.passed(bad)) == len(bad)


def test_universe_steps(spark):
    s = "match_id long, tournament_id long, tier string, team1_id long, team2_id long, start_ts timestamp"
    rows = [(i, 7, "s" if i else None, i, i + 1, f"2026-01-{10 + i:02d} 00:00:00") for i in range(3)] + [(9, None, "s", 1, 2, "2026-01-01 00:00:00"), (10, 8, "b", 1, 2, "2025-12-01 00:00:00"), (11, 8, "b", 4, 9, "2025-12-31 00:00:00"), (12, 8, "b", 9, 12, "2026-01-05 00:00:00"), (13, 8, "b", 12, 13, "2025-06-30 00:00:00")]
    m = spark.createDataFrame(rows, "match_id long, tournament_id long, tier string, team1_id long, team2_id long, start_ts string").withColumn("start_ts", F.col("start_ts").cast("timestamp"))
    assert m.schema.simpleString().count("timestamp") == 1 and s
    good, rest = events.event_universe(m, least=3)
    assert [(r.tournament_id, r.tier, r.n) for r in good.collect()] == [(7, "s", 3)] and [(r.tournament_id, r.reason) for r in rest.collect()] == [(8, "tier")]
    assert [events.split(good, d).first().part for d in ("2026-02-01", "2026-01-10", "2026-01-11")] == ["dev", "holdout", "straddler"]
    w = events.window_matches(good, m, 6)
    assert {r.match_id for r in w.collect()} == {9, 10, 11, 12}
    hops = {r.team: r.hop for r in events.expand(events.participants(good, m), w, 2).collect()}
    assert hops == {0: 0, 1: 0, 2: 0, 3: 0}
    more = events.expand(spark.createDataFrame([(7, 4)], "event_id long, team long"), w, 2)
    assert {r.team: r.hop for r in more.collect()} == {4: 0, 9: 1, 12: 2}
    assert {r.match_id for r in events.inside(w, more).collect()} == {11, 12}
    with pytest.raises(ValueError):
        events.assert_no_leakage(w.withColumn("start_ts", F.col("boundary")), w.limit(0))
    loo = events.leave_one_out(spark.createDataFrame([(1, "s", 1100.0), (1, "s", 1060.0), (1, "a", 990.0), (1, None, 5.0)], "event_id long, modal_tier string, rating double"), 1000.0)
    assert {r.rating: r.prior for r in loo.collect()} == {1100.0: 1060.0, 1060.0: 1100.0, 990.0: 1000.0, 5.0: 1000.0}


def test_modal_tiers(spark):
    rows = [(1, 1, 2, t) for t in ("b", "a", "a", "b", None)] + [(1, 3, 4, t) for t in ("z", "y")]
    df = spark.createDataFrame(rows, "event_id long, team1_id long, team2_id long, tier string").withColumn("start_ts", F.lit("2026-01-01").cast("timestamp"))
    assert {r.team: (r.n, r.modal_tier) for r in events.team_statistics(df).collect()} == {1: (5, "a"), 2: (5, "a"), 3: (2, "y"), 4: (2, "y")}
