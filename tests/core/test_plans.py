import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from duelframe.plans import bracket, gates, live, posterior, ratings, replay, slates, swiss
from duelframe.sources import files
from pyspark.sql import functions as F

TEAMS = tuple(f"t{i:02d}" for i in range(16))
EVENT = swiss.Event(TEAMS, tuple(zip(TEAMS[:8], TEAMS[8:], strict=True)), {t: i + 1 for i, t in enumerate(TEAMS)})
RATED = {t: 1200.0 - 25 * i for i, t in enumerate(TEAMS)}


def test_small_fit_by_hand():
    """Two matches, few steps, against the update written out."""
    priors = {"a": 1100.0, "b": 1050.0, "c": 900.0}
    got = ratings.fit(["a", "b"], ["b", "c"], [1.0, 0.5], priors, ratings.Settings(sigma=60.0, iters=25))
    r = dict(priors)
    for _ in range(25):
        g = dict.fromkeys(r, 0.0)
        for w, x, k in (("a", "b", 1.0), ("b", "c", 0.5)):
            s = k * (1 - 1 / (1 + 10 ** (-(r[w] - r[x]) / 400))) * math.log(10) / 400
            g[w] += s
            g[x] -= s
        r = {t: r[t] + 2000 * (g[t] - (r[t] - priors[t]) / 3600) for t in r}
    shift = (sum(priors.values()) - sum(r.values())) / 3
    assert got == pytest.approx({t: v + shift for t, v in r.items()}, abs=1e-9)


def test_dense_fits_settle_or_raise():
    w, x = ["a"] * 200 + ["b"] * 100, ["b"] * 200 + ["a"] * 100
    flat = {"a": 1000.0, "b": 1000.0}
    got = ratings.fit(w, x, [1.0] * 300, flat, ratings.Settings(50.0, iters=2000, lr=100.0, tol=0.01))
    assert got["a"] > 1000 > got["b"] and sum(got.values()) == pytest.approx(2000)
    for s in (ratings.Settings(50.0, iters=3, lr=100.0, tol=0.01), ratings.Settings(50.0, iters=500, lr=20000.0, tol=0.01)):
        with pytest.raises(ratings.FitError):
            ratings.fit(w, x, [1.0] * 300, flat, s)


def test_anchors_move_both_sides():
    moved = ratings.anchored({"a": 1000.0, "b": 1000.0}, [{"a": "a", "b": "b", "p": 0.75}], 1.0)
    assert 1 / (1 + 10 ** (-(moved["a"] - moved["b"]) / 400)) == pytest.approx(0.75) and sum(moved.values()) == pytest.approx(2000)
    assert ratings.overrides([{"a": "a", "b": "b", "p": 0.75}]) == {("a", "b"): 0.75, ("b", "a"): 0.25}
    assert ratings.tier_priors({"x": 1100.0, "y": 1060.0, "z": 990.0}, {"x": "s", "y": "s", "z": "a"}, 1000) == {"x": 1060.0, "y": 1100.0, "z": 1000.0}


def test_stages_have_the_records_of_a_stage():
    prob = swiss.rated_prob(RATED)
    for seed in range(200):
        rng = random.Random(seed)
        seen = []
        result = swiss.play(EVENT, lambda a, b, seen=seen: seen.append(frozenset((a, b))) or prob(a, b), rng.random)
        assert Counter(result.values()) == swiss.RECORDS and len(seen) == 33
        assert len(set(seen)) == len(seen)


def test_groups_of_six_take_the_first_row_without_rematch():
    group, key = list("abcdef"), lambda t: ("abcdef".index(t),)
    none = {t: [] for t in group}
    assert swiss.pair_group(group, none, key) == [("a", "f"), ("b", "e"), ("c", "d")]
    assert swiss.pair_group(group, {**none, "a": ["f"], "f": ["a"]}, key) == [("a", "e"), ("b", "f"), ("c", "d")]
    assert swiss.pair_group(group, {**none, "a": ["f", "e"]}, key) == [("a", "d"), ("b", "f"), ("c", "e")]
    assert swiss.pair_group(["a", "b"], {"a": ["b"], "b": ["a"]}, key) == [("a", "b")]
    assert swiss.pair_group(list("abcd"), {**none, "a": ["d"], "b": ["c"]}, key) == [("a", "c"), ("b", "d")]


def test_states_are_checked():
    a, b, c = TEAMS[:3]
    for completed, upcoming in (([(a, "nobody")], []), ([(a, b), (b, a)], []), ([(a, b)], [(a, b)]), ([(a, t) for t in TEAMS[1:5]], []), ([(a, b), (a, c)], []), ([(a,)], [])):
        with pytest.raises(ValueError):
            swiss.State.of(TEAMS, completed, upcoming)
    state = swiss.State.of(TEAMS, EVENT.round1)
    assert state.wins[a] == 1 and Counter(swiss.play(EVENT, swiss.rated_prob(RATED), random.Random(1).random, state).values()) == swiss.RECORDS


def test_final_seeds():
    completed, now = [], swiss.State(met={t: [] for t in TEAMS}, due=list(EVENT.round1))
    while due := now.due or swiss.next_round(EVENT, now):
        now.due = []
        for m in due:
            w, x = sorted(m)
            completed.append((w, x))
            now.record(w, x)
    seeds = swiss.final_seeds(EVENT, completed)
    assert len(seeds) == 8 and seeds[0] == "t00"
    with pytest.raises(ValueError):
        swiss.final_seeds(EVENT, completed[:-1])


def test_simulations_do_not_depend_on_partitions(spark):
    one = swiss.simulate(spark, EVENT, {"x": RATED}, 1200, 3)
    two = swiss.simulate(spark, EVENT, {"x": RATED, "y": RATED}, 1200, 3)
    rows = lambda d, s: sorted(tuple(r)[1:] for r in d.where(F.col("scenario") == s).collect())
    assert rows(one, "x") == rows(two, "y") and len(rows(one, "x")) == 1200
    stats = {r.team: r for r in swiss.statistics(one, EVENT).collect()}
    assert sum(r.p30 for r in stats.values()) == pytest.approx(2) and sum(r.padv for r in stats.values()) == pytest.approx(6) and sum(r.p03 for r in stats.values()) == pytest.approx(2)
    stream = swiss.simulate(spark, EVENT, {"x": RATED}, 50, 3, stream=True).collect()
    rng, prob = random.Random(3), swiss.rated_prob(RATED)
    assert [tuple(r)[2:] for r in sorted(stream, key=lambda r: r.sim)] == [swiss._masks(EVENT, swiss.play(EVENT, prob, rng.random)) for _ in range(50)]
    p, q = stats["t00"].p30, np.mean([swiss.play(EVENT, prob, random.Random(i).random)["t00"] == (3, 0) for i in range(1200)])
    assert abs(p - q) < 4 * math.sqrt(2 * p * (1 - p) / 1200)


def test_best_slate_is_best(spark):
    sims = swiss.simulate(spark, EVENT, {"x": RATED}, 400, 5).cache()
    best = slates.optimize(sims, EVENT, k30=3, k03=3, kadv=7)["x"]
    rows = [[swiss_result(r) for r in [row]][0] for row in sims.collect()]
    assert best.p_pass == pytest.approx(np.mean([live.slate_ticks(r, best) >= 5 for r in rows])) and best.expected == pytest.approx(np.mean([live.slate_ticks(r, best) for r in rows]))
    scored = slates.score(sims, slates.candidate_slates(swiss.statistics(sims, EVENT), EVENT, 3, 3, 7)).collect()
    assert max((r.p_pass, r.expected) for r in scored) == (best.p_pass, best.expected)
    s = {r.scenario: r for r in slates.sensitivity(sims, EVENT, "x").collect()}
    assert not s["x"].flipped and s["x"].margin == 0


def swiss_result(row):
    out = {}
    for i, t in enumerate(TEAMS):
        out[t] = (3, 0) if row.m30 >> i & 1 else (0, 3) if row.m03 >> i & 1 else (3, 1) if row.madv >> i & 1 else (1, 3)
    return out


def test_bracket_is_exact(spark):
    flat = bracket.branch_probs(TEAMS[:8], bracket.bracket_prob(dict.fromkeys(TEAMS, 1000.0)))
    assert flat == pytest.approx(np.full(128, 1 / 128))
    scores = dict(zip(bracket.OBJECTIVES, bracket.pick_scores(flat), strict=True))
    assert scores["champion"] == pytest.approx(np.full(128, 0.125)) and scores["expected_correct"] == pytest.approx(np.full(128, 2.625)) and scores["challenges"] == pytest.approx(np.full(128, 0.125 * 0.875))
    b = bracket.branch_probs(TEAMS[:8], bracket.bracket_prob(RATED, {("t00", "t07"): 1.0, ("t07", "t00"): 0.0}))
    reach = {r.team: r for r in bracket.reach(spark, TEAMS[:8], b).collect()}
    assert b.sum() == pytest.approx(1) and reach["t00"].sf == pytest.approx(1) and sum(r.final for r in reach.values()) == pytest.approx(2)
    ranked = bracket.rank_picks(posterior.draw_table(spark, [RATED, dict(RATED, t01=1300.0)]), TEAMS[:8]).orderBy("place").collect()
    assert len(ranked) == 128 and ranked[0].champ in ("t00", "t01") and len(ranked[0]["values"]) == 2 and ranked[0].challenges >= ranked[1].challenges
    assert bracket.series_bo5(0.5) == pytest.approx(0.5) and bracket.series_bo5(0.7) > 0.7
    with pytest.raises(ValueError):
        bracket.checked(["x"] * 8)
    assert live.bracket_grade([*"abcd", "a", "c", "a"], [*"abef", "a", "e", "a"]) == {"qf": 2, "sf": 1, "champion": True, "challenges": True}


MATCHES = [("a", "b", 1.0), ("b", "c", 0.5), ("a", "c", 1.0), ("c", "a", 1.0)]
PRIORS = {"a": 1000.0, "b": 1000.0, "c": 1000.0}


def test_posterior_agrees_with_chains(spark):
    own = ratings.fit(*zip(*[(w, x) for w, x, _ in MATCHES], strict=True), [k for *_, k in MATCHES], PRIORS, ratings.Settings(70.0))
    sigma = dict.fromkeys(PRIORS, 70.0)
    h = posterior.hessian([m[0] for m in MATCHES], [m[1] for m in MATCHES], [m[2] for m in MATCHES], own, list(PRIORS), sigma)
    factor = np.linalg.cholesky(h)
    sd = posterior.marginal_sd(factor)
    assert sd == pytest.approx(np.sqrt(np.diag(np.linalg.inv(h))))
    d = posterior.draws(own, factor, list(PRIORS), 4000, 1)
    assert np.std([x["a"] for x in d]) == pytest.approx(sd[0], rel=0.05)
    chains = {r.team: r for r in posterior.metropolis(spark, MATCHES, own, PRIORS, sigma, 12_000, 1000, 90.0).collect()}
    assert chains["a"].sd == pytest.approx(sd[0], rel=0.15) and abs(chains["a"].mean - own["a"]) < 15
    corners = posterior.structural_corners(MATCHES, PRIORS, ratings.Settings(70.0, iters=200), [{"a": "a", "b": "b", "p": 0.6}])
    assert len(corners) == 9 and corners[0]["ratings"]["a"] != corners[1]["ratings"]["a"]


def test_the_grid_equals_a_loop_over_its_corners(spark):
    corners = [{"scale": s, "share": x, "ratings": {t: r + 40 * s * (i % 3 - 1) + 20 * x for i, (t, r) in enumerate(RATED.items())}} for s in (0.7, 1.0, 1.3) for x in (0.3, 0.5, 0.7)]
    slate = slates.Slate(0, 0, TEAMS[:2], TEAMS[14:], TEAMS[2:8])
    points = posterior.structural_points(spark, EVENT, corners, slate, 150, 3).cache()
    got = {(r.scale, r["share"], r.quantity, r.team): r.value for r in points.collect()}
    assert len(got) == 9 * (1 + 3 * 16)
    masks = slates.slate_masks(EVENT, slate)
    for c in corners[::4]:
        sims = swiss.simulate(spark, EVENT, {"x": c["ratings"]}, 150, 3).collect()
        right = [sum((m & s).bit_count() for m, s in zip((r.m30, r.m03, r.madv), masks, strict=True)) for r in sims]
        assert got[c["scale"], c["share"], "p_pass", None] == pytest.approx(sum(k >= 5 for k in right) / 150)
        assert got[c["scale"], c["share"], "p30", "t00"] == pytest.approx(sum(r.m30 & 1 for r in sims) / 150)
    param = spark.createDataFrame([("p_pass", None, 0.5, 0.49, 0.9999), ("p30", "t00", 0.2, 0.199, 0.2005), ("other", "t00", 0.001, 0.0005, 0.0012)], "quantity string, team string, point double, low double, high double")
    out = {r.quantity: (r.low, r.high) for r in posterior.published(points, param).collect()}
    values = [v for (_, _, q, t), v in got.items() if (q, t) == ("p30", "t00")]
    assert out["p30"] == pytest.approx((min(0.197, *values), max(0.203, *values))) and out["other"] == pytest.approx((0.0, 0.004)) and out["p_pass"][1] >= 0.9999


def test_relational_hessian_equals_the_dense_one(spark):
    weights = [k for *_, k in MATCHES]
    rated = {"a": 1010.0, "b": 990.0, "c": 1000.0}
    h = posterior.hessian([m[0] for m in MATCHES], [m[1] for m in MATCHES], weights, rated, list(rated), dict.fromkeys(rated, 70.0))
    pairs = spark.createDataFrame([(e, *m) for e in (1, 2) for m in MATCHES], "event_id long, winner string, loser string, weight double")
    table = spark.createDataFrame([(e, t, r) for e in (1, 2) for t, r in [*rated.items(), *([("d", 900.0)] if e == 2 else [])]], "event_id long, team string, rating double")
    entries = posterior.hessian_entries(pairs, table, 70.0, ["event_id"]).cache()
    got = {(r.row, r.column): r.value for r in entries.where("event_id = 1").collect()}
    assert all(got.get((x, y), 0.0) == pytest.approx(h[i, j]) for i, x in enumerate(rated) for j, y in enumerate(rated))
    sds = {(r.event_id, r.team): r.sd for r in posterior.deviations(entries, "event_id").collect()}
    want = np.sqrt(np.diag(np.linalg.inv(h)))
    assert [sds[1, t] for t in rated] == pytest.approx(want) and [sds[2, t] for t in rated] == pytest.approx(want) and sds[2, "d"] == pytest.approx(70.0)
    drawn = posterior.drawn(entries, table, "event_id", 3000, 5)
    assert drawn.count() == 3000 * 7
    again = posterior.drawn(entries.repartition(3), table, "event_id", 3000, 5).where("event_id = 2 AND team = 'b'").agg(F.avg("rating"), F.stddev("rating")).first()
    own = drawn.where("event_id = 2 AND team = 'b'").agg(F.avg("rating"), F.stddev("rating")).first()
    assert tuple(own) == pytest.approx(tuple(again)) and own[0] == pytest.approx(990, abs=5) and own[1] == pytest.approx(want[1], rel=0.06)


def test_live_forecast(spark):
    slate = slates.Slate(0, 0, TEAMS[:2], TEAMS[14:], TEAMS[2:8])
    upcoming = list(EVENT.round1[6:])
    scores, stats = live.forecast(spark, EVENT, RATED, slate, EVENT.round1[:6], upcoming, 200)
    guide = live.rooting(scores, upcoming).collect()
    assert len(guide) == 2 and guide[0].swing >= guide[1].swing and stats.count() == 16
    forecasts = live.match_forecasts(RATED, upcoming, {upcoming[0]: 0.9})
    assert forecasts[0]["model_prob"] == forecasts[0]["market_prob"] == 0.9 and forecasts[1]["market_prob"] is None
    entry = live.log_entry("t", "r", "s", EVENT.round1[:6], upcoming, 0.4, 4.2, {}, [g.asDict() for g in guide])
    assert json.loads(json.dumps(entry))["n_completed"] == 6


HARNESS = {
    "eligibility": {"tiers": ["s", "a"], "min_consumer_matches": 8}, "window_months": 6, "fit_universe": {"rule": "1hop", "min_obs": 3}, "coverage_floor": 0.5, "holdout_split": "2030-01-01",
    "seeds": {"self_test": 20260705, "slate_sim": 3}, "mc": {"slate_sims": 200}, "verdict": {"mde_brier": 0.002, "min_events": 2, "ci_level": 0.95},
}
INCUMBENT = {"name": "inc", "model": {"priors_scheme": "flat1000", "prior_mean": 1000, "sigma": 50.0, "iters": 3000, "lr": 100.0, "converge_tol": 0.01}, "data_prep": {"weighting": "uniform"}}
CANDIDATE = {**INCUMBENT, "name": "cand", "knob_id": "sigma", "sweep_family": "f", "expected_diff_paths": ["model.sigma"], "model": {**INCUMBENT["model"], "sigma": 25.0}}
META = {"reconciled": "true", "audit_ok": "true", "audit_version": "v", "audit_input_counts": '{"reference_n": 1, "csv_n": 1}'}


@pytest.fixture(scope="module")
def substrate(spark):
    rows, i = [], 0
    for month in range(1, 6):
        for k in range(12):
            i += 1
            a, b = [(1, 2), (1, 3), (2, 3), (1, 4)][k % 4]
            rows.append((i, f"2026-{month:02d}-{k + 1:02d} 00:00:00", 3 if k % 3 else 1, a, b, a if k % 5 else b, "s", 100 + month))
    df = spark.createDataFrame(rows, "match_id long, start_ts string, bo_type int, team1_id long, team2_id long, winner_team_id long, tier string, tournament_id long")
    return df.withColumn("start_ts", F.col("start_ts").cast("timestamp")).cache()


def test_replay_end_to_end(substrate, tmp_path):
    got = replay.run(substrate, META, CANDIDATE, INCUMBENT, HARNESS, tmp_path, code_dirty=False)
    again = replay.run(substrate, META, CANDIDATE, INCUMBENT, HARNESS, tmp_path / "again", code_dirty=False)
    assert got == again and got["verdict"] in ("REJECT", "INCONCLUSIVE") and got["stats"]["n_events"] == 4 and got["evidence"]["uniform_brier"] == 0.25
    names = ("manifest.json", "verdict.json", "events.jsonl", "failures.jsonl")
    assert all((tmp_path / got["run_id"] / n).read_bytes() == (tmp_path / "again" / got["run_id"] / n).read_bytes() for n in names)
    lines = lambda top, name: sorted(x for f in (top / got["run_id"] / name).glob("part-*.json") for x in f.read_text().splitlines())
    assert all(lines(tmp_path, n) == lines(tmp_path / "again", n) != [] for n in ("rows", "skipped"))
    assert len(lines(tmp_path, "rows")) + len(lines(tmp_path, "skipped")) >= sum(json.loads(x)["n_graded"] for x in (tmp_path / got["run_id"] / "events.jsonl").read_text().splitlines())
    assert got["adoption_eligible"] and not replay.run(substrate, META, CANDIDATE, INCUMBENT, HARNESS, tmp_path, code_dirty=True)["adoption_eligible"]


def test_replay_blocks_without_metrics(substrate, tmp_path):
    clone = replay.run(substrate, META, {**INCUMBENT, "knob_id": "x"}, INCUMBENT, HARNESS, tmp_path)
    assert clone["verdict"] == "BLOCKED" and clone["stats"] is None and clone["evidence"] == {}
    few = replay.run(substrate, {**META, "audit_ok": "false"}, CANDIDATE, INCUMBENT, {**HARNESS, "verdict": {**HARNESS["verdict"], "min_events": 50}}, tmp_path)
    assert len(few["blocked_gates"]) >= 2
    limited = replay.run(substrate, META, CANDIDATE, INCUMBENT, HARNESS, tmp_path, limit=4)
    assert limited["verdict"] == "EXPLORATORY" and not limited["adoption_eligible"]
    with pytest.raises(gates.GateError):
        replay.run(substrate, META, CANDIDATE, INCUMBENT, HARNESS, tmp_path, "holdout", limit=1)


def test_fits_by_scheme_and_cache(spark, substrate, tmp_path):
    from duelframe.operators.events import event_universe

    ready = replay.prepare(substrate, event_universe(substrate)[0], 6)
    odd = {**INCUMBENT, "model": {**INCUMBENT["model"], "priors_scheme": "tier-empirical-2pass", "staleness": {"sigma_per_year": 40.0}}, "data_prep": {"weighting": {"scheme": "weighted", "half_life_days": 60, "bo1_discount": 0.5}}}
    fits = ratings.fit_events(ready.fitted, ready.teams, {"a": INCUMBENT, "b": odd}).cache()
    n = ready.teams.count()
    assert fits.count() == 2 * n and fits.groupBy("event_id", "config").agg(F.avg("rating").alias("m")).where("config = 'a' AND abs(m - 1000) > 1e-6").count() == 0
    with pytest.raises(ratings.FitError):
        ratings.fit_events(ready.fitted, ready.teams, {"a": {**INCUMBENT, "data_prep": {"weighting": "odd"}}})
    # A pair's matches count like one of their summed weight.
    own = ready.fitted.where("event_id = 105").orderBy("match_id").toPandas()
    names = sorted(r.team for r in ready.teams.where("event_id = 105").collect())
    model = INCUMBENT["model"]
    alone = ratings.fit(own["winner"].tolist(), own["loser"].tolist(), [1.0] * len(own), dict.fromkeys(names, float(model["prior_mean"])), ratings.Settings(float(model["sigma"]), {}, model["iters"], model["lr"], model.get("converge_tol")))
    assert {r.team: r.rating for r in fits.where("event_id = 105 AND config = 'a'").collect()} == pytest.approx(alone, abs=1e-9)
    key = ratings.fit_key(INCUMBENT, ["b", "a"], [1, 2], ["x"], "s")
    assert key == ratings.fit_key(INCUMBENT, ["a", "b"], [1, 2], ["x"], "s") != ratings.fit_key(INCUMBENT, ["a", "b"], [2, 1], ["x"], "s")
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing.withColumns({"team": F.lit("t"), "rating": F.lit(1.0)})

    for keys in (["k1"], ["k1", "k2"], ["k2"]):
        df = spark.createDataFrame([(k,) for k in keys], "fit_key string")
        assert {r.fit_key for r in ratings.cached(df, str(tmp_path / "fits"), compute).collect()} == set(keys)
    assert calls == [1, 1]


def test_slate_check(spark):
    same = replay.slate_check(spark, EVENT, RATED, RATED, 200, 3)
    assert same["objective_ok"] and same["identical_slates"] and same["mean"] == 0
    worse = replay.slate_check(spark, EVENT, {t: 2400 - r for t, r in RATED.items()}, RATED, 300, 3)
    assert not worse["objective_ok"] and worse["mean"] < 0


def test_event_configs(tmp_path):
    raw = {"event_id": "e", "name": "E", "teams": list(TEAMS), "round1": [list(p) for p in EVENT.round1], "seeds": dict(EVENT.seeds), "scoring": {"exact_3_0": 2, "exact_0_3": 2, "advance": 6, "pass_threshold": 5}, "playoffs": {"grand_final_bo5": True}}
    assert files.EventConfig.from_dict(raw).teams == TEAMS
    bad = [{"teams": list(TEAMS[:15])}, {"teams": [*TEAMS[:15], TEAMS[0]]}, {"round1": raw["round1"][:7]}, {"seeds": {t: 1 for t in TEAMS}}, {"scoring": {**raw["scoring"], "advance": True}}, {"scoring": {}}, {"playoffs": {}}]
    for b in bad:
        with pytest.raises(ValueError):
            files.EventConfig.from_dict({**raw, **b})
    with pytest.raises(ValueError):
        files.EventConfig.from_dict({k: v for k, v in raw.items() if k != "seeds"})
    with pytest.raises(ValueError):
        files.write_results({"t": (3, 0)}, tmp_path / "r.json", swiss.RECORDS)


def test_market_files(spark, tmp_path):
    listed = [("volume", 0, 0, "CS: A vs B at E", "s1", '["Alpha", "Bravo"]', '["0.6", "0.6"]', "5000", "1"), ("id", 0, 0, "CS: A vs B at E", "s1", '["Alpha", "Bravo"]', '["0.1", "0.9"]', "1", "1"), ("volume", 0, 1, "CS at E", "s2", '["Alpha", "Bravo"]', '["0.97", "0.03"]', "5000", None), ("volume", 0, 2, "chess at E", "s3", "[]", "[]", None, None), ("volume", 0, 3, "CS at E", "s4", '["Alpha", "Zed"]', '["0", "0"]', "9000", None)]
    df = spark.createDataFrame([(1 if p == "id" else 0, *r) for p, *r in listed], "pass int, page int, position int, question string, slug string, outcomes string, prices string, volume string, liquidity string").withColumn("end_date", F.lit(None).cast("string"))
    snap = files.market_snapshot(df, ["CS", "E"], "2026-01-01T00:00:00Z")
    assert {r.slug: r.prices for r in snap.collect()} == {"s1": [0.5, 0.5], "s2": [0.97, 0.03], "s4": [0.0, 0.0]}
    own = files.write_anchors(files.anchor_rows(snap, {"alpha": "A", "bravo": "B"}), tmp_path / "a.json")
    assert own == files.anchors(tmp_path / "a.json") == [{"a": "A", "b": "B", "p": 0.5, "slug": "s1", "volume": 5000}] and files.anchors(tmp_path / "none.json") == []
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in files.json_lines(spark, str(tmp_path / "log.jsonl"), "a int").orderBy("ordinal").collect()] == [1, 2]
    (tmp_path / "fit.csv").write_text('winner,loser,weight,event,note\nA,B,0.5,"e, f",n\n')
    assert files.fit_rows(spark, str(tmp_path / "fit.csv")).first().event == "e, f" and files.fit_list(tmp_path / "fit.csv") == [("A", "B", 0.5)]
