import pytest
from duelframe.plans import ratings, sensitivity, swiss

from .test_plans import EVENT, RATED, TEAMS

RESULTS = [(TEAMS[i], TEAMS[j], 1.0, "g1" if i % 2 else "g2") for i in range(6) for j in range(i + 1, 10)]
ANCHORS = [{"a": "t00", "b": "t08", "p": 0.7}, {"a": "t01", "b": "t09", "p": 0.985}]


def test_scenarios_move_one_thing_each():
    got = sensitivity.scenarios(RESULTS, ANCHORS)
    assert [s.name for s in got] == ["base", "t00-t08 +0.03", "t00-t08 -0.03", "t01-t09 +0.03", "t01-t09 -0.03", "g1 x0.8", "g1 x1.2", "g2 x0.8", "g2 x1.2"]
    assert got[1].anchors[0][2] == pytest.approx(0.73) and got[1].anchors[1][2] == 0.985 and got[3].anchors[1][2] == 0.99 and got[5].anchors == got[0].anchors


def test_fits_equal_those_done_one_by_one(spark):
    priors, settings = dict(RATED), ratings.Settings(70.0, iters=200)
    asked = sensitivity.scenarios(RESULTS, ANCHORS)
    got = sensitivity.fitted(spark, asked, RESULTS, priors, settings, TEAMS)
    one = ratings.fit([r[0] for r in RESULTS], [r[1] for r in RESULTS], [r[2] * (1.2 if r[3] == "g1" else 1) for r in RESULTS], priors, settings, TEAMS)
    assert got["g1 x1.2"] == pytest.approx(ratings.anchored(one, ANCHORS)) and got["base"] != got["t00-t08 +0.03"]


def test_the_ritual_reports_every_scenario(spark):
    out = {r.scenario: r for r in sensitivity.ritual(spark, EVENT, RESULTS[:20], ANCHORS[:1], RATED, ratings.Settings(70.0, iters=50), n=300, each=150).collect()}
    assert set(out) == {s.name for s in sensitivity.scenarios(RESULTS[:20], ANCHORS[:1])} and not out["base"].flipped and out["base"].margin == 0 and all(r.margin >= 0 for r in out.values())


def test_engines_side_by_side(spark):
    same = sensitivity.engines(spark, EVENT, RATED, RATED, 200).collect()
    assert len(same) == 16 and all(r.p30_moved == 0 and r.p03_moved == 0 for r in same)
    moved = {r.team: r for r in sensitivity.engines(spark, EVENT, RATED, {**RATED, "t15": 1600.0}, 300).collect()}
    assert moved["t15"].pany_moved > 0.5 and isinstance(swiss.rated_prob(RATED)("t00", "t01"), float)
