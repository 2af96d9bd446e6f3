"""Builds of the parsed tables, and the joins over them that SQL queries don't reach."""

import gzip
import json
from pathlib import Path

import pytest
from duelframe.operators import audit, grading, latest
from duelframe.plans import bracket, live, ratings, swiss
from duelframe.sources import archive, commits, files, substrate
from pyspark.sql import functions as F

from .test_matches import CASES, chunk, match
from .test_plans import EVENT, RATED, TEAMS


def event(i, **over):
    return dict.fromkeys(archive.EVENT_KEYS) | {"id": i, "name": f"E{i}", "tier": "s", "tier_rank": 1, "pickem_presence": [1, 2]} | over


def snapshot(path, sid, rows):
    with gzip.open(path, "at") as f:
        f.write(json.dumps({"snapshot_id": sid, "fetched_at": sid, "url": "u", "offset": 0, "body": json.dumps({"total": {"count": len(rows)}, "results": rows})}) + "\n")


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("A", 1, "x"), ("B", 2, "x")], "canonical string, team_id long, source string")


def test_builds_and_loads(spark, tmp_path, aliases):
    rows = [match(i, **over) for i, (over, _) in enumerate(CASES)]
    chunk(tmp_path / "matches_0000.jsonl.gz", [(0, 12, rows)])
    lines = archive.read_lines(spark, f"{tmp_path}/*.gz")
    root = f"{tmp_path}/store"
    meta = substrate.build(spark, lines, aliases, root)
    assert (meta["rows_seen"], meta["unique_ids"], meta["clean_n"], meta["quarantined_n"], meta["reconciled"]) == ("12", "12", "2", "10", "false")
    assert json.loads(meta["reason_counts"])["score_bo_mismatch"] == 3
    again = substrate.build(spark, lines, aliases, root)
    assert again == meta and substrate.newest(spark, root).endswith("build-000001")
    held = substrate.load(spark, root)
    assert held.meta == meta and held.matches.count() == 12 and held.teams.count() == 2 and held.tournaments is None and held.flags is None
    with pytest.raises(ValueError, match="audit"):
        held.consumed()
    snapshot(tmp_path / "s.jsonl.gz", "2026-03-01", [event(7), event(500, name=None), event(7, name="later")])
    found = substrate.add_tournaments(spark, root, archive.read_lines(spark, f"{tmp_path}/s.jsonl.gz"))
    assert found == {"snapshot_id": "2026-03-01", "tournaments_n": 2, "null_names": 1, "states": {}, "ok": True}
    held = substrate.load(spark, root)
    assert held.meta["tournaments_snapshot_id"] == "2026-03-01" and {r.tournament_id: r.name for r in held.tournaments.collect()} == {7: "later", 500: None} and held.tournaments.first().pickem_presence == "[1,2]"
    substrate.add_audit(spark, root, audit.run_audit(held.matches, held.tournaments, held.aliases, None, None, "2026-01-01", partial=True))
    done = substrate.load(spark, root)
    assert done.meta["audit_version"] == audit.AUDIT_VERSION and {r.match_id for r in done.consumed().collect()} == {6, 8, 9}


def test_events_that_matches_name_and_a_snapshot_lacks(spark, tmp_path, aliases):
    chunk(tmp_path / "matches_0000.jsonl.gz", [(0, 3, [match(1, tournament_id=1), match(2, tournament_id=2), match(3, tournament_id=3)])])
    root = f"{tmp_path}/store"
    substrate.build(spark, archive.read_lines(spark, f"{tmp_path}/m*.gz"), aliases, root)
    snapshot(tmp_path / "s.jsonl.gz", "2026-03-01", [event(1)])
    excused = spark.createDataFrame([(2,)], "tournament_id long")
    got = substrate.add_tournaments(spark, root, archive.read_lines(spark, f"{tmp_path}/s.jsonl.gz"), excused)
    assert got["states"] == {"excused": 1, "gone": 1} and not got["ok"]
    snapshot(tmp_path / "t.jsonl.gz", "2026-01-01", [event(1)])
    assert substrate.add_tournaments(spark, root, archive.read_lines(spark, f"{tmp_path}/t.jsonl.gz"))["states"] == {"stale": 2}
    broken = event(4)
    broken.pop("prize")
    snapshot(tmp_path / "u.jsonl.gz", "2026-04-01", [broken])
    with pytest.raises(Exception, match="contract keys"):
        substrate.add_tournaments(spark, root, archive.read_lines(spark, f"{tmp_path}/u.jsonl.gz"))
    with pytest.raises(FileNotFoundError):
        substrate.load(spark, f"{tmp_path}/nowhere")


def test_regrading_agrees_with_the_committed_log(spark):
    results = spark.createDataFrame([(0, "A", "B", "A"), (1, "B", "C", "C")], "match_key long, a string, b string, winner string")
    overrides = spark.createDataFrame([("B", "A", 0.3)], "a string, b string, p double")
    rated = spark.createDataFrame([("A", 1000.0), ("B", 1000.0), ("C", 1200.0)], "team string, rating double")
    closes = spark.createDataFrame([(0, 0.6, False), (1, None, False)], "match_key long, p_a double, flagged boolean")
    prov = {"reconstruction_mode": "immutable_forecast", "code_dirty": "false", "code_sha": "x"}
    graded, none = grading.regrade(results, overrides, rated, closes, results.limit(0).selectExpr("a", "b", "0D AS model_prob", "0D AS result", "0D AS brier_model", "0D AS log_model"), prov)
    assert {(r.a, r.field, r.found) for r in none.collect()} == {("A", "row", "there"), ("B", "row", "there")}
    own = {r.match_key: r for r in graded.collect()}
    assert own[0].model_prob == pytest.approx(0.7) and own[0].adoption_eligible and own[1].model_prob == pytest.approx(1 / (1 + 10**0.5)) and not own[1].adoption_eligible
    committed = graded.select("a", "b", "model_prob", "result", "brier_model", "log_model")
    assert grading.regrade(results, overrides, rated, closes, committed, prov)[1].count() == 0
    moved = committed.withColumn("brier_model", F.when(F.col("a") == "A", 0.5).otherwise(F.col("brier_model")))
    assert [(r.a, r.field, r.committed) for r in grading.regrade(results, overrides, rated, closes, moved, prov)[1].collect()] == [("A", "brier_model", "0.5")]
    with pytest.raises(Exception, match="no price and no rating"):
        grading.forecast_rows(results, overrides, rated.where("team <> 'C'"), closes).collect()
    with pytest.raises(Exception, match="no result"):
        grading.team_rows(spark.createDataFrame([("A", 0.1, 0.2, 0.3)], "team string, p30 double, padv double, p03 double"), spark.createDataFrame([], "team string, wins int, losses int")).collect()


def test_deltas_between_versions(spark):
    df = spark.createDataFrame([("p30", 1, 0.5), ("p30", 3, 0.25), ("p30", 2, 0.4), ("padv", 1, 1.0)], "category string, version int, brier double")
    got = {(r.category, r.version): (r.previous, round(r.brier_change, 9)) for r in latest.version_deltas(df, ["category"], "version", ["brier"]).collect()}
    assert got == {("p30", 2): (1, -0.1), ("p30", 3): (2, -0.15)}


def test_the_rival_differs_from_the_leader(spark):
    ranked = spark.createDataFrame([(1, 5, 0.5, [0.5, 0.5]), (2, 6, 0.5, [0.5, 0.5]), (3, 9, 0.4, [0.3, 0.5])], "place int, pick int, challenges double, values array<double>")
    got = bracket.rival(ranked)
    assert (got["leader"], got["tied"], got["rival"], round(got["margin"], 9), round(got["se"], 9)) == (5, 2, 9, 0.1, 0.1)
    assert bracket.rival(ranked.limit(2)) is None


def test_announced_brackets_go_before_derived_ones(tmp_path):
    completed, now = [], swiss.State(met={t: [] for t in TEAMS}, due=list(EVENT.round1))
    while due := now.due or swiss.next_round(EVENT, now):
        now.due = []
        for m in due:
            completed.append(tuple(sorted(m)))
            now.record(*sorted(m))
    seeds, how = bracket.announced_or_derived(tmp_path / "bracket.json", EVENT, completed)
    assert how == "derived" and seeds == swiss.final_seeds(EVENT, completed)
    (tmp_path / "bracket.json").write_text(json.dumps({"seeds": list(TEAMS[8:])}))
    assert bracket.announced_or_derived(tmp_path / "bracket.json", EVENT, []) == (list(TEAMS[8:]), "announced")
    (tmp_path / "bracket.json").write_text(json.dumps({"seeds": ["?"] * 8}))
    with pytest.raises(ValueError):
        bracket.announced_or_derived(tmp_path / "bracket.json", EVENT, [])


def test_forecast_manifests_name_and_hash_their_inputs():
    m = live.forecast_manifest({"ratings": ("r.json", RATED), "anchors": ("a.json", None)}, "abc", False, 40_000, 11, {"policy": "p"})
    assert m["ratings_source"] == "r.json" and len(m["ratings_sha"]) == 64 and m["anchors_sha"] == "unknown" and m["code_dirty"] is False and m["policy"] == "p"
    assert live.forecast_manifest({}, None, None, 1, 1)["code_dirty"] and live.forecast_manifest({}, None, None, 1, 1)["code_sha"] == "unknown"


def test_broken_fits_are_misses(spark, tmp_path):
    path, calls = f"{tmp_path}/fits", []

    def compute(missing):
        calls.append(sorted(r[0] for r in missing.collect()))
        return missing.crossJoin(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "team string, rating double"))

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "fit_key string")
    assert ratings.cached(keys("a", "b"), path, compute).count() == 4
    table = commits.Table(spark, f"{path}/version={ratings.FIT_VERSION}")
    for i, rows in enumerate(([("b", "x", float("nan"))], [("a", "x", 1.0), ("a", "y", 2.0)])):
        table.update(lambda base, i=i, rows=rows: ({**base.parts, f"more-{i}": table.stage(spark.createDataFrame(rows, "fit_key string, team string, rating double"))}, {}))
    (Path(table.head().parts["more-1"]) / "part-9.parquet").write_text("no parquet")
    assert {(r.fit_key, r.team): r.rating for r in ratings.cached(keys("a", "b", "c"), path, compute).collect()} == {(k, t): v for k in "abc" for t, v in (("x", 1.0), ("y", 2.0))}
    assert ratings.cached(keys("a", "b", "c"), path, compute).count() == 6 and calls == [["a", "b"], ["b", "c"]]


def test_csv_fields_stay_text(spark, tmp_path):
    (tmp_path / "fit.csv").write_text("winner,loser,weight\n01,B,0.50\n")
    assert tuple(files.csv_texts(spark, str(tmp_path / "fit.csv")).first()) == ("01", "B", "0.50")


# Prior ratings, of which the first sixteen play the stage.
PRIORS = {
    "Vitality": 1180, "Spirit": 1075, "NAVI": 1065, "Falcons": 1040, "FURIA": 995, "MOUZ": 990, "MongolZ": 985, "Aurora": 950, "PARIVISION": 945, "FUT": 935, "G2": 920, "BetBoom": 880, "Monte": 875, "Legacy": 870, "B8": 845, "9z": 790,
    "Astralis": 900, "GamerLegion": 900, "paiN": 860, "TYLOO": 860, "BIG": 860, "Liquid": 850, "MIBR": 840, "3DMAX": 840, "M80": 820, "FlyQuest": 820, "HOTU": 820, "RedCanids": 780, "GentleMates": 780, "PassionUA": 760,
}
# Ratings after 25 steps over two matches.
FITTED = {"Vitality": 1189.288373985839, "Spirit": 1065.711626014161, "NAVI": 1070.4391508097926, "FURIA": 989.5608491902075, "G2": 920.0}
# A bracket's seeds, the ratings and prices before it, and the chance of its likeliest champion.
SEEDS = ("Spirit", "FURIA", "Aurora", "Vitality", "Falcons", "BetBoom", "9z", "G2")
STRENGTH = {"Vitality": 1171.2506830325908, "Falcons": 1050.0146666935073, "Aurora": 962.7971131969234, "FURIA": 1020.6373205980242, "Spirit": 1120.7100399931592, "G2": 946.1230144493074, "9z": 859.9550612758283, "BetBoom": 921.0675905572331}
PRICES = [{"a": "Vitality", "b": "Falcons", "p": 0.705}, {"a": "Aurora", "b": "BetBoom", "p": 0.545}, {"a": "FURIA", "b": "9z", "p": 0.735}, {"a": "Spirit", "b": "G2", "p": 0.735}]
CHAMPION = 0.3569


def test_golden_fit():
    stage = list(PRIORS)[:16]
    settings = ratings.Settings(sigma=50.0, sigma_by_team=dict.fromkeys(stage, 70.0), iters=25)
    got = ratings.fit(["Vitality", "NAVI"], ["Spirit", "FURIA"], [1.0, 0.5], {t: float(r) for t, r in PRIORS.items()}, settings, stage)
    assert {t: got[t] for t in FITTED} == pytest.approx(FITTED, abs=1e-6)


def test_golden_bracket(spark):
    branches = bracket.branch_probs(SEEDS, bracket.bracket_prob(STRENGTH, ratings.overrides(PRICES)))
    assert max(r.champ for r in bracket.reach(spark, SEEDS, branches).collect()) == pytest.approx(CHAMPION, abs=5e-5)
