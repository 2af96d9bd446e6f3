"""The commands over small files, the state of the code, and pages by HTTP."""

import http.server
import json
import subprocess
import threading

import pytest
from duelframe.__main__ import COMMANDS, main
from duelframe.functions import repository
from duelframe.plans import ratings, swiss
from duelframe.sources import archive, http as pages, paged

from .test_matches import CASES, chunk, match, service
from .test_plans import EVENT, RATED, TEAMS


@pytest.fixture
def run(spark, capsys):
    def call(*words, status=0):
        assert main([str(w) for w in words], spark) == status
        return json.loads(capsys.readouterr().out)

    return call


@pytest.fixture
def event(tmp_path):
    raw = {"event_id": "e", "name": "E", "teams": TEAMS, "round1": EVENT.round1, "seeds": EVENT.seeds, "scoring": {"exact_3_0": 2, "exact_0_3": 2, "advance": 6, "pass_threshold": 5}, "playoffs": {"grand_final_bo5": True}}
    (tmp_path / "event.json").write_text(json.dumps(raw))
    (tmp_path / "ratings.json").write_text(json.dumps(dict(RATED)))
    return tmp_path


def test_fits_and_posteriors(run, tmp_path):
    (tmp_path / "m.csv").write_text("winner,loser,weight,event,note\nA,B,1.0,x,\nB,C,0.5,x,\nA,C,1.0,y,\n")
    (tmp_path / "a.json").write_text(json.dumps({"anchors": [{"a": "A", "b": "B", "p": 0.6}]}))
    got = run("fit", "--matches", tmp_path / "m.csv", "--anchors", tmp_path / "a.json", "--out", tmp_path / "r.json")
    own = ratings.fit(["A", "B", "A"], ["B", "C", "C"], [1.0, 0.5, 1.0], dict.fromkeys("ABC", 1000.0), ratings.Settings(70.0))
    assert got == json.loads((tmp_path / "r.json").read_text()) == pytest.approx(ratings.anchored(own, [{"a": "A", "b": "B", "p": 0.6}]))
    sds = run("posterior-deviations", "--matches", tmp_path / "m.csv")
    assert set(sds) == {"A", "B", "C"} and all(40 < v < 70 for v in sds.values())


def test_slates_brackets_and_live(run, event):
    best = run("optimize", "--event", event / "event.json", "--ratings", event / "ratings.json", "--sims", 60)["base"]
    assert len(best["exact30"]) == 2 and len(best["advance"]) == 6
    out = run("playoffs", "--seeds", *TEAMS[:8], "--ratings", event / "ratings.json", "--draws", 3, "--sd", 20)
    assert sum(r["champ"] for r in out["reach"]) == pytest.approx(1) and [p["place"] for p in out["picks"]] == list(range(1, 13))
    for name, value in (("slate", {k: best[k] for k in ("exact30", "exact03", "advance")}), ("done", EVENT.round1[:7]), ("due", EVENT.round1[7:])):
        (event / f"{name}.json").write_text(json.dumps(value))
    entry = run("live-forecast", "--event", event / "event.json", "--ratings", event / "ratings.json", "--slate", event / "slate.json", "--completed", event / "done.json", "--upcoming", event / "due.json", "--sims", 40, "--log", event / "log")
    assert entry["n_completed"] == 7 and len(entry["rooting"]) == 1 and len(entry["teams"]) == 16 and list((event / "log").iterdir())


def test_results_and_postmortem(run, event):
    state, matches = swiss.State.of(TEAMS), []
    for _ in range(5):
        for a, b in swiss.next_round(EVENT, state) if matches else EVENT.round1:
            state.record(a, b)
            matches.append([a, b])
    (event / "matches.json").write_text(json.dumps(matches))
    records = run("make-results", "--event", event / "event.json", "--matches", event / "matches.json", "--out", event / "results.json")
    assert sorted(map(tuple, records.values())) == sorted(r for r, n in swiss.RECORDS.items() for _ in range(n))
    (event / "table.json").write_text(json.dumps({t: {"p30": 0.125, "padv": 0.375, "p03": 0.125} for t in TEAMS}))
    won = [t for t, r in records.items() if r == [3, 0]]
    (event / "slate.json").write_text(json.dumps({"exact30": won, "exact03": [t for t, r in records.items() if r == [0, 3]], "advance": won * 3}))
    got = run("postmortem", "--table", event / "table.json", "--results", event / "results.json", "--slate", event / "slate.json", "--pick", *TEAMS[:7], "--actual", *TEAMS[:7])
    assert len(got["teams"]) == 16 and got["ticks"] == 4 and got["bracket"]["challenges"]
    (event / "matches.json").write_text(json.dumps(matches[:8]))
    with pytest.raises(ValueError):
        run("make-results", "--event", event / "event.json", "--matches", event / "matches.json", "--out", event / "results.json")


def test_archives_and_audits(run, spark, tmp_path):
    got = run("crawl", "--fetch", "tests.core.test_matches:fetch", "--out", tmp_path / "a", "--limit", service(7)["limit"])
    assert got["rows"] == 7 and run("crawl", "--fetch", "x:y", "--out", tmp_path / "a", "--verify")["offsets_contiguous"]
    chunk(tmp_path / "matches_0000.jsonl.gz", [(0, 12, [match(i, **over) for i, (over, _) in enumerate(CASES)])])
    (tmp_path / "aliases.json").write_text(json.dumps({"A": 1, "B": 2}))
    root = tmp_path / "store"
    meta = run("parse", "--archive", f"{tmp_path}/matches_*.gz", "--aliases", tmp_path / "aliases.json", "--root", root)
    assert meta["unique_ids"] == "12"
    from .test_substrate import event as row
    from .test_substrate import snapshot

    snapshot(tmp_path / "s.jsonl.gz", "2026-03-01", [row(7), row(500)])
    assert run("tournaments", "--archive", tmp_path / "s.jsonl.gz", "--root", root)["tournaments_n"] == 2
    found = run("integrity-audit", "--root", root, "--partial")
    assert found["ok"] and found["counts"]
    with pytest.raises(ValueError):
        run("integrity-audit", "--root", root)


def test_calibration_takes_the_last_grade(run, tmp_path):
    line = lambda **k: json.dumps({"a": "A", "b": "B", "close_prob": 0.6, "close_flagged": False, "manifested": True, "adoption_eligible": True, "brier_model": 0.2, "brier_market": 0.3, "log_model": 0.5, "log_market": 0.6} | k)
    (tmp_path / "log.jsonl").write_text("\n".join([line(brier_model=0.9), line(a="C"), "", line(brier_model=0.1), line(a="D", manifested=False)]))
    got = run("calibration", "--log", tmp_path / "log.jsonl")
    assert got["n"] == 2 and got["model_brier"] == pytest.approx(0.15) and got["excluded_unmanifested_n"] == 1


def test_every_command_says_what_it_needs(capsys):
    for name in COMMANDS:
        with pytest.raises(SystemExit) as e:
            main([name, "--help"])
        assert e.value.code == 0
    capsys.readouterr()


def test_the_state_of_the_code(tmp_path):
    git = lambda *w: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *w], check=True, capture_output=True)
    assert repository.state(tmp_path) == {"sha": None, "dirty": None}
    git("init")
    (tmp_path / "f").write_text("1")
    git("add", "f")
    git("commit", "-m", "f")
    clean = repository.state(tmp_path)
    assert len(clean["sha"]) == 40 and clean["dirty"] is False
    (tmp_path / "f").write_text("2")
    assert repository.state(tmp_path) == {"sha": clean["sha"], "dirty": True}


def test_pages_by_http():
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["User-Agent"]))
            self.send_response(503 if len(asked) == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"total": {"count": 1}, "results": ["é"]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        fetch = pages.pages(f"http://127.0.0.1:{server.server_port}/?o={{offset}}&n={{limit}}", pause=0.01)
        body = paged.patient(lambda: fetch(50, 25), 2, lambda s: None)  # HTTP errors are OSErrors
    finally:
        server.shutdown()
    assert paged.page_of(body) == (1, ["é"]) and asked == [("/?o=50&n=25", "duelframe")] * 2 and archive.PAGE
