"""Archive, parsing, quarantine, audit and consumer view on small pages."""

import gzip
import json
import os
import tempfile
from pathlib import Path

import pytest
from duelframe.operators import audit, quarantine
from duelframe.sources import archive, files, paged


def match(i, **over):
    sides = {f"team{k}": {"id": k, "name": f"T{k}", "slug": f"t{k}", "country_id": None} for k in (1, 2)}
    base = dict.fromkeys(quarantine.MATCH_KEYS) | {"id": i, "slug": f"m{i}", "start_date": f"2026-01-{i % 27 + 1:02d}T10:00:00+00:00", "bo_type": 3, "team1_id": 1, "team2_id": 2, "team1_score": 2, "team2_score": 0, "winner_team_id": 1, "tier": "s", "tournament_id": 500, "maps_score": [True, True], **sides}
    return base | over


def chunk(path, pages, **more):
    with gzip.open(path, "wt") as f:
        for offset, total, results in pages:
            f.write(json.dumps({"fetched_at": f"2026-02-01T00:00:{offset % 60:02d}", "url": "u", "offset": offset, "body": json.dumps({"total": {"count": total}, "results": results}), **more}) + "\n\n")


CASES = [
    (dict(bo_type=4), "unknown_bo_type"), (dict(team2=None), "null_team"), (dict(team2_score=None), "missing_score"), (dict(bo_type=2, team1_score=1, team2_score=1), "bo2_draw"), (dict(winner_team_id=None), "null_winner"), (dict(winner_team_id=9), "null_winner"),
    (dict(bo_type=1), "score_bo_mismatch"), (dict(team1_score=1), "score_bo_mismatch"), (dict(bo_type=5, team1_score=3, team2_score=1), None), (dict(bo_type=1, team1_score=1), None), (dict(winner_team_id=2), "score_bo_mismatch"), (dict(bo_type=7, team1=None), "unknown_bo_type"),
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("archive")
    rows = [match(i, **over) for i, (over, _) in enumerate(CASES)]
    chunk(d / "matches_0000.jsonl.gz", [(0, 12, rows[:6]), (6, 12, [match(6), match(7)])])
    chunk(d / "matches_0001.jsonl.gz", [(6, 12, rows[6:]), (12, 13, [match(0, slug="again", **CASES[0][0])])])
    return archive.parsed_matches(archive.archive_rows(archive.read_lines(spark, f"{d}/*.gz"))).cache(), archive.read_lines(spark, f"{d}/*.gz")


def test_reasons_and_last_fetch_wins(parsed):
    matches, lines = parsed
    got = {r.match_id: r for r in matches.collect()}
    assert {i: r.quarantine_reason for i, r in got.items()} == {i: why for i, (_, why) in enumerate(CASES)}
    assert got[0].slug == "again" and got[3].maps_score == "[true,true]"
    assert archive.verify(lines) == {"pages": 3, "rows": 13, "offsets_contiguous": True, "first_offset": 0, "last_offset": 12}
    assert {r.team_id: r.name for r in archive.teams(matches).collect()} == {1: "T1", 2: "T2"}


def test_view_promotes_what_the_score_proves(parsed):
    matches, _ = parsed
    flags = audit.promotions(matches)
    assert {(r.match_id, r.flag) for r in flags.collect()} == {(6, "inferred_multi_map"), (7, "forfeit_signature"), (10, "forfeit_signature")}
    ids = {r.match_id for r in quarantine.consumer_view(matches, flags).collect()}
    assert ids == {6, 8, 9} == {r.match_id for r in matches.where(quarantine.consumable()).collect()}
    with pytest.raises(ValueError):
        quarantine.consumer_view(matches, None)


def test_reconciliation(parsed):
    matches, _ = parsed
    ok, wrong = quarantine.reconcile(matches, 13, 13, True, 12)
    assert not ok and wrong == ["10 of 12 matches are quarantined"]
    assert len(quarantine.reconcile(matches, 12, 13, False, 11)[1]) == 4


@pytest.mark.parametrize("bad", [dict(start_date=None), dict(start_date="soon"), "drop"])
def test_contract_drift_fails(spark, tmp_path, bad):
    row = match(1)
    row.pop("stars") if bad == "drop" else row.update(bad)
    chunk(tmp_path / "matches_0000.jsonl.gz", [(0, 1, [row])])
    with pytest.raises(Exception, match="contract keys|start_date"):
        archive.parsed_matches(archive.archive_rows(archive.read_lines(spark, f"{tmp_path}/*.gz"))).collect()


def test_broken_pages_fail_and_gaps_show(spark, tmp_path):
    chunk(tmp_path / "matches_0000.jsonl.gz", [(0, 9, [match(1)]), (5, 9, [match(2)])])
    assert not archive.verify(archive.read_lines(spark, f"{tmp_path}/*.gz"))["offsets_contiguous"]
    with gzip.open(tmp_path / "matches_0001.jsonl.gz", "wt") as f:
        f.write(json.dumps({"fetched_at": "x", "url": "u", "offset": 9, "body": "{}"}) + "\n")
    with pytest.raises(Exception, match="lacks total"):
        archive.pages(archive.read_lines(spark, f"{tmp_path}/*.gz")).collect()


def test_snapshots(spark, tmp_path):
    path = tmp_path / "s.jsonl.gz"
    t = lambda i: {"id": i}
    with gzip.open(path, "wt") as f:
        for sid, offset, total, rows in (("b", 0, 3, [t(1), t(2)]), ("b", 2, 3, [t(3)]), ("a", 0, 2, [t(4), t(5)]), ("torn", 0, 4, [t(6)]), ("moved", 0, 2, [t(7)]), ("moved", 1, 3, [t(8)])):
            f.write(json.dumps({"snapshot_id": sid, "fetched_at": "x", "url": "u", "offset": offset, "body": json.dumps({"total": {"count": total}, "results": rows})}) + "\n")
    sid, rows = archive.latest_snapshot(archive.read_lines(spark, str(path)))
    assert sid == "a" and rows.count() == 2


#: A folder of this run's own; set before Spark starts, so that workers inherit it.
os.environ.setdefault("DUELFRAME_SERVICE", tempfile.mkdtemp(prefix="duelframe-service-"))
SERVICE = Path(os.environ["DUELFRAME_SERVICE"]) / "state.json"


def store(state):
    """Readers see the file before or after, never half of it."""
    aside = SERVICE.with_suffix(f".{os.getpid()}")
    aside.write_text(json.dumps(state))
    os.replace(aside, SERVICE)


def fetch(offset, limit):
    """A service that executors see too: its rows, failures to come and whether it grows are in a file."""
    state = json.loads(SERVICE.read_text())
    if state["fail"]:
        store(state | {"fail": state["fail"] - 1})
        raise OSError("down")
    n = state["n"] + (offset if state["grows"] else 0)  # later pages find more
    return json.dumps({"total": {"count": n}, "results": [{"id": i} for i in range(n)][offset : offset + limit]})


def service(n, fail=0, grows=False):
    store({"n": n, "fail": fail, "grows": grows})
    return {"fetch": f"{__name__}:fetch", "limit": 3}


def test_crawl_resumes_by_rows(spark, tmp_path):
    path = f"{tmp_path}/archive"
    assert paged.crawl(spark, service(7), path) == {"pages": 3, "rows": 7, "total": 7, "next_offset": 7}
    assert paged.crawl(spark, service(7), path)["pages"] == 0
    assert paged.crawl(spark, service(9), path) == {"pages": 1, "rows": 2, "total": 9, "next_offset": 9}
    lines = archive.read_lines(spark, path)
    assert archive.verify(lines) == {"pages": 4, "rows": 9, "offsets_contiguous": True, "first_offset": 0, "last_offset": 7}
    assert sorted(json.loads(r.match)["id"] for r in archive.archive_rows(lines).collect()) == list(range(9))
    with pytest.raises(ValueError, match="fell"):
        paged.crawl(spark, service(5), path)


def test_retries():
    waits = []
    service(4, fail=3)
    assert paged.page_of(paged.patient(lambda: fetch(0, 2), 5, waits.append))[0] == 4 and waits == [2.0, 4.0, 8.0]
    service(4, fail=9)
    with pytest.raises(OSError):
        paged.patient(lambda: fetch(0, 2), 2, waits.append)
    assert waits[3:] == [2.0]
    for body in ("<html>", "{}", "[]", '{"total": 3, "results": []}'):
        with pytest.raises(ValueError):
            paged.page_of(body)


def test_torn_snapshot_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/snapshots"
    with pytest.raises(ValueError, match="changed"):
        paged.snapshot(spark, service(9, grows=True), path, "s")
    assert not Path(path).exists() and paged.snapshot(spark, service(4), path, "t") == "t"
    sid, rows = archive.latest_snapshot(archive.read_lines(spark, path))
    assert sid == "t" and rows.count() == 4


def test_a_page_that_is_none_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="not a page"):
        paged.snapshot(spark, {"fetch": f"{__name__}:broken", "limit": 3}, f"{tmp_path}/snapshots", "s")
    assert not (tmp_path / "snapshots").exists()


def broken(offset, limit):
    return "<html>" if offset else json.dumps({"total": {"count": 5}, "results": [1, 2, 3]})


def listed(order):
    """Markets by volume or newest first; lists are JSON or texts of it."""
    market = lambda i, v, text=True: {"question": f"Cup: game {i}", "slug": f"m{i}", "outcomes": json.dumps(["A", "B"]) if text else ["A", "B"], "outcomePrices": json.dumps(["0.6", "0.5"]), "volumeNum": v, "liquidityNum": i, "endDate": "x"}
    own = [market(1, 5000), market(2, 3000, False), {"question": "else", "slug": "e"}] if order == "volume" else [market(9, None), {**market(2, 1), "outcomePrices": json.dumps(["0.1", "0.1"])}]
    return lambda offset, limit: json.dumps({"total": {"count": len(own)}, "results": own[offset : offset + limit]})


def by_volume(offset, limit):
    return listed("volume")(offset, limit)


def by_id(offset, limit):
    return listed("id")(offset, limit)


def test_two_passes_find_new_markets_and_keep_the_first_listing(spark):
    rows = paged.listed_markets(paged.listings(spark, [{"fetch": f"{__name__}:{f}", "limit": 2} for f in ("by_volume", "by_id")]))
    found = {r.slug: r for r in files.market_snapshot(rows, ["Cup"], "2026-01-01").collect()}
    assert set(found) == {"m1", "m2", "m9"} and found["m2"].volume == 3000 and found["m9"].volume == 0
    assert [round(p, 6) for p in found["m2"].prices] == [round(0.6 / 1.1, 6), round(0.5 / 1.1, 6)] and found["m1"].outcomes == found["m2"].outcomes == ["A", "B"]
    assert [(r.a, r.p) for r in files.anchor_rows(spark.createDataFrame(list(found.values())), {"a": "Alpha", "b": "Beta"}).orderBy("slug").collect()] == [("Alpha", 0.5455)] * 2


def test_references_are_numbered_by_file_and_place(spark, tmp_path):
    for name, n in (("x.json", 3), ("y.json", 2)):
        (tmp_path / name).write_text(json.dumps({"matches": [{"a": "A", "b": "B", "winner": "A", "start": str(i)} for i in range(n)]}))
    ids = lambda paths: {r.ref_id: r.start for r in files.references(spark, [str(tmp_path / p) for p in paths]).collect()}
    assert ids(["x.json", "y.json"]) == ids(["y.json", "x.json"]) and list(ids(["y.json"])) == ["y.json#000000000", "y.json#000000001"]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_full_audit(spark):
    cols = "match_id long, start_date string, end_date string, bo_type int, team1_id long, team2_id long, team1_score int, team2_score int, winner_team_id long, tier string, tournament_id long, quarantine_reason string"
    rows = [
        (1, "2026-01-01T10:00", None, 3, 1, 2, 2, 0, 1, "s", 5, None), (2, "2026-01-02T10:00", "2026-01-01T00:00", 3, 2, 1, 2, 1, 2, "s", 5, None), (3, "2026-01-03T10:00", None, 3, 3, 3, 2, 0, 3, "a", 6, None),
        (4, "2026-01-04T10:00", None, 3, 1, 3, -1, 0, 3, "a", 6, "score_bo_mismatch"), (5, "2026-01-05T10:00", None, 3, 2, 3, 2, 0, 2, "a", 6, None), (6, "2026-01-05T10:00", None, 3, 3, 2, 2, 0, 3, "a", 6, None),
    ]
    m = table(spark, rows, cols)
    tours = table(spark, [(5, "s"), (6, "b")], "tournament_id long, tier string")
    aliases = table(spark, [("A", 1), ("B", 2), ("C", 3)], "canonical string, team_id long")
    ref = table(spark, [(0, "A", "B", "A", "2026-01-01T09:00"), (1, "B", "A", "A", "2026-01-02T09:00"), (2, "A", "C", "C", "2026-01-09T00:00"), (3, "B", "C", "B", "2026-01-05T00:00")], "ref_id long, a string, b string, winner string, start string")
    csv = table(spark, [(0, "A", "B", "e"), (1, "A", "Z", "e"), (2, "C", "A", "e"), (3, "B", "C", "e")], "row_id long, winner string, loser string, event string")
    got = audit.run_audit(m, tours, aliases, ref, csv, "2026-01-01")
    assert not got.ok and got.counts == {"csv_ambiguous": 2, "csv_match_quarantined": 1, "date_order": 1, "duplicate_pairing": 2, "forfeit_signature": 1, "negative_score": 1, "orientation_mismatch": 1, "reference_ambiguous": 1, "reference_missing": 1, "self_play": 1, "tier_divergence": 1}
    coverage = {r.name: (r.expected, r.found) for r in audit.reference_check(m, ref, aliases)[1].collect()}
    assert coverage == {"A": (3, 2), "B": (3, 3), "C": (2, 1)}
    assert {r.outcome: r.n for r in audit.csv_check(m, csv, aliases, "2026-01-02")[1].collect()} == {"mismatch": 1, "unresolvable": 1, "quarantined": 1, "ambiguous": 1}
    with pytest.raises(ValueError):
        audit.run_audit(m, tours, aliases, None, None, "2026-01-01")
    assert audit.run_audit(m, tours.limit(0), aliases, None, None, "2026-01-01", partial=True).counts["tier_check_vacuous"] == 1
    with pytest.raises(Exception, match="no alias"):
        audit.reference_check(m, ref, aliases.where("canonical <> 'A'"))[0].collect()
