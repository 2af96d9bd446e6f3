"""python -m duelframe COMMAND: the library's operations over files; each prints its result as JSON.

Paths are Spark's where tables are meant and local where small files are. Functions that fetch
pages are named as module:function, where executors can import them.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions import repository
from .operators import audit, grading
from .plans import bracket, live, posterior, ratings, replay, sensitivity, slates, swiss
from .session import scratch, session
from .sources import archive, files, paged, substrate

COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], Any], dict[str, dict]]] = {}
FILE, MANY, COUNT, NUMBER, FLAG = {"required": True}, {"nargs": "*", "default": []}, {"type": int}, {"type": float}, {"action": "store_true"}


def command(**options: dict):
    """Registers a function of the session and the options as a command of its name."""

    def add(fn):
        COMMANDS[fn.__name__.replace("_", "-")] = fn, options
        return fn

    return add


def _json(path: str) -> Any:
    return json.loads(Path(path).read_text())


def _event(path: str) -> swiss.Event:
    c = files.EventConfig.load(path)
    return swiss.Event(c.teams, c.round1, c.seeds)


def _rows(df: DataFrame) -> list[dict]:
    """A small result, of teams, slates or events."""
    return [r.asDict(recursive=True) for r in df.collect()]


@command(fetch=FILE, out=FILE, limit=COUNT | {"default": 50}, verify=FLAG)
def crawl(spark, a):
    """Archive what a service gained since the last crawl; with --verify only check the archive's chain."""
    if a.verify:
        return archive.verify(archive.read_lines(spark, a.out))
    return paged.crawl(spark, {"fetch": a.fetch, "limit": a.limit}, a.out)


@command(archive=FILE, aliases=FILE, root=FILE)
def parse(spark, a):
    """Build the parsed tables of an archive. aliases: a JSON file of names and ids."""
    known = spark.createDataFrame([(k, int(v), a.aliases) for k, v in _json(a.aliases).items()], "canonical string, team_id long, source string")
    return substrate.build(spark, archive.read_lines(spark, a.archive), known, a.root)


@command(fetch={"default": None}, archive=FILE, root=FILE, limit=COUNT | {"default": 50})
def tournaments(spark, a):
    """Put the newest whole snapshot of events into the last build, after fetching one where --fetch says how."""
    if a.fetch:
        paged.snapshot(spark, {"fetch": a.fetch, "limit": a.limit}, a.archive, datetime.now(timezone.utc).isoformat(timespec="seconds"))
    return substrate.add_tournaments(spark, a.root, archive.read_lines(spark, a.archive))


@command(root=FILE, references=MANY, results={"default": None}, since={"default": "1970-01-01"}, partial=FLAG)
def integrity_audit(spark, a):
    """Check the last build against results known from elsewhere and keep the flags; exit status 1 unless nothing failed."""
    own = substrate.load(spark, a.root)
    csv = files.numbered_results(spark, a.results) if a.results else None
    found = audit.run_audit(own.matches, own.tournaments, own.aliases, files.references(spark, a.references) if a.references else None, csv, a.since, a.partial)
    substrate.add_audit(spark, a.root, found)
    return {"ok": found.ok, "counts": found.counts}


@command(fetch=MANY, must_hold=MANY, aliases=FILE, log=FILE, out={"default": None}, limit=COUNT | {"default": 100})
def anchors(spark, a):
    """List markets (by volume, newest first: a --fetch for each), append them to the log, and write the anchors among them."""
    rows = paged.listed_markets(paged.listings(spark, [{"fetch": f, "limit": a.limit} for f in a.fetch]))
    snapshot = files.market_snapshot(rows, a.must_hold, datetime.now(timezone.utc).isoformat(timespec="seconds"))
    files.append_lines(snapshot, a.log)
    chosen = files.anchor_rows(snapshot, _json(a.aliases))
    return files.write_anchors(chosen, a.out) if a.out else _rows(chosen)


def _fit(spark: SparkSession, a: argparse.Namespace) -> tuple[list, dict[str, float], dict[str, float], ratings.Settings, list[dict]]:
    matches = files.fit_list(a.matches)
    priors = dict.fromkeys(sorted({t for w, x, _ in matches for t in (w, x)}), 1000.0)
    settings = ratings.Settings(a.sigma)
    return matches, priors, ratings.fit([m[0] for m in matches], [m[1] for m in matches], [m[2] for m in matches], priors, settings), settings, files.anchors(a.anchors) if a.anchors else []


FITS = {"matches": FILE, "anchors": {"default": None}, "sigma": NUMBER | {"default": 70.0}}


@command(**FITS, out={"default": None}, share=NUMBER | {"default": 0.5})
def fit(spark, a):
    """Ratings of results kept by hand, moved towards the market's lines."""
    _, _, own, _, lines = _fit(spark, a)
    found = dict(sorted(ratings.anchored(own, lines, a.share).items()))
    if a.out:
        Path(a.out).write_text(json.dumps(found, indent=2))
    return found


@command(**FITS)
def posterior_deviations(spark, a):
    """The ratings' posterior deviations."""
    matches, _, own, settings, _ = _fit(spark, a)
    pairs = spark.createDataFrame([(0, *m) for m in matches], "event long, winner string, loser string, weight double")
    rated = spark.createDataFrame([(0, t, r) for t, r in own.items()], "event long, team string, rating double")
    return {r.team: r.sd for r in posterior.deviations(posterior.hessian_entries(pairs, rated, settings.sigma, ["event"]), "event").collect()}


SIMS = {"event": FILE, "sims": COUNT | {"default": 40_000}, "seed": COUNT | {"default": 11}}


@command(**SIMS, ratings=FILE)
def optimize(spark, a):
    """The best slate of an event under ratings."""
    config = files.EventConfig.load(a.event)
    sims = swiss.simulate(spark, _event(a.event), {"base": _json(a.ratings)}, a.sims, a.seed)
    return {k: s._asdict() for k, s in slates.optimize(sims, _event(a.event), config.scoring["pass_threshold"]).items()}


@command(**SIMS, **FITS)
def sensitivity_ritual(spark, a):
    """Whether the best slate stays best when lines and weights move."""
    event = _event(a.event)
    results = [(r.winner, r.loser, r.weight, r.event) for r in files.fit_rows(spark, a.matches).collect()]  # kept by hand
    return _rows(sensitivity.ritual(spark, event, results, files.anchors(a.anchors) if a.anchors else [], dict.fromkeys(event.teams, 1000.0), ratings.Settings(a.sigma), a.sims, max(1, a.sims * 3 // 8), a.seed))


@command(seeds={"nargs": 8}, ratings=FILE, draws=COUNT | {"default": 200}, sd=NUMBER | {"default": 0.0})
def playoffs(spark, a):
    """Chances in a bracket of eight, and its best picks over draws of the ratings."""
    rated = _json(a.ratings)
    chances = bracket.reach(spark, a.seeds, bracket.branch_probs(a.seeds, bracket.bracket_prob(rated)))
    table = spark.range(a.draws if a.sd else 1).selectExpr("id AS draw", *(f"{float(rated[t])} + {float(a.sd)} * randn({i}) AS r{i}" for i, t in enumerate(a.seeds)))
    picks = bracket.rank_picks(table.selectExpr("draw", "map(" + ", ".join(f"'{t}', r{i}" for i, t in enumerate(a.seeds)) + ") AS ratings"), a.seeds)
    return {"reach": _rows(chances), "picks": _rows(picks.drop("values").where("place <= 12").orderBy("place"))}


@command(**SIMS, ratings=FILE, slate=FILE, completed=FILE, upcoming=FILE, log={"default": None})
def live_forecast(spark, a):
    """A slate's chances from where a stage stands, what each upcoming match would change, and a line for the log."""
    slate, done, due = slates.Slate(0.0, 0.0, *(tuple(_json(a.slate)[k]) for k in slates.NAMES)), *([tuple(m) for m in _json(p)] for p in (a.completed, a.upcoming))
    scores, stats = live.forecast(spark, _event(a.event), _json(a.ratings), slate, done, due, a.sims, a.seed)
    now = scores.where("scenario = 'now'").first()
    code = repository.state()
    manifest = live.forecast_manifest({"ratings": (a.ratings, _json(a.ratings))}, code["sha"], code["dirty"], a.sims, a.seed)
    teams = {r.team: {k: r[k] for k in ("p30", "padv", "p03")} for r in stats.collect()}
    entry = live.log_entry(datetime.now(timezone.utc).isoformat(timespec="seconds"), a.ratings, manifest["ratings_sha"], done, due, now.p_pass, now.expected, teams, _rows(live.rooting(scores, due)), manifest, live.match_forecasts(_json(a.ratings), due))
    if a.log:
        files.append_lines(spark.createDataFrame([(json.dumps(entry),)], "entry string"), a.log)
    return entry


@command(event=FILE, matches=FILE, out=FILE)
def make_results(spark, a):
    """The records of a finished stage from its matches [winner, loser]."""
    event = _event(a.event)
    state = swiss.State.of(event.teams, [tuple(m) for m in _json(a.matches)])
    records = {t: (state.wins[t], state.losses[t]) for t in event.teams}
    files.write_results(records, a.out, swiss.RECORDS)
    return records


@command(table=FILE, results=FILE, slate={"default": None}, pick={"nargs": 7, "default": None}, actual={"nargs": 7, "default": None})
def postmortem(spark, a):
    """Grades of a forecast table by team, of a slate and of a bracket pick, against what happened."""
    records = {t: tuple(r) for t, r in _json(a.results).items()}
    table = spark.createDataFrame([(t, *(float(v[k]) for k in ("p30", "padv", "p03"))) for t, v in _json(a.table).items()], "team string, p30 double, padv double, p03 double")
    given = spark.createDataFrame([(t, *r) for t, r in records.items()], "team string, wins int, losses int")
    out = {"teams": _rows(grading.grade_teams(grading.team_rows(table, given)).orderBy("team"))}
    if a.slate:
        out["ticks"] = live.slate_ticks(records, slates.Slate(0.0, 0.0, *(tuple(_json(a.slate)[k]) for k in slates.NAMES)))
    if a.pick and a.actual:
        out["bracket"] = live.bracket_grade(a.pick, a.actual)
    return out


GRADED = "a string, b string, close_prob double, close_flagged boolean, manifested boolean, adoption_eligible boolean, brier_model double, brier_market double, log_model double, log_market double"


@command(log=FILE, include_flagged=FLAG, all_rows=FLAG)
def calibration(spark, a):
    """Mean scores of a log of graded matches, the last line of each pair."""
    from pyspark.sql import functions as F

    from .operators.latest import last_per_key

    rows = last_per_key(files.json_lines(spark, a.log, GRADED), ["a", "b"], [F.col("ordinal")])
    return _rows(grading.summarize(rows, a.include_flagged, not a.all_rows))[0]


@command(root=FILE, replay=FILE, incumbent=FILE, harness=FILE, out=FILE, holdout=FLAG, nominee_from={"default": None}, limit=COUNT, burn_log={"default": None})
def harness(spark, a):
    """A gated walk-forward replay of a candidate's configuration; exit status 1 where it is blocked."""
    from pyspark.sql import functions as F

    own = substrate.load(spark, a.root)
    matches = own.consumed().withColumn("start_ts", F.to_timestamp("start_date"))
    dirty = repository.state()["dirty"]
    return replay.run(matches, own.meta, _json(a.replay), _json(a.incumbent), _json(a.harness), a.out, "holdout" if a.holdout else "dev", a.limit, a.nominee_from, dirty, burn_log=a.burn_log, config_files=[a.replay, a.incumbent, a.harness])


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m duelframe", description=__doc__)
    kinds = parser.add_subparsers(dest="command", required=True)
    for name, (fn, options) in COMMANDS.items():
        own = kinds.add_parser(name, help=fn.__doc__)
        for o, how in options.items():
            own.add_argument(f"--{o.replace('_', '-')}", **how)
    a = parser.parse_args(given)
    spark = spark or session()
    with scratch(spark):
        found = COMMANDS[a.command][0](spark, a)
    print(json.dumps(found, indent=2, default=str))
    return int(isinstance(found, dict) and (found.get("ok") is False or found.get("verdict") == "BLOCKED"))


if __name__ == "__main__":
    sys.exit(main())
