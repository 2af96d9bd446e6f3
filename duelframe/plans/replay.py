"""Walk-forward replays: both configurations fitted on the window before each event, graded on the event.

Every step over matches is a DataFrame, and so is what is written of them; the driver sees
one row for each event.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import canonical_sha, has_placeholder, t_quantile
from ..functions.scoring import age_days
from ..operators import grading
from ..operators.events import assert_no_leakage, event_universe, expand_masks, inside_masks, numbered, participants, split, team_statistics_masks, unmasked, window_masks
from ..operators.grading import event_summaries, paired_events, verdict, walk_forward
from ..session import cut
from ..sources.files import EventConfig, write_run
from . import gates, slates, swiss
from .ratings import fit_events

VERSION = "1:walk-forward+paired-events"
BASELINES = {"constant-0.5": 0.5}


@dataclass
class Prepared:
    events: DataFrame
    own: DataFrame  # the events' matches
    fitted: DataFrame  # event_id, match_id, winner, loser, age_days, bo_type
    teams: DataFrame  # event_id, team, n, modal_tier, idle_days


def fingerprint(matches: DataFrame, meta: Mapping[str, str]) -> dict[str, Any]:
    """What identifies a substrate: the number and order-free digest of its rows, and the stamps that say what they mean."""
    row = F.xxhash64(*sorted(matches.columns))
    n, digest = matches.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    return {"rows": n, "digest": str(digest), **{k: meta.get(k) for k in ("parse_version", "archive_max_fetched_at", "tournaments_snapshot_id", "audit_version")}}


def prepare(matches: DataFrame, events: DataFrame, months: int, hops: int = 1) -> Prepared:
    """Windows, fit universes and what fits need, of consumer matches with start_ts.

    What is stored has a row for each match and word of events; rows for each match and event (fitted) are
    made where they are read.
    """
    # Each step stands on its own table: one plan of them all would be too deep to optimize.
    events = cut(events)
    bits = numbered(events)
    window = cut(window_masks(bits, matches.select("match_id", "team1_id", "team2_id", "winner_team_id", "bo_type", "tier", "start_ts"), months))
    own = matches.join(events.select("tournament_id", "boundary"), "tournament_id").withColumn("event_id", F.col("tournament_id"))
    masked = expand_masks(bits, participants(events, matches), window, hops)
    universe = unmasked(masked.select("word", "team", "mask"), bits)
    kept = cut(inside_masks(window, masked))
    rows = unmasked(kept, bits)
    first = F.col("winner_team_id") == F.col("team1_id")
    sided = F.when(first | (F.col("winner_team_id") == F.col("team2_id")), True).otherwise(F.raise_error(F.concat(F.lit("the winner is neither side of match "), F.col("match_id").cast("string"))).cast("boolean"))
    winner = F.when(first, F.col("team1_id")).otherwise(F.col("team2_id")).cast("string")
    loser = F.when(first, F.col("team2_id")).otherwise(F.col("team1_id")).cast("string")
    fitted = rows.where(sided).select("event_id", "match_id", winner.alias("winner"), loser.alias("loser"), age_days("start_ts", "boundary").alias("age_days"), "bo_type")
    known = team_statistics_masks(kept, bits).join(events.select(F.col("tournament_id").alias("event_id"), "boundary"), "event_id").withColumn("idle_days", age_days("last_start", "boundary"))
    teams = universe.select("event_id", "team").join(known, ["event_id", "team"], "left").select("event_id", F.col("team").cast("string").alias("team"), F.coalesce("n", F.lit(0)).alias("n"), "modal_tier", "idle_days")
    assert_no_leakage(unmasked(window.select("word", "mask", "start_ts"), bits), own)
    return Prepared(events, cut(own), fitted, cut(teams))


def replay(prepared: Prepared, configs: Mapping[str, dict], least: int, floor: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """graded, skipped, summaries and fits of configs 'cand' and 'inc'."""
    fits = cut(fit_events(prepared.fitted, prepared.teams, configs))
    sides = prepared.own.withColumns({s: F.col(s).cast("string") for s in ("team1_id", "team2_id", "winner_team_id")})
    by = {k: fits.where(F.col("config") == k) for k in ("cand", "inc")}
    graded, skipped = map(cut, walk_forward(sides, by["cand"], by["inc"], prepared.teams, least))
    return graded, skipped, cut(event_summaries(graded, skipped, floor)), fits


def evidence(graded: DataFrame, baselines: Mapping[str, str]) -> dict[str, Any]:
    """Mean scores of both configurations and of simple rules over the same rows."""
    for rule in baselines.values():
        if rule not in BASELINES:
            raise gates.GateError(f"unknown baseline rule {rule!r}")
    found = grading.evidence(graded, {name: BASELINES[rule] for name, rule in baselines.items()}).collect()  # a row for each forecast
    return {f"{r.who}_{what}": r[what] for r in found for what in ("brier", "log")}


def slate_check(spark, event: swiss.Event, candidate: Mapping[str, float], incumbent: Mapping[str, float], n: int, seed: int, level: float = 0.95, threshold: int = 5, judge: Mapping[str, float] | None = None, **search: int) -> dict[str, Any]:
    """Whether the slate that the candidate's ratings choose holds up under the judge's (the incumbent's, by default).

    Both slates meet the same simulations, paired by number; markets have no say.
    """
    sims = swiss.simulate(spark, event, {"cand": candidate, "inc": incumbent, "judge": judge or incumbent}, n, seed).cache()
    best = slates.optimize(sims.where("scenario <> 'judge'"), event, threshold, **search)
    if set(best) != {"cand", "inc"}:
        raise gates.GateError("no slate without overlaps; allow more teams to advance")
    masks = {k: slates.slate_masks(event, s) for k, s in best.items()}
    hit = {k: (sum((F.bit_count(F.col(c).bitwiseAND(F.lit(m))) for c, m in zip(("m30", "m03", "madv"), own, strict=True)), F.lit(0)) >= threshold).cast("int") for k, own in masks.items()}
    # Counts of the four ways that two slates can pass or fail are all that the statistics need.
    counts = {tuple(r)[:2]: r["n"] for r in sims.where("scenario = 'judge'").groupBy(hit["cand"].alias("c"), hit["inc"].alias("i")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    mean = sum((c - i) * v for (c, i), v in counts.items()) / total
    se = math.sqrt(sum((c - i - mean) ** 2 * v for (c, i), v in counts.items()) / (total - 1) / total) if total > 1 else 0.0
    half = t_quantile(0.5 + level / 2, total - 1) * se
    return {"objective_ok": mean >= 0 or mean + half >= 0, "mean": mean, "se": se, "ci": [mean - half, mean + half], "identical_slates": masks["cand"] == masks["inc"], "slates": {k: s._asdict() for k, s in best.items()}, "n_sims": n, "seed": seed}


def run(matches: DataFrame, meta: Mapping[str, str], candidate: dict, incumbent: dict, harness: dict, root: str | Path, split_name: str = "dev", limit: int | None = None, nominating: str | Path | None = None, code_dirty: bool | None = None, slate_events: Sequence[tuple[EventConfig, Mapping[str, int]]] = (), burn_log: str | Path | None = None, config_files: Sequence[str | Path] = ()) -> dict[str, Any]:
    """A gated replay with its folder: manifest, verdict, events, rows and failures.

    Any gate that fails blocks the verdict and leaves no metrics. A limited run is
    exploratory; a holdout run that graded anything is noted in the burn log, whatever came out.
    """
    spark = matches.sparkSession
    if split_name == "holdout" and limit is not None:
        raise gates.GateError("a holdout run can't be limited")
    rules, judged = harness["eligibility"], harness["verdict"]
    hops = {"1hop": 1, "2hop": 2}[harness["fit_universe"]["rule"]]
    every, excluded = event_universe(matches, rules["tiers"], rules["min_consumer_matches"])
    parts = split(every, harness["holdout_split"])
    chosen = parts.where(F.col("part") == split_name).drop("part").orderBy("tournament_id")
    chosen = (chosen.limit(limit) if limit is not None else chosen).cache()
    listed = [[r[0], str(r[1])] for r in chosen.select("tournament_id", "boundary").orderBy("tournament_id").collect()]  # a row for each event
    failures: list[dict] = [{"kind": "straddler_excluded", "tournament_id": r[0]} for r in parts.where("part = 'straddler'").select("tournament_id").collect()]
    failures += [{"kind": f"excluded_{r[1]}", "tournament_id": r[0]} for r in excluded.select("tournament_id", "reason").collect()]

    def tested() -> None:
        found = gates.self_test(harness["seeds"]["self_test"], judged["mde_brier"], judged["min_events"], judged["ci_level"])
        if not found["ok"]:
            raise gates.GateError(f"known answers came out as {found['verdicts']}")

    def enough(n: int) -> None:
        if n < judged["min_events"]:
            raise gates.GateError(f"{n} events, at least {judged['min_events']} are needed")

    checks = [(tested,), (gates.one_knob, candidate, incumbent), (gates.registered_against, candidate, incumbent), (gates.audited, meta), (enough, len(listed))]
    if split_name == "holdout":
        checks.insert(0, (gates.nominated, nominating, candidate, incumbent, harness))
    blocked = gates.passed(checks)

    kept = skipped = None
    n_rows = 0
    events: list[dict] = []
    stats, name, objective, proof = None, "BLOCKED", {"status": "not-run"}, {}
    if not blocked:
        prepared = prepare(matches, chosen, harness["window_months"], hops)
        graded, skipped, summaries, fits = replay(prepared, {"cand": candidate, "inc": incumbent}, harness["fit_universe"]["min_obs"], harness["coverage_floor"])
        events = [r.asDict() for r in summaries.orderBy("event_id").collect()]
        kept = cut(graded.join(summaries.where("NOT excluded").select("event_id"), "event_id", "left_semi"))
        failures += [{"kind": "excluded_event_coverage", "tournament_id": e["event_id"], "coverage": e["coverage"]} for e in events if e["excluded"]]
        deltas = [e["mean_delta_brier"] for e in events if not e["excluded"] and e["mean_delta_brier"] is not None]
        blocked = gates.passed([(enough, len(deltas))])
        if not blocked:
            stats = paired_events(deltas, judged["ci_level"])
            rated = {k: {r["team"]: r["rating"] for r in own.collect()} for k in ("cand", "inc") for own in [fits.where(F.col("config") == k).join(_of(slate_events, spark), "event_id", "left_semi")]} if slate_events else {}
            found = []
            for config, ids in slate_events:
                if config.tournament_id in [e[0] for e in listed]:
                    by = {k: {t: rated[k][str(ids[t])] for t in config.teams} for k in ("cand", "inc")}
                    found.append(slate_check(spark, swiss.Event(config.teams, config.round1, config.seeds), by["cand"], by["inc"], harness["mc"]["slate_sims"], harness["seeds"]["slate_sim"], judged["ci_level"], config.scoring["pass_threshold"]))
            objective = {"status": "computed" if found else "no-slate-events-computed", "events": found}
            name = verdict(stats, judged["mde_brier"], judged["min_events"], all(f["objective_ok"] for f in found), split_name)
            blocked = gates.passed([(gates.objective_known, name, bool(found))])
            n_rows = kept.count()
            proof = evidence(kept, {"uniform": "constant-0.5"})
    manifest = {
        "version": VERSION, "code_dirty": code_dirty, "substrate": fingerprint(matches, meta), "candidate_config_sha": canonical_sha(candidate), "incumbent_config_sha": canonical_sha(incumbent), "harness_config_sha": canonical_sha(harness),
        "sweep_family": candidate.get("sweep_family"), "split": split_name, "holdout_split": harness["holdout_split"], "event_set": listed, "event_set_sha": canonical_sha(listed), "limited": limit is not None, "seeds": harness["seeds"], "nominated_by": str(nominating) if nominating else None, "blocked_gates": blocked,
    }
    manifest["adoption_eligible"] = code_dirty is False and not blocked and limit is None and not has_placeholder([manifest, candidate, incumbent, harness])
    run_id = canonical_sha(manifest)[:16]
    result = {"run_id": run_id, "verdict": "BLOCKED" if blocked else "EXPLORATORY" if limit is not None else name, "would_be": None if blocked else name, "blocked_gates": blocked, "stats": None if blocked else stats, "evidence": {} if blocked else proof, "objective_check": objective, "split": split_name, "adoption_eligible": manifest["adoption_eligible"]}
    out = write_run(Path(root) / run_id, {"manifest": manifest, "verdict": result}, {"events": events, "failures": failures}, config_files)
    # What has a row for each match is written by Spark: rows and skipped are folders of JSON lines.
    for name, df in (("rows", kept if n_rows else None), ("skipped", skipped)):
        if df is not None:
            df.select(*sorted(df.columns)).repartitionByRange("event_id", "match_id").sortWithinPartitions("event_id", "match_id").write.mode("overwrite").json(str(out / name))
    if split_name == "holdout" and n_rows and burn_log:
        entry = {"date": datetime.now(timezone.utc).date().isoformat(), "run_id": run_id, "result": result["verdict"], "n_matches": n_rows, "event_set_sha": manifest["event_set_sha"]}
        with open(burn_log, "a", encoding="utf-8") as f:
            f.write(json.dumps(entry, sort_keys=True) + "\n")
    return result


def _of(slate_events: Sequence[tuple[EventConfig, Mapping[str, int]]], spark) -> DataFrame:
    return spark.createDataFrame([(c.tournament_id,) for c, _ in slate_events], "event_id long")
