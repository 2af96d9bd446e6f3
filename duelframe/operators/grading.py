"""Grading of forecasts: match and team rows, manifests, summaries, walk-forward pairs, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import student
from ..functions.numeric import paired, t_quantile
from ..functions.scoring import brier, log_loss, win_prob

# The replay inputs that each way of reconstruction depends on.
NEEDED = {
    "backfill_reconstructed": ("code_sha", "ratings_sha", "anchors_sha"),
    "forecast_manifest": ("code_sha", "ratings_sha", "anchors_sha", "pair_overrides_sha"),
    "immutable_forecast": ("code_sha",),
}


def resolved(v: Column) -> Column:
    """A hash that was pinned: there, not empty, no placeholder."""
    return F.coalesce((v != "") & (v != "unknown") & ~v.startswith("pending"), F.lit(False))


def manifested(provenance: Column | str) -> Column:
    """Whether a row's probability can be replayed, by its provenance: a map of texts (code_dirty as 'false')."""
    p = F.col(provenance) if isinstance(provenance, str) else provenance
    get = lambda k: F.try_element_at(p, F.lit(k))
    mode = F.lit(False)
    for name, keys in NEEDED.items():
        whole = get("reconstruction_mode") == name
        for k in keys:
            whole = whole & resolved(get(k))
        mode = mode | whole
    hashes = F.map_values(F.map_filter(p, lambda k, _: k.endswith("_sha")))
    return F.coalesce((get("code_dirty") == "false") & mode & F.forall(hashes, resolved), F.lit(False))


def grade_matches(rows: DataFrame, provenance: str | None = "provenance") -> DataFrame:
    """rows (a, winner, model_prob, close_prob, close_flagged, ...) with results, scores and eligibility."""
    y = F.when(F.col("winner") == F.col("a"), 1.0).otherwise(0.0)
    out = rows.withColumn("result", y).withColumns({
        "brier_model": brier("model_prob", "result"), "log_model": log_loss("model_prob", "result"),
        "brier_market": brier("close_prob", "result"), "log_market": F.when(F.col("close_prob").isNotNull(), log_loss("close_prob", "result")),
        "manifested": manifested(provenance) if provenance else F.lit(False),
    })
    eligible = F.col("close_prob").isNotNull() & ~F.coalesce("close_flagged", F.lit(False)) & F.col("manifested")
    return out.withColumns({"delta_brier": F.col("brier_market") - F.col("brier_model"), "delta_log": F.col("log_market") - F.col("log_model"), "adoption_eligible": eligible})


def forecast_rows(results: DataFrame, overrides: DataFrame, ratings: DataFrame, closes: DataFrame) -> DataFrame:
    """What grade_matches grades: results (match_key, a, b, winner, ...) with market_prob, model_prob, close_prob and close_flagged.

    overrides: a, b, p, each pair once, either way round; a price stands before the ratings
    (team, rating). closes: match_key, p_a, flagged. A side without price and rating fails the query.
    """
    both = overrides.select("a", "b", F.col("p").alias("market_prob")).unionByName(overrides.select(F.col("b").alias("a"), F.col("a").alias("b"), (1 - F.col("p")).alias("market_prob"))).dropDuplicates(["a", "b"])
    rated = lambda side: ratings.select(F.col("team").alias(side), F.col("rating").alias(f"__{side}"))
    close = closes.select("match_key", F.col("p_a").alias("close_prob"), F.col("flagged").alias("close_flagged"))
    rows = results.join(both, ["a", "b"], "left").join(rated("a"), "a", "left").join(rated("b"), "b", "left").join(close, "match_key", "left")
    model = F.coalesce("market_prob", win_prob("__a", "__b"), F.raise_error(F.concat(F.lit("no price and no rating for "), F.col("a"), F.lit(" and "), F.col("b"))).cast("double"))
    return rows.select(*results.columns, "market_prob", model.alias("model_prob"), "close_prob", "close_flagged")


def team_rows(table: DataFrame, results: DataFrame) -> DataFrame:
    """What grade_teams grades: a forecast table (team, p30, padv, p03, ...) with each team's wins and losses; a team without a result fails the query."""
    held = table.join(results.select("team", "wins", "losses"), "team", "left")
    known = F.when(F.col("wins").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no result for "), F.col("team"))).cast("boolean"))
    return held.where(known)


def differences(new: DataFrame, committed: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, field, found, committed (as text): where two logs do not agree exactly; a missing row differs in field 'row'."""
    side = lambda df, tag: df.select(*keys, F.struct(*fields).alias(tag))
    both = side(new, "__n").join(side(committed, "__c"), list(keys), "full")
    lone = F.struct(F.lit("row").alias("field"), F.when(F.col("__n").isNotNull(), "there").alias("found"), F.when(F.col("__c").isNotNull(), "there").alias("committed"))
    each = [F.when(~F.col(f"__n.{f}").eqNullSafe(F.col(f"__c.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"__n.{f}").cast("string").alias("found"), F.col(f"__c.{f}").cast("string").alias("committed"))) for f in fields]
    alone = F.col("__n").isNull() | F.col("__c").isNull()
    found = F.when(alone, F.array(lone)).otherwise(F.array_compact(F.array(*each)))
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


def regrade(results: DataFrame, overrides: DataFrame, ratings: DataFrame, closes: DataFrame, committed: DataFrame, provenance: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Grades from a snapshot's inputs under its provenance, and where they differ from the committed log (a, b and the graded fields)."""
    stamped = forecast_rows(results, overrides, ratings, closes).withColumn("provenance", F.create_map(*(F.lit(x) for kv in provenance.items() for x in kv)))
    graded = grade_matches(stamped)
    return graded, differences(graded, committed, ["a", "b"], ["model_prob", "result", "brier_model", "log_model"])


def grade_teams(rows: DataFrame) -> DataFrame:
    """rows (wins, losses, p30, padv, p03) with the Brier score of each category."""
    w, x = F.col("wins"), F.col("losses")
    hit = {"p30": (w == 3) & (x == 0), "padv": (w == 3) & x.isin(1, 2), "p03": (w == 0) & (x == 3)}
    return rows.withColumns({f"{c}_brier": brier(c, h.cast("double")) for c, h in hit.items()})


def summarize(graded: DataFrame, include_flagged: bool = False, require_manifest: bool = True) -> DataFrame:
    """One row: counts and mean scores of the match rows that have a close."""
    closed = graded.where("close_prob IS NOT NULL")
    flagged = F.coalesce("close_flagged", F.lit(False))
    good = F.coalesce("manifested", F.lit(False))
    used = (F.lit(True) if include_flagged else ~flagged) & (good if require_manifest else F.lit(True))
    mean = lambda c: F.avg(F.when(used, F.col(c)))
    out = closed.agg(
        F.count_if(used).alias("n"), F.count_if("adoption_eligible").alias("eligible_n"), F.count_if(flagged).alias("excluded_flagged_n"), F.count_if(~flagged & ~good).alias("excluded_unmanifested_n"),
        *(mean(f"{s}_{side}").alias(f"{side}_{s}") for side in ("model", "market") for s in ("brier", "log")),
    )
    return out.withColumns({f"delta_{s}": F.col(f"market_{s}") - F.col(f"model_{s}") for s in ("brier", "log")})


def walk_forward(matches: DataFrame, candidate: DataFrame, incumbent: DataFrame, observed: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Paired grades of the events' matches, and those skipped with a reason.

    matches: event_id, match_id, sides, winner. candidate, incumbent: event_id, team, rating.
    observed: event_id, team, n; a match needs least of each side.
    """
    rows = matches
    for side in ("team1_id", "team2_id"):
        for df, value, name in ((candidate, "rating", "cand"), (incumbent, "rating", "inc"), (observed, "n", "n")):
            rows = rows.join(df.select("event_id", F.col("team").alias(side), F.col(value).alias(f"{name}_{side}")), ["event_id", side], "left")
    few = lambda side: F.coalesce(F.col(f"n_{side}"), F.lit(0)) < least
    thin = F.concat_ws(",", *(F.when(few(s), F.col(s).cast("string")) for s in ("team1_id", "team2_id")))
    side = F.col("winner_team_id").eqNullSafe(F.col("team1_id")) | F.col("winner_team_id").eqNullSafe(F.col("team2_id"))
    reason = F.when(thin != "", F.concat(F.lit("below_min_obs:"), thin)).when(~side, F.concat(F.lit("winner_not_a_side:"), F.coalesce(F.col("winner_team_id").cast("string"), F.lit("none"))))
    rows = rows.withColumn("reason", reason)
    graded = rows.where("reason IS NULL").withColumn("result", F.when(F.col("winner_team_id") == F.col("team1_id"), 1.0).otherwise(0.0))
    graded = graded.withColumns({f"p_{t}": win_prob(f"{t}_team1_id", f"{t}_team2_id") for t in ("cand", "inc")})
    graded = graded.withColumns({f"{n}_{t}": f(f"p_{t}", "result") for t in ("cand", "inc") for n, f in (("brier", brier), ("log", log_loss))})
    graded = graded.withColumns({f"delta_{n}": F.col(f"{n}_cand") - F.col(f"{n}_inc") for n in ("brier", "log")})
    return graded.drop("reason", *(f"{t}_{s}" for t in ("cand", "inc", "n") for s in ("team1_id", "team2_id"))), rows.where("reason IS NOT NULL").select("event_id", "match_id", "reason")


def event_summaries(graded: DataFrame, skipped: DataFrame, floor: float = 0.5) -> DataFrame:
    """event_id, n_graded, n_skipped, coverage, excluded (below the floor), mean deltas."""
    own = graded.groupBy("event_id").agg(F.count("*").alias("g"), F.avg("delta_brier").alias("mean_delta_brier"), F.avg("delta_log").alias("mean_delta_log"))
    rest = skipped.groupBy("event_id").agg(F.count("*").alias("s"))
    both = own.join(rest, "event_id", "full").select("event_id", F.coalesce("g", F.lit(0)).alias("n_graded"), F.coalesce("s", F.lit(0)).alias("n_skipped"), "mean_delta_brier", "mean_delta_log")
    coverage = F.col("n_graded") / (F.col("n_graded") + F.col("n_skipped"))
    return both.withColumn("coverage", coverage).withColumn("excluded", coverage < floor)


def paired_events(deltas: Sequence[float], level: float = 0.95) -> dict[str, Any]:
    """Mean, error and t interval of events' mean deltas; the event is the unit."""
    if len(deltas) < 2:
        raise ValueError(f"paired statistics need two events, got {len(deltas)}")
    mean, se = paired(deltas, [0.0] * len(deltas))
    t = t_quantile(0.5 + level / 2, len(deltas) - 1)
    return {"n_events": len(deltas), "mean": mean, "se": se, "t_crit": t, "ci": [mean - t * se, mean + t * se]}


def paired_families(events: DataFrame, keys: Sequence[str], delta: str = "mean_delta_brier", level: float = 0.95) -> DataFrame:
    """keys, n_events, mean, se, t_crit, ci_low, ci_high of the events' mean deltas, a row for each family; the event is the unit.

    Events without a delta do not count. A family of one event has no error and interval.
    """
    own = events.where(F.col(delta).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_events"), F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("__sd"))
    se = F.col("__sd") / F.sqrt(F.col("n_events").cast("double"))
    # The fold runs once for each different number of events, not for each use.
    crit = own.select("n_events").distinct().select(F.col("n_events"), student.t_quantile(0.5 + level / 2, F.col("n_events") - 1).alias("t_crit"))
    out = own.withColumn("se", se).join(crit, "n_events")
    half = F.col("t_crit") * F.col("se")
    return out.select(*keys, "n_events", "mean", "se", "t_crit", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def verdicts(families: DataFrame, mde: float, min_events: int, objective_ok: Column | bool = True, split: Column | str = "dev") -> DataFrame:
    """paired_families with the verdict that verdict() gives each."""
    good = objective_ok if isinstance(objective_ok, Column) else F.lit(objective_ok)
    part = split if isinstance(split, Column) else F.lit(split)
    proven = (F.col("ci_high") < 0) & (F.abs("mean") >= mde)
    name = (
        F.when(F.col("n_events") < min_events, "BLOCKED")
        .when(proven, F.when(~good, "INCONCLUSIVE").when(part == "dev", "DEV-SCREENED").otherwise("ADOPTED"))
        .when(F.col("ci_low") > 0, "REJECT")
        .otherwise("INCONCLUSIVE")
    )
    return families.withColumn("verdict", name)


def evidence(graded: DataFrame, baselines: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, who, n, brier, log: mean scores of candidate, incumbent and constant forecasts over the same rows, in one pass."""
    sides = {"candidate": (F.col("brier_cand"), F.col("log_cand")), "incumbent": (F.col("brier_inc"), F.col("log_inc"))}
    sides |= {name: (brier(F.lit(p), "result"), log_loss(F.lit(p), "result")) for name, p in baselines.items()}
    means = F.array(*(F.struct(F.lit(who).alias("who"), F.count("*").alias("n"), F.avg(b).alias("brier"), F.avg(x).alias("log")) for who, (b, x) in sides.items()))
    return graded.groupBy(*keys).agg(means.alias("__e")).select(*keys, F.explode("__e").alias("__e")).select(*keys, "__e.*")


def nominees(screened: DataFrame, family: Sequence[str], variant: str) -> DataFrame:
    """Of each family's DEV-SCREENED variants the one with the best mean; of equal means the first by name."""
    own = screened.where("verdict = 'DEV-SCREENED'")
    return own.groupBy(*family).agg(F.min_by(F.struct(variant, "mean"), F.struct("mean", variant)).alias("__b")).select(*family, "__b.*")


def verdict(stats: dict[str, Any], mde: float, min_events: int, objective_ok: bool = True, split: str = "dev") -> str:
    """What paired statistics allow: negative deltas are improvements, and both width and size have to show."""
    low, high = stats["ci"]
    if stats["n_events"] < min_events:
        return "BLOCKED"
    if high < 0 and abs(stats["mean"]) >= mde:
        return "INCONCLUSIVE" if not objective_ok else "DEV-SCREENED" if split == "dev" else "ADOPTED"
    return "REJECT" if low > 0 else "INCONCLUSIVE"


def nominee(results: Sequence[dict[str, Any]]) -> dict[str, Any] | None:
    """Of one family's screened variants the one with the best mean."""
    families = {r["sweep_family"] for r in results}
    if len(families) > 1:
        raise ValueError(f"a nominee belongs to one family, got {sorted(map(str, families))}")
    return min((r for r in results if r["verdict"] == "DEV-SCREENED"), key=lambda r: r["stats"]["mean"], default=None)
